"""String, id and number functions as columns. Patterns use Java's (?iuU) so that case and word classes are Unicode-aware."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Lines that carry no content.
PAGE_NUMBER = r"^\s*\d{1,4}\s*$"
BOILERPLATE = [r"(?iu)^CỘNG\s+HÒA\s+XÃ\s+HỘI", r"(?iu)^Độc\s+lập\s*[-–]\s*Tự\s+do\s*[-–]\s*Hạnh\s+phúc"]

#: Operations by the first pattern that matches.
OPERATIONS = [
    ("THAY_THE_PHU_LUC", r"(?iu)thay\s+thế\s+(một\s+số\s+)?phụ\s+lục"),
    ("THAY_THE_TEXT", r"(?iu)thay\s+thế\s+(?:một\s+số\s+)?(?:từ|cụm\s+từ)"),
    ("BO_SUNG_TEXT", r"(?iu)bổ\s+sung\s+(?:từ|cụm\s+từ)"),
    ("BAI_BO_TEXT", r"(?iu)(bãi\s+bỏ|bỏ)\s+(?:từ|cụm\s+từ)"),
    ("BAI_BO", r"(?iu)bãi\s+bỏ"),
    ("THAY_THE", r"(?iu)thay\s+thế"),
    ("THEM_MOI", r"(?iu)thêm\s+mới"),
    ("BO_SUNG", r"(?iu)bổ\s+sung.{0,30}vào\s+sau"),
    ("SUA_DOI", r"(?iu)sửa\s+đổi"),
    ("BO_SUNG", r"(?iu)bổ\s+sung"),
]

#: Phrases of warnings and refusals.
WARNINGS = [
    "hết hiệu lực", "đã được sửa đổi", "được sửa đổi", "sửa đổi, bổ sung bởi", "thay thế bởi", "đã bị thay thế", "đã bị bãi bỏ", "bãi bỏ bởi", "chưa có hiệu lực", "lưu ý hiệu lực", "cảnh báo",
]
REFUSALS = [
    "không thuộc phạm vi", "ngoài phạm vi", "nằm ngoài phạm vi", "không điều chỉnh", "không áp dụng", "không có thẩm quyền", "không quy định xử phạt", "không bị phạt", "không có chế tài", "không xử phạt",
    "chưa có quy định xử phạt", "chỉ hỗ trợ", "chỉ giải đáp", "không hỗ trợ",
]

#: Amounts, points, months and dates in sentences.
FINE_RANGE = r"(?iu)(?:phạt\s+tiền\s+từ|từ)\s+([\d.,]+)\s*(triệu|tr|nghìn|k|đồng|đ)?\s*(?:đến|-)\s*([\d.,]+)\s*(triệu|tr|nghìn|k|đồng|đ)?"
FINE_SINGLE = r"(?iu)(?:phạt\s+tiền\s+mức|phạt\s+tiền|phạt)\s+([\d.,]+)\s*(triệu|tr|nghìn|k|đồng|đ)"
POINTS = r"(?iu)trừ\s*(?:điểm\s*giấy\s*phép\s*lái\s*xe|điểm\s*gplx|gplx)?\s*(\d+|mười\s*hai|mười|tám|sáu|bốn|hai)\s*điểm"
NO_POINTS = r"(?iu)không\s*(?:bị\s*)?trừ\s*điểm"
SUSPENSION = r"(?iu)tước\s*(?:quyền\s*sử\s*dụng\s*)?(?:GPLX|giấy\s*phép\s*lái\s*xe|bằng\s*lái(?:\s*xe)?)?\s*"
SUSPENSION_RANGE = SUSPENSION + r"(?:từ\s*)?(\d+)\s*(?:tháng\s*)?(?:đến|-)\s*(\d+)\s*tháng"
SUSPENSION_SINGLE = SUSPENSION + r"(\d+)\s*tháng"
POINT_WORDS = {"hai": 2, "bốn": 4, "sáu": 6, "tám": 8, "mười": 10, "mười hai": 12}
DATE = r"(?iu)ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})"
EFFECT_FROM = r"(?iu)(?:có|được)\s+hiệu\s+lực(?:\s+thi\s+hành)?\s+(?:từ|kể\s+từ)\s+" + DATE.removeprefix("(?iu)")
EFFECT_TO = r"(?iu)hết\s+hiệu\s+lực\s+(?:kể\s+từ|từ)\s+" + DATE.removeprefix("(?iu)")

#: Accented Latin letters and their base letters, made from the decomposition rule.
_ACCENTED = "".join(c for c in map(chr, range(0xC0, 0x1F00)) if len(unicodedata.normalize("NFD", c)) > 1 and unicodedata.normalize("NFD", c)[0].isascii())
_BASE = "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED)


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no built-in for it."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def normalise(text: Column, compose: bool = True) -> Column:
    """ST-01: NFC, blanks squeezed, at most one empty line, three repairs of straight quotes, trimmed."""
    text = nfc(text) if compose else text
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    text = F.regexp_replace(F.regexp_replace(text, r'^"(?=(?U:\w))', "“"), r'"(?=\n?\z)', "”")
    return F.regexp_replace(F.regexp_replace(text, r'"(?=[.,;:!?])', "”"), r"^(?U:\s)+|(?U:\s)+$", "")


def strip_accents(text: Column) -> Column:
    """Letters without their marks; combining marks that stand alone go too."""
    return F.regexp_replace(F.translate(text, _ACCENTED, _BASE), r"\p{Mn}", "")


def slug(text: Column) -> Column:
    """ST-05: lower case, đ as d, no accents, other runs as one underscore, trimmed of them."""
    return F.regexp_replace(F.regexp_replace(strip_accents(F.replace(F.lower(F.trim(text)), F.lit("đ"), F.lit("d"))), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def document_id(text: Column) -> Column:
    """ST-02, ST-03: canonical document id; null for an empty one."""
    t = F.replace(F.replace(F.replace(F.trim(text), F.lit("NĐ-CP"), F.lit("ND-CP")), F.lit("NĐCP"), F.lit("ND-CP")), F.lit("/"), F.lit("_"))
    t = F.regexp_replace(F.regexp_replace(strip_accents(t), r"[^A-Za-z0-9_-]+", "_"), "_+", "_")
    return F.nullif(F.regexp_replace(t, r"^_+|_+$", ""), F.lit(""))


def document_of_unit(unit: Column) -> Column:
    """ST-24: the part before ``_PL``, else before the first ``_D``."""
    return F.when(F.contains(unit, F.lit("_PL")), F.substring_index(unit, "_PL", 1)).otherwise(F.substring_index(unit, "_D", 1))


def external_label(unit: Column, document: Column) -> Column:
    """ST-25, SRC-07: (label, number) of an external id, read from its end: a point, else a clause, else an article, else the document."""
    rest = F.when(F.startswith(unit, document), F.regexp_replace(F.substr(unit, F.length(document) + 1, F.length(unit)), "^_+", "")).otherwise(unit)
    parts = F.reverse(F.split(rest, "_"))
    first = lambda pattern: F.get(F.filter(parts, lambda p: p.rlike(pattern)), F.lit(0))
    point, clause, article = first(r"^D(?!\d+$).+"), first(r"^K\d+$"), first(r"^D\d+$")
    label = F.when(point.isNotNull(), "Point").when(clause.isNotNull(), "Clause").when(article.isNotNull(), "Article").otherwise("Document")
    return F.struct(label.alias("label"), F.coalesce(F.substr(F.coalesce(point, clause, article), F.lit(2), F.lit(1000)), F.lit("")).alias("number"))


def provision_id(text: Column) -> Column:
    """ST-29: trimmed, upper case, Đ as D, - and / as _."""
    return F.translate(F.upper(F.trim(text)), "Đ-/", "D__")


def point_breaks(text: Column) -> Column:
    """ST-06: a line break before ``a)`` that follows a colon or semicolon."""
    return F.regexp_replace(text, r"(?<=[:;]\s)([a-zđ]\))", "\n$1")


def replacement_start(text: Column) -> Column:
    """ST-07, second rule: 0-based place of the quote after ``như sau:``, -1 if none."""
    return F.when(text.rlike(r'(?iu)như sau:\s*[“"]'), F.regexp_instr(text, F.lit(r'(?iu)(?<=như sau:\s{0,20})[“"]')) - 1).otherwise(-1)


def quoted(text: Column) -> Column:
    """ST-08: from the first opening quote to the last closing one, else what follows the first, else empty."""
    whole = F.regexp_extract(text, r'(?s)[“"](.*)[”"]', 1)
    return F.when(text.rlike(r'(?s)[“"].*[”"]'), whole).otherwise(F.regexp_extract(text, r'(?s)[“"](.*)', 1))


def operation(text: Column) -> Column:
    """ST-11: the first operation whose pattern occurs; null if none does."""
    out = F.when(text.rlike(OPERATIONS[0][1]), OPERATIONS[0][0])
    for label, pattern in OPERATIONS[1:]:
        out = out.when(text.rlike(pattern), label)
    return out


def mentions(text: Column, phrases: Sequence[str]) -> Column:
    """ST-30: whether any phrase occurs, whatever the case."""
    return F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(F.lower(text), p))


def squeeze_words(text: Column, cap: int = 30) -> Column:
    """WN-16: words without consecutive repeats (whatever the case), at most ``cap``."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    once = F.filter(words, lambda w, i: (i == 0) | (F.lower(w) != F.lower(F.get(words, i - 1))))
    return F.array_join(F.slice(once, 1, cap), " ")


def amount(number: Column, unit: Column) -> Column:
    """MA-01: đồng; triệu and tr are millions, nghìn and k thousands, a bare number below 1,000 millions."""
    value = F.try_to_number(F.nullif(F.regexp_replace(number, "[.,]", ""), F.lit("")), F.lit("999999999999999999")).cast("long")
    name = F.lower(F.coalesce(unit, F.lit("")))
    return F.when(name.isin("triệu", "tr"), value * 1_000_000).when(name.isin("nghìn", "k"), value * 1_000).when(value < 1_000, value * 1_000_000).otherwise(value)


def fine(text: Column) -> Column:
    """MA-02: (low, high) of a range, whose first amount inherits the second's unit, swapped if reversed; else of a single amount."""
    t = F.translate(text, "*_#", "   ")
    g = lambda p, k: F.nullif(F.regexp_extract(t, p, k), F.lit(""))
    a, b = amount(g(FINE_RANGE, 1), F.coalesce(g(FINE_RANGE, 2), g(FINE_RANGE, 4))), amount(g(FINE_RANGE, 3), g(FINE_RANGE, 4))
    one = amount(g(FINE_SINGLE, 1), g(FINE_SINGLE, 2))
    ranged = a.isNotNull() & b.isNotNull()
    return F.struct(F.when(ranged, F.least(a, b)).otherwise(one).alias("low"), F.when(ranged, F.greatest(a, b)).otherwise(one).alias("high"))


def points(text: Column) -> Column:
    """MA-03: points deducted; 0 if the text says none are."""
    raw = F.lower(F.nullif(F.regexp_extract(text, POINTS, 1), F.lit("")))
    words = F.create_map(*[x for k, v in POINT_WORDS.items() for x in (F.lit(k), F.lit(v))])
    return F.when(text.rlike(NO_POINTS), 0).when(raw.rlike(r"^\d+$"), F.expr("0") + raw.try_cast("int")).otherwise(F.try_element_at(words, raw))


def suspension(text: Column) -> Column:
    """MA-04: (low, high) months of a suspension."""
    g = lambda p, k: F.nullif(F.regexp_extract(text, p, k), F.lit("")).try_cast("int")
    one = g(SUSPENSION_SINGLE, 1)
    ranged = text.rlike(SUSPENSION_RANGE)
    return F.struct(F.when(ranged, g(SUSPENSION_RANGE, 1)).otherwise(one).alias("low"), F.when(ranged, g(SUSPENSION_RANGE, 2)).otherwise(one).alias("high"))


def date_in(text: Column, pattern: str = DATE) -> Column:
    """DT-01, DT-02: the first date of a sentence; null if none or impossible."""
    g = lambda k: F.regexp_extract(text, pattern, k)
    return F.when(text.rlike(pattern), F.try_to_date(F.concat_ws("-", g(3), F.lpad(g(2), 2, "0"), F.lpad(g(1), 2, "0"))))


def vnd(value: Column) -> Column:
    """MA-09: 1.234.567đ."""
    return F.concat(F.translate(F.format_number(value, 0), ",", "."), F.lit("đ"))


def masked(key: Column) -> Column:
    """ST-38: the first and last four characters of a key of more than eight."""
    return F.when(F.length(key) <= 8, F.lit("****")).otherwise(F.concat(F.substring(key, 1, 4), F.lit("..."), F.substring(key, -4, 4)))
