"""Replies of text models as columns: lenient JSON, cleaned answers, grounding; and what a question asks for when no model is there."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .answers import point_lines

#: Tags that prompts use, a speaker's self-introduction, echoes before an answer.
TAGS = r"(?i)</?(?:can_cu_phap_ly|chi_dan_tu_van|evidence|instructions)>"
INTRODUCTION = r"(?iu)^(?:(?:Bạn|Tôi)\s+là\s+chuyên\s+viên\s+tư\s+vấn\s+pháp\s+luật\s+giao\s+thông\s+đường\s+bộ\s+Việt\s+Nam[.\s]*)+"
ECHO = r"(?iu)^(?:Trả\s+lời\s*:|Câu\s+trả\s+lời\s*:|Tư\s+vấn\s*:|CÂU\s+TRẢ\s+LỜI(?:\s+CĂN\s+CỨ\s+PHÁP\s+LUẬT)?\s*:)\s*"
HEADER = r"[ \t]*#{1,4}[ \t]+[^\n]"
#: What a block without sanctions is about, and how it says that there are none.
SANCTION_TOPICS = ["ghi chú", "hình thức xử phạt", "mức phạt", "trừ điểm"]
NO_SANCTION = ["không trực tiếp chế tài", "không quy định mức phạt", "không quy định hình thức xử phạt", "không có mức phạt"]
#: Words that show that an answer speaks of a group of road users.
ENTITY_WORDS = {
    "xe_o_to": ["ô tô", "o to", "xe con", "xe tải"], "xe_mo_to": ["mô tô", "mo to", "xe máy", "xe gắn máy"], "xe_may_chuyen_dung": ["chuyên dùng", "máy thi công", "xe lu", "máy ủi"],
    "xe_dap": ["xe đạp", "xe thô sơ"], "nguoi_di_bo": ["người đi bộ", "đi bộ"], "vat_nuoi": ["súc vật", "vật nuôi"],
}
#: Documents by the number that names them, questions about the system, words of amendments and of their direction.
DOCUMENTS = {
    "118": "118_2025_QH15", "151": "151_2024_ND-CP", "156": "156_2024_ND-CP", "160": "160_2024_ND-CP", "165": "165_2024_ND-CP", "168": "168_2024_ND-CP",
    "184": "184_2025_ND-CP", "236": "236_2026_ND-CP", "238": "238_2026_ND-CP", "35": "35_2024_QH15", "36": "36_2024_QH15", "72": "72_2024_TT-BCA",
}
META = [
    "bạn nắm rõ", "bạn biết", "bạn có", "hệ thống có", "danh mục luật", "danh mục nghị định", "các luật mà bạn", "các nghị định mà bạn", "những văn bản nào", "những luật nào",
    "những nghị định nào", "tài liệu nào", "văn bản mà bạn", "hệ thống gồm", "cơ sở dữ liệu của bạn", "giới thiệu hệ thống", "bạn được huấn luyện", "danh sách luật", "danh sách nghị định",
]
AMENDING = ["sửa đổi", "bổ sung", "bãi bỏ", "thay thế", "được sửa", "sửa bởi", "sua doi", "bo sung", "thay the"]
PASSIVE = ["trong", "của", "bị", "được"]
KIND = r"(?:nghị\s*định|nghidinh|nđ|nd|luật|luat)"
NUMBER = r"([0-9]{1,4}(?:/[0-9]{4}/[a-z0-9_-]+)?)"
AMENDED_BY = rf"(?:được|bi)\s+sửa\s*(?:đổi|bổ\s*sung)?\s*bởi\s+{KIND}?\s*{NUMBER}"
AMENDS = rf"{KIND}?\s*{NUMBER}\s+sửa\s*(?:đổi|bổ\s*sung)\s*(?:các\s*quy\s*định|các\s*điều\s*khoản|những\s*gì)?\s*(?:trong|cho|của)?\s*{KIND}?\s*{NUMBER}"

_EMPTY = "array<string>"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def _holds(text: Column, words) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def first_sections(text: Column) -> Column:
    """WN-17: a section whose header stood before (marks and case aside) goes, up to the next header."""
    sections = F.split(text, rf"\n(?={HEADER})")
    title = lambda s: F.when(s.rlike(rf"\A{HEADER}"), F.lower(_strip(F.regexp_replace(F.regexp_extract(s, r"\A[ \t]*#{1,4}[ \t]+([^\n]+)", 1), r"[*_#`]", ""))))
    titles = F.transform(sections, lambda s: F.coalesce(title(s), F.lit("\x00")))
    pairs = F.zip_with(sections, titles, lambda s, t: F.struct(s.alias("s"), t.alias("t")))
    kept = F.filter(pairs, lambda p, i: (p["t"] == "\x00") | (F.array_position(titles, p["t"]) == i + 1))
    return F.array_join(F.transform(kept, lambda p: p["s"]), "\n")


def without_sanction_notes(text: Column) -> Column:
    """Blocks that only say that there are no sanctions go, unless that would leave nothing."""
    blocks = F.filter(F.transform(F.split(text, r"\n\s*---\s*\n|\n(?=#{1,4}\s+)"), _strip), lambda b: b != "")
    says = lambda b: _holds(b, NO_SANCTION) | F.contains(b, F.lit("không quy định")) & _holds(b, ["phạt tiền", "trừ điểm"])
    kept = F.filter(blocks, lambda b: ~(_holds(F.lower(b), SANCTION_TOPICS) & says(F.lower(b))))
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n\n---\n\n")).otherwise(text)


def clean_answer(text: Column, has_sanctions: Column) -> Column:
    """ST-23: prompt tags, repeated sections, notes on missing sanctions, introductions, echoes and dividers go; points start their own lines. Null is empty."""
    out = first_sections(F.regexp_replace(F.coalesce(text, F.lit("")), TAGS, ""))
    out = F.when(has_sanctions, out).otherwise(without_sanction_notes(out))
    out = F.regexp_replace(_strip(F.regexp_replace(_strip(out), INTRODUCTION, "")), ECHO, "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?:\n\s*---\s*)+\z", ""), r"\n{3,}", "\n\n")
    return _strip(point_lines(out))


def ungrounded(answer: Column, question: Column, must_not: Column, keywords: Column, entities: Column, ids: Column, titles: Column, citations: Column) -> Column:
    """ST-32: array of (kind, value): ``drift`` for a forbidden term that neither question nor keywords hold, ``entity`` for a group of several that the answer leaves out, ``citation`` for an article that no evidence id or title names."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    none = F.array().cast(_EMPTY)
    some = lambda c: F.coalesce(c, none)
    lowered = lambda c: F.transform(some(c), F.lower)
    asked = lambda t: F.contains(F.lower(F.coalesce(question, F.lit(""))), t) | F.exists(lowered(keywords), lambda k: F.contains(k, t))
    drift = F.filter(some(must_not), lambda t: (t != "") & F.contains(low, F.lower(t)) & ~asked(F.lower(t)))
    words = F.create_map(*[x for k, v in ENTITY_WORDS.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    named = lambda e: F.coalesce(F.try_element_at(words, e), F.array(F.replace(e, F.lit("_"), F.lit(" "))))
    left_out = F.filter(some(entities), lambda e: ~F.exists(named(e), lambda w: F.contains(low, w)))
    article = lambda c: F.regexp_extract(F.lower(c), r"(?:điều|dieu)\s+(\d+)", 1)
    known = lambda n: F.exists(lowered(ids), lambda i: F.contains(F.concat(i, F.lit("_")), F.concat(F.lit("_d"), n, F.lit("_")))) | F.exists(lowered(titles), lambda t: F.contains(t, F.concat(F.lit("điều "), n)))
    unknown = F.filter(some(citations), lambda c: (article(c) != "") & ~known(article(c)))
    tagged = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    evidence = F.size(some(ids)) + F.size(some(titles)) > 0
    nothing = F.array().cast("array<struct<kind:string,value:string>>")
    found = F.concat(tagged("drift", drift), F.when(F.size(some(entities)) > 1, tagged("entity", left_out)).otherwise(nothing), F.when(evidence, tagged("citation", unknown)).otherwise(nothing))
    return F.when(low == "", nothing).otherwise(found)


def resolve_document(reference: Column) -> Column:
    """ST-36: the canonical id of a document reference: a known id, else the first known number in it, else its plain form; null if empty."""
    clean = F.trim(reference)
    number = F.regexp_extract(clean, rf"\b({'|'.join(DOCUMENTS)})\b", 1)
    known = F.create_map(*[F.lit(x) for pair in DOCUMENTS.items() for x in pair])
    return F.when(F.coalesce(clean, F.lit("")) == "", None).when(clean.isin(*DOCUMENTS.values()), clean).otherwise(F.coalesce(F.try_element_at(known, number), T.document_id(clean)))


def document_intent(question: Column) -> Column:
    """ST-33: struct of intent, source and target document: who amends whom, by the patterns "amended by", "amends", else by the order and number of the documents named."""
    low = F.lower(F.coalesce(question, F.lit("")))
    amending = _holds(low, AMENDING)
    part = lambda pattern, k: F.nullif(F.regexp_extract(low, pattern, k), F.lit(""))
    by, source, target = part(AMENDED_BY, 1), part(AMENDS, 1), part(AMENDS, 2)
    src0 = F.coalesce(resolve_document(by), resolve_document(source))
    dst0 = resolve_document(target)
    listed = F.regexp_extract_all(low, F.lit(rf"{KIND}\s*{NUMBER}"), F.lit(1))
    named = F.when(F.size(listed) > 0, listed).otherwise(F.regexp_extract_all(low, F.lit(rf"\b({'|'.join(DOCUMENTS)})\b"), F.lit(1)))
    ids = F.transform(named, resolve_document)
    n, first, second = F.size(named), F.get(ids, F.lit(0)), F.get(ids, F.lit(1))
    other = F.get(F.filter(ids, lambda d: d != src0), F.lit(0))
    alone = amending & (n == 1) & src0.isNull() & dst0.isNull()
    pair = amending & (n >= 2) & src0.isNull() & dst0.isNull()
    src = F.when(pair, first).when(alone & ~_holds(low, PASSIVE), first).otherwise(src0)
    dst = F.when(amending & (n >= 2) & src0.isNotNull(), F.coalesce(other, dst0)).when(pair, second).when(alone & _holds(low, PASSIVE), first).otherwise(dst0)
    meta = _holds(low, META)
    intent = F.when(meta, "system_meta_query").when(amending & (src.isNotNull() | dst.isNotNull() | F.contains(low, F.lit("điều khoản"))), "document_amendment").otherwise("violation_sanction")
    return F.struct(intent.alias("intent"), F.when(~meta, src).alias("source"), F.when(~meta, dst).alias("target"))


def reply_object(reply: Column) -> Column:
    """JS-04: the object in a model's reply as JSON text: without a code fence, from its first brace to its last, commas before closing brackets left out."""
    body = F.regexp_extract(F.regexp_replace(F.trim(F.coalesce(reply, F.lit(""))), r"(?s)^```(?:json)?\s*|\s*```$", ""), r"(?s)\{.*\}", 0)
    return F.regexp_replace(body, r",\s*([}\]])", "$1")


def reply_field(reply: Column, name: str) -> Column:
    """JS-04: a string of a reply, from its object, else, where that is broken, from the first place that looks like the field."""
    whole = F.get_json_object(reply_object(reply), f"$.{name}")
    loose = F.regexp_extract(F.coalesce(reply, F.lit("")), rf'"{name}"\s*:\s*"((?:[^"\\]|\\.)*)"', 1)
    return F.coalesce(whole, F.nullif(loose, F.lit("")))


def routing_decision(reply: Column, question: Column) -> Column:
    """LM-01's reply as (action, unit_id, query): a direct lookup only where the reply says so, else hybrid search for the question."""
    action = F.when(F.upper(F.coalesce(reply_field(reply, "action"), F.lit(""))) == "DIRECT_LOOKUP", "DIRECT_LOOKUP").otherwise("HYBRID_SEARCH")
    return F.struct(action.alias("action"), reply_field(reply, "unit_id").alias("unit_id"), F.coalesce(F.nullif(reply_field(reply, "query"), F.lit("")), question).alias("query"))


def rewritten(question: Column) -> Column:
    """LM-02 without a model: the question itself as its only variant, with its intent and documents."""
    found = document_intent(question)
    return F.struct(F.array(question).alias("variants"), found["intent"].alias("intent"), found["source"].alias("source"), found["target"].alias("target"))


def search_json(rewritten_query: Column) -> Column:
    """CD-37: the rewritten question as JSON."""
    return F.to_json(rewritten_query)
