"""Operator 7, quality rules: cross-document line frequency.

Lines are normalised (ASCII lower case, runs of white space as one space, trimmed) and hashed to 128 bits, two hashes of different seeds.
For each (host, line) the operator counts the *distinct documents* that hold it; exact copies of one text count once, so
that a text which was crawled many times isn't taken for boilerplate. Altered copies are documents of their own; folding
them is the work of the join (operator 4). A line is
boilerplate on a host when at least ``min_docs`` distinct documents hold it and these are at least ``max_share`` of the
host's distinct documents. Boilerplate lines are removed (:func:`without_boilerplate`); a document is rejected as depleted when fewer than
``min_words`` words or less than ``min_left`` of its words remain.

Skew: one host may hold a third of all rows and one line may stand in most of them. The counts are plain
hash aggregates keyed by (host, line) with map-side combining; no host or line is gathered in one task.
The limits need only the lines that pass ``min_docs``; that list is joined back by (host, line), where Spark can split the hot keys.

Defined results: a null or empty text has no words (all counts 0, ``base_failed`` true, ``kept`` false); a null host is a host of
its own; repeated rows each get a row; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .tables import cut, row_key, with_workers

WINDOW = 8
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[[ord(c) for c in SYMBOLS]] = 1
_STARTS_POINT = np.array([(b & 0xC0) != 0x80 for b in range(256)])

SCHEMA = "row_id long, row_key binary, doc_id long, host string, text_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<line:long,check:long,n:int,at:int>>"


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which entries of ``keys`` (two columns compared together) occur twice or more."""
    if not len(keys[0]):
        return np.zeros(0, bool)
    order = np.lexsort(keys[::-1])
    same = np.ones(len(order) - 1, dtype=bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    out = np.zeros(len(order), dtype=bool)
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    out[order] = twice
    return out


def repeat_words(words: np.ndarray, owner: np.ndarray, n_texts: int, window: int = WINDOW) -> np.ndarray:
    """Words per text that stand in a window of ``window`` words which occurs twice or more in that text."""
    value, text, first = tb.shingle_hash(words, owner, window)
    hit = first[_repeated((text, value))]
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(cover, hit, 1)
    np.subtract.at(cover, hit + window, 1)
    return np.bincount(owner, weights=np.cumsum(cover)[:-1] > 0, minlength=n_texts).astype(np.int64)


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text of every \\n-split line."""
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    owner = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, side="right") - 1])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    ends = np.empty(len(starts), dtype=np.int64)
    last = np.ones(len(starts), dtype=bool)
    last[:-1] = owner[1:] != owner[:-1]
    ends[:-1] = starts[1:] - 1
    ends[last] = offsets[1:][owner[last]]
    return starts, ends, owner


def features(data: np.ndarray, offsets: np.ndarray) -> dict:
    """The base counts of each text of a slice, and its normalised lines' hashes with their word counts."""
    n = len(offsets) - 1
    word_at, word_end, owner = tb.word_spans(data, offsets)
    words = tb.chunk_hash(data, word_at, word_end)
    low = tb.LOWER[data]
    n_words = np.bincount(owner, minlength=n).astype(np.int64)
    points = _sums(_STARTS_POINT[data], offsets) - _sums(tb.SPACE[data], offsets)

    at, end, line_owner = _lines(data, offsets)
    number = (np.arange(len(at)) - np.searchsorted(line_owner, line_owner)).astype(np.int32)  # of the line in its text, from 0
    first, last = np.searchsorted(word_at, at), np.searchsorted(word_at, end)
    some = last > first
    at, end, line_owner, first, last, number = at[some], end[some], line_owner[some], first[some], last[some], number[some]
    raw = tb.chunk_hash(data, at, end)
    order = np.lexsort((at, raw, line_owner))
    again = np.zeros(len(order), dtype=bool)
    again[1:] = (raw[order][1:] == raw[order][:-1]) & (line_owner[order][1:] == line_owner[order][:-1])
    n_dup = np.bincount(line_owner[order][again], minlength=n).astype(np.int64)

    # a normalised line is its sequence of lower-cased words: two hashes of the words, each mixed with its place in the line and added up, give 128 bits
    count = last - first
    place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    spread = []
    for seed in (1, 2):
        hashed = tb.chunk_hash(low, word_at, word_end, seed)
        total = np.zeros(len(place) + 1, dtype=tb.U64)
        np.cumsum(tb.mix(hashed[np.repeat(first, count) + place] ^ tb.mix(place.astype(tb.U64) + tb.U64(seed))), out=total[1:])
        stop = np.cumsum(count)
        spread.append(tb.mix((total[stop] - total[stop - count]) + count.astype(tb.U64)).view(np.int64))
    return {
        "n_words": n_words, "word_chars": points, "n_symbols": _sums(_SYMBOL[data], offsets), "n_dup_lines": n_dup,
        "n_repeat_words": repeat_words(words, owner, n), "key": tb.text_keys(data, offsets), "line_owner": line_owner, "line": spread[0], "check": spread[1], "line_words": (last - first).astype(np.int32), "line_number": number,
    }


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in tb.slices(batch, "text"):
            f = features(data, offsets)
            n = len(offsets) - 1
            cuts = np.searchsorted(f["line_owner"], np.arange(n + 1)).astype(np.int32)
            lines = pa.StructArray.from_arrays([pa.array(f["line"]), pa.array(f["check"]), pa.array(f["line_words"]), pa.array(f["line_number"])], names=["line", "check", "n", "at"])
            columns = [
                *[rows.column(rows.schema.get_field_index(c)) for c in ("row_id", "row_key", "doc_id", "host")],
                pa.array(f["key"].view(np.int64)), *[pa.array(f[k]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                pa.ListArray.from_arrays(pa.array(cuts), lines),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["row_id", "row_key", "doc_id", "host", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"])


def base_failed(min_words: int = 20, max_repeat_pct: int = 30) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = 30, max_share: float = 0.1, min_words: int = 10, min_left: float = 0.5) -> DataFrame:
    """Per row of ``docs``: doc_id, row_key, the base counts, base_failed, removed_lines (numbers of the boilerplate lines, from 0; null if none), n_removed_lines, n_words_left, depleted and kept."""
    with_workers(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), row_key(docs[id_col], docs[text_col], docs[host_col]).alias("row_key"), docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.coalesce(docs[host_col].cast("string"), F.lit("\x00null")).alias("host"))
    facts = cut(rows.mapInArrow(_rows, SCHEMA), "quality")
    lines = facts.select("row_id", "host", "text_key", F.explode("lines").alias("l")).select("row_id", "host", "text_key", "l.line", "l.check", "l.n", "l.at")
    # distinct documents per (host, line); a line that stands in fewer than min_docs rows can't pass, so the exact
    # distinct count is made for the few frequent lines only
    frequent = lines.groupBy("host", "line", "check").agg(F.count("*").alias("rows")).where(F.col("rows") >= min_docs).select("host", "line", "check")
    sizes = facts.select("host", "text_key").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    limits = (
        lines.join(frequent, ["host", "line", "check"], "left_semi").select("host", "line", "check", "text_key").distinct()
        .groupBy("host", "line", "check").agg(F.count("*").alias("docs"))
        .join(sizes, "host").where((F.col("docs") >= min_docs) & (F.col("docs") >= max_share * F.col("host_docs"))).select("host", "line", "check")
    )
    removed = lines.join(limits, ["host", "line", "check"], "left_semi").groupBy("row_id").agg(F.sum("n").cast("long").alias("gone"), F.count("*").alias("n_removed_lines"), F.collect_list("at").alias("removed_lines"))
    judged = facts.drop("lines", "host", "text_key").join(removed, "row_id", "left").withColumn("n_removed_lines", F.coalesce("n_removed_lines", F.lit(0)))
    judged = judged.withColumn("n_words_left", F.col("n_words") - F.coalesce("gone", F.lit(0))).withColumn("base_failed", base_failed())
    judged = judged.withColumn("depleted", (F.col("n_words_left") < min_words) | (F.col("n_words_left") < min_left * F.col("n_words")))
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted")).drop("gone", "row_id")


def _without_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, _, _ in tb.slices(batch, "text"):
            texts, gone = (rows.column(rows.schema.get_field_index(c)).to_pylist() for c in ("text", "removed_lines"))
            kept = []
            for text, numbers in zip(texts, gone, strict=True):
                left_out = set(numbers)
                kept.append("\n".join(line for k, line in enumerate(text.split("\n")) if k not in left_out))
            at = rows.schema.get_field_index("text")
            yield rows.set_column(at, "text", pa.array(kept, pa.string()))


def without_boilerplate(docs: DataFrame, judged: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` that ``judged`` (:func:`quality_rules` of the same rows) keeps, with the same columns, their boilerplate lines removed; ``chars_col`` follows a changed text.

    Texts without such lines pass unchanged, and only the others go through Python. Repeated rows share their verdict.
    """
    with_workers(docs.sparkSession)
    columns = docs.columns
    verdict = judged.where("kept").select(F.col("row_key").alias("judged_key"), "removed_lines").dropDuplicates(["judged_key"])
    # the row's other columns travel in one struct, so their names never meet those used here
    rows = docs.select(row_key(docs[id_col], docs[text_col], docs[host_col]).alias("own_key"), docs[text_col].alias("text"), F.struct(*[docs[c].alias(c) for c in columns if c != text_col]).alias("rest"))
    kept = rows.join(verdict, F.col("own_key") == F.col("judged_key"))
    dirty = kept.where("removed_lines is not null").select("removed_lines", "text", "rest")
    cleaned = dirty.mapInArrow(_without_lines, dirty.schema)
    plain = {text_col: F.col("text")}
    new = plain | ({chars_col: F.char_length("text").cast(docs.schema[chars_col].dataType)} if chars_col in columns else {})
    shaped = lambda df, own: df.select(*[own.get(c, F.col(f"rest.`{c}`")).alias(c) for c in columns])
    return shaped(kept.where("removed_lines is null"), plain).union(shaped(cleaned, new))
