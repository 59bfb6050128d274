"""Operator 6, suffix-array deduplication by column-wise multi-document construction.

Every byte that a string of ``length`` bytes covers which also starts anywhere else (same document included) is removed.

1. *Anchors.* Each window of ``length`` bytes names the position of its smallest 32-byte gram hash (leftmost of ties). Equal windows name the same
   gram at the same place, so equal windows lie in the segments [anchor - (length - 32), anchor + length) of one gram.
   Anchors stand about every 185 bytes; only grams that occur twice or more go on.
2. *Classes.* Segments of one gram with the same bytes are one class. A class of two or more is repeated as a whole; its bytes aren't needed for
   that. Only grams with two or more different classes fetch one segment for each class.
3. *Construction.* The classes' segments, aligned at their anchors, are a collection of documents. From the last column to the first one,
   each round inserts one symbol per document: the symbols in the current order are the round's part of the collection's Burrows-Wheeler
   transform; a stable distribution by them gives the order of the suffixes one symbol longer, and the common prefixes of
   neighbours are updated by range minima. Columns are kept in a file that is read from its end to its start,
   so memory holds one order, one array of common prefixes and one column. As the segments are aligned, equal windows start in the
   same column, and suffixes of other columns needn't be merged; this is why long documents don't make more than
   2 * length - 32 rounds. A window is repeated when a neighbour shares ``length`` symbols or more.
4. *Removal.* Repeated windows of a segment all hold its anchor, so they cover one interval. Intervals go back to every segment of the class and are merged per document.

Skew: classes fold exact repeats before bytes are moved; classes join back by (gram, class), where Spark splits hot keys. A gram with more than
``max_classes`` different contexts isn't gathered in one task: its windows are counted by 128-bit hashes with map-side combining instead.

Files: classes and results are written by as many tasks as their rows and bytes need, however many partitions shuffles have. Hadoop's local file system
starts some six processes for each file, and each shares all of the JVM's memory until it runs its own program.

A class is compared by 128 bits, its gram's and its bytes' hashes, of which the latter mixes every eight bytes with their place (a polynomial modulo 2^64 can be made to take different segments of 256 bytes for one); a row is found again by 128 bits of its id and text. Defined results: a null or empty text has no bytes; texts shorter than ``length`` keep all; repeated rows
are copies of each other (and each get a row); a null doc_id is allowed; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import textbatch as tb
from .tables import cut, row_key, with_workers

LENGTH = 400
GRAM = 32
#: Bytes of text whose windows are looked at together; a byte takes some 100 bytes of memory then.
ANCHOR_BYTES = 1 << 20
#: Rows and bytes of text that a task writes, at least.
TASK_ROWS, TASK_BYTES = 1 << 16, 4 << 20
U64 = tb.U64


def tasks(rows: int, n_bytes: int = 0) -> int:
    """How many tasks write a table of so many rows and bytes of text."""
    return max(1, math.ceil(rows / TASK_ROWS), math.ceil(n_bytes / TASK_BYTES))


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in the slice that windows name, their gram hashes and texts."""
    n, reach = len(data), length - gram + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)
    prefix = tb.prefix_hash(data)
    starts = np.arange(n - gram + 1)
    grams = tb.mix((prefix[gram:] - prefix[: n - gram + 1]) * tb.powers(tb._INVERSE, n - gram + 1))
    key = (grams & U64(0xFFFFFFFF00000000)) | starts.astype(U64)
    # sliding minimum over ``reach`` positions by blocks: suffix minimum of one block, prefix minimum of the next
    blocks = -(-len(key) // reach)
    padded = np.full(blocks * reach, np.iinfo(U64).max, dtype=U64)
    padded[: len(key)] = key
    grid = padded.reshape(blocks, reach)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    least = np.minimum(backward[:windows], forward[reach - 1 : reach - 1 + windows])
    at = np.arange(windows)
    owner = np.searchsorted(offsets, at, side="right") - 1
    inside = at + length <= offsets[1:][owner]
    named = np.unique((least[inside] & U64(0xFFFFFFFF)).astype(np.int64))
    return named, grams[named], np.searchsorted(offsets, named, side="right") - 1


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in tb.slices(batch, "text", ANCHOR_BYTES):
                at, value, owner = anchors(data, offsets, length, gram)
                low, high = np.maximum(offsets[owner], at - (length - gram)), np.minimum(offsets[owner + 1], at + length)
                shape = (at - low).astype(U64) << U64(32) | (high - at).astype(U64)
                bytes_of = [tb.chunk_hash(data, low[i : i + 4096], high[i : i + 4096]) for i in range(0, len(at), 4096)]
                one = tb.mix(np.concatenate([np.zeros(0, U64), *bytes_of]) ^ shape)
                # neighbouring anchors of one class (periodic texts) are one row: their repeated windows cover one interval
                fresh = np.ones(len(at), dtype=bool)
                fresh[1:] = (owner[1:] != owner[:-1]) | (one[1:] != one[:-1]) | (value[1:] != value[:-1]) | (np.diff(at) > length)
                first_of = np.flatnonzero(fresh)
                n = np.diff(np.append(first_of, len(at)))
                last = at[first_of + n - 1] if len(at) else at
                at, low, high, value, one, owner = (x[first_of] for x in (at, low, high, value, one, owner))
                keys = rows.column(rows.schema.get_field_index("row_key")).take(pa.array(owner))
                columns = [keys, (at - offsets[owner]).astype(np.int32), (last - offsets[owner]).astype(np.int32), n.astype(np.int64), value.view(np.int64), one.view(np.int64), (low - at).astype(np.int16), (high - at).astype(np.int16)]
                yield pa.RecordBatch.from_arrays([columns[0], *map(pa.array, columns[1:])], names=["row_key", "pos", "last", "n", "gram", "c1", "low", "high"])

    return run


def _cut_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, wanted: list of segments) to one row per segment with its bytes."""
    for batch in batches:
        for rows, data, offsets in tb.slices(batch, "text"):
            wanted = rows.column(rows.schema.get_field_index("wanted"))
            flat = wanted.flatten()
            owner = np.repeat(np.arange(len(wanted)), np.asarray(wanted.value_lengths().fill_null(0)))
            pos, low, high = (np.asarray(flat.field(c)).astype(np.int64) for c in ("pos", "low", "high"))
            begin, end = offsets[owner] + pos + low, offsets[owner] + pos + high
            raw = data.tobytes()
            for i in range(0, len(begin), 20_000):
                part = slice(i, i + 20_000)
                cells = pa.array([raw[a:b] for a, b in zip(begin[part], end[part], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(flat.field(c).slice(i, 20_000) for c in ("gram", "c1", "low", "high")), cells], names=["gram", "c1", "low", "high", "segment"])


def repeated_windows(segments: list[bytes], low: np.ndarray, high: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Column-wise construction over aligned segments: per segment the first and last start (relative to its anchor) of a repeated window; first > last if none."""
    m, left = len(segments), length - gram
    first, last = np.full(m, 1 << 20, dtype=np.int64), np.full(m, -(1 << 20), dtype=np.int64)
    if m < 2:
        return first, last
    width = left + length
    lens = (high - low).astype(np.int64)
    with tempfile.TemporaryFile() as columns:
        matrix = np.zeros((m, width), dtype=np.uint8)
        for i in range(0, m, 512):  # the places take eight bytes a symbol, so by blocks
            flat, n = np.frombuffer(b"".join(segments[i : i + 512]), dtype=np.uint8), lens[i : i + 512]
            matrix[np.repeat(np.arange(i, i + len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n - left - low[i : i + 512], n)] = flat
        np.ascontiguousarray(matrix.T).tofile(columns)
        del matrix
        order = np.arange(m)
        common = np.zeros(m + 1, dtype=np.int32)  # common[i]: of order[i - 1] and order[i]; sentinels at both ends
        for column in range(width - 1, -1, -1):
            columns.seek(column * m)
            symbol = np.fromfile(columns, dtype=np.uint8, count=m).astype(np.uint16)
            symbol[(column < left + low) | (column >= left + high)] = 256  # beyond the document's ends
            transform = symbol[order]
            dealt = np.argsort(transform, kind="stable")
            sorted_symbol = transform[dealt]
            a, b = dealt[:-1] + 1, dealt[1:]
            same = sorted_symbol[1:] == sorted_symbol[:-1]
            fresh = np.zeros(m + 1, dtype=np.int32)
            near = same & (a == b)
            fresh[1:m][near] = common[b[near]] + 1
            far = np.flatnonzero(same & (a != b))
            if len(far):
                ends = np.empty(2 * len(far), dtype=np.int64)
                ends[0::2], ends[1::2] = a[far], b[far] + 1
                fresh[far + 1] = np.minimum.reduceat(common, ends)[0::2] + 1
            order, common = order[dealt], fresh
            if column <= left:
                start = column - left
                hit = order[np.maximum(common[:m], common[1:]) >= length]
                hit = hit[(start >= low[hit]) & (start + length <= high[hit])]
                first[hit] = np.minimum(first[hit], start)
                last[hit] = np.maximum(last[hit], start)
    return first, last


def _construct(length: int, gram: int, batch_size: int):
    """Rows sorted by gram within the task; a batch ends where a gram ends."""

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        low, high = (np.asarray(table.column(c)).astype(np.int64) for c in ("low", "high"))
        first, last = repeated_windows(table.column("segment").to_pylist(), low, high, length, gram)
        some = np.flatnonzero(first <= last)
        names = ["gram", "c1"]
        found = table.select(names).take(pa.array(some))
        return pa.RecordBatch.from_arrays([*(found.column(c).combine_chunks() for c in names), pa.array(first[some].astype(np.int32)), pa.array((last[some] + length).astype(np.int32))], names=["gram", "c1", "from", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < batch_size:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            grams = np.asarray(table.column("gram"))
            cutoff = int(np.flatnonzero(grams == grams[-1])[0])
            if cutoff:
                yield solve(table.slice(0, cutoff).to_batches())
            held = table.slice(cutoff).to_batches()
            n = len(grams) - cutoff
        if n:
            yield solve(held)

    return run


def placed_sums(data: np.ndarray, place: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Sums of the ``width`` bytes from each position on, mixed with their place, from 0. Spans of the same places have equal differences if their bytes are equal;
    as in ``chunk_hash``, the terms follow no algebraic rule of the bytes."""
    words = np.ndarray((len(data),), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,)) & U64((1 << 8 * width) - 1)
    sums = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(tb.mix(words ^ tb.mix(place.astype(U64) ^ U64(seed << 32))), out=sums[1:])
    return sums


def _window_hashes(length: int):
    """Each window of a segment: two 64-bit hashes and its start relative to the anchor. Windows of one start are compared."""
    width = min(8, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = batch.slice(i, 256)
                low = np.asarray(rows.column(rows.schema.get_field_index("low"))).astype(np.int64)
                cells = rows.column(rows.schema.get_field_index("segment")).to_pylist()
                size = np.array([len(x) for x in cells], dtype=np.int64)
                data = np.frombuffer(b"".join(cells), dtype=np.uint8)
                base = np.cumsum(size) - size
                count = np.maximum(size - length + 1, 0)
                owner = np.repeat(np.arange(len(cells)), count)
                step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                at = base[owner] + step
                place = np.arange(len(data)) - np.repeat(base - low, size)
                one, two = (tb.mix(sums[at + length - width + 1] - sums[at]) for sums in (placed_sums(data, place, width, seed) for seed in (1, 2)))
                picked = rows.take(pa.array(owner))
                start = (low[owner] + step).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(picked.column(picked.schema.get_field_index(c)) for c in ("gram", "c1")), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(start)], names=["gram", "c1", "w1", "w2", "start"])

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in tb.slices(batch, "text"):
            spans = rows.column(rows.schema.get_field_index("spans"))
            flat = spans.flatten()
            owner = np.repeat(np.arange(len(spans)), np.asarray(spans.value_lengths().fill_null(0)))
            cover = np.zeros(len(data) + 1, dtype=np.int32)
            np.add.at(cover, offsets[owner] + np.asarray(flat.field("from")), 1)
            np.subtract.at(cover, offsets[owner] + np.asarray(flat.field("to")), 1)
            gone = np.cumsum(cover[:-1]) > 0
            edge = np.zeros(len(data), dtype=bool)
            if len(data):
                edge[1:] = gone[1:] & ~gone[:-1]
                edge[0] = gone[0]
                begins = offsets[:-1][offsets[:-1] < len(data)]
                edge[begins] = gone[begins]
            kept = data[~gone]
            def per(mask: np.ndarray) -> np.ndarray:
                total = np.concatenate([[0], np.cumsum(mask)]).astype(np.int64)
                return total[offsets[1:]] - total[offsets[:-1]]
            removed, runs = per(gone), per(edge)
            size = np.diff(offsets)
            to = np.cumsum(size - removed)
            texts = [kept[b - k : b] for b, k in zip(to, size - removed, strict=True)]
            digest = [hashlib.sha256(x).hexdigest() for x in texts]
            ids = rows.column(rows.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x) for x in (size, removed, runs)), pa.array(digest, pa.string()), pa.array([x.tobytes() for x in texts], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, max_classes: int = 65_536, batch_size: int = 16_384) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes)."""
    with_workers(docs.sparkSession)
    rows = docs.select(row_key(docs[id_col], docs[text_col]).alias("row_key"), docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    seen = Observation()
    observed = rows.observe(seen, F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes"))
    places = cut(observed.select("row_key", "text").mapInArrow(_anchor_rows(length, gram), "row_key binary, pos int, last int, n long, gram long, c1 long, low smallint, high smallint"), "suffix-anchors")
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    classes = places.groupBy("gram", "c1").agg(F.sum("n").alias("n"), F.min(F.struct("row_key", "pos", "low", "high")).alias("rep"))
    by_gram = classes.groupBy("gram").agg(F.count("*").alias("kinds"), F.sum("n").alias("total")).where("total > 1")
    classes = cut(classes.join(by_gram, "gram").select("gram", "c1", "n", "kinds", "rep.*").coalesce(tasks(places.count())), "suffix-classes")
    whole = classes.where("n > 1").select("gram", "c1", F.col("low").cast("int").alias("from"), F.col("high").cast("int").alias("to"))

    wanted = classes.where("kinds > 1").groupBy("row_key").agg(F.collect_list(F.struct("pos", "gram", "c1", "low", "high")).alias("wanted"))
    # repeated rows share a key and fetch the same segment twice, rightly: it is repeated. The columns are those of the last join, so its exchange of texts serves both
    owners = rows.join(wanted, "row_key")
    shape = "gram long, c1 long, low smallint, high smallint, segment binary"
    segments = owners.select("row_key", "doc_id", "text", "wanted").mapInArrow(_cut_segments, shape)
    hot_grams = classes.where(F.col("kinds") > max_classes).select("gram").distinct()
    found = "gram long, c1 long, `from` int, `to` int"
    if hot_grams.limit(1).count():
        segments = cut(segments, "suffix-segments")
        hot = segments.join(hot_grams, "gram", "left_semi").mapInArrow(_window_hashes(length), "gram long, c1 long, w1 long, w2 long, start int")
        hot = cut(hot, "suffix-windows")
        same = ["gram", "start", "w1", "w2"]  # one window stands in the segments of several anchors, but once at a start of one gram
        twice = hot.groupBy(*same).agg(F.count("*").alias("n")).where("n > 1").select(*same)
        by_count = hot.join(twice, same, "left_semi").groupBy("gram", "c1").agg(F.min("start").alias("from"), (F.max("start") + length).alias("to"))
        segments = segments.join(hot_grams, "gram", "left_anti")
    else:
        by_count = None
    built = segments.repartition(n_parts, "gram").sortWithinPartitions("gram").mapInArrow(_construct(length, gram, batch_size), found)
    cover = whole.union(built) if by_count is None else whole.union(built).union(by_count)
    cover = cover.groupBy("gram", "c1").agg(F.min("from").alias("from"), F.max("to").alias("to"))

    spans = places.join(cover, ["gram", "c1"]).select("row_key", (F.col("pos") + F.col("from")).alias("from"), (F.col("last") + F.col("to")).alias("to")).distinct()
    spans = spans.groupBy("row_key").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    joined = rows.join(spans, "row_key", "left").select("row_key", "doc_id", "text", "spans")
    joined = joined.coalesce(tasks(seen.get["rows"], seen.get["bytes"] or 0))
    return joined.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
