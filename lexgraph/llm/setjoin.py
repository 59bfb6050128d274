"""Operator 4, n-gram Jaccard join by PartEnum signatures.

A document's set holds its distinct 5-word shingles. Two sets r, s link when 100 |r & s| >= 75 |r | s|; then
|r ^ s| <= (|r| + |s|) / 7, and their sizes lie in one size band or in neighbouring ones (bands grow by 4/3).

PartEnum: for each band i there is an instance for the sets of bands i and i + 1. It partitions the feature domain (shingle hashes) into n1
groups of three parts each and enumerates the subsets of two parts of every group; a set's signature for a subset is the set's projection on it. r ^ s touches at most d parts. A group with no touched part
has three signatures in common, one with a single touched part has one, others none, so at least 3 n1 - lost(d) are in common, where lost(d) = 2 d (d <= n1); n1 exceeds d by two at least, so ``REQUIRED`` are.
Not all 3 n1 signatures of a set need to be written: under one fixed total order of all signatures, the first lost(d) + 1 of each
set must meet (t common ones of n lie in the first n - t + 1). The order puts rare signatures first, measured by a counting sketch of all shingles of all documents,
and empty projections last. So boilerplate that a third of all documents share doesn't make signatures, unless a text holds little else.

Equal sets are one set from the start, so exact copies cost nothing further. A set is addressed by 64 bits; where two sets of the input share them (a second digest tells), that address is replaced by the second one for
both. Both digests are sums over the 64-bit hashes of the shingles, which are mixed from all bytes of their words. Sets that share a signature
are candidates. Each set emits ``REQUIRED`` - 1 signatures more than needed, so a linked pair shares at least ``REQUIRED`` of them:

* In groups of at most ``SMALL`` sets all pairs are counted, and a pair is compared when it shares enough signatures.
* In a larger group all members are compared with a hub, the member that shares most signatures with others. Then members outside of the
  group's largest component are compared with all of its members, in jobs of bounded blocks. Nothing is paired row by row, and no link is lost:
  a linked pair shares a signature of a large group, or enough of small ones.

Only the edges of a job's components are returned. Links are verified on the whole sets of 64-bit shingle hashes (two different shingles of
one comparison collide with probability below 1e-12).

Skew: a signature whose shingles are far more frequent than the average is dealt over several buckets by its sets' addresses; its members form one group again as rows of a table. Signatures travel as packed arrays per (slice of input, bucket); comparisons are dealt by (hub, block, chunk). Tables are joined
by set, where Spark splits hot keys.

Defined results: null, empty or word-less texts have an empty set (n_shingles 0), link with nothing and are their own component; repeated rows link with one another (equal
sets) and each get a row; a null doc_id takes part, but a component's id is its smallest non-null doc_id; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .components import components
from .tables import cut, row_key, with_workers

SHINGLE = 5
U64 = tb.U64
#: Counters of the sketch that orders signatures by rarity. A bound of memory; any order gives right results.
SKETCH_BITS = 18
SKETCH_SLICES = 16
#: Common signatures that a pair must have in small groups; the size up to which a group is small.
REQUIRED = 4
SMALL = 8
#: Members of a signature that one task should gather at most, beyond twice the mean of the sketch.
HOT = 50_000
#: Addresses that two sets may share; n texts share about n^2 / 2^65.
CLASHES = 1_000_000
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Left and right sets of one comparison job.
LEFT, RIGHT = 256, 4096
_LIMIT = 1 << 40


def band_starts() -> np.ndarray:
    """l_0 = 1, l_{i+1} = floor(4 l_i / 3) + 1."""
    out = [1]
    while out[-1] < _LIMIT:
        out.append(4 * out[-1] // 3 + 1)
    return np.array(out, dtype=np.int64)


BANDS = band_starts()


def groups_of(band: np.ndarray) -> np.ndarray:
    """n1: the number of groups of three parts of a band's instance: more than the largest difference of its sets, so that a third of the signatures, the most frequent ones, needn't be written."""
    top = BANDS[band + 2] - 1
    most = np.minimum(BANDS[band + 1] - 1 + top, 2 * top) // 7
    return most + 2


def lost(d: np.ndarray) -> np.ndarray:
    """The most signatures that ``d`` touched parts can change: each stands in two subsets of its group."""
    return 2 * d


def sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The texts' sets, flat: owner and shingle hash, sorted by both, distinct. Fewer than ``k`` words are one shingle."""
    lowered = tb.LOWER[data]
    starts, ends, owner = tb.word_spans(data, offsets)
    words = tb.chunk_hash(lowered, starts, ends)
    value, text, _ = tb.shingle_hash(words, owner, k)
    n_words = np.bincount(owner, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(n_words)[:-1]])
    for n in range(1, k):
        short = np.flatnonzero(n_words == n)
        if len(short):
            whole = np.full(len(short), n, dtype=U64)
            for j in range(n):
                whole = tb.mix(whole * U64(3) + words[first[short] + j])
            value, text = np.concatenate([value, whole]), np.concatenate([text, short])
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return text[new], value[new]


def _sizes(owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.bincount(owner, minlength=n).astype(np.int64)
    return size, np.concatenate([[0], np.cumsum(size)])


def set_ids(owner: np.ndarray, value: np.ndarray, n_docs: int, clash: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit address of each set, 0 of the empty set; sets whose address is in ``clash`` have their second digest."""
    sid = _digests(owner, value, n_docs, 0x5851F42D4C957F2D)
    if clash is not None and len(clash):
        again = np.isin(sid, clash)
        sid[again] = _digests(owner, value, n_docs, SECOND)[again]
    return sid


SECOND = 0xA24BAED4963EE407


def _digests(owner: np.ndarray, value: np.ndarray, n_docs: int, seed: int) -> np.ndarray:
    size, at = _sizes(owner, n_docs)
    total = np.zeros(len(value) + 1, dtype=U64)
    np.cumsum(tb.mix(value ^ U64(seed)), out=total[1:])
    return np.where(size > 0, tb.mix((total[at[1:]] - total[at[:-1]]) ^ tb.mix(size.astype(U64) + U64(seed))), U64(0))


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass 1: doc_id, row_key, size and address of each set; the task's part of the sketch as rows with a slice number."""
    counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    names = ["doc_id", "row_key", "n", "sid", "second", "slice", "counts"]
    for batch in batches:
        for rows, data, offsets in tb.slices(batch, "text"):
            ids, keys = (rows.column(rows.schema.get_field_index(c)) for c in ("doc_id", "row_key"))
            n = len(ids)
            owner, value = sets(data, offsets)
            counts += np.bincount((value >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
            yield pa.RecordBatch.from_arrays([ids, keys, pa.array(_sizes(owner, n)[0]), *(pa.array(x.view(np.int64)) for x in (set_ids(owner, value, n), _digests(owner, value, n, SECOND))), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
    small = np.minimum(counts, np.iinfo(np.uint32).max).astype(np.uint32).reshape(SKETCH_SLICES, -1)
    none = pa.nulls(SKETCH_SLICES, pa.int64())
    yield pa.RecordBatch.from_arrays([none, pa.nulls(SKETCH_SLICES, pa.binary()), none, none, none, pa.array(np.arange(SKETCH_SLICES, dtype=np.int32)), pa.array([x.tobytes() for x in small], pa.binary())], names=names)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the sketch rows of each slice within a task."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            row = np.frombuffer(x, dtype=np.uint32).astype(np.uint64)
            total[k] = total[k] + row if k in total else row
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(x, np.iinfo(np.uint32).max).astype(np.uint32).tobytes() for x in total.values()], pa.binary())], names=["slice", "counts"])


def signatures(owner: np.ndarray, value: np.ndarray, n_docs: int, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The signatures each set must emit: (owner, 64-bit signature, whether one in common suffices, count of its rarest shingle)."""
    size, at = _sizes(owner, n_docs)
    band = np.searchsorted(BANDS, size, side="right") - 1
    rarity = sketch[(value >> U64(64 - SKETCH_BITS)).astype(np.int64)]
    spread = tb.mix(value)  # its high bits choose the part; the sort order by value isn't kept
    order = np.lexsort((spread, owner))
    spread, rarity, owner_s = spread[order], rarity[order], owner[order]
    never = np.iinfo(np.int64).max
    out: list[tuple[np.ndarray, ...]] = []
    for upper in (False, True):
        inst = band - 1 if upper else band
        use = (size > 0) & (inst >= 0)
        low, high = BANDS[np.maximum(inst, 0)], BANDS[np.maximum(inst, 0) + 1]
        if upper:  # partners: smaller sets, of band inst
            use &= -(-3 * size // 4) <= high - 1
            d = (size + high - 1) // 7
        else:  # partners: sets of the same band and of the next
            d = (size + np.minimum(4 * size // 3, BANDS[np.maximum(inst, 0) + 2] - 1)) // 7
        n1 = groups_of(np.maximum(inst, 0))
        keep = use[owner_s]
        o, v, r = owner_s[keep], spread[keep], rarity[keep]
        if not len(o):
            continue
        part = (((v >> U64(32)) * (3 * n1[o]).astype(U64)) >> U64(32)).astype(np.int64)
        new = np.ones(len(o), dtype=bool)
        new[1:] = (o[1:] != o[:-1]) | (part[1:] != part[:-1])
        start = np.flatnonzero(new)
        total, rare, part, o = np.add.reduceat(tb.mix(v), start), np.minimum.reduceat(r, start), part[start], o[start]
        # a row per (set, group), a column per part of the group
        group, place = part // 3, part % 3
        new = np.ones(len(o), dtype=bool)
        new[1:] = (o[1:] != o[:-1]) | (group[1:] != group[:-1])
        row, first = np.cumsum(new) - 1, np.flatnonzero(new)
        sums, least = np.zeros((len(first), 3), dtype=U64), np.full((len(first), 3), never)
        sums[row, place], least[row, place] = total, rare
        ow, gr = o[first], group[first]
        code = np.concatenate([gr * 3 + k for k in range(3)])
        so = np.tile(ow, 3)
        projection = np.concatenate([sums[:, a] + sums[:, b] for a, b in PAIRS])
        rare = np.concatenate([np.minimum(least[:, a], least[:, b]) for a, b in PAIRS])
        sig = tb.mix(projection ^ tb.mix(code.astype(U64) + inst[so].astype(U64) * U64(0xD1342543DE82EF95)))
        some = rare < never
        code, so, sig, rare = code[some], so[some], sig[some], rare[some]
        # lost(d) + REQUIRED signatures; a set with fewer filled projections emits what it has, lost(d) + 1 at least, and is marked:
        # any signature in common makes it a candidate. Empty projections come after all others, in the order of their numbers
        filled, gone = np.bincount(so, minlength=n_docs), lost(d)
        wanted = gone + np.clip(filled - gone, 1, REQUIRED)
        short = np.flatnonzero(use & (filled < gone + 1))
        if len(short):
            order = np.argsort(so, kind="stable")
            bounds = np.searchsorted(so[order], [short, short + 1])
            more = []
            for x, a, b in zip(short, *bounds, strict=True):
                empty = np.setdiff1d(np.arange(3 * n1[x]), code[order[a:b]])[: gone[x] + 1 - filled[x]]
                more.append((np.full(len(empty), x), tb.mix(empty.astype(U64) + inst[[x]].astype(U64) * U64(SECOND)), never - 3 * int(n1.max()) + empty))
            so, sig, rare = (np.concatenate([one, *rest]) for one, rest in zip((so, sig, rare), zip(*more, strict=True), strict=True))
        order = np.lexsort((sig, rare, so))
        so, sig, rare = so[order], sig[order], rare[order]
        begin = np.searchsorted(so, np.arange(n_docs))
        take = np.arange(len(so)) - begin[so] < wanted[so]
        out.append((so[take], sig[take], (wanted - gone < REQUIRED)[so[take]], rare[take]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, bool), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


SIG_BITS = 46
_HOT_BIT, _MARK_BIT = U64(SIG_BITS), U64(SIG_BITS + 1)


def _tokens(n_buckets: int, sketch, clash, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(sketch.value, dtype=np.uint32).astype(np.int64)
        most = max(1, hot + 2 * int(counts.mean()))
        for batch in batches:
            for rows, data, offsets in tb.slices(batch, "text"):
                n = rows.num_rows
                owner, value = sets(data, offsets)
                sid = set_ids(owner, value, n, clash)
                _, once = np.unique(sid, return_index=True)  # equal sets of a slice emit once
                keep = np.zeros(n, dtype=bool)
                keep[once] = True
                value, owner = value[keep[owner]], owner[keep[owner]]
                who, sig, mark, rare = signatures(owner, value, n, counts)
                # a frequent signature's sets are dealt over several buckets; empty projections are as frequent as can be told
                shares = np.where(rare > most, np.minimum(rare // most, n_buckets), 1)
                salt = tb.mix(sid[who]) % shares.astype(U64)
                dealt = np.where(salt > 0, tb.mix(sig ^ salt), sig)
                bucket = ((dealt >> U64(40)) * U64(n_buckets) >> U64(24)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                who, sig, mark, split, bucket = who[order], sig[order], mark[order], (shares > 1)[order], bucket[order]
                cuts = np.searchsorted(bucket, np.arange(n_buckets + 1))
                blobs, numbers = [], []
                for b in range(n_buckets):
                    at = slice(cuts[b], cuts[b + 1])
                    w, s = who[at], sig[at]
                    if len(w):
                        there, local = np.unique(w, return_inverse=True)
                        low = (s & U64((1 << SIG_BITS) - 1)) | (split[at].astype(U64) << _HOT_BIT) | (mark[at].astype(U64) << _MARK_BIT)
                        blobs.append(len(there).to_bytes(4, "little") + sid[there].tobytes() + local.astype("<u2").tobytes() + low.astype("<u4").tobytes() + (low >> U64(32)).astype("<u2").tobytes())
                        numbers.append(b)
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "tokens"])

    return run


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    keys = np.frombuffer(blob, dtype=np.int64, count=n, offset=4)
    m = (len(blob) - 4 - 8 * n) // 8
    at = 4 + 8 * n
    local = np.frombuffer(blob, dtype="<u2", count=m, offset=at)
    low = np.frombuffer(blob, dtype="<u4", count=m, offset=at + 2 * m).astype(U64)
    high = np.frombuffer(blob, dtype="<u2", count=m, offset=at + 6 * m).astype(U64)
    return keys[local], low | (high << U64(32))


def _groups(small: int):
    """Of each task's buckets: pairs of small groups with the signatures they share there (kind 0: a, b, n), and members of large groups (kind 1: group, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets: dict[int, list[bytes]] = {}
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                buckets.setdefault(b, []).append(blob)
        for b in sorted(buckets):
            blobs = buckets.pop(b)
            for quarter in range(4):  # a signature lies in one quarter; unpacking and sorting take memory by quarters
                parts = []
                for blob in blobs:
                    key, sig = _unpacked(blob)
                    pick = (sig >> U64(SIG_BITS - 2)) & U64(3) == U64(quarter)
                    parts.append((key[pick], sig[pick]))
                key, sig = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                del parts
                if len(key):
                    yield from _grouped(key, sig, small)

    return run


def _grouped(key: np.ndarray, sig: np.ndarray, small: int) -> Iterator[pa.RecordBatch]:
    mark, sig = (sig >> _MARK_BIT).astype(bool), sig & U64((1 << (SIG_BITS + 1)) - 1)  # the hot bit stays: split groups aren't mixed with others
    order = np.lexsort((key, sig))
    key, sig, mark = key[order], sig[order], mark[order]
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
    key, sig, mark = key[fresh], sig[fresh], mark[fresh]
    start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    count = np.diff(np.concatenate([start, [len(key)]]))
    split = (sig[start] >> _HOT_BIT).astype(bool)
    pairs = []
    for size in range(2, small + 1):
        at = start[(count == size) & ~split]
        for i in range(size):
            for j in range(i + 1, size):
                weight = np.where(mark[at + i] | mark[at + j], REQUIRED, 1)
                pairs.append(np.stack([key[at + i], key[at + j], weight], axis=1))
    if pairs and sum(map(len, pairs)):
        rows = np.concatenate(pairs)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        new = np.flatnonzero(np.concatenate([[True], (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])]))
        yield from _packed_rows(0, rows[new, 0], rows[new, 1], np.add.reduceat(rows[:, 2], new))
    large = np.repeat((count > small) | split, count)
    if large.any():
        # groups of the same members are one group; a split one is named by its signature, in all of its buckets
        total = np.add.reduceat(tb.mix(key.view(U64)), start)
        name = np.repeat(np.where(split, tb.mix(sig[start]), tb.mix(total ^ count.astype(U64))), count).view(np.int64)
        member, n = np.unique(np.stack([name[large], key[large]], axis=1), axis=0, return_counts=True)
        yield from _packed_rows(1, member[:, 0].copy(), member[:, 1].copy(), n)


def _packed_rows(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(a), 200_000):
        part = slice(i, i + 200_000)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a[part]), kind, np.int8)), pa.array(a[part]), pa.array(b[part]), pa.array(n[part].astype(np.int64))], names=["kind", "a", "b", "n"])


def _set_rows(clash):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in tb.slices(batch, "text"):
                n = rows.num_rows
                owner, value = sets(data, offsets)
                _, at = _sizes(owner, n)
                whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((at * 8).astype(np.int64)), pa.py_buffer(value)])
                yield pa.RecordBatch.from_arrays([pa.array(set_ids(owner, value, n, clash).view(np.int64)), whole.cast(pa.binary())], names=["key", "members"])

    return run


def _compared(percent: int):
    """Rows (job, side, key, members), sorted by job and side: the edges of each job's components; lefts are compared with all others."""

    def edges(lefts: list[tuple[int, np.ndarray]], rights: list[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
        flat = np.concatenate([x for _, x in lefts])
        owner = np.repeat(np.arange(len(lefts)), [len(x) for _, x in lefts])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        size = np.array([len(x) for _, x in lefts])
        found = []
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for key, members in [*lefts, *rights]:
            low, high = np.searchsorted(flat, members, "left"), np.searchsorted(flat, members, "right")
            long = high - low
            hit = np.repeat(low, long) + np.arange(int(long.sum())) - np.repeat(np.cumsum(long) - long, long)
            common = np.bincount(owner[hit], minlength=len(lefts))
            for i in np.flatnonzero(100 * common >= percent * (size + len(members) - common)):
                other = lefts[i][0]
                x, y = top(key), top(other)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    found.append((key, other))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, lefts, rights = None, [], []

        def done() -> list[tuple[int, int]]:
            return edges(lefts, rights) if lefts and len(lefts) + len(rights) > 1 else []

        for batch in batches:
            out = []
            for j, side, key, cell in zip(*(batch.column(c) for c in range(3)), batch.column(3), strict=True):
                j, side, key, members = j.as_py(), side.as_py(), key.as_py(), np.frombuffer(cell.as_buffer(), dtype=U64)
                if j != job:
                    out += done()
                    job, lefts, rights = j, [], []
                (rights if side else lefts).append((key, members))
                if len(rights) >= 512:  # rights go through in parts
                    out += done()
                    rights = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])
        if out := done():
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return run


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, row_key (of id and text) and root, which names the component (null for an empty set). ``percent`` is fixed by the bands at 75 or more."""
    if not 75 <= percent <= 100:
        raise ValueError("the size bands hold for 75 to 100 percent")
    spark = with_workers(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), row_key(docs[id_col], docs[text_col]).alias("row_key"), docs[text_col].alias("text"))
    n_buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    pass1 = cut(rows.mapInArrow(_facts, "doc_id long, row_key binary, n long, sid long, second long, slice int, counts binary"), "setjoin-facts")
    facts = pass1.where("slice is null").select("doc_id", "row_key", "n", "sid", "second")

    def sets_of(facts: DataFrame) -> DataFrame:
        return cut(facts.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.min("second").alias("low"), F.max("second").alias("high")), "setjoin-known")

    known = sets_of(facts)
    found = [r[0] for r in known.where("low <> high").select("sid").limit(CLASHES + 1).collect()]
    if len(found) > CLASHES:
        raise ValueError("too many sets share an address")
    clash = np.array(found, dtype=np.int64).view(U64)
    if found:
        twice = spark.createDataFrame([(x, True) for x in found], "sid long, clashes boolean")
        facts = facts.join(twice, "sid", "left").withColumn("sid", F.when(F.col("clashes"), F.col("second")).otherwise(F.col("sid")))
        known = sets_of(facts)
    merged = pass1.where("slice is not null").select("slice", "counts").mapInArrow(_added, "slice int, counts binary").repartition(SKETCH_SLICES, "slice").mapInArrow(_added, "slice int, counts binary")
    whole: dict[int, np.ndarray] = {}  # a sketch of fixed size (1 MB), whatever the input
    for k, x in merged.collect():
        whole[k] = np.frombuffer(bytes(x), dtype=np.uint32)
    sketch = spark.sparkContext.broadcast(b"".join(whole[k].tobytes() for k in range(SKETCH_SLICES)) if whole else np.zeros(1 << SKETCH_BITS, np.uint32).tobytes())

    tokens = rows.mapInArrow(_tokens(n_buckets, sketch, clash, HOT), "bucket int, tokens binary")
    found = cut(tokens.repartition(n_buckets, "bucket").mapInArrow(_groups(SMALL), "kind byte, a long, b long, n long"), "setjoin-groups")

    # small groups: pairs with enough signatures and near enough sizes, one job per left set
    pairs = found.where("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= REQUIRED).select("a", "b")
    # large groups: members with the hub of their group
    members = found.where("kind = 1").select(F.col("a").alias("name"), F.col("b").alias("key"), "n")
    degree = members.groupBy("key").agg(F.sum("n").alias("degree"))
    hubs = members.join(degree, "key").groupBy("name").agg(F.max(F.struct("degree", "key"))["key"].alias("hub"))
    stars = cut(members.join(hubs, "name").where("key <> hub").select("hub", "key").distinct(), "setjoin-stars")
    asked = cut(pairs.select(F.col("a").alias("hub"), F.col("b").alias("key")).union(stars).distinct(), "setjoin-asked")

    wanted = asked.select("key").union(asked.select("hub")).distinct()
    owners = known.join(wanted, known["sid"] == wanted["key"], "left_semi").select("doc_id").distinct()
    texts = rows.join(owners, rows["doc_id"].eqNullSafe(owners["doc_id"]), "left_semi").select("text")
    members_of = cut(texts.mapInArrow(_set_rows(clash), "key long, members binary").join(wanted, "key", "left_semi").dropDuplicates(["key"]), "setjoin-sets")

    def compared(jobs: DataFrame, label: str) -> DataFrame:
        """jobs: job, side (0 left, 1 right), key."""
        dealt = jobs.join(members_of, "key").select("job", "side", "key", "members").repartition(n_buckets, "job").sortWithinPartitions("job", "side")
        return cut(dealt.mapInArrow(_compared(percent), "a long, b long"), label)

    chunk = F.pmod(F.xxhash64("key"), F.greatest(F.ceil(F.col("size") / RIGHT), F.lit(1)))
    sized = asked.join(asked.groupBy("hub").agg(F.count("*").alias("size")), "hub").select("hub", "key", F.xxhash64("hub", chunk).alias("job"))
    first = sized.select("job", F.lit(1).cast("byte").alias("side"), "key").union(sized.select("job", F.lit(0).cast("byte").alias("side"), F.col("hub").alias("key")).distinct())
    links = compared(first, "setjoin-links")
    roots = cut(components(links), "setjoin-roots")

    # what the stars leave: per hub, its members outside of the largest component against all of its members
    ring = stars.union(stars.select("hub", F.col("hub").alias("key")).distinct())
    ring = ring.join(roots, ring["key"] == roots["node"], "left").select("hub", "key", F.coalesce("root", "key").alias("root"))
    per_root = ring.groupBy("hub", "root").agg(F.count("*").alias("size"))
    main = per_root.groupBy("hub").agg(F.max(F.struct("size", "root"))["root"].alias("main"), F.sum("size").alias("size"), (F.sum("size") - F.max("size")).alias("apart")).where("apart > 0")
    ring = cut(ring.join(main, "hub").select("hub", "key", (F.col("root") != F.col("main")).alias("apart"), F.ceil(F.col("apart") / LEFT).alias("blocks"), F.ceil(F.col("size") / RIGHT).alias("chunks")), "setjoin-ring")
    if ring.limit(1).count():
        block = F.pmod(F.xxhash64("key"), F.col("blocks"))
        part = F.pmod(F.xxhash64(F.lit(7), "key"), F.col("chunks"))
        lefts = ring.where("apart").select("hub", "key", block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(0).cast("byte").alias("side"))
        rights = ring.select("hub", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), part.alias("chunk"), F.lit(1).cast("byte").alias("side"))
        more = compared(lefts.unionByName(rights).select(F.xxhash64("hub", "block", "chunk").alias("job"), "side", "key"), "setjoin-more")
        roots = cut(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)), "setjoin-roots2")

    placed = facts.join(roots, facts["sid"] == roots["node"], "left").select("doc_id", "row_key", "n", F.coalesce("root", "sid").alias("root"))
    names = placed.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = placed.where("n > 0").join(names, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "row_key", "root")
    return out.union(placed.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "row_key", F.lit(None).cast("long")))


def representatives(groups: DataFrame) -> DataFrame:
    """row_key of one row per component of :func:`jaccard_groups`: the smallest id's (null ids last; of several texts of that id in the component the one with the smallest key), and of every row with an empty set."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row_key"))
    return groups.where("root is not null").groupBy("root").agg(first.alias("first")).select("first.row_key").union(groups.where("root is null").select("row_key")).distinct()
