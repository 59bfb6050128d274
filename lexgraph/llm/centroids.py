"""Operator 11, centroid clustering: Lloyd's rounds with Drake's adaptive bounds, in integers.

Vectors are quantised once (``floor(scale * x)``), so centroids, sums and distances are integers and every comparison is exact. Each vector keeps an upper bound of the
distance to its centroid, lower bounds of the distances to its next nearest ``tracked`` centroids with their numbers, and one remainder bound for all others. When centroids
move, bounds move by at most as much. A round then

1. keeps a vector whose upper bound is below all lower bounds, without any distance;
2. else takes the exact distance to its own centroid and looks again;
3. else takes the distances to itself and the fewest tracked centroids after which the order is certain again, and orders these anew;
4. else, when even the remainder bound may be reached, scans all centroids.

Certainty is strict and leaves room for rounding, so ties are always decided by integer distances and the smaller number. As in Drake's method the number of
tracked centroids shrinks to what the rounds still need.

A round is one pass: it writes the vectors with their new bounds, and one row per task and centroid with the sums of that task; only ``k`` sums come to the driver. The pass of a round is a
table in the shared folder, so a lost executor costs tasks of one round; the table before it is deleted.

Defined results: a vector with another number of components, or a null or non-finite one, isn't kept, neither is a null vector; repeated rows are vectors of their own; a null id is
kept, but never seeds while there are others; of equal seed hashes the smaller components come first; with fewer vectors than ``k`` there are as many centroids; an empty table
gives no rows; further columns are ignored. Quantised components beyond 2**27 are an error, as squared distances would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut, drop, with_workers

LIMIT = 1 << 27
#: Relative room for the rounding of square roots and sums.
EPS = 1e-11
#: A lower bound where there is no centroid to bound.
FAR = 1e300
TRACKED = 3
_CODE = "<i4"

VECTORS = "vec_id long, code binary"
STATE = f"{VECTORS}, cluster int, distance long, upper double, near binary, lower binary, part_cluster int, part_n long, part_sum array<long>, part_distance decimal(38,0), part_depth int"


def quantised(vectors: DataFrame, size: int, scale: float, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and the components as little-endian 32-bit integers, of the vectors that are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            fits = pc.fill_null(pc.equal(pc.list_value_length(lists), size), False)
            batch = batch.filter(fits)
            lists = batch.column(1)
            flat = pc.list_flatten(lists)
            x = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(len(batch), size)
            finite = np.isfinite(x).all(axis=1)
            with np.errstate(over="ignore"):
                value = np.floor(scale * x[finite])
            if value.size and np.abs(value).max() > LIMIT:
                raise ValueError(f"a quantised component is beyond {LIMIT}")
            code = value.astype(_CODE)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(finite)), pa.array([row.tobytes() for row in code], pa.binary())], names=["vec_id", "code"])

    with_workers(vectors.sparkSession)
    return vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("vector")).mapInArrow(run, VECTORS)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of every row of ``x`` to every row of ``c``, exact in 64 bits."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)), 1)
    if 4 * x.shape[1] * top * top < 1 << 52:  # every partial sum is an integer that a double holds
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    a, b = x.astype(np.int64), c.astype(np.int64)
    out = np.empty((len(a), len(b)), dtype=np.int64)
    for k in range(len(b)):
        d = a - b[k]
        out[:, k] = (d * d).sum(1)
    return out


def paired(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of each row of ``x`` to the row of ``c`` beside it."""
    d = x.astype(np.int64) - c
    return (d * d).sum(1)


class Bounds:
    """Assignment and bounds of a batch of vectors; ``near`` and ``lower`` have ``tracked`` columns, and ``lower`` one more for the remainder."""

    def __init__(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, near: np.ndarray, lower: np.ndarray):
        self.x, self.cluster, self.upper, self.near, self.lower = x, cluster, upper, near, lower
        self.distance = np.full(len(x), -1, dtype=np.int64)
        self.depth = 0
        self.scanned = 0

    @classmethod
    def fresh(cls, x: np.ndarray, tracked: int) -> Bounds:
        n = len(x)
        return cls(x, np.zeros(n, np.int32), np.full(n, np.inf), np.full((n, tracked), -1, np.int32), np.zeros((n, tracked + 1)))

    def move(self, drift: np.ndarray) -> None:
        """Centroid ``i`` has moved by at most ``drift[i]``."""
        self.upper = (self.upper + drift[self.cluster]) * (1 + EPS)
        step = np.concatenate([np.where(self.near >= 0, drift[self.near], 0.0), np.full((len(self.x), 1), drift.max(initial=0.0))], axis=1)
        self.lower = self.lower - step - EPS * (np.abs(self.lower) + step)

    def shrink(self, tracked: int) -> None:
        """Keep fewer tracked centroids; those dropped belong to the remainder."""
        if tracked < self.near.shape[1]:
            self.lower = np.concatenate([self.lower[:, :tracked], self.lower[:, tracked:].min(axis=1, keepdims=True)], axis=1)
            self.near = self.near[:, :tracked]

    def _exact(self, rows: np.ndarray, centroids: np.ndarray) -> None:
        self.distance[rows] = paired(self.x[rows], centroids[self.cluster[rows]])
        self.upper[rows] = np.sqrt(self.distance[rows].astype(np.float64)) * (1 + EPS)

    def _order(self, rows: np.ndarray, near: np.ndarray, d: np.ndarray, columns: int) -> None:
        """Give ``rows`` the centroids ``near`` (a column each) with squared distances ``d``, by distance, then number; the first is their own."""
        order = np.lexsort((near, d), axis=1)
        near, d = np.take_along_axis(near, order, 1), np.take_along_axis(d, order, 1)
        root = np.sqrt(d.astype(np.float64))
        self.cluster[rows] = near[:, 0]
        self.distance[rows] = d[:, 0]
        self.upper[rows] = root[:, 0] * (1 + EPS)
        self.near[rows[:, None], np.arange(columns)] = near[:, 1 : columns + 1]
        self.lower[rows[:, None], np.arange(columns)] = root[:, 1 : columns + 1] * (1 - EPS)

    def assign(self, centroids: np.ndarray) -> None:
        """Every vector to its nearest centroid, ties to the smaller number."""
        tracked = self.near.shape[1]
        # of the bounds from column z on, the smallest: what remains when z tracked centroids have been looked at
        later = np.minimum.accumulate(self.lower[:, ::-1], axis=1)[:, ::-1]
        open_ = np.flatnonzero(~(self.upper < later[:, 0]))
        if len(open_):
            known = open_[np.isfinite(self.upper[open_])]
            if len(known):
                self._exact(known, centroids)
            open_ = open_[~(self.upper[open_] < later[open_, 0])]
        if not len(open_):
            return
        certain = self.upper[open_, None] < later[open_]  # column z: z tracked centroids are enough
        depth = np.where(certain.any(axis=1), certain.argmax(axis=1), tracked + 1)
        for z in range(1, tracked + 1):
            rows = open_[depth == z]
            if len(rows):
                near = np.concatenate([self.cluster[rows][:, None], self.near[rows, :z]], axis=1)
                d = np.stack([paired(self.x[rows], centroids[near[:, j]]) for j in range(z + 1)], axis=1)
                self._order(rows, near, d, z)
        rows = open_[depth == tracked + 1]
        if len(rows):
            d = distances(self.x[rows], centroids)
            near = np.broadcast_to(np.arange(len(centroids), dtype=np.int32), d.shape)
            columns = min(tracked, len(centroids) - 1)
            self._order(rows, near, d, columns)
            self.near[rows[:, None], np.arange(columns, tracked)] = -1
            self.lower[rows[:, None], np.arange(columns, tracked + 1)] = FAR
            if columns + 1 < len(centroids):
                self.lower[rows, tracked] = np.sqrt(np.partition(d, columns + 1, axis=1)[:, columns + 1].astype(np.float64)) * (1 - EPS)
            self.scanned += len(rows)
        self.depth = max(self.depth, int(depth[depth <= tracked].max(initial=1)))

    def exact(self, centroids: np.ndarray) -> None:
        """The distance of every vector whose bounds made it unnecessary so far."""
        rows = np.flatnonzero(self.distance < 0)
        if len(rows):
            self._exact(rows, centroids)


def _codes(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=_CODE).reshape(len(column), size)


def _packed(rows: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in rows], pa.binary())


def _round(state: DataFrame, size: int, centroids: np.ndarray, drift: np.ndarray | None, tracked: int, last: bool) -> DataFrame:
    """One assignment; ``drift`` is None in the first. The rows of a task's sums follow its vectors."""
    k = len(centroids)
    names = [x.split()[0] for x in STATE.replace("(38,0)", "").split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, spread, depth = np.zeros(k, np.int64), np.zeros((k, size), np.int64), [0] * k, 1
        for batch in batches:
            rows = len(batch)
            if not rows:
                continue
            x = _codes(batch.column(1), size)
            if drift is None:
                b = Bounds.fresh(x, tracked)
            else:
                lower = np.frombuffer(b"".join(batch.column(5).to_pylist()), dtype=np.float64).reshape(rows, -1).copy()
                near = np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype=np.int32).reshape(rows, lower.shape[1] - 1).copy()
                b = Bounds(x, batch.column(2).to_numpy().copy(), batch.column(3).to_numpy().copy(), near, lower)
                b.move(drift)
                b.shrink(tracked)
            b.assign(centroids)
            if last:
                b.exact(centroids)
            depth = max(depth, b.depth)
            for c in np.unique(b.cluster):
                mine = b.cluster == c
                n[c] += int(mine.sum())
                total[c] += x[mine].sum(axis=0, dtype=np.int64)
                if last:
                    spread[c] += sum(b.distance[mine].tolist())
            nothing = [pa.nulls(rows, t) for t in (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.decimal128(38, 0), pa.int32())]
            distance = pa.array(b.distance, mask=b.distance < 0)
            bounds = [pa.nulls(rows, pa.float64()), pa.nulls(rows, pa.binary()), pa.nulls(rows, pa.binary())] if last else [pa.array(b.upper), _packed(b.near), _packed(b.lower)]
            kept = pa.nulls(rows, pa.binary()) if last else batch.column(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), kept, pa.array(b.cluster), distance, *bounds, *nothing], names=names)
        used = np.flatnonzero(n)
        if len(used):
            m = len(used)
            first = [pa.nulls(m, t) for t in (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.float64(), pa.binary(), pa.binary())]
            sums = [pa.array(used, pa.int32()), pa.array(n[used]), pa.array(total[used].tolist(), pa.list_(pa.int64())), pa.array([spread[c] for c in used], pa.decimal128(38, 0)), pa.array([depth] * m, pa.int32())]
            yield pa.RecordBatch.from_arrays([*first, *sums], names=names)

    columns = ["vec_id", "code"] + ([] if drift is None else ["cluster", "upper", "near", "lower"])
    return state.select(*columns).mapInArrow(run, STATE)


def _vectors(table: DataFrame) -> DataFrame:
    return table.where("part_cluster is null")


def _sums(table: DataFrame) -> tuple[dict[int, tuple[int, list[int], int]], int]:
    """Of each non-empty centroid its vectors, their sums and the sum of their distances; the deepest use of the bounds."""
    parts = table.where("part_cluster is not null")
    wide = "decimal(38,0)"
    each = parts.select("part_cluster", F.posexplode("part_sum").alias("at", "value")).groupBy("part_cluster", "at").agg(F.sum(F.col("value").cast(wide)).alias("value"))
    total: dict[int, dict[int, int]] = {}
    for r in each.collect():
        total.setdefault(r["part_cluster"], {})[r["at"]] = int(r["value"])
    counts = parts.groupBy("part_cluster").agg(F.sum("part_n").alias("n"), F.sum("part_distance").alias("d"), F.max("part_depth").alias("depth")).collect()
    return {r["part_cluster"]: (r["n"], [total[r["part_cluster"]][i] for i in range(len(total[r["part_cluster"]]))], int(r["d"])) for r in counts}, max((r["depth"] for r in counts), default=1)


def seed_hash(seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)


def cluster(vectors: DataFrame, k: int, rounds: int, size: int, scale: float = 1024.0, seed: int = 3, tracked: int = TRACKED, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(assignments, centroids).

    assignments: vec_id, cluster, distance (squared) of each kept vector. centroids, at most ``k`` rows: cluster, n, cluster_inertia, inertia (of all), components array<long>.
    """
    spark = vectors.sparkSession
    codes = cut(quantised(vectors, size, scale, id_col, vector_col), "centroids-vectors")
    first = codes.orderBy(F.asc_nulls_last(seed_hash(seed)), "code").limit(k).collect()
    shape = "cluster int, n long, cluster_inertia long, inertia long, components array<long>"
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), spark.createDataFrame([], shape)
    centroids = np.stack([np.frombuffer(r["code"], dtype=_CODE) for r in first]).astype(np.int64)
    state, drift, tracked = codes, None, max(1, min(tracked, k - 1))
    for at in range(rounds + 1):
        new = cut(_round(state, size, centroids, drift, tracked, last=at == rounds), f"centroids-{at}")
        found, depth = _sums(new)
        drop(spark, state)
        state = _vectors(new)
        if at == rounds:
            break
        moved = centroids.copy()
        for c, (n, total, _) in found.items():
            moved[c] = [v // n for v in total]
        drift = np.sqrt(paired(moved, centroids).astype(np.float64)) * (1 + EPS)
        if at:
            tracked = max(1, min(tracked, depth))
        centroids = moved
    whole = sum(d for _, _, d in found.values())
    ends = [(c, *((found[c][0], found[c][2]) if c in found else (0, 0)), whole, centroids[c].tolist()) for c in range(len(centroids))]
    return state.select("vec_id", "cluster", "distance"), spark.createDataFrame(ends, shape)


def digested(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """Each vector with the inertia of its cluster and of all, and the SHA-256 of its centroid; the centroids are at most ``k`` rows."""
    text = F.array_join(F.transform("components", lambda x: x.cast("string")), ",")
    ends = centroids.select("cluster", "cluster_inertia", "inertia", F.sha2(text, 256).alias("centroid_sha256"))
    return assigned.join(F.broadcast(ends), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same rounds as common table expressions, one after the other."""
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS x FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: isfinite(CAST(x AS DOUBLE)))) = {size})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS c, x FROM (SELECT sha256('{seed}:' || vec_id) AS h, x FROM v ORDER BY h NULLS LAST, x LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT v.r, min(CAST(list_inner_product(v.x, v.x) + list_inner_product(c.x, c.x) - 2 * list_inner_product(v.x, c.x) AS BIGINT) * {k} + c.c) AS m FROM v, c{i} c GROUP BY v.r)")
        if i < rounds:
            parts.append(f"s{i} AS MATERIALIZED (SELECT m % {k} AS c, p, CAST(sum(x[p]) AS BIGINT) AS s, count(*) AS n FROM a{i} JOIN v USING (r), unnest(generate_series(1, {size})) AS g(p) GROUP BY 1, 2)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT o.c, list(coalesce(CAST((s - (s % n + n) % n) // n AS DOUBLE), o.x[o.p]) ORDER BY o.p) AS x FROM (SELECT c, x, unnest(generate_series(1, {size})) AS p FROM c{i}) o LEFT JOIN s{i} s ON s.c = o.c AND s.p = o.p GROUP BY o.c)")
    end = f"c{rounds}"
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT vec_id, CAST(m % {k} AS INTEGER) AS cluster, CAST(m // {k} AS BIGINT) AS distance, CAST(sum(m // {k}) OVER (PARTITION BY m % {k}) AS BIGINT) AS cluster_inertia, CAST(sum(m // {k}) OVER () AS BIGINT) AS inertia, "
        f"sha256(array_to_string(list_transform({end}.x, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256 FROM a{rounds} JOIN v USING (r) JOIN {end} ON {end}.c = m % {k}"
    )
