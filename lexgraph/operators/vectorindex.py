"""A stored inverted-file index of vectors: lists around centroids, several of which are probed per query.

Centroids are fitted on a bounded sample; every vector is assigned to the list of its nearest centroid and stored in that list's partition, batch by batch. A query probes the lists of its nearest
centroids (``probes``, measured against exact search on stored vectors until a recall is reached), or, certified, every list that can still hold one of its k best, which is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgraph.storage import kept, with_workers

from . import nearest, retrieval

#: Vectors that centroids are fitted on, at most (in expectation); vectors whose own neighbours measure the recall.
SAMPLE = 100_000
MEASURED = 200
#: Probed lists of queries, two numbers each, that one pass sends to every task.
PAIRS = 1_000_000
#: Room for the rounding of scores (six places) and of distances.
ROOM = 2e-6


def _matrix(column: pa.ListArray, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T))


class VectorIndex:
    """The index of unit vectors (id, embedding array<float|double>) below ``path``."""

    def __init__(self, spark: SparkSession, path: str, centroids: np.ndarray):
        self.spark, self.path, self.centroids, self.probes = with_workers(spark), path.rstrip("/"), centroids, len(centroids)

    @classmethod
    def fit(cls, vectors: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE, seed: int = 7) -> VectorIndex:
        """Centroids of at most ``sample`` of the vectors (all if there are fewer); as many lists as the square root of their number unless told."""
        spark = vectors.sparkSession
        n = vectors.count()
        fraction = min(1.0, sample / max(n, 1))
        some = vectors if fraction == 1.0 else vectors.sample(fraction, seed)
        k = max(2, lists or int(np.sqrt(min(n, sample))))
        points = kept(some.select(F.col("embedding").cast("array<double>").alias("e")), "vector-sample").select(array_to_vector("e").alias("features"))
        model = KMeans(k=k, seed=seed, maxIter=10, initMode="random").fit(points)
        return cls(spark, path, np.array(model.clusterCenters()))

    def _assigned(self, vectors: DataFrame) -> DataFrame:
        sent, size = self.spark.sparkContext.broadcast(self.centroids), self.centroids.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    d = _distances(_matrix(batch.column(1), size), sent.value)
                    near = d.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], names=["id", "embedding", "list", "far"])

        kind = vectors.schema["embedding"].dataType.simpleString()
        return vectors.select(F.col("id").cast("long").alias("id"), "embedding").where("id is not null and embedding is not null").where(F.size("embedding") == size).mapInArrow(run, f"id long, embedding {kind}, list int, far double")

    def append(self, vectors: DataFrame, batch: str) -> None:
        """Index a batch; a batch that comes again replaces itself. Null ids, null vectors and those of another size aren't indexed."""
        rows = self._assigned(vectors).withColumn("batch", F.lit(batch))
        rows.repartition("list").sortWithinPartitions("list", "id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("list", "batch").parquet(f"{self.path}/vectors")

    def vectors(self, lists: list[int] | None = None) -> DataFrame:
        table = self.spark.read.parquet(f"{self.path}/vectors")
        return table if lists is None else table.where(F.col("list").isin(lists))

    def _probed(self, queries: DataFrame, probes: int) -> DataFrame:
        """(query_id, query_vector, list, distance) of the ``probes`` nearest lists of each query."""
        sent, size = self.spark.sparkContext.broadcast(self.centroids), self.centroids.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    d = _distances(_matrix(batch.column(1), size), sent.value)
                    near = np.argsort(d, axis=1, kind="stable")[:, :probes]
                    at = np.repeat(np.arange(len(d)), near.shape[1])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(near.ravel().astype(np.int32)), pa.array(d[at, near.ravel()])], names=["query_id", "list", "distance"])

        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query_vector")).where(F.size("query_vector") == size)
        return asked.mapInArrow(run, "query_id long, list int, distance double")

    def _scored(self, probed: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """The k best of the probed lists, with exact scores. Queries (with distinct ids) are sent in blocks, as by exact search, of at most ``PAIRS`` probed lists."""
        pairs = kept(probed.select("query_id", "list"), "probed")
        n, asking = pairs.agg(F.count("*"), F.count_distinct("query_id")).first()
        blocks = max(-(-asking // retrieval.QUERY_BLOCK), -(-n // PAIRS)) or 1
        size = self.centroids.shape[1]
        whole = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query_vector").cast("array<double>").alias("query_vector"))
        even, plain = nearest.regular("embedding", size), nearest.regular("query_vector", size)
        odd_vectors, odd_queries = not self.vectors().where(~even).isEmpty(), not whole.where(F.size("query_vector") == size).where(~plain).isEmpty()
        best = None
        for block in range(blocks):
            mine = lambda df: df if blocks == 1 else df.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)  # noqa: E731, B023
            part = mine(pairs)
            asked = mine(whole).where(plain).toArrow()
            table = part.toArrow()
            ids = asked.column("query_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            of, lists = table.column("query_id").to_numpy(), table.column("list").to_numpy()
            at = np.minimum(np.searchsorted(ids[order], of), max(len(ids) - 1, 0))
            known = ids[order[at]] == of if len(ids) else np.zeros(len(of), bool)
            numbers, lists_of = order[at[known]] if len(ids) else at[known], lists[known]
            turn = np.argsort(lists_of, kind="stable")
            found, starts = np.unique(lists_of[turn], return_index=True)
            probing = {int(x): y for x, y in zip(found, np.split(numbers[turn], starts[1:]), strict=True)} if len(found) else {}
            read = self.vectors(sorted(set(lists.tolist())))
            met = nearest.best_pairs(read.where(even), asked, size, k, probing).select("query_id", "id", F.round("score", 6).alias("dense_score"))
            one_by_one = lambda v, q: v.join(q.join(part, "query_id"), "list").select("query_id", "id", F.round(retrieval.cosine(F.col("embedding"), F.col("query_vector")), 6).alias("dense_score"))  # noqa: E731, B023
            if odd_vectors:
                met = met.union(one_by_one(read.where(~even), mine(whole)))
            if odd_queries:
                met = met.union(one_by_one(read.where(even), mine(whole).where(~plain)))
            ranked = met.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("dense_score"), "id"))).where(F.col("rank") <= k)
            best = ranked if best is None else best.union(ranked)
        return best

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """TX-01: query_id, id, dense_score, rank among the vectors of the ``probes`` nearest lists. queries: query_id, query_vector."""
        return self._scored(self._probed(queries, probes or self.probes), queries, k)

    def certified(self, queries: DataFrame, k: int) -> DataFrame:
        """TX-01, exactly, for unit vectors: after the nearest lists, those whose ball may hold a vector at least as near as the k-th found."""
        first = kept(self.search(queries, k, min(3, len(self.centroids))), "nearest")
        # the distance of the k-th: |q - x|^2 = 2 - 2 q.x for unit vectors
        reach = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("dense_score").alias("s"))
        reach = reach.select("query_id", F.when(F.col("n") >= k, F.sqrt(2 - 2 * (F.col("s") - ROOM)) + ROOM).otherwise(F.lit(4.0)).alias("reach"))
        balls = self.vectors().groupBy("list").agg(F.max("far").alias("radius"))
        every = self._probed(queries, len(self.centroids)).join(reach, "query_id", "left").join(balls, "list")
        return self._scored(every.where(F.col("distance") - F.col("radius") <= F.coalesce("reach", F.lit(4.0))).select("query_id", "list"), queries, k)

    def _exact(self, queries: DataFrame, k: int) -> DataFrame:
        return kept(retrieval.knn(self.vectors().select("id", "embedding"), queries, k).select("query_id", "id"), "exact")

    def recall(self, queries: DataFrame, k: int, probes: int | None = None, exact: DataFrame | None = None) -> float:
        """The share of exact neighbours that the probed lists give, over all queries. ``exact``: these neighbours, if they are known."""
        exact = self._exact(queries, k) if exact is None else exact
        found = self.search(queries, k, probes).select("query_id", "id")
        wanted, got = exact.count(), exact.join(found, ["query_id", "id"], "left_semi").count()
        return got / wanted if wanted else 1.0

    def calibrate(self, k: int, target: float = 0.95, measured: int = MEASURED) -> float:
        """Double the probes until ``measured`` stored vectors (those of the smallest hashes) find ``target`` of their neighbours; the recall that was reached."""
        some = kept(self.vectors().orderBy(F.xxhash64("id"), "id").limit(measured).select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector")), "measured")
        probes, exact = 1, self._exact(some, k)
        while True:
            reached = self.recall(some, k, probes, exact)
            if reached >= target or probes >= len(self.centroids):
                self.probes = min(probes, len(self.centroids))
                return reached
            probes *= 2
