"""The best vectors of each query by matrix products: a task keeps the k best per query of the vectors that it reads, with scores summed in order.

Products tell which pairs can be among the k best, with room for their rounding; the scores of these pairs are summed again in the order of the components, so they are those of ``retrieval.cosine``. Of
vectors with equal scores a task keeps the k smallest ids, so copies don't add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgraph.storage import with_workers

#: Rows and queries whose products are held at once; kept pairs after which they are cut to the best.
ROWS, QUERIES, PAIRS = 2048, 512, 1_000_000
#: Scores are rounded to six places, so a vector this much below the k-th may tie with it.
ROOM = 2e-6


def regular(column: str, size: int):
    """Whether a vector has ``size`` components and all of them are finite numbers."""
    wrong = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) > 1e150))
    return F.coalesce((F.size(column) == size) & ~wrong, F.lit(False))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)


class Best:
    """The k best (query, id, score) so far."""

    def __init__(self, asked: np.ndarray, k: int):
        self.asked, self.k = asked, k
        self.least = np.full(len(asked), -np.inf)
        self.held = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        self.pairs = 0

    def add(self, ids: np.ndarray, x: np.ndarray, queries: np.ndarray | None) -> None:
        """Rows against the queries of these numbers (all if None)."""
        every = np.arange(len(self.asked)) if queries is None else queries
        for at in range(0, len(every), QUERIES):
            some = every[at : at + QUERIES]
            near = np.clip(self.asked[some] @ x.T, -1.0, 1.0)
            least = self.least[some]
            hits = near >= least[:, None] - ROOM
            if len(ids) > self.k and hits.sum() > 2 * self.k * len(some):
                least = np.maximum(least, np.partition(near, -self.k, axis=1)[:, -self.k])
                hits = near >= least[:, None] - ROOM
            q, r = np.nonzero(hits)
            if len(q):
                q = some[q]
                score = np.zeros(len(q))
                for lo in range(0, len(q), 65_536):
                    a, b, part = self.asked[q[lo : lo + 65_536]], x[r[lo : lo + 65_536]], score[lo : lo + 65_536]
                    for c in range(x.shape[1]):
                        part += b[:, c] * a[:, c]
                self.held.append((q, ids[r], np.clip(score, -1.0, 1.0)))
                self.pairs += len(q)
                if self.pairs > PAIRS:
                    self.cut()

    def cut(self) -> None:
        q, ids, score = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        at = np.arange(len(q))
        new = np.r_[True, q[1:] != q[:-1]] if len(q) else np.empty(0, bool)
        first = np.maximum.accumulate(np.where(new, at, 0))
        kth = (at - first) == self.k - 1
        self.least[q[kth]] = score[kth]
        tied = np.maximum.accumulate(np.where(new | np.r_[True, score[1:] != score[:-1]], at, 0)) if len(q) else first
        stays = (score >= self.least[q] - ROOM) & (at - tied < self.k)
        self.held = [(q[stays], ids[stays], score[stays])]
        self.pairs = 0


def best_pairs(vectors: DataFrame, asked: pa.Table, size: int, k: int, probing: dict[int, np.ndarray] | None = None) -> DataFrame:
    """(query_id, id, score) with every pair that can be among the k best of its query. vectors: id long, embedding and, with ``probing``, list; ``asked``: query_id, query_vector, a bounded block that is sent to every task.

    ``probing`` has the numbers of the queries that look at a list; without it all look at every vector. Vectors and queries are :func:`regular`."""
    spark = with_workers(vectors.sparkSession)
    names = asked.column("query_id").combine_chunks()
    sent = spark.sparkContext.broadcast((_matrix(asked.column("query_vector").combine_chunks(), size), names, probing))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, ids_of, lists = sent.value
        best = Best(matrix, k)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                ids, x = part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1), size)
                if lists is None:
                    best.add(ids, x, None)
                    continue
                of = part.column(2).to_numpy(zero_copy_only=False)
                for number in np.unique(of):
                    if int(number) in lists:
                        mine = of == number
                        best.add(ids[mine], x[mine], lists[int(number)])
        best.cut()
        q, ids, score = best.held[0]
        for lo in range(0, len(q), 10_000):
            yield pa.RecordBatch.from_arrays([ids_of.take(pa.array(q[lo : lo + 10_000])), pa.array(ids[lo : lo + 10_000]), pa.array(score[lo : lo + 10_000])], names=["query_id", "id", "score"])

    kind = {"int64": "long", "int32": "int", "string": "string", "large_string": "string"}[str(names.type)]
    columns = ["id", F.col("embedding").cast("array<double>").alias("embedding"), *(["list"] if probing is not None else [])]
    return vectors.select(*columns).mapInArrow(run, f"query_id {kind}, id long, score double")
