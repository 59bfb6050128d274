"""Search by matrix products gives what scoring every pair gives."""

import math
import random

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgraph.operators import nearest, retrieval
from lexgraph.operators.vectorindex import VectorIndex

K = 5


def vectors(spark, n=400):
    r = random.Random(3)
    rows = []
    for i in range(n):
        v = [r.gauss(0, 1) for _ in range(8)]
        rows.append((i, [x / math.hypot(*v) for x in v]))
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # copies, and vectors a little beside them
    rows += [(2000 + i, [x + 1e-9 * i for x in rows[7][1]]) for i in range(20)]
    odd = [(3000, None), (3001, [1.0]), (3002, [None] + [0.5] * 7), (3003, [float("nan")] * 8), (3004, [1e200] * 8)]
    return spark.createDataFrame(rows + odd, "id long, embedding array<double>")


def every_pair(v, q):
    scored = v.crossJoin(q).select("query_id", "id", F.round(retrieval.cosine(F.col("embedding"), F.col("query_vector")), 6).alias("dense_score"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("dense_score"), "id"))).where(F.col("rank") <= K)


def shown(df):
    return sorted(str(tuple(r)) for r in df.select("query_id", "id", "dense_score", "rank").collect())


def test_products_give_what_every_pair_gives(spark, monkeypatch):
    monkeypatch.setattr(nearest, "ROWS", 64)
    v = vectors(spark)
    q = v.where("id % 7 = 0 or id >= 3000").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    assert shown(retrieval.knn(v, q, K)) == shown(every_pair(v, q))
    plan = retrieval.knn(v, q, K)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan


def test_index_probes_by_products(spark, tmp_path, monkeypatch):
    v = vectors(spark).where("id < 3000")
    q = v.where("id % 7 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    index = VectorIndex.fit(v, f"{tmp_path}/index", lists=6)
    index.append(v, "all")
    monkeypatch.setattr("lexgraph.operators.vectorindex.PAIRS", 100)  # several blocks
    found = index.search(q, K, 6)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert shown(found) == shown(every_pair(v, q))


def test_a_task_keeps_few_of_many_copies():
    best = nearest.Best(np.eye(2), 3)
    for at in range(0, 5000, 500):
        best.add(np.arange(at, at + 500), np.ones((500, 2)) / 2, None)
    best.cut()
    assert sorted(zip(*(c.tolist() for c in best.held[:1][0]))) == [(q, i, 0.5) for q in (0, 1) for i in range(3)]
