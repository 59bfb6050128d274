"""Connected components of an edge table, by min-label hooking and pointer jumping.

Each round is two hash aggregates and joins; labels are written to the shared folder after each round, so lineage stays short and a
lost executor costs one round at most. Rounds grow with the logarithm of the longest chain; a star of any size takes two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut, drop


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``edges`` (a long, b long) -> (node, root): root is the smallest node of the component. Self loops and repeated edges are allowed; nulls are dropped."""
    spark = edges.sparkSession
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null")
    rest = cut(edges.where("a <> b").distinct(), label)
    # alternate large-star and small-star steps (Kiveris et al. 2014) until the edges are stars
    while True:
        both = rest.union(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: strictly larger neighbours of u go to the smallest of u and its neighbours
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours of u, and u, go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x")).select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).where("a <> b").distinct()
        new = cut(small, label)
        gone = new.join(rest, ["a", "b"], "left_anti").limit(1).count() + rest.join(new, ["a", "b"], "left_anti").limit(1).count()
        drop(spark, rest)
        rest = new
        if not gone:
            break
    return rest.select(F.col("a").alias("node"), F.col("b").alias("root")).union(rest.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
