"""Deterministic evaluation: set metrics, slots, averages over the applicable subset, summaries with totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def prefix_match(expected: Column, cited: Column) -> Column:
    """JN-28: equal, or either is a raw prefix of the other."""
    return (expected == cited) | F.startswith(expected, cited) | F.startswith(cited, expected)


def retrieval_metrics(must: Column, must_not: Column, got: Column) -> list[Column]:
    """AG-11: recall (1 without expectations), collision rate (0 without), and pass: full recall and nothing forbidden."""
    hit = F.size(F.filter(must, lambda e: F.exists(got, lambda g: prefix_match(e, g))))
    bad = F.size(F.filter(must_not, lambda e: F.exists(got, lambda g: prefix_match(e, g))))
    recall = F.when(F.size(must) == 0, 1.0).otherwise(hit / F.size(must))
    collision = F.when(F.size(must_not) == 0, 0.0).otherwise(bad / F.size(must_not))
    return [F.round(recall, 6).alias("recall"), F.round(collision, 6).alias("collision_rate"), ((recall >= 1.0) & (bad == 0)).alias("passed")]


def f1(precision: Column, recall: Column) -> Column:
    """MA-10: harmonic mean, 0 where both are 0."""
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def precision_recall(predicted: DataFrame, truth: DataFrame, group: str) -> DataFrame:
    """AG-12: per group the precision, recall and F1 of predicted (group, id) against truth (group, id), guarded against empty sets."""
    joined = predicted.withColumn("p", F.lit(1)).join(truth.withColumn("t", F.lit(1)), [group, "id"], "full_outer")
    c = joined.groupBy(group).agg(F.sum("p").alias("n_p"), F.sum("t").alias("n_t"), F.sum(F.col("p") * F.col("t")).alias("n_both")).na.fill(0)
    precision = F.when(F.col("n_p") > 0, F.col("n_both") / F.col("n_p")).otherwise(0.0)
    recall = F.when(F.col("n_t") > 0, F.col("n_both") / F.col("n_t")).otherwise(0.0)
    return c.select(group, F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1(precision, recall), 6).alias("f1"))


def root_cause(retrieved: Column, generated: Column, refused: Column) -> Column:
    """PR-12: ordered causes of a failed item."""
    return F.when(retrieved & generated, "PASS").when(~retrieved & ~generated, F.when(refused, "RETRIEVAL_MISS_REFUSED").otherwise("RETRIEVAL_AND_GENERATION")).when(~retrieved, "RETRIEVAL").otherwise("GENERATION")


def summary(results: DataFrame, category: str, passed: str, applicable: str) -> DataFrame:
    """AG-13 to AG-16: counts and rates per category and in total (``ALL``) in one pass; a rate's denominator leaves nulls out and is 1 without any."""
    rolled = results.rollup(category).agg(F.count("*").alias("n"), F.sum(F.col(passed).cast("int")).alias("n_passed"), F.avg(F.col(applicable).cast("double")).alias("rate"), F.grouping(category).alias("total"))
    return rolled.select(F.when(F.col("total") == 1, "ALL").otherwise(F.col(category)).alias("category"), "n", "n_passed", F.round(F.coalesce("rate", F.lit(1.0)), 4).alias("rate"))


def average_precision(ranked: DataFrame, group: str) -> DataFrame:
    """AG-17, WN-12: rank-weighted average precision; 0 without a relevant row. ranked: group, rank, rel (0/1)."""
    seen = F.sum("rel").over(W.partitionBy(group).orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    marked = ranked.withColumn("p", F.col("rel") * seen / F.col("rank"))
    return marked.groupBy(group).agg(F.round(F.when(F.sum("rel") > 0, F.sum("p") / F.sum("rel")).otherwise(0.0), 6).alias("ap"), F.sum("rel").cast("long").alias("n_relevant"))


#: How far a sample is judged.
TIERS = ("deterministic", "full")


def overall_passed(deterministic: Column, judged: Column, tier: str) -> Column:
    """CD-11: whether a sample passes: by its deterministic checks alone, or, in the full tier, only if a judge passed it, too; a missing judgement fails."""
    if tier not in TIERS:
        raise ValueError(f"unknown tier {tier!r}")
    passed = F.coalesce(deterministic, F.lit(False))
    return passed if tier == "deterministic" else passed & F.coalesce(judged, F.lit(False))
