"""Benchmark datasets: two JSON schemas, flat tables with lists in cells, and the way between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = (
    "id string, category string, question string, expected_provision_ids array<string>, expected_fine_min long, expected_fine_max long, expected_points_deducted long, "
    "is_amended_case boolean, expected_warning_keywords array<string>, ground_truth_answer string, notes string"
)
SLOTS = "struct<fine_min:long,fine_max:long,points_deducted:long>"
ITEM = (
    "id string, test_id string, category string, question string, retrieval struct<must_have:array<string>,must_not_have:array<string>>, "
    f"generation struct<sanctions:map<string,{SLOTS}>,warning_required:boolean,forbidden:array<string>>, ground_truth string"
)
LISTS = ["expected_provision_ids", "expected_warning_keywords"]


def identified(items: DataFrame) -> DataFrame:
    """CD-39: ``id`` and ``test_id`` stand for each other."""
    return items.withColumn("id", F.coalesce("id", "test_id")).withColumn("test_id", F.coalesce("test_id", "id"))


def flat_sample(items: DataFrame) -> DataFrame:
    """PR-17: nested benchmark items as flat samples; of several vehicles' sanctions the last non-null value of each slot, by the vehicles' order."""
    slots = F.map_values(F.coalesce("generation.sanctions", F.create_map().cast(f"map<string,{SLOTS}>")))
    last = lambda slot: F.element_at(F.concat(F.array(F.lit(None).cast("long")), F.filter(F.transform(slots, lambda s: s[slot]), lambda v: v.isNotNull())), -1)
    none = F.array().cast("array<string>")
    return identified(items).select(
        "id", "category", "question", F.coalesce("retrieval.must_have", none).alias("expected_provision_ids"), last("fine_min").alias("expected_fine_min"), last("fine_max").alias("expected_fine_max"),
        last("points_deducted").alias("expected_points_deducted"), F.coalesce("generation.warning_required", F.lit(False)).alias("is_amended_case"), none.alias("expected_warning_keywords"), F.col("ground_truth").alias("ground_truth_answer"), F.lit(None).cast("string").alias("notes"),
    )


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11: samples of a JSON dataset: nested items where the file has them, else flat samples."""
    raw = spark.read.option("multiLine", True).json(path)
    if {"retrieval", "generation"} & set(raw.columns):
        return flat_sample(spark.read.option("multiLine", True).schema(ITEM).json(path))
    return spark.read.option("multiLine", True).schema(SAMPLE).json(path)


def _listed(cell: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """SRC-12, CD-14: samples of a CSV sheet with a header: rows without an id are left out, lists are cut at semicolons, ``TRUE`` in any case is true."""
    names = [part.split()[0] for part in SAMPLE.split(", ")]
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    kinds = {"long": lambda c: F.trim(c).try_cast("long"), "boolean": lambda c: F.coalesce(F.upper(F.trim(c)) == "TRUE", F.lit(False)), "array<string>": _listed, "string": lambda c: F.nullif(F.trim(c), F.lit(""))}
    types = dict(part.split() for part in SAMPLE.split(", "))
    return raw.select(*[kinds[types[c]](F.col(c)).alias(c) for c in names]).where("id is not null").withColumn("category", F.upper("category"))


def save_sheet(samples: DataFrame, path: str) -> None:
    """CD-14: samples as a CSV sheet; lists are joined by semicolons."""
    cells = [F.array_join(c, "; ").alias(c) if c in LISTS else F.col(c) for c in samples.columns]
    samples.select(*cells).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def first_items(items: DataFrame, n: int) -> DataFrame:
    """SO-10: the first ``n`` items by id (the report's own limit)."""
    return items.orderBy("id").limit(n)
