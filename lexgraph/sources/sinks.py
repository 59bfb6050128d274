"""Sinks: partitioned tables, upserts by key, indexes, reports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgraph.operators import retrieval


def identifier(name: str) -> str:
    """ST-37: a name that may stand in SQL or a path; raises otherwise."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def save_table(df: DataFrame, path: str, by: str | None = None, fmt: str = "parquet") -> None:
    """SNK-01, SNK-02, SNK-05, SNK-06, SNK-14: overwrite a table, one folder per value of ``by``."""
    writer = df.write.mode("overwrite").format(fmt)
    (writer.partitionBy(identifier(by)) if by else writer).save(path)


def save_postings(units: DataFrame, path: str, n_files: int = 64) -> None:
    """SNK-12: the full-text index as postings, dealt and sorted by term so that a term's rows are read from few row groups."""
    retrieval.postings(units).repartition(n_files, "term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(path)


def merged_by_key(existing: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """SRC-16: rows of ``fresh`` replace those of the same key."""
    return existing.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def metadata(nodes: DataFrame, events: DataFrame) -> DataFrame:
    """SNK-03: per document its chapters, articles, and whether and what it amends. nodes: document_id, label; events: document_id, target."""
    counts = nodes.groupBy("document_id").agg(F.count_if(F.col("label") == "Chapter").alias("n_chapters"), F.count_if(F.col("label") == "Article").alias("n_articles"))
    told = events.groupBy("document_id").agg(F.sort_array(F.collect_set("target")).alias("amended"))
    return counts.join(told, "document_id", "left").withColumn("is_amendment", F.col("amended").isNotNull())


def save_report(df: DataFrame, path: str) -> None:
    """SNK-15, SNK-16, SNK-17: a report as CSV with a header; nested columns as JSON. Reports are one row per benchmark item or category."""
    flat = [F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c) for c, kind in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def rendered(df: DataFrame, fmt: str = "json", rows: int = 20) -> str:
    """SNK-18: the first ``rows`` rows (a display's own limit) as JSON lines or as a table of text."""
    shown = df.limit(rows)
    if fmt == "json":
        return "\n".join(r[0] for r in shown.select(F.to_json(F.struct("*"))).collect())
    cells = [df.columns, *[["" if v is None else str(v) for v in r] for r in shown.collect()]]
    widths = [max(len(row[k]) for row in cells) for k in range(len(df.columns))]
    return "\n".join(" | ".join(cell.ljust(width) for cell, width in zip(row, widths, strict=True)).rstrip() for row in cells)
