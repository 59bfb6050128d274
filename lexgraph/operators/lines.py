"""Line-level document operators: quote state, sections, merging of broken lines. A document's lines are windows over (document, line number)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgraph.functions import text as T

#: What ends a sentence, and what starts a heading.
ENDINGS = r'[.;:"”)]\s*$'
HEADING = r"^(Điều\s+\d|Chương\s+[IVXLCDM]|[a-zđ]\)|\d+[a-zđ]?\.\s)"


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ord, text) of every line."""
    return docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("ord", "text"))


def without_noise(rows: DataFrame) -> DataFrame:
    """FL-01, FL-02, FL-03: no page numbers, boilerplate or empty lines."""
    keep = ~F.col("text").rlike(T.PAGE_NUMBER) & (F.trim("text") != "")
    for pattern in T.BOILERPLATE:
        keep &= ~F.col("text").rlike(pattern)
    return rows.where(keep)


def quote_state(rows: DataFrame) -> DataFrame:
    """WN-07: whether a line starts inside a quotation: a balance of “ and ” that never falls below 0, or an odd number of straight quotes before it.

    The clamped running sum S_i - min(0, min S_j) needs windows only."""
    w = W.partitionBy("id").orderBy("ord")
    count = lambda c: F.length("text") - F.length(F.replace("text", F.lit(c)))
    s = rows.withColumn("__d", count("“") - count("”")).withColumn("__q", count('"'))
    s = s.withColumn("__s", F.sum("__d").over(w.rowsBetween(W.unboundedPreceding, 0)))
    s = s.withColumn("__low", F.min("__s").over(w.rowsBetween(W.unboundedPreceding, 0)))
    after = F.col("__s") - F.least(F.lit(0), F.col("__low"))
    before = F.coalesce(F.lag(after).over(w), F.lit(0))
    odd = F.coalesce(F.sum("__q").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) % 2
    return s.withColumn("balance", before).withColumn("inside", (before > 0) | (odd == 1)).drop("__d", "__q", "__s", "__low")


def sections(rows: DataFrame, heading: Column) -> DataFrame:
    """WN-08, WN-11: each line with the latest heading at or before it."""
    w = W.partitionBy("id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("section", F.last(F.when(heading, F.col("ord")), ignorenulls=True).over(w))


def merge_broken(rows: DataFrame) -> DataFrame:
    """WN-09: a line joins the one before it unless that ends a sentence or is bold, or the line is a heading or bold. rows: id, ord, text, bold.

    A merged line ends as its last part does, and bold lines never merge, so the previous row decides."""
    w = W.partitionBy("id").orderBy("ord")
    joins = ~F.lag("text").over(w).rlike(ENDINGS) & ~F.lag("bold").over(w) & ~F.col("bold") & ~F.col("text").rlike(HEADING)
    marked = rows.withColumn("__new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    marked = marked.withColumn("island", F.sum("__new").over(w))
    held = marked.groupBy("id", "island").agg(F.sort_array(F.collect_list(F.struct("ord", F.trim("text").alias("t")))).alias("x"), F.min("ord").alias("ord"), F.max("bold").alias("bold"))
    return held.select("id", "ord", F.array_join(F.transform("x", lambda y: y["t"]), " ").alias("text"), "bold")


def fill_forward(rows: DataFrame, key: str, order: list[str], column: str) -> Column:
    """WN-13: a missing value is taken from the next row that has one."""
    return F.first(column, ignorenulls=True).over(W.partitionBy(key).orderBy(*order).rowsBetween(0, W.unboundedFollowing))


def normalised(rows: DataFrame) -> DataFrame:
    """CD-42: paragraphs (id, ord, text, bold) in the fixed order: text, page numbers, boilerplate, empty ones, broken lines."""
    return merge_broken(without_noise(rows.withColumn("text", T.normalise(F.col("text")))))
