"""Audits of a corpus in few passes: row checks are one aggregate, key checks share one, reference checks one anti join; and the nine checks of a parsed corpus."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def row_checks(rows: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """VAL-02, VAL-04, VAL-11: (check, n): rows for which each condition holds, all in one pass. A null condition doesn't hold."""
    return rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in checks.items()]).unpivot([], list(checks), "check", "n")


def key_checks(rows: DataFrame, keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """VAL-01, VAL-06, VAL-10: (check, n): keys that occur more than once, for several keys of one table by one aggregate. Rows with a null in a key don't count for it."""
    each = [F.when(~F.concat(*[F.col(c).cast("string") for c in columns]).isNull(), F.struct(F.lit(name).alias("check"), F.to_json(F.struct(*columns)).alias("key"))) for name, columns in keys.items()]
    spread = rows.select(F.explode(F.array_compact(F.array(*each))).alias("x")).select("x.*")
    twice = spread.groupBy("check", "key").agg(F.count("*").alias("rows")).where(F.col("rows") > 1).groupBy("check").agg(F.count("*").alias("n"))
    return _all(rows, keys).join(twice, "check", "left").select("check", F.coalesce("n", F.lit(0)).alias("n"))


def reference_checks(asked: Mapping[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """VAL-05, VAL-12, JN-20: (check, n): rows whose value the known table lacks, for several pairs of tables by one join. asked: check -> (rows, column, known, column). Null values are missing, too."""
    left = right = None
    for name, (rows, column, known, other) in asked.items():
        a = rows.select(F.lit(name).alias("check"), F.col(column).cast("string").alias("value"))
        b = known.select(F.lit(name).alias("check"), F.col(other).cast("string").alias("value")).distinct()
        left, right = (a, b) if left is None else (left.union(a), right.union(b))
    missing = left.join(right, ["check", "value"], "left_anti").groupBy("check").agg(F.count("*").alias("n"))
    return _all(left, asked).join(missing, "check", "left").select("check", F.coalesce("n", F.lit(0)).alias("n"))


def _all(rows: DataFrame, names: Mapping) -> DataFrame:
    return rows.sparkSession.createDataFrame([(x,) for x in names], "check string")


def report(*found: DataFrame) -> DataFrame:
    """AG-24, CD-09: the checks (check, n) with whether each passes, and all of them."""
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return every.union(every.agg(F.lit("all_pass").alias("check"), F.sum("n").alias("n"))).select("check", "n", (F.col("n") == 0).alias("passed"))


def save_audited(rows: DataFrame, path: str, checks: Mapping[str, Column]) -> dict[str, int]:
    """VAL-02, CD-08: write a table and get its row checks from the same pass, as metrics of the write."""
    watch = Observation("audit")
    counts = [F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in checks.items()]
    rows.observe(watch, F.count("*").alias("rows"), *counts).write.mode("overwrite").parquet(path)
    return watch.get


#: Names of the nine checks.
NINE = (
    "issue_1_backfill_originals", "issue_2_amendment_edges", "issue_3_target_documents", "issue_4_quoted_context", "issue_5_deduplication",
    "issue_6_effective_support", "issue_7_duplicate_ids", "issue_8_external_references", "issue_9_cross_document",
)


def nine_checks(edges: DataFrame, units: DataFrame, amendments: DataFrame, support: DataFrame, repairs: DataFrame, external: DataFrame, known_edges: DataFrame, crossing: DataFrame) -> DataFrame:
    """AG-24, VAL-12, CD-08, CD-09: (check, n, passed) of a parsed corpus, and ``all_pass``; n is what a check counts.

    1 units that say what changed them (some must); 2 amendment edges (some); 3 targets without a document, and units whose targets differ from the events' (none); 4 wrong edges of a known
    source (none, and the right one there); 5 repeated (source, target, relation) (none); 6 nodes of effect (some); 7 repaired ids (two at least); 8 external edges (some, and external nodes); 9 documents
    without an edge into their laws (none).

    edges: document, source, target, relation, external; units: id, amended boolean, n_unresolved, expected and actual array<string>; known_edges: source, target, right boolean; crossing: document, prefix. The others are counted."""
    marked = edges.join(F.broadcast(known_edges.select("source", "target", "right")), ["source", "target"], "left")  # a handful of known edges
    facts = marked.agg(F.count_if("external").alias("external"), F.count_if(F.col("right")).alias("right"), F.count_if(~F.col("right")).alias("wrong"))
    repeated = edges.groupBy("source", "target", "relation").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated"))
    differs = (F.size("expected") > 0) & (F.array_sort(F.array_distinct("expected")) != F.array_sort(F.array_distinct("actual")))
    told = units.agg(F.count_if("amended").alias("amended"), (F.coalesce(F.sum("n_unresolved"), F.lit(0)) + F.count_if(differs)).alias("targets"))
    laws = edges.join(F.broadcast(crossing), "document").where(F.startswith("target", F.col("prefix"))).select("document").distinct()
    alone = crossing.select("document").distinct().join(laws, "document", "left_anti").agg(F.count("*").alias("alone"))
    size = lambda df, name: df.agg(F.count("*").alias(name))
    row = facts
    for one in (repeated, told, alone, size(amendments, "amendments"), size(support, "support"), size(repairs, "repairs"), size(external, "nodes")):
        row = row.crossJoin(one)  # each is one row
    c = F.col
    results = [
        (c("amended"), c("amended") > 0), (c("amendments"), c("amendments") > 0), (c("targets"), c("targets") == 0), (c("wrong"), (c("wrong") == 0) & (c("right") > 0)), (c("repeated"), c("repeated") == 0),
        (c("support"), c("support") > 0), (c("repairs"), c("repairs") >= 2), (c("external"), (c("external") > 0) & (c("nodes") > 0)), (c("alone"), c("alone") == 0),
    ]
    listed = F.array(*[F.struct(F.lit(name).alias("check"), n.cast("long").alias("n"), ok.alias("passed")) for name, (n, ok) in zip(NINE, results, strict=True)])
    failed = F.size(F.filter(listed, lambda x: ~x["passed"])).cast("long")
    whole = F.array(F.struct(F.lit("all_pass").alias("check"), failed.alias("n"), (failed == 0).alias("passed")))
    return row.select(F.explode(F.concat(listed, whole)).alias("x")).select("x.*")
