"""Operators of the corpus: scope, units, amendments, catalogue counts, audits, rule and event checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_scope(articles: DataFrame, chapters: DataFrame, scope: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FL-04: articles of documents in scope (a document without a scope row is whole; with rows, the listed articles only), and the chapters that keep any.

    articles: document_id, chapter_id, id, number; scope: document_id, number."""
    limited = scope.select("document_id").distinct().withColumn("limited", F.lit(True))
    whole = articles.join(limited, "document_id", "left_anti")
    picked = articles.join(scope, ["document_id", "number"], "left_semi").select(*articles.columns)
    kept = whole.unionByName(picked)
    return kept, chapters.join(kept.select(F.col("chapter_id").alias("id")), "id", "left_semi")


def semantic_units(articles: DataFrame, clauses: DataFrame, points: DataFrame, decree: Column) -> DataFrame:
    """PR-04: the unit rows: an article without clauses; the points of a decree's clause that has any; other clauses. Levels 2, 4 and 3.

    articles: id, document_id; clauses: id, article_id, document_id; points: id, clause_id, document_id."""
    a = articles.join(clauses.select(F.col("article_id").alias("id")), "id", "left_anti").select("id", "document_id", F.lit(2).alias("unit_level"))
    p = points.where(decree).select("id", "document_id", F.lit(4).alias("unit_level"))
    split = points.where(decree).select(F.col("clause_id").alias("id")).distinct()
    c = clauses.join(split, "id", "left_anti").select("id", "document_id", F.lit(3).alias("unit_level"))
    return a.union(p).union(c)


def document_amendments(rows: DataFrame) -> DataFrame:
    """JN-09: one row per (target, operation, instruction); the first by ord, its replacement filled by the first non-empty one. rows: target, operation, instruction, replacement, ord."""
    full = F.when(F.coalesce("replacement", F.lit("")) != "", F.col("ord"))
    return rows.groupBy("target", "operation", "instruction").agg(F.min("ord").alias("ord"), F.min_by("replacement", full).alias("replacement"))


def audit(**violations: DataFrame) -> DataFrame:
    """AG-24, VAL-12, CD-09: one row per check with its violations, and whether all pass."""
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n") for name, df in violations.items()]
    every = rows[0]
    for r in rows[1:]:
        every = every.union(r)
    total = every.agg(F.lit("all_pass").alias("check"), F.sum("n").alias("n"))
    return every.union(total).select("check", "n", (F.col("n") == 0).alias("passed"))


def rule_violations(rules: DataFrame, known: DataFrame) -> DataFrame:
    """VAL-07, DT-05: rules without type, with an end not after the start, external ones without basis, with unknown targets, or repeated.

    rules: rule_id, document_id, rule_type, targets array<string>, effective_from, effective_to, external_basis; known: unit_id."""
    of = lambda df, kind: df.select("rule_id", F.lit(kind).alias("violation"))
    bad_type = of(rules.where(~F.coalesce(F.col("rule_type").isin("GENERAL", "EXPLICIT", "EXTERNAL_RULE"), F.lit(False))), "type")
    dates = of(rules.where("effective_to <= effective_from"), "dates")
    basis = of(rules.where("rule_type = 'EXTERNAL_RULE' and (external_basis is null or trim(external_basis) = '')"), "basis")
    asked = rules.select("rule_id", F.explode("targets").alias("unit_id"))
    missing = of(asked.join(known.select("unit_id").distinct(), "unit_id", "left_anti").dropDuplicates(["rule_id"]), "target")
    key = ["document_id", "rule_type", "effective_from", "effective_to", "external_basis", "targets"]
    repeated = rules.groupBy(*key).agg(F.min("rule_id").alias("rule_id"), F.count("*").alias("n")).where("n > 1")
    return bad_type.union(dates).union(basis).union(missing).union(of(repeated, "repeated"))


def event_violations(events: DataFrame) -> DataFrame:
    """VAL-11, VAL-04: repeated targets, repeals with a replacement, changes without one, levels that disagree. events: event_id, operation, target, path, target_level, replacement_level."""
    twice = events.groupBy("event_id", "target").agg(F.count("*").alias("n")).where("n > 1").select("event_id", "target", F.lit("repeated_target").alias("violation"))
    kind = F.when((F.col("operation") == "BAI_BO") & F.col("path").isNotNull(), "repeal_with_path").when(F.col("operation").isin("SUA_DOI", "BO_SUNG") & F.col("path").isNull(), "missing_path").when(F.col("path").isNotNull() & (F.col("target_level") != F.col("replacement_level")), "level")
    return twice.union(events.select("event_id", "target", kind.alias("violation")).where("violation is not null"))


def property_differences(expected: DataFrame, actual: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """VAL-03: (key, column) of every property that differs, nulls equal to nulls; keys that only one side has aren't compared."""
    joined = expected.select(key, *[F.col(c).cast("string").alias(f"e_{c}") for c in columns]).join(actual.select(key, *[F.col(c).cast("string").alias(f"a_{c}") for c in columns]), key)
    wrong = F.array(*[F.when(~F.col(f"e_{c}").eqNullSafe(F.col(f"a_{c}")), F.lit(c)) for c in columns])
    return joined.select(key, F.explode(F.array_compact(wrong)).alias("column"))


def merged_properties(rows: DataFrame, key: str) -> DataFrame:
    """AG-27, MP-02: maps folded by ord, later values win and nulls are left out; ``SemanticUnit`` never replaces a specific label. rows: key, ord, label, props map<string,string>."""
    labels = rows.groupBy(key).agg(F.max_by("label", F.struct(F.col("label") != "SemanticUnit", -F.col("ord"))).alias("label"))
    # the last value of each property by itself, so a hot key's maps are combined before the shuffle and never held together
    each = rows.select(F.col(key).alias("__key"), "ord", F.explode("props").alias("name", "value")).where("value is not null")
    latest = each.groupBy("__key", "name").agg(F.max(F.struct("ord", "value"))["value"].alias("value"))
    held = latest.groupBy("__key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("props"))
    joined = labels.join(held, F.col(key).eqNullSafe(F.col("__key")), "left")
    return joined.select(key, "label", F.coalesce("props", F.create_map().cast("map<string,string>")).alias("props"))


def between_documents(edges: DataFrame, a: str, b: str | None = None) -> DataFrame:
    """FL-07: edges (action, target) that mention document ``a`` at either end; with ``b``, one at each end in either direction."""
    has = lambda c, d: F.contains(F.col(c), F.lit(d))
    if b is None:
        return edges.where(has("action", a) | has("target", a))
    return edges.where((has("action", a) & has("target", b)) | (has("action", b) & has("target", a)))


def extraction_links(units: DataFrame, nodes: DataFrame) -> DataFrame:
    """SNK-10: unit (id, level) to the provision of the same id whose label the level names: 4 Point, 3 Clause, 2 Article."""
    label = F.when(F.col("level") == 4, "Point").when(F.col("level") == 3, "Clause").when(F.col("level") == 2, "Article")
    return units.select("id", label.alias("label")).join(nodes.select("id", "label"), ["id", "label"], "left_semi").select("id", "label")


def created_nodes(replacements: DataFrame, created: DataFrame) -> DataFrame:
    """AR-03, AR-04: replacement nodes (item, level, number) that an insertion creates; the context around them goes."""
    return replacements.join(created, ["item", "level", "number"], "left_semi").select(*replacements.columns)


def appendix_actions(actions: DataFrame, provisions: DataFrame, document_dates: DataFrame) -> DataFrame:
    """VB-07: version events of appendix replacements: V1 from the document's date for an appendix that isn't known yet, then the replacement.

    actions: action_id, target_unit, old_document, old_number, new_document, new_number, effective_date; provisions: id; document_dates: document_id, effective_from."""
    unit = F.coalesce("target_unit", F.concat_ws("", "old_document", F.lit("_PL"), F.trim("old_number")))
    named = actions.withColumn("unit", unit).withColumn("document_id", F.substring_index("unit", "_PL", 1))
    fresh = named.join(provisions.select(F.col("id").alias("unit")), "unit", "left_anti").groupBy("unit", "document_id").agg(F.first("old_number").alias("number"))
    first = fresh.join(document_dates, "document_id", "left").select("unit", F.col("effective_from").alias("valid_from"), "number", F.col("document_id").alias("document"), F.lit(None).cast("string").alias("produced_by"))
    return first.union(named.select("unit", F.col("effective_date"), "new_number", "new_document", "action_id"))
