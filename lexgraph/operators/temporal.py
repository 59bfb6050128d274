"""Versions and effective rules: slowly changing timelines, points in time, status ladders, ordered text folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def timeline(events: DataFrame, key: str, start: str, tie: str) -> DataFrame:
    """WN-04, WN-05, VB-02..VB-04: versions numbered per key; valid_to is the next valid_from; neighbours' ids."""
    w = W.partitionBy(key).orderBy(start, tie)
    n = F.row_number().over(w)
    return events.withColumn("version_no", n).withColumn("valid_from", F.col(start)).withColumn("valid_to", F.lead(start).over(w)).withColumn("prev_id", F.lag(tie).over(w)).withColumn("next_id", F.lead(tie).over(w)).withColumn("is_current", F.col("valid_to").isNull())


def valid_at(when: Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    """FL-08: half-open validity, null is unbounded."""
    return (F.col(start).isNull() | (F.col(start) <= when)) & (F.col(end).isNull() | (when < F.col(end)))


def rule_active(when: Column, start: str = "effective_from", end: str = "effective_to") -> Column:
    """FL-08, the rules' twin: as :func:`valid_at`, but a rule with neither date isn't active."""
    return valid_at(when, start, end) & (F.col(start).isNotNull() | F.col(end).isNotNull())


def latest(versions: DataFrame, key: str, tie: str) -> DataFrame:
    """JN-02, SO-06: per key the version of the greatest valid_from, a missing one first."""
    w = W.partitionBy(key).orderBy(F.desc_nulls_first("valid_from"), F.desc(tie))
    return versions.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def violations(versions: DataFrame, key: str) -> DataFrame:
    """VAL-08, WN-06: gaps and overlaps between neighbours, reversed intervals, more than one current version."""
    w = W.partitionBy(key).orderBy("valid_from", "version_no")
    checked = versions.withColumn("before", F.lag("valid_to").over(w)).withColumn("has_before", F.lag("version_no").over(w).isNotNull()).withColumn("currents", F.sum(F.col("valid_to").isNull().cast("int")).over(W.partitionBy(key)))
    kind = (
        F.when(F.col("valid_to") <= F.col("valid_from"), "empty").when(F.col("has_before") & F.col("before").isNull(), "open_before_last").when(F.col("has_before") & (F.col("before") < F.col("valid_from")), "gap")
        .when(F.col("has_before") & (F.col("before") > F.col("valid_from")), "overlap").when((F.col("currents") > 1) & F.col("valid_to").isNull(), "two_currents")
    )
    return checked.withColumn("violation", kind).where("violation is not null").select(key, "version_no", "violation")


def applicable_rules(units: DataFrame, rules: DataFrame) -> DataFrame:
    """JN-23: GENERAL rules apply to every unit of their document, the others to their targets.

    units: unit_id, document_id; rules: rule_id, document_id, rule_type, targets array<string>, effective_from, effective_to."""
    general = units.join(rules.where("rule_type = 'GENERAL'").drop("targets"), "document_id")
    pointed = rules.where("rule_type <> 'GENERAL'").withColumn("unit_id", F.explode("targets")).drop("targets", "document_id")
    return general.unionByName(units.join(pointed, "unit_id"))


def evaluate(units: DataFrame, rules: DataFrame, as_of: Column) -> DataFrame:
    """VB-11, AG-08, AG-09: status of each unit at a date.

    EXTERNAL if an external rule points at it; ACTIVE by the best active rule (EXPLICIT before GENERAL, later start, rule order);
    NOT_YET_EFFECTIVE with the earliest start ahead; INACTIVE if rules exist; else UNKNOWN."""
    found = applicable_rules(units, rules).withColumn("active", rule_active(as_of) & (F.col("rule_type") != "EXTERNAL_RULE"))
    rank = F.struct(F.when(F.col("rule_type") == "EXPLICIT", 1).otherwise(0).alias("p"), F.coalesce("effective_from", F.to_date(F.lit("0001-01-01"))).alias("f"), (-F.col("rule_ord")).alias("o"), F.col("rule_id").alias("r"))
    facts = found.groupBy("unit_id").agg(
        F.max((F.col("rule_type") == "EXTERNAL_RULE").cast("int")).alias("external"), F.max(F.when(F.col("active"), rank))["r"].alias("best"), F.max(F.when(F.col("active"), F.lit(1)).otherwise(0)).alias("any_active"),
        F.min(F.when(F.col("effective_from") > as_of, F.col("effective_from"))).alias("starts"), F.count("*").alias("n_rules"),
    )
    joined = units.select("unit_id").join(facts, "unit_id", "left")
    status = F.when(F.col("n_rules").isNull(), "UNKNOWN").when(F.col("external") == 1, "EXTERNAL").when(F.col("any_active") == 1, "ACTIVE").when(F.col("starts").isNotNull(), "NOT_YET_EFFECTIVE").otherwise("INACTIVE")
    out = joined.withColumn("status", status)
    return out.select("unit_id", "status", F.when(F.col("status") == "ACTIVE", F.col("best")).alias("rule_id"), F.when(F.col("status") == "NOT_YET_EFFECTIVE", F.col("starts")).alias("starts"))


def effective_date(units: DataFrame, rules: DataFrame) -> DataFrame:
    """JN-24, AG-07: earliest explicit date of the unit, else of its document's GENERAL rules, else of its untargeted rules; external units have none."""
    pointed = rules.where("rule_type = 'EXPLICIT'").select(F.explode("targets").alias("unit_id"), "effective_from").groupBy("unit_id").agg(F.min("effective_from").alias("own"))
    external = rules.where("rule_type = 'EXTERNAL_RULE'").select(F.explode("targets").alias("unit_id")).distinct().withColumn("external", F.lit(True))
    general = rules.groupBy("document_id").agg(F.min(F.when(F.col("rule_type") == "GENERAL", F.col("effective_from"))).alias("general"), F.min(F.when((F.size("targets") == 0) & (F.col("rule_type") != "EXTERNAL_RULE"), F.col("effective_from"))).alias("untargeted"))
    joined = units.join(pointed, "unit_id", "left").join(external, "unit_id", "left").join(general, "document_id", "left")
    return joined.select("unit_id", F.when(F.col("external").isNull(), F.coalesce("own", "general", "untargeted")).alias("effective_from"))


def legal_status(version_status: Column, is_current: Column, incoming: Column, outgoing: Column) -> Column:
    """PR-09: ordered ladder over a provision's version and its amendments (arrays of operations).

    Without a version any repeal in either direction repeals; with one only incoming repeals count. A change never alters the status."""
    repealed_in, repealed_out = F.array_contains(incoming, "BAI_BO"), F.array_contains(outgoing, "BAI_BO")
    return (
        F.when(version_status.isNull() & (repealed_in | repealed_out), "REPEALED").when(version_status.isNull(), "ACTIVE").when(repealed_in, "REPEALED")
        .when(version_status.isin("EXPIRED", "INACTIVE"), "EXPIRED").when(version_status == "NOT_YET_EFFECTIVE", "NOT_YET_EFFECTIVE").when(~is_current, "SUPERSEDED").otherwise("ACTIVE")
    )


def _apply(state: Column, a: Column) -> Column:
    """One action (op, old_text, new_text) on a struct (text, applied)."""
    text, old, new, op = state["text"], a["old_text"], a["new_text"], a["op"]
    at = F.call_function("instr", text, old)
    found = at > 0
    before, after = F.substr(text, F.lit(1), at - 1), F.substr(text, at + F.length(old), F.length(text))
    changed = (
        F.when(op == "ADD", F.concat(text, new)).when(~found, text).when(op == "REPLACE", F.replace(text, old, new)).when(op == "AFTER", F.concat(before, old, new, after))
        .when(op == "BEFORE", F.concat(before, new, old, after)).when(op == "DELETE", F.trim(F.regexp_replace(F.replace(text, old, F.lit("")), " +", " "))).otherwise(text)
    )
    counts = F.when((op == "ADD") | (found & op.isin("REPLACE", "AFTER", "BEFORE", "DELETE")), 1).otherwise(0)
    return F.struct(changed.alias("text"), (state["applied"] + counts).alias("applied"))


def fold_text(actions: DataFrame, key: str, order: Sequence[str], start: str = "") -> DataFrame:
    """VB-06, ST-40: ordered actions (op, old_text, new_text) of a key applied to its content, as one aggregate over the sorted list.

    REPLACE swaps all occurrences; AFTER and BEFORE insert at the first anchor; DELETE removes all, squeezes blanks and trims; ADD appends. An action whose text isn't
    found is skipped and makes no version. A key's list is one provision's history, which is bounded by its own amendments; :class:`lexgraph.operators.versions.TextVersions` keeps snapshots and folds new actions only."""
    held = actions.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, "op", "old_text", "new_text"))).alias("acts"))
    state = F.struct(F.lit(start).alias("text"), F.lit(0).alias("applied"))
    return held.select(key, F.aggregate("acts", state, _apply).alias("s")).select(key, F.col("s.text").alias("text"), F.col("s.applied").cast("long").alias("n_applied"))


#: Levels by the label of a node.
LEVELS = {"Article": "ARTICLE", "Clause": "CLAUSE", "Point": "POINT", "Appendix": "APPENDIX"}


def level_of(label: Column) -> Column:
    """CD-35: the level of a node's label; null for labels without one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair]), label)


def current_version(versions: DataFrame, key: str, number: str) -> DataFrame:
    """CD-35: the last version of each provision, by its number, as a struct ``version``."""
    return versions.groupBy(key).agg(F.max_by(F.struct(*versions.columns), number).alias("version"))


def rules_of(rules: DataFrame, targets: DataFrame) -> DataFrame:
    """CD-35: rules (rule_id, target_id) that name one of the targets (id)."""
    return rules.join(targets.select(F.col("id").alias("target_id")), "target_id", "left_semi")


def provision_details(provisions: DataFrame, versions: DataFrame, references: DataFrame, amendments: DataFrame) -> DataFrame:
    """PR-16, SO-08: provisions (id, ...) with their current version, references and amendments as arrays, ordered by id.

    versions: id, version_id, ...; references: id, target_id, ...; amendments: id, operation, .... Lists are one provision's own."""
    listed = lambda df, name: df.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in df.columns if c != "id"]))).alias(name))
    out = provisions.join(current_version(versions, "id", "version_id").withColumnRenamed("version", "current_version"), "id", "left")
    return out.join(listed(references, "cross_references"), "id", "left").join(listed(amendments, "amendments"), "id", "left").orderBy("id")


def evaluated_at() -> Column:
    """DT-06: the time of evaluation in UTC, as ISO text; kept out of what is compared."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
