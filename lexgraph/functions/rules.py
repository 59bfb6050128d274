"""Effective rules from closing articles (DT-03, FL-17)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import legal
from . import text as T

SPLIT = r";\s*(?=(?:quy định|Luật|Nghị định|Thông tư|Quyết định|Văn bản))"
GENERAL = r"(?iu)^\s*(?:\d+[a-zđ]?\.\s*)?(?:Luật|Nghị định|Thông tư|Quyết định|Văn bản) này có hiệu lực"
EXTERNAL = r"(?iu)hiệu lực.*theo quy định của pháp luật"


def effective_rules(clauses: DataFrame) -> DataFrame:
    """clauses: document, title, article, clause (null for an article's own text), text -> one row per rule.

    Only articles whose title speaks of effect count. A part with a start, an end or a reference to other law is a rule: EXTERNAL_RULE for the latter without a start, GENERAL
    if the document itself takes effect, else EXPLICIT with the units it names, each once."""
    about = F.lower(F.coalesce("title", F.lit("")))
    closing = clauses.where(F.contains(about, F.lit("hiệu lực")) | F.contains(about, F.lit("điều khoản thi hành")))
    parts = closing.select("document", "article", "clause", F.posexplode(F.split(F.trim("text"), SPLIT)).alias("k", "part"))
    p = F.col("part")
    dated = parts.withColumn("effective_from", T.date_in(p, T.EFFECT_FROM)).withColumn("effective_to", T.date_in(p, T.EFFECT_TO))
    dated = dated.withColumn("external", p.rlike(EXTERNAL) & F.col("effective_from").isNull()).where("external or effective_from is not null or effective_to is not null")
    kind = F.when(F.col("external"), "EXTERNAL_RULE").when(p.rlike(GENERAL), "GENERAL").otherwise("EXPLICIT")
    named = dated.withColumn("rule_type", kind).withColumn("units", legal.targets_udf(p))
    document = T.document_id(F.col("document"))
    unit = lambda t: F.concat_ws("_", document, F.concat(F.lit("D"), t["article"]), F.concat(F.lit("K"), t["clause"]), F.concat(F.lit("D"), t["point"]))
    ids = F.when(F.col("rule_type") == "GENERAL", F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform("units", unit)))
    rule_id = F.concat_ws("_", document, F.lit("ER"), "article", F.coalesce("clause", F.lit("0")), (F.col("k") + 1).cast("string"))
    return named.select(rule_id.alias("rule_id"), "document", "rule_type", ids.alias("targets"), "effective_from", "effective_to", F.when(F.col("external"), F.trim(p)).alias("external_basis"), F.trim(p).alias("raw_text"))
