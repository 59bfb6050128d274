"""Omnibus texts: one document whose articles each amend another document. Their blocks find their own targets: a number in the title, a known name, then configured keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgraph.functions import legal
from lexgraph.storage import kept

from . import instructions, lines, patterns

#: What a document's number looks like, and the spelling of a decree's number that registries differ in.
NUMBER = r"(\d+/\d{4}/[A-ZĐ\-]+\d*)"
DECREE = ("NĐ-CP", "ND-CP")


def blocks(rows: DataFrame) -> DataFrame:
    """WN-11, CD-02: (id, block, number, title, ord, text) of lines (id, ord, text, bold): a bold article heading outside of a quotation opens a block, whose lines follow it. Lines before the first heading go.

    Quotations are those of “ and ”; a line that begins with a quotation mark is no heading."""
    state = lines.quote_state(rows.select("id", "ord", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("bold", F.lit(False)).alias("bold")))
    quoted = (F.col("balance") > 0) | F.ltrim("text").rlike("^[“\"]")
    heading = F.col("text").rlike(instructions.ARTICLE) & F.col("bold") & ~quoted
    marked = state.withColumn("heading", heading).drop("inside", "balance")
    placed = lines.sections(marked, F.col("heading")).where("section is not null")
    titles = placed.where("ord = section").select(F.col("id").alias("of"), F.col("ord").alias("at"), F.col("text").alias("title"), F.regexp_extract("text", instructions.ARTICLE, 1).alias("number"))
    joined = placed.join(titles, placed["id"].eqNullSafe(F.col("of")) & (placed["section"] == F.col("at")))
    return joined.select("id", F.concat_ws("/", "id", "section").alias("block"), "number", "title", "ord", "text")


def plain_number(number: Column) -> Column:
    return F.replace(number, F.lit(DECREE[0]), F.lit(DECREE[1]))


def block_targets(titles: DataFrame, registry: DataFrame, keywords: DataFrame) -> DataFrame:
    """CD-02: (block, document) for blocks (block, source, title); null where nothing names a target.

    registry: number, alias, ord (a number has a row per alias; alias may be null); keywords: source, document, keyword, ord (the first configured document of the block's source with a keyword in the
    title). A number in the title counts in either spelling; a known name in lower case, the longest first."""
    named = titles.select("block", "source", "title", F.nullif(F.regexp_extract("title", NUMBER, 1), F.lit("")).alias("said"))
    numbers = registry.where("number is not null").select("number").distinct()
    spelled = numbers.groupBy(plain_number(F.col("number")).alias("plain")).agg(F.min("number").alias("by_number"))
    exact = numbers.select(F.col("number").alias("exact"))
    found = named.join(exact, F.col("said") == F.col("exact"), "left").join(spelled, plain_number(F.col("said")) == F.col("plain"), "left")
    aliases = registry.where("alias is not null").select(F.col("number").alias("entity"), "alias", "ord")
    by_name = patterns.longest_alias(titles.select(F.col("block").alias("id"), F.rtrim("title").alias("text")), aliases).select(F.col("id").alias("block"), F.col("entity").alias("by_name"))
    asked = titles.join(keywords, "source").where(F.contains("title", F.col("keyword"))).groupBy("block").agg(F.min_by("document", "ord").alias("by_keyword"))
    return found.join(by_name, "block", "left").join(asked, "block", "left").select("block", F.coalesce("exact", "by_number", "by_name", "by_keyword").alias("document"))


_TARGET = "struct<article:string,clause:string,point:string>"


def _completed(target: Column, base: Column) -> Column:
    """A target whose missing parts are those of ``base``."""
    return F.struct(*[F.coalesce(target[f], base[f]).alias(f) for f in ("article", "clause", "point")]).cast(_TARGET)


def with_context(events: DataFrame, bases: DataFrame) -> DataFrame:
    """CD-01, CD-02: events whose targets take missing parts from their context: for a point of a clause, what that clause's own instruction names first, else what the block's title names.

    events: as :func:`lexgraph.operators.instructions.recorded_actions`; bases: id, base (a target or null)."""
    held = kept(events.join(bases.select(F.col("id").alias("of"), "base"), F.col("id") == F.col("of"), "left").drop("of"), "events")
    complete = lambda column, base: F.transform(column, lambda t: _completed(t, base))
    none = F.lit(None).cast(_TARGET)
    own = F.coalesce("base", none)
    parents = held.where("clause is not null and point is null and segment = 0 and size(targets) > 0").select(F.col("id").alias("of"), F.col("clause").alias("in_clause"), F.col("item").alias("parent_item"), F.get(complete(F.col("targets"), own), F.lit(0)).alias("parent"))
    keys = ["id", "item", "k", "segment"]
    inside = held.where("clause is not null and point is not null").select(*keys, "clause")
    last = inside.join(parents, (inside["id"] == F.col("of")) & (inside["clause"] == F.col("in_clause")) & (F.col("parent_item") < inside["item"])).groupBy(*keys).agg(F.max_by("parent", "parent_item").alias("parent"))
    joined = held.join(last, keys, "left")
    base = F.coalesce("parent", own)
    new = {c: complete(F.col(c), F.col("context")) for c in ("targets", "created_targets")}
    return joined.withColumn("context", base).select(*[new.get(c, F.col(c)).alias(c) for c in events.columns])


def record(rows: DataFrame, registry: DataFrame, keywords: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """CD-01, CD-02: the amendment events of texts' lines (id, ord, text, bold); ``id`` of the result is the block, ``source`` its document.

    A block's document is what :func:`block_targets` finds, else, for texts that amend one document, that of ``fallback`` (source, document); blocks without one give nothing. The context of a block is the first unit
    that its whole title names, the heading's own article included."""
    parts = kept(blocks(rows), "omnibus-blocks")
    titles = kept(parts.select("block", F.col("id").alias("source"), "title").distinct(), "omnibus-titles")
    found = block_targets(titles, registry, keywords).join(titles, "block")
    if fallback is not None:
        own = fallback.select(F.col("source").alias("of"), F.col("document").alias("own"))
        found = found.join(own, F.col("source") == F.col("of"), "left").withColumn("document", F.coalesce("document", "own"))
    aimed = kept(found.select("block", "source", "title", "document"), "omnibus-targets")
    first = F.get(legal.targets_udf(F.col("title")), F.lit(0))
    bases = aimed.select(F.col("block").alias("id"), F.struct(*[first[f].alias(f) for f in ("article", "clause", "point")]).cast(_TARGET).alias("base"))
    done = instructions.recorded_actions(parts.select(F.col("block").alias("id"), "ord", "text"), aimed.select(F.col("block").alias("id"), "document"))
    return instructions.settled(with_context(done, bases)).withColumn("source", F.regexp_replace("id", r"/[^/]*$", ""))
