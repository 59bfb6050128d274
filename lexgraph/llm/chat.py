"""Operator 2, chat formatting: multi-party perspective rotation.

For every participant of a conversation the whole dialogue is rendered, with that speaker as the assistant and the others as named users, together with masks: the spans
of the assistant's turns (what is trained on), in code points of the whole rendering, ends exclusive.

A rendering comes in parts of ``part_turns`` consecutive turns (column ``part``), so that no row or task has to hold a conversation of any length. Every participant has every part,
also those in which it is silent (no masks there), and mask offsets continue over the parts: a participant's parts, put together in order, are the
rendering of the whole dialogue. A conversation of at most ``part_turns`` turns has one part.

1. Turns are numbered. Conversations within one part are numbered by a window; longer ones by a range-partitioned sort, whose partitions are numbered by themselves and
   shifted by the counts of those before, so a conversation that holds most of the rows isn't sorted in one task.
2. Where a turn stands follows from two running sums over the part: the characters before it if all turns were other people's, and the number of the speaker's own turns before it (an own
   turn's head differs from a named one by a fixed length). So a participant's masks are one pass over its own turns.
3. The parts are joined with the conversation's participants and rendered by expressions.

Defined results: turns are ordered by turn, then role, then text, nulls first; a null role is the participant ``unknown``, a null text is empty; repeated rows are turns of their own; a null
conv_id is a conversation of its own; markers inside texts are escaped by a backslash; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import cut

UNKNOWN = "unknown"
OPEN, CLOSE = "<|", "|>"
PART_TURNS = 4096
OWN_HEAD = f"{OPEN}assistant{CLOSE}\n"
_SPANS = "array<struct<start:bigint,stop:bigint>>"


def escaped(text: Column) -> Column:
    """Texts can't contain a turn marker."""
    return F.replace(text, F.lit(OPEN), F.lit("<\\|"))


def named_head(name: Column) -> Column:
    return F.concat(F.lit(f"{OPEN}user name="), name, F.lit(f"{CLOSE}\n"))


def numbered(rows: DataFrame, part_turns: int) -> DataFrame:
    """``rows`` with the column ``number`` of each turn in its conversation, from 0."""
    order = ["turn", "who", "text"]
    long_ones = rows.groupBy("conv_id").agg(F.count("*").alias("turns")).where(F.col("turns") > part_turns).select(F.col("conv_id").alias("long_id"), F.lit(True).alias("is_long"))
    marked = rows.join(long_ones, rows["conv_id"].eqNullSafe(long_ones["long_id"]), "left")
    short = marked.where("is_long is null").select(*rows.columns, (F.row_number().over(W.partitionBy("conv_id").orderBy(*order)) - 1).cast("long").alias("number"))
    # the spread lets a range boundary fall between equal turns
    spread = marked.where("is_long").select(*rows.columns, F.xxhash64(F.monotonically_increasing_id()).alias("spread"))
    dealt = cut(spread.repartitionByRange("conv_id", *order, "spread").withColumn("at", F.spark_partition_id()), "chat-long")
    before = dealt.groupBy("conv_id", "at").agg(F.count("*").alias("n"))
    before = before.select(F.col("conv_id").alias("c"), F.col("at").alias("a"), F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("conv_id", "at").orderBy(*order)) - 1
    long_rows = dealt.withColumn("inside", inside).join(before, dealt["conv_id"].eqNullSafe(before["c"]) & (dealt["at"] == before["a"]))
    return short.union(long_rows.select(*rows.columns, (F.col("inside") + F.col("before")).cast("long").alias("number")))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, part, perspective, n_turns, n_own, n_chars (of the part), rendered, masks array<struct<start,stop>> (offsets in the whole rendering)."""
    who = F.coalesce(turns[role_col].cast("string"), F.lit(UNKNOWN))
    rows = turns.select(
        turns[conv_col].cast("long").alias("conv_id"), turns[turn_col].cast("long").alias("turn"), who.alias("who"), F.coalesce(turns[text_col].cast("string"), F.lit("")).alias("text"),
    )
    placed = numbered(rows, part_turns).withColumn("part", F.floor(F.col("number") / part_turns))
    head = F.char_length(named_head(escaped(F.col("who"))))
    placed = placed.withColumn("size", F.char_length(escaped(F.col("text"))).cast("long"))
    placed = placed.withColumn("long_form", head + F.col("size") + 1)  # of a turn that someone else said
    part = W.partitionBy("conv_id", "part").orderBy("number").rowsBetween(W.unboundedPreceding, -1)
    own = W.partitionBy("conv_id", "part", "who").orderBy("number")
    placed = placed.withColumn("before", F.coalesce(F.sum("long_form").over(part), F.lit(0))).withColumn("own_before", F.row_number().over(own) - 1)
    said = F.struct("number", "who", "text", "before", "own_before", "size")
    held = cut(placed.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(said)).alias("turns"), F.sum("long_form").alias("length")), "chat-parts")

    # who takes part, and how often each has spoken before each part in which it does
    spoken = held.select("conv_id", "part", F.explode("turns").alias("t")).groupBy("conv_id", "part", F.col("t.who").alias("perspective")).agg(F.count("*").alias("n_own"))
    people = spoken.groupBy("conv_id", "perspective").agg(F.sum("n_own").alias("all_own"))
    starts = held.select("conv_id", "part", F.coalesce(F.sum("length").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    before_own = spoken.withColumn("own_start", F.coalesce(F.sum("n_own").over(W.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("conv_id", "part", "perspective", "own_start")

    def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
        """Equi-join in which nulls are equal."""
        x, y = left.alias("x"), right.alias("y")
        on = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys]
        return x.join(y, on, how).select("x.*", *[F.col(f"y.{c}") for c in right.columns if c not in keys])

    each = same(same(same(held, starts, ["conv_id", "part"]), people, ["conv_id"]), before_own, ["conv_id", "part", "perspective"], "left")
    own_head = len(OWN_HEAD)
    saved = F.lit(own_head) - F.char_length(named_head(escaped(F.col("perspective"))))  # what an own turn adds to the long form
    shown = each.withColumn("saved", saved).withColumn("own", F.filter("turns", lambda x: x["who"] == F.col("perspective")))
    # a silent part has no own turns, so its own_start isn't needed
    first = lambda x: F.col("start") + x["before"] + (F.coalesce("own_start", F.lit(0)) + x["own_before"]) * F.col("saved") + own_head
    masks = F.transform("own", lambda x: F.struct(first(x).alias("start"), (first(x) + x["size"]).alias("stop"))).cast(_SPANS)
    line = lambda x: F.concat(F.when(x["who"] == F.col("perspective"), F.lit(OWN_HEAD)).otherwise(named_head(escaped(x["who"]))), escaped(x["text"]), F.lit("\n"))
    rendered = F.array_join(F.transform("turns", line), "")
    n_own = F.size("own").cast("long")
    return shown.select("conv_id", "part", "perspective", F.size("turns").cast("long").alias("n_turns"), n_own.alias("n_own"), (F.col("length") + n_own * F.col("saved")).cast("long").alias("n_chars"), rendered.alias("rendered"), masks.alias("masks"))


def query(turns: DataFrame) -> DataFrame:
    """The renderings with masks as text, for comparison by value."""
    shown = F.array_join(F.transform("masks", lambda x: F.concat_ws(":", x["start"].cast("string"), x["stop"].cast("string"))), ",")
    return rotate(turns).select("conv_id", "part", "perspective", "n_turns", "n_own", "n_chars", "rendered", shown.alias("masks"))


SQL = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS who, replace(coalesce(text, ''), '<|', '<\\|') AS txt, coalesce(text, '') AS raw FROM conversations),
people AS (SELECT DISTINCT conv_id, who AS perspective FROM said),
view AS (
  SELECT p.conv_id, p.perspective, s.turn, s.who, s.raw, s.txt, s.who = p.perspective AS own,
    CASE WHEN s.who = p.perspective THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || replace(s.who, '<|', '<\\|') || '|>' || chr(10) END AS head
  FROM people p JOIN said s ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(txt) + 1) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, who, raw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS a,
    row_number() OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, who, raw) AS rn FROM view)
SELECT conv_id, CAST((rn - 1) // {PART_TURNS} AS BIGINT) AS part, perspective, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_own, CAST(sum(length(head) + length(txt) + 1) AS BIGINT) AS n_chars,
  string_agg(head || txt || chr(10), '' ORDER BY rn) AS rendered,
  coalesce(string_agg(CAST(a AS BIGINT) || ':' || CAST(a + length(txt) AS BIGINT), ',' ORDER BY rn) FILTER (WHERE own), '') AS masks
FROM placed GROUP BY conv_id, perspective, part"""
