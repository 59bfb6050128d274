"""Operator 8, sharding by extendible hashing. DataFrame functions only.

A row's hash gives 60 bits. The directory is indexed by the first bits; a bucket that exceeds the byte limit splits on its next bit, and only such buckets do, until every
shard fits. Sizes come from a histogram of hash prefixes (map-side combined), ``step`` bits deeper than an even split would need; its levels are
summed from the deepest one upwards and a bucket is a shard when it fits and its parent doesn't. Cells that are still too large are counted again, ``step`` bits deeper, over their own rows only.
Sums and shards are written in as few files as their rows need, not one for each shuffle partition: every file costs a task, and on a local disk processes that set its rights.

A single row beyond the limit is a shard of its own. Rows whose 60 bits are equal (copies of one row) can't be split by bits: they overflow into pages that hold as many
rows as fit, one at least, numbered within input partitions, so no task gathers them.

The hash covers id and text, so a hot id or source doesn't make a hot bucket. Shards are stable: they depend on the rows and the limit only (pages of equal rows are interchangeable).

Defined results: null texts have no bytes, null ids are hashed as such; an empty table has no shards; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import cut

BITS = 60
#: Cells of a histogram that one task sums, and writes in one file.
TASK_CELLS = 250_000


def hash_bits(doc_id: Column, text: Column) -> Column:
    """60 bits of an MD5 of id and text, as a long."""
    seed = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(seed.cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(h: Column, depth: Column) -> Column:
    return F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int"))


def fits(limit: int) -> Column:
    """Whether a bucket is a shard: within the limit, or one row that no split can shrink."""
    return (F.col("bytes") <= limit) | (F.col("rows") == 1)


def tasks(cells: int) -> int:
    """How many tasks sum a histogram of at most so many cells."""
    return min(max(1, math.ceil(cells / TASK_CELLS)), 1 << 30)


def bucket_sums(cells: DataFrame, low: int, high: int, limit: int, stride: int = 6, n_tasks: int = 1 << 30) -> DataFrame:
    """(depth, prefix, bytes, rows) of the buckets above ``cells`` (prefix of ``high`` bits, bytes, rows) and of the cells, from the deepest level upwards, ``stride`` levels at a time.

    A level on which no bucket fits ends it: what lies above is larger. So each cell is summed into a few levels only, however deep the directory is."""
    found, bottom, held = None, high, cells
    while True:
        top = max(low, bottom - stride)
        each = held.select("prefix", "bytes", "rows", F.explode(F.sequence(F.lit(top), F.lit(bottom))).alias("depth"))
        each = each.select("depth", F.call_function("shiftright", "prefix", (F.lit(bottom) - F.col("depth")).cast("int")).alias("prefix"), "bytes", "rows")
        sums = cut(each.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).coalesce(n_tasks), "shard-sums")
        found = sums if found is None else found.union(sums.where(F.col("depth") < bottom))
        held = sums.where(F.col("depth") == top).drop("depth")
        if top == low or not held.where(fits(limit)).limit(1).count():
            return found
        bottom = top


def leaves(cells: DataFrame, low: int, high: int, limit: int, n_tasks: int = 1 << 30) -> DataFrame:
    """Shards among the buckets of depth ``low`` to ``high``: cells (prefix of ``high`` bits, bytes, rows) -> depth, prefix, bytes, rows. Of the deepest cells, those beyond the limit too."""
    sums = bucket_sums(cells, low, high, limit, n_tasks=n_tasks)
    parents = sums.where(~fits(limit)).select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
    roots = sums.where(F.col("depth") == low).select("depth", "prefix")
    return sums.join(parents.union(roots), ["depth", "prefix"], "left_semi").where(fits(limit) | (F.col("depth") == high))


def shards(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", step: int = 6) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, depth, prefix (bits as text), page, shard_bytes, shard_rows."""
    rows = cut(docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(F.octet_length(docs[text_col]), F.lit(0)).cast("long").alias("n_bytes"), hash_bits(docs[id_col], docs[text_col]).alias("h")), "shard-rows")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    low, high = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + step)
    open_rows, n_open, found = rows, 1, []
    while True:
        n_tasks = tasks(n_open << (high - low))
        cells = open_rows.groupBy(_prefix(F.col("h"), F.lit(high)).alias("prefix")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows"))
        now = cut(leaves(cells, low, high, limit, n_tasks).coalesce(n_tasks), "shard-leaves")
        fit = now.where(fits(limit)) if high < BITS else now
        level = open_rows.join(fit.select("depth", "prefix", "bytes", "rows").withColumn("cell_low", F.call_function("shiftleft", "prefix", (F.lit(high) - F.col("depth")).cast("int"))).withColumn("cell_n", F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(high) - F.col("depth")).cast("int"))).select("depth", "prefix", "bytes", "rows", F.explode(F.sequence("cell_low", F.col("cell_low") + F.col("cell_n") - 1)).alias("cell")), _prefix(open_rows["h"], F.lit(high)) == F.col("cell"))
        found.append(level.select("doc_id", "n_bytes", "h", "depth", "prefix", "bytes", "rows"))
        rest = now.where(~fits(limit))
        n_open = rest.count()
        if high >= BITS or not n_open:
            break
        open_rows = cut(open_rows.join(rest.select("prefix"), _prefix(open_rows["h"], F.lit(high)) == F.col("prefix"), "left_semi"), "shard-open")
        low, high = high, min(BITS, high + step)
    placed = found[0]
    for more in found[1:]:
        placed = placed.union(more)
    bits = F.substring(F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), BITS, "0"), -1 * BITS, BITS)
    named = placed.withColumn("bits", F.when(F.col("depth") == 0, F.lit("")).otherwise(F.substr(bits, F.lit(BITS + 1) - F.col("depth"), F.col("depth"))))
    whole = named.where(fits(limit)).select("doc_id", "n_bytes", "depth", F.col("bits").alias("prefix"), F.lit(0).cast("long").alias("page"), F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows"))
    over = named.where(~fits(limit))
    if high < BITS or not n_open:
        return whole
    # equal hashes: rows of one size; number them across partitions without gathering a bucket
    over = cut(over.withColumn("at", F.spark_partition_id()), "shard-overflow")
    counts = over.groupBy("h", "at").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("h").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    number = F.row_number().over(W.partitionBy("h", "at").orderBy("doc_id")) - 1 + F.col("before")
    each = F.greatest(F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1))), F.lit(1))
    paged = over.join(before, ["h", "at"]).withColumn("number", number).withColumn("page", F.floor(F.col("number") / each)).withColumn("held", F.least(each, F.col("rows") - F.col("page") * each))
    return whole.union(paged.select("doc_id", "n_bytes", "depth", F.col("bits").alias("prefix"), "page", F.col("held") * F.col("n_bytes"), "held"))


def directory(assigned: DataFrame) -> DataFrame:
    """The directory of :func:`shards`: entry (bits of the global depth), depth and prefix of the shard it points to. Entries of hash ranges without rows are left out."""
    each = assigned.select("depth", "prefix").distinct()
    depth = each.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("top"))
    free = F.expr("cast(pow(2, top - depth) as bigint)")
    entry = F.when(F.col("top") == F.col("depth"), F.col("prefix")).otherwise(F.concat("prefix", F.lpad(F.conv(F.col("x").cast("string"), 10, 2), F.col("top") - F.col("depth"), F.lit("0"))))
    return each.join(depth).select("depth", "prefix", "top", F.explode(F.sequence(F.lit(0).cast("long"), free - 1)).alias("x")).select(entry.alias("entry"), "depth", "prefix")


#: Bytes of text a shard may hold in the registered query.
LIMIT = 1 << 20

_PREFIXES = " UNION ALL ".join(f"SELECT {d} AS depth, h >> {BITS - d} AS prefix, sum(n_bytes) AS bytes, count(*) AS rows FROM hashed GROUP BY ALL" for d in range(25))
SQL = f"""
WITH hashed AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes, CAST('0x' || md5(concat(coalesce(CAST(doc_id AS VARCHAR), 'null'), ':', md5(coalesce(text, ''))))[1:15] AS BIGINT) AS h FROM documents),
sums AS ({_PREFIXES}),
leaf AS (
  SELECT s.* FROM sums s LEFT JOIN sums p ON p.depth = s.depth - 1 AND p.prefix = s.prefix >> 1 WHERE (s.bytes <= {LIMIT} OR s.rows = 1) AND (s.depth = 0 OR (p.bytes > {LIMIT} AND p.rows > 1)))
SELECT h.doc_id, h.n_bytes, l.depth, CASE WHEN l.depth = 0 THEN '' ELSE lpad(bin(l.prefix), l.depth, '0') END AS prefix, CAST(0 AS BIGINT) AS page, CAST(l.bytes AS BIGINT) AS shard_bytes, l.rows AS shard_rows
FROM hashed h JOIN leaf l ON h.h >> ({BITS} - l.depth) = l.prefix"""
