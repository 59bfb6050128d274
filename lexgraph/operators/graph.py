"""Property-graph operators: hierarchy, traversals, upserts, matching. Nodes and edges are tables; every hop is an equi join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Largest number of rows of a dimension that is sent to every executor; beyond it the join is shuffled.
BROADCAST_ROWS = 100_000


#: Bytes of such a dimension, with its texts.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have at most ``rows`` rows and ``size`` bytes (of its rows as JSON, an upper bound of their values)."""
    whole = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, held = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(whole), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= size else df


def hierarchy(levels: Sequence[tuple[DataFrame, str, Column, Column | None, Column]]) -> DataFrame:
    """PR-03, CD-22: one table of provisions from (table, label, id, parent id, number) per level."""
    out = None
    for depth, (df, label, key, parent, number) in enumerate(levels, 1):
        rows = df.select(F.lit(depth).alias("tree_level"), F.lit(label).alias("label"), key.alias("id"), (F.lit(None).cast("string") if parent is None else parent).alias("parent_id"), number.cast("long").alias("number"))
        out = rows if out is None else out.unionByName(rows)
    return out


def ancestors(nodes: DataFrame, depth: int = 4, above: DataFrame | None = None) -> DataFrame:
    """JN-03: id and its parents, ``parent_1`` (nearest) to ``parent_depth``, by left equi joins of fixed depth. ``above`` are the nodes that can be parents, all unless told."""
    links = (above or nodes).select("id", "parent_id")
    out = nodes.select("id", F.col("parent_id").alias("parent_1"))
    for k in range(2, depth + 1):
        up = links.select(F.col("id").alias("__id"), F.col("parent_id").alias(f"parent_{k}"))
        out = out.join(up, F.col(f"parent_{k - 1}") == F.col("__id"), "left").drop("__id")
    return out


def neighbourhood(down: Sequence[DataFrame], up: Sequence[DataFrame], references: DataFrame, targets: DataFrame, cap: int = 30) -> DataFrame:
    """JN-08: per target id its own row, children and references, and parents; first by priority, at most ``cap`` each (the cap is the report's size).

    ``down`` and ``up`` hold the nodes (id, parent_id) that a hop can reach, one table per hop: of levels above or below a hop's nothing is read."""
    both = references.select("src", "dst").union(references.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    found = [targets.select("id", F.col("id").alias("near"), F.lit(0).alias("priority"))]
    found.append(targets.join(both, targets["id"] == F.col("src")).select("id", F.col("dst").alias("near"), F.lit(2).alias("priority")))
    for tables, key, value, priority in ((down, "parent_id", "id", 1), (up, "id", "parent_id", 3)):
        at = targets.select("id", F.col("id").alias("__m"))
        for nodes in tables:
            hop = nodes.where("parent_id is not null").select(F.col(key).alias("__k"), F.col(value).alias("__v"))
            at = at.join(hop, F.col("__m") == F.col("__k")).select("id", F.col("__v").alias("__m"))
            found.append(at.select("id", F.col("__m").alias("near"), F.lit(priority).alias("priority")))
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    best = every.groupBy("id", "near").agg(F.min("priority").alias("priority"))
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy("priority", "near")))
    return ranked.where(F.col("rank") <= cap)


def directed_both_ways(edges: DataFrame) -> DataFrame:
    """JN-07: every edge from both of its ends, with the direction seen from ``id``."""
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), "rel", F.lit("out").alias("direction"))
    return out.union(edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), "rel", F.lit("in").alias("direction")))


def subgraph(nodes: DataFrame, edges: DataFrame, ids: DataFrame, limit: int = 100) -> DataFrame:
    """JN-12, AG-27, SO-09: edges that touch ``ids``, without repeats, in a total order, at most ``limit``, with both labels."""
    touched = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").union(edges.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns)).distinct()
    picked = touched.orderBy("src", "rel", "dst").limit(limit)
    a, b = nodes.select(F.col("id").alias("src"), F.col("label").alias("src_label")), nodes.select(F.col("id").alias("dst"), F.col("label").alias("dst_label"))
    return picked.join(a, "src", "left").join(b, "dst", "left").select("src", "src_label", "rel", "dst", "dst_label")


def clean_edges(edges: DataFrame, default: str = "THAM_CHIEU") -> DataFrame:
    """SRC-08, FL-15, SNK-04: no missing ends, no self loops; relation upper case with underscores; the first (by ord) of repeats."""
    named = edges.where("src is not null and dst is not null and src <> dst").withColumn("rel", F.replace(F.upper(F.coalesce("rel", F.lit(default))), F.lit(" "), F.lit("_")))
    return named.groupBy("src", "rel", "dst").agg(F.min("ord").alias("ord"))


def upsert_nodes(existing: DataFrame, changes: DataFrame, properties: Sequence[str]) -> DataFrame:
    """SNK-07: per (label, id) the last non-null value of each property by ord; absent values keep what exists."""
    latest = changes.groupBy("label", "id").agg(*[F.max_by(p, F.when(F.col(p).isNotNull(), F.col("ord"))).alias(f"__{p}") for p in properties])
    joined = existing.join(latest, ["label", "id"], "full_outer")
    return joined.select("label", "id", *[F.coalesce(f"__{p}", p).alias(p) for p in properties])


def upsert_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """SNK-08: edges whose ends both exist, once each."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "rel", "dst").distinct()


def containment(children: DataFrame, parents: DataFrame, kind: str) -> DataFrame:
    """JN-11, one kind: child (id, parent_id) to existing parents (id)."""
    return children.join(parents.select(F.col("id").alias("parent_id")), "parent_id").select(F.lit(kind).alias("kind"), F.col("id").alias("child"), "parent_id").distinct()


def prefix_owner(rows: DataFrame, owners: DataFrame, id_col: str = "id", owner_col: str = "owner_id", separator: str = "_") -> DataFrame:
    """JN-04, JN-18, JN-28: the longest owner whose id is a ``separator``-bounded prefix of the row's id.

    All bounded prefixes of an id are few, so the theta join is an equi join on the exploded prefixes."""
    parts = F.split(id_col, separator)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), separator))
    spread = rows.select(F.col(id_col).alias("__row"), F.explode(prefixes).alias(owner_col))
    best = spread.join(owners.select(owner_col), owner_col).groupBy("__row").agg(F.max_by(owner_col, F.length(owner_col)).alias(owner_col))
    return rows.join(best, F.col(id_col) == F.col("__row"), "left").drop("__row")


def back_fill(targets: DataFrame, edges: DataFrame, repeal: str = "BAI_BO") -> DataFrame:
    """JN-19, CD-05, AG-22, AG-23: targets with status, operations by priority and sorted distinct sources; a repeal wins over changes.

    edges: target, source, operation, priority."""
    told = edges.groupBy("target").agg(F.max((F.col("operation") == repeal).cast("int")).alias("repealed"), F.array_sort(F.collect_set(F.struct("priority", "operation"))).alias("ops"), F.sort_array(F.collect_set("source")).alias("sources"))
    joined = targets.join(told, targets["id"] == told["target"], "left")
    status = F.when(F.col("repealed") == 1, "bai_bo").when(F.col("repealed") == 0, "da_sua_doi").otherwise("con_hieu_luc")
    return joined.select("id", status.alias("status"), F.get(F.transform("ops", lambda x: x["operation"]), F.lit(0)).alias("operation"), F.coalesce(F.size("sources"), F.lit(0)).alias("n_sources"), F.array_join("sources", ",").alias("sources"))


def match_targets(targets: DataFrame, replacements: DataFrame) -> DataFrame:
    """JN-22: targets (item, ord, level, number) to replacement nodes of the same item by (level, number), the first by ord; by position only if the
    counts are equal and no replacement is numbered."""
    numbered = replacements.where("number is not null").groupBy("item", "level", "number").agg(F.min("ord").alias("by_number"))
    facts = replacements.groupBy("item").agg(F.count("*").alias("n_r"), F.max(F.col("number").isNotNull().cast("int")).alias("any_number"))
    sizes = targets.groupBy("item").agg(F.count("*").alias("n_t"))
    at = W.partitionBy("item").orderBy("ord")
    placed = replacements.withColumn("pos", F.row_number().over(at)).select("item", "pos", F.col("ord").alias("by_place"))
    asked = targets.withColumn("pos", F.row_number().over(at))
    joined = asked.join(numbered, ["item", "level", "number"], "left").join(placed, ["item", "pos"], "left").join(facts, "item", "left").join(sizes, "item")
    positional = (F.col("n_r") == F.col("n_t")) & (F.col("any_number") == 0)
    return joined.select("item", "ord", F.coalesce("by_number", F.when(positional, F.col("by_place"))).alias("matched"))


def resolve_names(slots: DataFrame, *tables: DataFrame) -> DataFrame:
    """JN-13, JN-14, JN-15: names within a record to ids; the last duplicate of a table wins, the first table that knows the name wins, unknown names drop.

    slots: clause_id, name and further columns; tables: clause_id, name, id, ord."""
    out = slots
    found = []
    for k, table in enumerate(tables):
        last = table.groupBy("clause_id", "name").agg(F.max_by("id", "ord").alias(f"__id{k}"))
        out = out.join(last, ["clause_id", "name"], "left")
        found.append(F.col(f"__id{k}"))
    return out.withColumn("id", F.coalesce(*found)).where("id is not null").drop(*[f"__id{k}" for k in range(len(tables))])


def occurrence_ids(rows: DataFrame, keys: Sequence[str], order: Sequence[str], id_col: str = "id") -> DataFrame:
    """WN-15: the second and later occurrences of an id get the suffix ``__occN``."""
    n = F.row_number().over(W.partitionBy(*keys, id_col).orderBy(*order))
    return rows.withColumn("__n", n).withColumn("unique_id", F.when(F.col("__n") > 1, F.concat(F.col(id_col), F.lit("__occ"), F.col("__n").cast("string"))).otherwise(F.col(id_col))).drop("__n")
