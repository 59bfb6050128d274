"""Queries over the star schema, read as a five-level hierarchy of provisions, and their SQL.

Region, nation, customer, orders and lineitem are document, chapter, article, clause and point; part and supplier are
cross-referenced; the orders of a customer are the versions of a provision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgraph.operators import graph, patterns, temporal

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _id(*parts: tuple[str, str]) -> Column:
    """R1_C2_... of (letter, column) pairs."""
    return F.concat_ws("_", *[F.concat(F.lit(letter), F.col(column).cast("string")) for letter, column in parts])


def nodes(spark: SparkSession, sf_dir: str, deepest: int = 5) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    region, nation = t("region"), t("nation")
    customer = t("customer").join(nation.select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    levels = [
        (region, "Document", _id(("R", "r_regionkey")), None, F.col("r_regionkey")),
        (nation, "Chapter", _id(("R", "n_regionkey"), ("C", "n_nationkey")), _id(("R", "n_regionkey")), F.col("n_nationkey")),
        (customer, "Article", _id(("R", "n_regionkey"), ("C", "c_nationkey"), ("D", "c_custkey")), _id(("R", "n_regionkey"), ("C", "c_nationkey")), F.col("c_custkey")),
    ]
    if deepest >= 4:
        keys = customer.select("c_custkey", "c_nationkey", "n_regionkey")
        orders = t("orders").select("o_orderkey", "o_custkey").join(keys, F.col("o_custkey") == F.col("c_custkey"))
        article, clause = [("R", "n_regionkey"), ("C", "c_nationkey"), ("D", "c_custkey")], ("K", "o_orderkey")
        levels.append((orders, "Clause", _id(*article, clause), _id(*article), F.col("o_orderkey")))
        if deepest >= 5:
            lines = t("lineitem").select("l_orderkey", "l_linenumber").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            levels.append((lines, "Point", _id(*article, clause, ("P", "l_linenumber")), _id(*article, clause), F.col("l_linenumber")))
    return graph.hierarchy(levels)


NODES = """
cust AS (SELECT c.*, n_regionkey, concat('R', n_regionkey, '_C', c_nationkey, '_D', c_custkey) AS cid FROM customer c JOIN nation ON c_nationkey = n_nationkey),
ord AS (SELECT o_orderkey, cid, concat(cid, '_K', o_orderkey) AS oid FROM orders JOIN cust ON o_custkey = c_custkey),
nodes AS (
  SELECT 1 AS tree_level, 'Document' AS label, concat('R', r_regionkey) AS id, CAST(NULL AS VARCHAR) AS parent_id, CAST(r_regionkey AS BIGINT) AS number FROM region
  UNION ALL SELECT 2, 'Chapter', concat('R', n_regionkey, '_C', n_nationkey), concat('R', n_regionkey), n_nationkey FROM nation
  UNION ALL SELECT 3, 'Article', cid, concat('R', n_regionkey, '_C', c_nationkey), c_custkey FROM cust
  UNION ALL SELECT 4, 'Clause', oid, cid, o_orderkey FROM ord
  UNION ALL SELECT 5, 'Point', concat(oid, '_P', l_linenumber), oid, l_linenumber FROM lineitem JOIN ord ON l_orderkey = o_orderkey)"""


@query(f"WITH {NODES} SELECT * FROM nodes")
def pr03_hierarchy(spark, sf_dir):
    """PR-03, CD-22, CD-33, VB-01: all provisions."""
    return nodes(spark, sf_dir)


@query("""WITH cust AS (SELECT c_custkey, concat('R', n_regionkey) AS r, concat('R', n_regionkey, '_C', c_nationkey) AS c, concat('R', n_regionkey, '_C', c_nationkey, '_D', c_custkey) AS d FROM customer JOIN nation ON c_nationkey = n_nationkey),
ord AS (SELECT o_orderkey, r, c, d, concat(d, '_K', o_orderkey) AS k FROM orders JOIN cust ON o_custkey = c_custkey)
SELECT concat('R', r_regionkey) AS id, CAST(NULL AS VARCHAR) AS parent_1, CAST(NULL AS VARCHAR) AS parent_2, CAST(NULL AS VARCHAR) AS parent_3, CAST(NULL AS VARCHAR) AS parent_4 FROM region
UNION ALL SELECT concat('R', n_regionkey, '_C', n_nationkey), concat('R', n_regionkey), NULL, NULL, NULL FROM nation UNION ALL SELECT d, c, r, NULL, NULL FROM cust UNION ALL SELECT k, d, c, r, NULL FROM ord
UNION ALL SELECT concat(k, '_P', l_linenumber), k, d, c, r FROM lineitem JOIN ord ON l_orderkey = o_orderkey""")
def jn03_ancestor_chain(spark, sf_dir):
    """JN-03: parents of every provision, points included."""
    n = nodes(spark, sf_dir)
    # a point has no children, so only the levels above can be parents
    return graph.ancestors(n, above=n.where("label <> 'Point'"))


@query("SELECT r_name, n_name, count(DISTINCT c_custkey) AS n_articles, count(DISTINCT c_mktsegment) AS n_segments FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL ORDER BY n_articles DESC, n_name LIMIT 10 OFFSET 5")
def jn29_catalogue(spark, sf_dir):
    """JN-29, AG-01, SO-07: catalogue with article counts, sorted, with offset and limit (a page of the report)."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = n.join(table(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    counts = joined.groupBy("r_name", "n_name").agg(F.countDistinct("c_custkey").alias("n_articles"), F.countDistinct("c_mktsegment").alias("n_segments"))
    return counts.orderBy(F.desc("n_articles"), "n_name").offset(5).limit(10)


@query(f"WITH {NODES}, docs AS (SELECT id FROM nodes WHERE label IN ('Document', 'Chapter')) SELECT a.id, arg_max(d.id, length(d.id)) AS owner_id FROM nodes a LEFT JOIN docs d ON a.id = d.id OR starts_with(a.id, d.id || '_') WHERE a.label = 'Clause' GROUP BY a.id")
def jn04_prefix_owner(spark, sf_dir):
    """JN-04, JN-18, FL-06: the longest owner whose id is a prefix, as an equi join on exploded prefixes."""
    n = nodes(spark, sf_dir, 4)
    return graph.prefix_owner(n.where("label = 'Clause'").select("id"), n.where("label in ('Document', 'Chapter')").select(F.col("id").alias("owner_id")))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    src = F.concat(F.lit("O"), F.col("l_orderkey").cast("string"))
    part = lines.select(src.alias("src"), F.lit("USES").alias("rel"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("dst"))
    return part.union(lines.select(src.alias("src"), F.lit("FROM").alias("rel"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("dst"))).distinct()


REFERENCES = "refs AS (SELECT DISTINCT concat('O', l_orderkey) AS src, 'USES' AS rel, concat('P', l_partkey) AS dst FROM lineitem UNION SELECT DISTINCT concat('O', l_orderkey), 'FROM', concat('S', l_suppkey) FROM lineitem)"


@query(f"""WITH {REFERENCES}, both_ways AS (SELECT src AS id, dst AS other, rel, 'out' AS direction FROM refs UNION ALL SELECT dst, src, rel, 'in' FROM refs),
b AS (SELECT id, direction, rel, CAST(substr(other, 2) AS BIGINT) // 1000 AS bucket, count(*) AS n, min(other) AS first, md5(string_agg(other, ',' ORDER BY other)) AS part FROM both_ways GROUP BY ALL)
SELECT id, direction, rel, CAST(sum(n) AS BIGINT) AS n, min(first) AS first, md5(string_agg(part, ',' ORDER BY bucket)) AS others FROM b GROUP BY id, direction, rel""")
def jn07_references_both_ways(spark, sf_dir):
    """JN-05, JN-06, JN-07, AG-02: every reference from both of its ends. Lists are digests of buckets of a thousand numbers each, so a supplier's list, which grows with the data, is never held as one."""
    both = graph.directed_both_ways(references(spark, sf_dir)).withColumn("bucket", F.floor(F.substring("other", 2, 20).cast("long") / 1000))
    ordered = lambda key, value: F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, value))), lambda x: x[value]), ",").cast("binary"))
    parts = both.groupBy("id", "direction", "rel", "bucket").agg(F.count("*").alias("n"), F.min("other").alias("first"), F.md5(F.array_join(F.sort_array(F.collect_list("other")), ",").cast("binary")).alias("part"))
    return parts.groupBy("id", "direction", "rel").agg(F.sum("n").alias("n"), F.min("first").alias("first"), ordered("bucket", "part").alias("others"))


@query(f"WITH {REFERENCES} SELECT dst AS id, count(*) AS n_in, count(DISTINCT rel) AS n_rel FROM refs GROUP BY dst")
def jn05_incoming_counts(spark, sf_dir):
    """JN-05: incoming references of every target, counted."""
    return references(spark, sf_dir).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_in"), F.countDistinct("rel").alias("n_rel"))


@query(f"""WITH {NODES}, {REFERENCES},
lookup AS (SELECT oid, o_orderkey FROM ord),
links AS (SELECT oid AS src, dst FROM refs JOIN lookup ON src = concat('O', o_orderkey)),
targets AS (SELECT id FROM nodes WHERE label = 'Clause'),
c1 AS (SELECT t.id, n.id AS near FROM targets t JOIN nodes n ON n.parent_id = t.id),
p1 AS (SELECT t.id, n.parent_id AS near FROM targets t JOIN nodes n ON n.id = t.id WHERE n.parent_id IS NOT NULL),
every AS (SELECT id, id AS near, 0 AS priority FROM targets UNION ALL SELECT id, near, 1 FROM c1 UNION ALL SELECT c1.id, n.id, 1 FROM c1 JOIN nodes n ON n.parent_id = c1.near
  UNION ALL SELECT t.id, l.dst, 2 FROM targets t JOIN links l ON l.src = t.id UNION ALL SELECT id, near, 3 FROM p1 UNION ALL SELECT p1.id, n.parent_id, 3 FROM p1 JOIN nodes n ON n.id = p1.near WHERE n.parent_id IS NOT NULL),
best AS (SELECT id, near, min(priority) AS priority FROM every GROUP BY id, near),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY priority, near) AS rank FROM best)
SELECT * FROM ranked WHERE rank <= 30""")
def jn08_neighbourhood(spark, sf_dir):
    """JN-08: neighbourhoods of all clauses, at most 30 rows each (the operator's own cap). A clause's children are points without children; its parents are articles, theirs chapters."""
    n = nodes(spark, sf_dir)
    level = lambda label: n.where(F.col("label") == label).select("id", "parent_id")
    clauses = n.where("label = 'Clause'").select("id", F.concat(F.lit("O"), F.col("number").cast("string")).alias("key"))
    links = references(spark, sf_dir).join(clauses, F.col("src") == F.col("key")).select(F.col("id").alias("src"), "dst")
    return graph.neighbourhood([level("Point")], [level("Clause"), level("Article")], links, clauses.select("id"))


@query("SELECT 'nation-region' AS kind, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'customer-nation', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'order-customer', count(*) FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'line-order', count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) JOIN orders ON l_orderkey = o_orderkey")
def jn11_containment(spark, sf_dir):
    """JN-11, SE-09, AG-04, AG-05: containment links by kind."""
    t = lambda n: table(spark, sf_dir, n)
    kinds = [
        ("nation-region", t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("parent_id")), t("region").select(F.col("r_regionkey").alias("id"))),
        ("customer-nation", t("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("parent_id")), t("nation").select(F.col("n_nationkey").alias("id"))),
        ("order-customer", t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("parent_id")), t("customer").select(F.col("c_custkey").alias("id"))),
        ("line-order", t("lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").alias("parent_id")), t("orders").select(F.col("o_orderkey").alias("id"))),
    ]
    out = None
    for kind, child, parent in kinds:
        rows = graph.containment(child.withColumn("id", F.col("id").cast("string")), parent, kind).groupBy("kind").agg(F.count("*").alias("n"))
        out = rows if out is None else out.union(rows)
    return out


@query(f"""WITH {REFERENCES}, ids AS (SELECT concat('O', o_orderkey) AS id FROM orders),
picked AS (SELECT * FROM refs WHERE src IN (SELECT id FROM ids) OR dst IN (SELECT id FROM ids) ORDER BY src, rel, dst LIMIT 100),
lab AS (SELECT concat('O', o_orderkey) AS id, o_orderstatus AS label FROM orders UNION ALL SELECT concat('P', p_partkey), p_brand FROM part UNION ALL SELECT concat('S', s_suppkey), s_name FROM supplier)
SELECT src, a.label AS src_label, rel, dst, b.label AS dst_label FROM picked LEFT JOIN lab a ON a.id = src LEFT JOIN lab b ON b.id = dst""")
def jn12_subgraph(spark, sf_dir):
    """JN-12, AG-27, SO-09: one-hop subgraph of given ids, at most 100 edges (the operator's own limit)."""
    t = lambda n: table(spark, sf_dir, n)
    labels = t("orders").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderstatus").alias("label"))
    labels = labels.union(t("part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")), "p_brand")).union(t("supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")), "s_name"))
    ids = t("orders").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("id"))
    return graph.subgraph(labels, references(spark, sf_dir), ids)


@query("""WITH acts AS (SELECT l_orderkey AS target, concat('S', l_suppkey) AS source, CASE WHEN l_returnflag = 'R' THEN 'BAI_BO' WHEN l_returnflag = 'A' THEN 'SUA_DOI' END AS operation, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 2 END AS priority FROM lineitem WHERE l_returnflag IN ('R', 'A')),
told AS (SELECT target, max(CASE WHEN operation = 'BAI_BO' THEN 1 ELSE 0 END) AS rep, arg_min(operation, priority) AS operation, list_sort(list(DISTINCT source)) AS sources FROM acts GROUP BY target)
SELECT o_orderkey AS id, CASE WHEN rep = 1 THEN 'bai_bo' WHEN rep = 0 THEN 'da_sua_doi' ELSE 'con_hieu_luc' END AS status, operation, coalesce(len(sources), 0) AS n_sources, array_to_string(sources, ',') AS sources FROM orders LEFT JOIN told ON target = o_orderkey""")
def jn19_back_fill(spark, sf_dir):
    """JN-19, CD-05, AG-22, AG-23: returned lines as amendments of their orders."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag in ('R', 'A')")
    edges = lines.select(F.col("l_orderkey").alias("target"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("source"), F.when(F.col("l_returnflag") == "R", "BAI_BO").otherwise("SUA_DOI").alias("operation"), F.when(F.col("l_returnflag") == "R", 1).otherwise(2).alias("priority"))
    return graph.back_fill(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), edges)


@query("SELECT 'order_without_line' AS kind, CAST(o_orderkey AS BIGINT) AS id FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey UNION ALL SELECT 'customer_without_order', c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey UNION ALL SELECT 'dangling_reference', l_orderkey FROM (SELECT DISTINCT l_orderkey FROM lineitem) ANTI JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'F') ON l_orderkey = o_orderkey")
def jn20_anti_joins(spark, sf_dir):
    """JN-17, JN-20, JN-21, JN-26, VAL-05: what has no counterpart."""
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").select("l_orderkey").distinct()
    a = t("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select(F.lit("order_without_line").alias("kind"), F.col("o_orderkey").cast("long").alias("id"))
    b = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.lit("customer_without_order"), F.col("c_custkey"))
    c = lines.join(t("orders").where("o_orderstatus <> 'F'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select(F.lit("dangling_reference"), F.col("l_orderkey"))
    return a.union(b).union(c)


@query("""WITH t AS (SELECT l_orderkey AS item, l_linenumber AS ord, 'POINT' AS level, CAST(l_linenumber AS BIGINT) AS number FROM lineitem WHERE l_returnflag <> 'N'),
r AS (SELECT l_orderkey AS item, l_linenumber AS ord, 'POINT' AS level, CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE CAST(l_linenumber AS BIGINT) END AS number FROM lineitem WHERE l_linestatus = 'F'),
nr AS (SELECT item, count(*) AS n_r, max(CASE WHEN number IS NOT NULL THEN 1 ELSE 0 END) AS anyn FROM r GROUP BY item), nt AS (SELECT item, count(*) AS n_t FROM t GROUP BY item),
tp AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY ord) AS pos FROM t), rp AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY ord) AS pos FROM r),
rn AS (SELECT item, level, number, min(ord) AS o FROM r WHERE number IS NOT NULL GROUP BY ALL)
SELECT tp.item, tp.ord, coalesce(rn.o, CASE WHEN n_r = n_t AND anyn = 0 THEN rp.ord END) AS matched FROM tp LEFT JOIN rn ON rn.item = tp.item AND rn.level = tp.level AND rn.number = tp.number LEFT JOIN rp ON rp.item = tp.item AND rp.pos = tp.pos LEFT JOIN nr ON nr.item = tp.item JOIN nt ON nt.item = tp.item""")
def jn22_match_targets(spark, sf_dir):
    """JN-22: match by number, by position only if nothing is numbered and the counts agree."""
    lines = table(spark, sf_dir, "lineitem")
    shape = [F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("ord"), F.lit("POINT").alias("level")]
    targets = lines.where("l_returnflag <> 'N'").select(*shape, F.col("l_linenumber").cast("long").alias("number"))
    replacements = lines.where("l_linestatus = 'F'").select(*shape, F.when(F.col("l_orderkey") % 3 != 0, F.col("l_linenumber").cast("long")).alias("number"))
    return graph.match_targets(targets, replacements)


@query("""WITH e AS (SELECT concat('O', l_orderkey) AS src, concat('P', l_partkey) AS dst, CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN 'can cu' ELSE 'ngoai_le' END AS rel, l_orderkey * 10 + l_linenumber AS ord FROM lineitem)
SELECT src, replace(upper(coalesce(rel, 'THAM_CHIEU')), ' ', '_') AS rel, dst, min(ord) AS ord FROM e GROUP BY ALL""")
def src08_clean_edges(spark, sf_dir):
    """SRC-08, FL-15, SNK-04, MP-01: normalised reference edges, the first of repeats."""
    n = F.col("l_linenumber") % 3
    rel = F.when(n == 1, "can cu").when(n == 2, "ngoai_le")
    edges = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("dst"), rel.alias("rel"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return graph.clean_edges(edges)


@query("""WITH ch AS (SELECT 'Clause' AS label, l_orderkey AS id, (((l_linenumber * 100000 + l_partkey) * 10000 + l_suppkey) * 4 + ascii(l_returnflag) % 4) * 2 + ascii(l_linestatus) % 2 AS ord, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS flag, l_linestatus AS state FROM lineitem),
last AS (SELECT label, id, arg_max(flag, ord) FILTER (WHERE flag IS NOT NULL) AS f, arg_max(state, ord) AS s FROM ch GROUP BY ALL),
ex AS (SELECT 'Clause' AS label, o_orderkey AS id, 'X' AS flag, o_orderstatus AS state FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(ex.label, last.label) AS label, coalesce(ex.id, last.id) AS id, coalesce(f, flag) AS flag, coalesce(s, state) AS state FROM ex FULL JOIN last ON ex.label = last.label AND ex.id = last.id""")
def snk07_node_upsert(spark, sf_dir):
    """SNK-07, MP-02: merge changes into existing nodes; the last non-null property wins, absent ones stay."""
    changes = table(spark, sf_dir, "lineitem").select(F.lit("Clause").alias("label"), F.col("l_orderkey").alias("id"), ((((F.col("l_linenumber") * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")) * 4 + F.ascii("l_returnflag") % 4) * 2 + F.ascii("l_linestatus") % 2).alias("ord"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).alias("flag"), F.col("l_linestatus").alias("state"))
    existing = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.lit("Clause").alias("label"), F.col("o_orderkey").alias("id"), F.lit("X").alias("flag"), F.col("o_orderstatus").alias("state"))
    return graph.upsert_nodes(existing, changes, ["flag", "state"])


@query(f"WITH {REFERENCES}, ids AS (SELECT concat('O', o_orderkey) AS id FROM orders WHERE o_orderstatus = 'F' UNION SELECT concat('P', p_partkey) FROM part WHERE p_size > 10) SELECT rel, count(*) AS n FROM refs WHERE src IN (SELECT id FROM ids) AND dst IN (SELECT id FROM ids) GROUP BY rel")
def snk08_edge_upsert(spark, sf_dir):
    """SNK-08, AG-04: edges with existing ends, counted by type."""
    ids = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("id"))
    ids = ids.union(table(spark, sf_dir, "part").where("p_size > 10").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string"))))
    return graph.upsert_edges(ids, references(spark, sf_dir)).groupBy("rel").agg(F.count("*").alias("n"))


@query("""WITH slot AS (SELECT l_orderkey AS clause_id, concat('n', l_partkey % 50) AS name, l_linenumber AS slot FROM lineitem),
a AS (SELECT l_orderkey AS clause_id, concat('n', l_suppkey % 50) AS name, arg_max(concat('a', l_linenumber), l_linenumber) AS i FROM lineitem GROUP BY 1, 2),
b AS (SELECT l_orderkey AS clause_id, concat('n', l_partkey % 50) AS name, arg_max(concat('b', l_linenumber), l_linenumber) AS i FROM lineitem WHERE l_quantity > 25 GROUP BY 1, 2)
SELECT slot.clause_id, slot.name, slot, coalesce(a.i, b.i) AS id FROM slot LEFT JOIN a ON a.clause_id = slot.clause_id AND a.name = slot.name LEFT JOIN b ON b.clause_id = slot.clause_id AND b.name = slot.name WHERE coalesce(a.i, b.i) IS NOT NULL""")
def jn13_resolve_names(spark, sf_dir):
    """JN-13, JN-14, JN-15, AG-28: names to ids within a record, over two tables in order."""
    lines = table(spark, sf_dir, "lineitem")
    name = lambda c: F.concat(F.lit("n"), (F.col(c) % 50).cast("string")).alias("name")
    key, n = F.col("l_orderkey").alias("clause_id"), F.col("l_linenumber")
    slots = lines.select(key, name("l_partkey"), n.alias("slot"))
    first = lines.select(key, name("l_suppkey"), F.concat(F.lit("a"), n.cast("string")).alias("id"), n.alias("ord"))
    second = lines.where("l_quantity > 25").select(key, name("l_partkey"), F.concat(F.lit("b"), n.cast("string")).alias("id"), n.alias("ord"))
    return graph.resolve_names(slots, first, second)


@query("WITH r AS (SELECT user_id, event_type AS id, ts, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) SELECT user_id, event_id, CASE WHEN n > 1 THEN concat(id, '__occ', n) ELSE id END AS unique_id FROM r")
def wn15_occurrence_ids(spark, sf_dir):
    """WN-15: repeated ids get an occurrence suffix."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("id"), "ts", "event_id")
    return graph.occurrence_ids(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "unique_id")


@query("WITH a AS (SELECT lower(r_name) AS alias, r_name AS entity, r_regionkey AS ord FROM region UNION ALL SELECT lower(left(p_brand, 7)), left(p_brand, 7), 100 + min(p_partkey) FROM part GROUP BY left(p_brand, 7)), h AS (SELECT p_partkey AS id, entity, row_number() OVER (PARTITION BY p_partkey ORDER BY length(alias) DESC, ord) AS rn FROM part JOIN a ON contains(lower(concat(p_name, ' ', p_brand, ' ', p_type)), alias)) SELECT p_partkey AS id, entity FROM part LEFT JOIN h ON h.id = p_partkey AND rn = 1")
def jn25_longest_alias(spark, sf_dir):
    """JN-25: the longest alias contained in a text."""
    parts = table(spark, sf_dir, "part")
    brand = F.substring("p_brand", 1, 7)
    aliases = table(spark, sf_dir, "region").select(F.col("r_name").alias("entity"), F.col("r_name").alias("alias"), F.col("r_regionkey").cast("long").alias("ord"))
    aliases = aliases.union(parts.groupBy(brand.alias("entity")).agg((F.min("p_partkey") + 100).alias("ord")).select("entity", F.col("entity").alias("alias"), "ord"))
    return patterns.longest_alias(parts.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text")), aliases)


VERSIONS = """v AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER w AS version_no, o_orderdate AS valid_from, lead(o_orderdate) OVER w AS valid_to, lag(o_orderkey) OVER w AS prev_id, lead(o_orderkey) OVER w AS next_id
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return temporal.timeline(rows, "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus", "version_no", "valid_from", "valid_to", "prev_id", "next_id", "is_current")


@query(f"WITH {VERSIONS} SELECT *, valid_to IS NULL AS is_current FROM v")
def wn04_version_timeline(spark, sf_dir):
    """WN-04, WN-05, SNK-09, VB-02, VB-03: versions per provision."""
    return versions(spark, sf_dir)


@query(f"WITH {VERSIONS} SELECT o_custkey, o_orderkey, version_no FROM v WHERE valid_from <= TIMESTAMP '1996-06-01' AND (valid_to IS NULL OR TIMESTAMP '1996-06-01' < valid_to)")
def vb10_point_in_time(spark, sf_dir):
    """VB-10, JN-27, FL-08: the versions valid at a date."""
    when = F.lit("1996-06-01").cast("timestamp_ntz")
    return versions(spark, sf_dir).where(temporal.valid_at(when)).select("o_custkey", "o_orderkey", "version_no")


@query("WITH v AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS valid_from FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY valid_from DESC NULLS FIRST, o_orderkey DESC) AS n FROM v) SELECT o_custkey, o_orderkey, valid_from FROM r WHERE n = 1")
def jn02_latest_version(spark, sf_dir):
    """JN-02, SO-06: the latest version, missing dates first."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("valid_from"))
    return temporal.latest(rows, "o_custkey", "o_orderkey")


@query(f"""WITH {VERSIONS}, w AS (SELECT *, lag(valid_to) OVER p AS bf, lag(version_no) OVER p AS bn, sum(CASE WHEN valid_to IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) AS cur FROM v WHERE o_orderstatus <> 'P' WINDOW p AS (PARTITION BY o_custkey ORDER BY valid_from, version_no)),
k AS (SELECT *, CASE WHEN valid_to <= valid_from THEN 'empty' WHEN bn IS NOT NULL AND bf IS NULL THEN 'open_before_last' WHEN bn IS NOT NULL AND bf < valid_from THEN 'gap' WHEN bn IS NOT NULL AND bf > valid_from THEN 'overlap' WHEN cur > 1 AND valid_to IS NULL THEN 'two_currents' END AS violation FROM w)
SELECT o_custkey, version_no, violation FROM k WHERE violation IS NOT NULL""")
def val08_timeline_violations(spark, sf_dir):
    """VAL-08, WN-06: adjacency checks after versions of one status are taken out."""
    return temporal.violations(versions(spark, sf_dir).where("o_orderstatus <> 'P'"), "o_custkey")


def _rules(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.to_date("o_orderdate").alias("d"))
    units = orders.select(F.col("o_orderkey").alias("unit_id"), F.col("o_orderpriority").alias("document_id"))
    general = orders.groupBy("o_orderpriority").agg(F.min("d").alias("f")).where("o_orderpriority not like '%LOW%'").select(F.concat(F.lit("G"), F.col("o_orderpriority")).alias("rule_id"), F.col("o_orderpriority").alias("document_id"), F.lit("GENERAL").alias("rule_type"), F.array().cast("array<bigint>").alias("targets"), (F.col("f") + 1000).alias("effective_from"), F.lit(None).cast("date").alias("effective_to"), F.lit(0).cast("long").alias("rule_ord"))
    pointed = orders.where("o_orderkey % 3 = 0").select(F.concat(F.lit("E"), F.col("o_orderkey").cast("string")), "o_orderpriority", F.when(F.col("o_orderstatus") == "P", "EXTERNAL_RULE").otherwise("EXPLICIT"), F.array("o_orderkey"), "d", F.when(F.col("o_orderkey") % 2 == 0, F.col("d") + 400), F.col("o_orderkey"))
    return units, general.union(pointed)


RULES = """o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, CAST(o_orderdate AS DATE) AS d FROM orders),
g AS (SELECT concat('G', o_orderpriority) AS rule_id, o_orderpriority AS doc, min(d) + 1000 AS f FROM o WHERE o_orderpriority NOT LIKE '%LOW%' GROUP BY o_orderpriority),
found AS (SELECT o_orderkey AS unit_id, rule_id, 'GENERAL' AS t, f, CAST(NULL AS DATE) AS e, 0 AS rord FROM o JOIN g ON doc = o_orderpriority
  UNION ALL SELECT o_orderkey, concat('E', o_orderkey), CASE WHEN o_orderstatus = 'P' THEN 'EXTERNAL_RULE' ELSE 'EXPLICIT' END, d, CASE WHEN o_orderkey % 2 = 0 THEN d + 400 END, o_orderkey FROM o WHERE o_orderkey % 3 = 0)"""


@query(f"""WITH {RULES}, a AS (SELECT *, t <> 'EXTERNAL_RULE' AND f <= DATE '1996-06-01' AND (e IS NULL OR DATE '1996-06-01' < e) AS act FROM found),
s AS (SELECT unit_id, max(CASE WHEN t = 'EXTERNAL_RULE' THEN 1 ELSE 0 END) AS ext, max(CASE WHEN act THEN 1 ELSE 0 END) AS anya, min(CASE WHEN f > DATE '1996-06-01' THEN f END) AS starts FROM a GROUP BY unit_id),
b AS (SELECT unit_id, rule_id, row_number() OVER (PARTITION BY unit_id ORDER BY CASE WHEN t = 'EXPLICIT' THEN 0 ELSE 1 END, f DESC, rord) AS n FROM a WHERE act),
l AS (SELECT o_orderkey AS unit_id, CASE WHEN s.unit_id IS NULL THEN 'UNKNOWN' WHEN ext = 1 THEN 'EXTERNAL' WHEN anya = 1 THEN 'ACTIVE' WHEN starts IS NOT NULL THEN 'NOT_YET_EFFECTIVE' ELSE 'INACTIVE' END AS status, starts AS st FROM o LEFT JOIN s ON s.unit_id = o_orderkey)
SELECT l.unit_id, status, CASE WHEN status = 'ACTIVE' THEN b.rule_id END AS rule_id, CASE WHEN status = 'NOT_YET_EFFECTIVE' THEN st END AS starts FROM l LEFT JOIN b ON b.unit_id = l.unit_id AND n = 1""")
def vb11_effective_status(spark, sf_dir):
    """VB-11, JN-23, AG-08, AG-09: status ladder of every unit at a date."""
    units, rules = _rules(spark, sf_dir)
    return temporal.evaluate(units, rules, F.to_date(F.lit("1996-06-01")))


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, CAST(o_orderdate AS DATE) AS d FROM orders), g AS (SELECT o_orderpriority AS doc, min(d) + 1000 AS f FROM o WHERE o_orderpriority NOT LIKE '%LOW%' GROUP BY 1)
SELECT o_orderkey AS unit_id, CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus = 'P' THEN NULL WHEN o_orderkey % 3 = 0 THEN d ELSE f END AS effective_from FROM o LEFT JOIN g ON doc = o_orderpriority""")
def jn24_effective_date(spark, sf_dir):
    """JN-24, AG-07: the date a unit starts by."""
    units, rules = _rules(spark, sf_dir)
    return temporal.effective_date(units, rules)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, CAST('' AS VARCHAR) AS s, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS n FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT f.user_id, CASE e.event_type WHEN 'view' THEN f.s || 'v;' WHEN 'click' THEN f.s || 'c;' WHEN 'purchase' THEN replace(f.s, 'v;', 'p;') WHEN 'signup' THEN f.s || 's;' ELSE trim(regexp_replace(replace(f.s, 'c;', ''), ' +', ' ', 'g')) END,
  f.k + CASE WHEN e.event_type IN ('view', 'click', 'signup') THEN 1 WHEN e.event_type = 'purchase' THEN CASE WHEN contains(f.s, 'v;') THEN 1 ELSE 0 END ELSE CASE WHEN contains(f.s, 'c;') THEN 1 ELSE 0 END END, e.n FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, arg_max(s, n) AS text, arg_max(k, n) AS n_applied FROM f GROUP BY user_id""")
def vb06_text_fold(spark, sf_dir):
    """VB-05, VB-06, VB-08, VB-09, ST-40: events as ordered text amendments of a user's content."""
    kind = F.col("event_type")
    op = F.when(kind.isin("view", "click", "signup"), "ADD").when(kind == "purchase", "REPLACE").otherwise("DELETE")
    old = F.when(kind == "purchase", "v;").when(kind.isin("view", "click", "signup"), "").otherwise("c;")
    new = F.when(kind == "view", "v;").when(kind == "click", "c;").when(kind == "signup", "s;").when(kind == "purchase", "p;").otherwise("")
    acts = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", op.alias("op"), old.alias("old_text"), new.alias("new_text"))
    return temporal.fold_text(acts, "user_id", ["ts", "event_id"])


@query("WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderstatus = 'P' THEN 'NOT_YET_EFFECTIVE' WHEN o_orderstatus = 'F' THEN 'EXPIRED' ELSE 'ACTIVE' END AS vs, o_orderkey % 2 = 0 AS cur, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS rin, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS rout FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) SELECT o_orderkey, CASE WHEN vs IS NULL AND (rin = 1 OR rout = 1) THEN 'REPEALED' WHEN vs IS NULL THEN 'ACTIVE' WHEN rin = 1 THEN 'REPEALED' WHEN vs IN ('EXPIRED', 'INACTIVE') THEN 'EXPIRED' WHEN vs = 'NOT_YET_EFFECTIVE' THEN vs WHEN NOT cur THEN 'SUPERSEDED' ELSE 'ACTIVE' END AS status FROM x")
def pr09_legal_status(spark, sf_dir):
    """PR-09, PR-10: the ordered status ladder over a version and its amendments."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") == "R", "BAI_BO").otherwise("SUA_DOI")).alias("incoming"), F.collect_set(F.when(F.col("l_returnflag") == "A", "BAI_BO").otherwise("SUA_DOI")).alias("outgoing"))
    joined = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    state = F.when(F.col("o_orderkey") % 5 == 0, F.lit(None)).when(F.col("o_orderstatus") == "P", "NOT_YET_EFFECTIVE").when(F.col("o_orderstatus") == "F", "EXPIRED").otherwise("ACTIVE")
    return joined.select("o_orderkey", temporal.legal_status(state, F.col("o_orderkey") % 2 == 0, F.col("incoming"), F.col("outgoing")).alias("status"))


@query("SELECT 'duplicate_part_name' AS kind, p_name AS id, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1 UNION ALL SELECT 'duplicate_triple', concat('O', l_orderkey, '-', l_suppkey), count(*) FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1 UNION ALL SELECT 'duplicate_text', md5(text), count(*) FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def val01_duplicates(spark, sf_dir):
    """AG-21, VAL-01, VAL-06, VAL-10: ids, triples and texts that occur more than once."""
    many = lambda df, kind, key: df.groupBy(key.alias("id")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(kind).alias("kind"), "id", "n")
    a = many(table(spark, sf_dir, "part"), "duplicate_part_name", F.col("p_name"))
    b = many(table(spark, sf_dir, "lineitem"), "duplicate_triple", F.concat(F.lit("O"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string")))
    return a.union(b).union(many(table(spark, sf_dir, "documents"), "duplicate_text", F.md5(F.col("text").cast("binary"))))


@query("WITH x AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R'), y AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_returnflag = 'A') SELECT 'missing' AS side, id FROM (SELECT id FROM x EXCEPT SELECT id FROM y) UNION ALL SELECT 'unexpected', id FROM (SELECT id FROM y EXCEPT SELECT id FROM x)")
def se01_set_differences(spark, sf_dir):
    """SE-01, SE-02, SE-04, SE-05, SE-10, VAL-02: expected against actual ids, both ways."""
    ids = lambda flag: table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("id")).distinct()
    expected, actual = ids("R"), ids("A")
    return expected.subtract(actual).select(F.lit("missing").alias("side"), "id").union(actual.subtract(expected).select(F.lit("unexpected"), "id"))


@query("WITH k AS (SELECT l_orderkey, list(DISTINCT l_linenumber) AS have, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey), g AS (SELECT l_orderkey, list_sort(list_filter(generate_series(lo, hi), lambda x: NOT list_contains(have, x))) AS gaps FROM k) SELECT l_orderkey, len(gaps) AS n_gaps, array_to_string(gaps, ',') AS gaps FROM g WHERE len(gaps) > 0")
def se07_number_gaps(spark, sf_dir):
    """SE-07, VAL-09: missing numbers between the first and the last one of a group."""
    held = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("have"), F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"))
    gaps = held.select("l_orderkey", F.sort_array(F.array_except(F.sequence("lo", "hi"), "have")).alias("g")).where(F.size("g") > 0)
    return gaps.select("l_orderkey", F.size("g").cast("long").alias("n_gaps"), F.array_join(F.transform("g", lambda x: x.cast("string")), ",").alias("gaps"))


@query("""WITH hits AS (SELECT l_orderkey AS q, l_linenumber AS ord, concat('P', l_partkey) AS chunk FROM lineitem), prov AS (SELECT concat('P', p_partkey) AS id, p_brand AS brand FROM part WHERE p_size % 2 = 0)
SELECT q, ord, chunk, coalesce(brand, 'UNKNOWN') AS brand, 'chunk' AS origin FROM hits LEFT JOIN prov ON id = chunk UNION ALL SELECT NULL, NULL, id, brand, 'appended' FROM prov WHERE id NOT IN (SELECT chunk FROM hits)""")
def jn16_evidence_join(spark, sf_dir):
    """JN-01, JN-16, JN-17: chunks with their provisions, UNKNOWN where none is known; unused provisions are appended."""
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("chunk"))
    prov = table(spark, sf_dir, "part").where("p_size % 2 = 0").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("brand"))
    used = hits.join(prov, F.col("chunk") == F.col("id"), "left").select("q", "ord", "chunk", F.coalesce("brand", F.lit("UNKNOWN")).alias("brand"), F.lit("chunk").alias("origin"))
    rest = prov.join(hits, F.col("chunk") == F.col("id"), "left_anti").select(F.lit(None).cast("long"), F.lit(None).cast("int"), "id", "brand", F.lit("appended"))
    return used.union(rest)
