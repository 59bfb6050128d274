"""Queries of the corpus operators over the star schema, of streams and of variants, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexgraph.operators import audits, documents
from lexgraph.storage import shared_folder
from lexgraph.streaming import ingest, status

from .star import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query("""WITH a AS (SELECT n_regionkey AS document_id, n_nationkey AS chapter_id, c_custkey AS id, c_custkey % 10 AS number FROM customer JOIN nation ON c_nationkey = n_nationkey),
k AS (SELECT * FROM a WHERE document_id NOT IN (1, 3) OR (document_id = 1 AND number IN (0, 5)) OR (document_id = 3 AND number = 7))
SELECT 'article' AS kind, id FROM k UNION ALL SELECT 'chapter', n_nationkey FROM nation WHERE n_nationkey IN (SELECT chapter_id FROM k)""")
def fl04_scope(spark, sf_dir):
    """FL-04: articles in scope and the chapters that keep any."""
    nation = table(spark, sf_dir, "nation")
    articles = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("document_id"), F.col("n_nationkey").alias("chapter_id"), F.col("c_custkey").alias("id"), (F.col("c_custkey") % 10).alias("number"))
    scope = spark.sql("select document_id, number from values (1, 0L), (1, 5L), (3, 7L) as s(document_id, number)")
    kept, chapters = documents.in_scope(articles, nation.select(F.col("n_nationkey").alias("id")), scope)
    return kept.select(F.lit("article").alias("kind"), "id").union(chapters.select(F.lit("chapter"), F.col("id").cast("long")))


@query("""WITH cl AS (SELECT o_orderkey AS id, o_custkey AS aid, o_custkey % 2 AS doc FROM orders), pt AS (SELECT concat(l_orderkey, '-', l_linenumber) AS id, l_orderkey AS cid, doc FROM lineitem JOIN cl ON l_orderkey = cl.id WHERE doc = 1)
SELECT concat('A', c_custkey) AS id, c_custkey % 2 AS document_id, 2 AS unit_level FROM customer WHERE c_custkey NOT IN (SELECT aid FROM cl)
UNION ALL SELECT id, doc, 4 FROM pt UNION ALL SELECT concat('C', id), doc, 3 FROM cl WHERE id NOT IN (SELECT cid FROM pt)""")
def pr04_semantic_units(spark, sf_dir):
    """PR-04, CD-07: unit rows of articles, clauses and points."""
    a = table(spark, sf_dir, "customer").select(F.concat(F.lit("A"), F.col("c_custkey").cast("string")).alias("id"), (F.col("c_custkey") % 2).alias("document_id"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") % 2).alias("document_id"))
    c = orders.select(F.concat(F.lit("C"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("A"), F.col("o_custkey").cast("string")).alias("article_id"), "document_id")
    p = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.concat(F.lit("C"), F.col("l_orderkey").cast("string")).alias("clause_id"), "document_id")
    return documents.semantic_units(a, c, p, F.col("document_id") == 1)


@query("""WITH r AS (SELECT l_partkey AS target, l_returnflag AS operation, l_linestatus AS instruction, CASE WHEN l_quantity > 25 THEN CAST(l_orderkey AS VARCHAR) ELSE '' END AS replacement, l_orderkey * 10 + l_linenumber AS ord FROM lineitem)
SELECT target, operation, instruction, min(ord) AS ord, arg_min(replacement, ord) FILTER (WHERE replacement <> '') AS replacement FROM r GROUP BY ALL""")
def jn09_document_amendments(spark, sf_dir):
    """JN-09, SO-05: the first row of each amendment, its replacement filled from later ones."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("operation"), F.col("l_linestatus").alias("instruction"), F.when(F.col("l_quantity") > 25, F.col("l_orderkey").cast("string")).otherwise("").alias("replacement"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return documents.document_amendments(rows)


@query("""WITH c AS (SELECT 'orders_without_customer' AS "check", count(*) AS n FROM orders ANTI JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'empty_texts', count(*) FROM documents WHERE trim(coalesce(text, '')) = ''
UNION ALL SELECT 'orders_without_lines', count(*) FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey UNION ALL SELECT 'negative_prices', count(*) FROM part WHERE p_retailprice < 0)
SELECT "check", n, n = 0 AS passed FROM c UNION ALL SELECT 'all_pass', CAST(sum(n) AS BIGINT), sum(n) = 0 FROM c""")
def ag24_audit(spark, sf_dir):
    """AG-24, VAL-12, CD-08, CD-09: named checks and whether all pass."""
    t = lambda n: table(spark, sf_dir, n)
    return documents.audit(
        orders_without_customer=t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti"), empty_texts=t("documents").where("trim(coalesce(text, '')) = ''"),
        orders_without_lines=t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti"), negative_prices=t("part").where("p_retailprice < 0"),
    )


@query("""WITH e AS (SELECT concat('D', l_suppkey % 4) AS document, concat('O', l_orderkey) AS source, concat('P', l_partkey) AS target, l_returnflag AS relation, l_quantity > 40 AS ext FROM lineitem),
u AS (SELECT o_orderkey % 7 = 0 AS amended, CASE WHEN o_custkey IS NULL THEN 1 ELSE 0 END AS n_un, CASE WHEN o_orderkey % 5 = 0 AND o_orderstatus = 'P' THEN 1 ELSE 0 END AS differs FROM orders),
x AS (SELECT (SELECT count(*) FILTER (WHERE amended) FROM u) AS a, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS b, (SELECT CAST(sum(n_un) + sum(differs) AS BIGINT) FROM u) AS c, (SELECT count(*) FROM e WHERE source = 'O2' AND target = 'P2') AS d, (SELECT count(*) FROM e WHERE source = 'O1' AND target = 'P1') AS d1,
  (SELECT count(*) FROM (SELECT 1 FROM e GROUP BY source, target, relation HAVING count(*) > 1)) AS f, (SELECT count(*) FROM supplier) AS g, (SELECT count(*) FROM region) AS h, (SELECT count(*) FILTER (WHERE ext) FROM e) AS i, (SELECT count(*) FROM nation) AS i1,
  (SELECT 5 - count(DISTINCT document) FROM e WHERE target LIKE 'P1%') AS j),
r AS (SELECT unnest([{'c': 'issue_1_backfill_originals', 'n': a, 'p': a > 0}, {'c': 'issue_2_amendment_edges', 'n': b, 'p': b > 0}, {'c': 'issue_3_target_documents', 'n': c, 'p': c = 0}, {'c': 'issue_4_quoted_context', 'n': d, 'p': d = 0 AND d1 > 0}, {'c': 'issue_5_deduplication', 'n': f, 'p': f = 0},
  {'c': 'issue_6_effective_support', 'n': g, 'p': g > 0}, {'c': 'issue_7_duplicate_ids', 'n': h, 'p': h >= 2}, {'c': 'issue_8_external_references', 'n': i, 'p': i > 0 AND i1 > 0}, {'c': 'issue_9_cross_document', 'n': j, 'p': j = 0}]) AS y FROM x)
SELECT y.c AS "check", y.n AS n, y.p AS passed FROM r UNION ALL SELECT 'all_pass', count(*) FILTER (WHERE NOT y.p), bool_and(y.p) FROM r""")
def ag24_nine_checks(spark, sf_dir):
    """AG-24, VAL-12, CD-08, CD-09: the nine checks of a parsed corpus, over orders as units and lines as reference edges."""
    t = lambda n: table(spark, sf_dir, n)
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    lines, orders = t("lineitem"), t("orders")
    edges = lines.select(F.concat(F.lit("D"), (F.col("l_suppkey") % 4).cast("string")).alias("document"), name("O", "l_orderkey").alias("source"), name("P", "l_partkey").alias("target"), F.col("l_returnflag").alias("relation"), (F.col("l_quantity") > 40).alias("external"))
    told = F.array(F.lit("x"))
    wrong = (F.col("o_orderkey") % 5 == 0) & (F.col("o_orderstatus") == "P")
    units = orders.select(name("O", "o_orderkey").alias("id"), (F.col("o_orderkey") % 7 == 0).alias("amended"), F.col("o_custkey").isNull().cast("int").alias("n_unresolved"), told.alias("expected"), F.when(wrong, F.array(F.lit("y"))).otherwise(told).alias("actual"))
    known = spark.createDataFrame([("O1", "P1", True), ("O2", "P2", False)], "source string, target string, right boolean")
    crossing = spark.range(5).select(F.concat(F.lit("D"), F.col("id").cast("string")).alias("document"), F.lit("P1").alias("prefix"))
    return audits.nine_checks(edges, units, lines.where("l_returnflag = 'R'"), t("supplier"), t("region"), t("nation"), known, crossing)


@query("""WITH c AS (SELECT 'blank_text' AS "check", count(*) FILTER (WHERE trim(coalesce(text, '')) = '') AS n FROM documents UNION ALL SELECT 'short_text', count(*) FILTER (WHERE n_chars < 100) FROM documents UNION ALL SELECT 'foreign_text', count(*) FILTER (WHERE lang <> 'en') FROM documents
UNION ALL SELECT 'repeated_id', (SELECT count(*) FROM (SELECT 1 FROM documents GROUP BY doc_id HAVING count(*) > 1)) UNION ALL SELECT 'repeated_text', (SELECT count(*) FROM (SELECT 1 FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1)) UNION ALL SELECT 'repeated_size', (SELECT count(*) FROM (SELECT 1 FROM documents GROUP BY source, n_chars HAVING count(*) > 1))
UNION ALL SELECT 'unknown_customer', (SELECT count(*) FROM orders ANTI JOIN customer ON o_custkey = c_custkey) UNION ALL SELECT 'order_without_line', (SELECT count(*) FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey) UNION ALL SELECT 'line_of_open_order', (SELECT count(*) FROM lineitem ANTI JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'O') ON l_orderkey = o_orderkey))
SELECT "check", n, n = 0 AS passed FROM c UNION ALL SELECT 'all_pass', CAST(sum(n) AS BIGINT), sum(n) = 0 FROM c""")
def val12_shared_checks(spark, sf_dir):
    """VAL-01 to VAL-06, VAL-10 to VAL-12: three row checks in one pass, three key checks by one aggregate, three reference checks by one join."""
    t = lambda n: table(spark, sf_dir, n)
    docs = t("documents").withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    rows = audits.row_checks(docs, {"blank_text": F.trim(F.coalesce("text", F.lit(""))) == "", "short_text": F.col("n_chars") < 100, "foreign_text": F.col("lang") != "en"})
    keys = audits.key_checks(docs, {"repeated_id": ["doc_id"], "repeated_text": ["digest"], "repeated_size": ["source", "n_chars"]})
    references = audits.reference_checks({
        "unknown_customer": (t("orders"), "o_custkey", t("customer"), "c_custkey"), "order_without_line": (t("orders"), "o_orderkey", t("lineitem"), "l_orderkey"), "line_of_open_order": (t("lineitem"), "l_orderkey", t("orders").where("o_orderstatus <> 'O'"), "o_orderkey"),
    })
    return audits.report(rows, keys, references)


@query("SELECT count(*) FILTER (WHERE p_type LIKE '%STEEL%') AS n_laws, count(*) FILTER (WHERE p_type NOT LIKE '%STEEL%') AS n_decrees, count(*) AS n FROM part")
def ag26_catalogue_split(spark, sf_dir):
    """AG-26: two kinds of the catalogue, counted."""
    steel = F.col("p_type").like("%STEEL%")
    return table(spark, sf_dir, "part").agg(F.count_if(steel).alias("n_laws"), F.count_if(~steel).alias("n_decrees"), F.count("*").alias("n"))


@query("""WITH e AS (SELECT l_orderkey AS event_id, CASE l_returnflag WHEN 'R' THEN 'BAI_BO' WHEN 'A' THEN 'SUA_DOI' ELSE 'KHAC' END AS operation, concat('P', l_partkey % 20) AS target, CASE WHEN l_quantity > 20 THEN 'x' END AS path, l_linenumber % 2 AS tl, l_suppkey % 2 AS rl FROM lineitem)
SELECT event_id, target, 'repeated_target' AS violation FROM e GROUP BY event_id, target HAVING count(*) > 1
UNION ALL SELECT event_id, target, v FROM (SELECT *, CASE WHEN operation = 'BAI_BO' AND path IS NOT NULL THEN 'repeal_with_path' WHEN operation = 'SUA_DOI' AND path IS NULL THEN 'missing_path' WHEN path IS NOT NULL AND tl <> rl THEN 'level' END AS v FROM e) WHERE v IS NOT NULL""")
def val11_event_checks(spark, sf_dir):
    """VAL-11, VAL-04: checks of amendment events."""
    op = F.when(F.col("l_returnflag") == "R", "BAI_BO").when(F.col("l_returnflag") == "A", "SUA_DOI").otherwise("KHAC")
    events = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), op.alias("operation"), F.concat(F.lit("P"), (F.col("l_partkey") % 20).cast("string")).alias("target"), F.when(F.col("l_quantity") > 20, "x").alias("path"), (F.col("l_linenumber") % 2).alias("target_level"), (F.col("l_suppkey") % 2).alias("replacement_level"))
    return documents.event_violations(events)


@query("""SELECT o_orderkey AS id, c AS "column" FROM orders, (SELECT unnest(['status', 'total', 'who']) AS c) WHERE (c = 'status' AND o_orderstatus = 'P') OR (c = 'total' AND o_orderkey % 11 = 0) OR (c = 'who' AND o_orderkey % 13 = 0)""")
def val03_property_differences(spark, sf_dir):
    """VAL-03: properties that differ between what is expected and what is there."""
    orders = table(spark, sf_dir, "orders")
    expected = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.lit(1).alias("total"), F.col("o_custkey").alias("who"))
    actual = orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"), F.when(F.col("o_orderkey") % 11 == 0, 2).otherwise(1).alias("total"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_custkey")).alias("who"))
    return documents.property_differences(expected, actual, "id", ["status", "total", "who"])


@query("""WITH r AS (SELECT o_orderkey AS rule_id, concat('D', o_custkey % 50) AS doc, CASE WHEN o_orderkey % 9 = 0 THEN 'OTHER' WHEN o_orderkey % 4 = 0 THEN 'EXTERNAL_RULE' ELSE 'EXPLICIT' END AS t, o_orderkey % 100 AS target, DATE '2020-01-01' + CAST(o_orderkey % 7 AS INT) AS f, DATE '2020-01-01' + CAST(o_orderkey % 11 AS INT) AS e, CASE WHEN o_orderkey % 8 = 0 THEN ' ' ELSE 'b' END AS basis FROM orders)
SELECT rule_id, 'type' AS violation FROM r WHERE t = 'OTHER' UNION ALL SELECT rule_id, 'dates' FROM r WHERE e <= f UNION ALL SELECT rule_id, 'basis' FROM r WHERE t = 'EXTERNAL_RULE' AND trim(basis) = '' UNION ALL SELECT rule_id, 'target' FROM r WHERE target >= 90
UNION ALL SELECT min(rule_id), 'repeated' FROM r GROUP BY doc, t, target, f, e, basis HAVING count(*) > 1""")
def val07_rule_checks(spark, sf_dir):
    """VAL-07, DT-05: checks of effective rules."""
    o = F.col("o_orderkey")
    kind = F.when(o % 9 == 0, "OTHER").when(o % 4 == 0, "EXTERNAL_RULE").otherwise("EXPLICIT")
    day = lambda n: F.date_add(F.to_date(F.lit("2020-01-01")), (o % n).cast("int"))
    rules = table(spark, sf_dir, "orders").select(o.alias("rule_id"), F.concat(F.lit("D"), (F.col("o_custkey") % 50).cast("string")).alias("document_id"), kind.alias("rule_type"), F.array((o % 100).cast("string")).alias("targets"), day(7).alias("effective_from"), day(11).alias("effective_to"), F.when(o % 8 == 0, " ").otherwise("b").alias("external_basis"))
    return documents.rule_violations(rules, spark.range(90).select(F.col("id").cast("string").alias("unit_id")))


@query("""WITH r AS (SELECT user_id, event_id, event_type, CAST(props->>'k' AS VARCHAR) AS k, CASE WHEN event_type = 'view' THEN 'SemanticUnit' ELSE event_type END AS label FROM events),
m AS (SELECT user_id, event_type AS key, arg_max(k, event_id) AS v FROM r WHERE k IS NOT NULL GROUP BY ALL)
SELECT user_id, (SELECT arg_min(label, event_id) FROM r x WHERE x.user_id = m.user_id AND (label <> 'SemanticUnit' OR NOT EXISTS (SELECT 1 FROM r y WHERE y.user_id = m.user_id AND y.label <> 'SemanticUnit'))) AS label, string_agg(key || '=' || v, ',' ORDER BY key) AS props FROM m GROUP BY user_id""")
def ag27_merged_properties(spark, sf_dir):
    """AG-27, MP-02: maps merged in order, a general label never replaces a specific one."""
    k = F.get_json_object("props", "$.k")
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("ord"), F.when(F.col("event_type") == "view", "SemanticUnit").otherwise(F.col("event_type")).alias("label"), F.create_map("event_type", k).alias("props"))
    merged = documents.merged_properties(rows, "user_id")
    return merged.select("user_id", "label", F.array_join(F.transform(F.map_entries("props"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("props"))


@query("SELECT o_orderkey, o_orderstatus AS status, CAST(o_custkey AS BIGINT) AS who, CAST(NULL AS VARCHAR) AS missing FROM orders")
def ar02_variant_paths(spark, sf_dir):
    """AR-02, AR-03, JS-05: paths into variant trees, missing ones are null."""
    tree = F.parse_json(F.to_json(F.struct(F.array(F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_custkey").alias("id")).alias("who"))).alias("articles"))))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", tree.alias("t"))
    return rows.select("o_orderkey", F.try_variant_get("t", "$.articles[0].status", "string").alias("status"), F.try_variant_get("t", "$.articles[0].who.id", "long").alias("who"), F.try_variant_get("t", "$.articles[3].status", "string").alias("missing"))


@query("SELECT event_type, count(DISTINCT event_id) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def sm02_stream_ingest(spark, sf_dir):
    """SM-02, SM-03: events ingested as a stream, once per key, then counted; the tables are in the shared folder."""
    base = shared_folder(spark, "stream")
    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    ingest.ingest(source, f"{base}/out", f"{base}/checkpoint", "event_id", "ts")
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS task_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'submitted' WHEN 'click' THEN 'started' WHEN 'view' THEN 'succeeded' WHEN 'purchase' THEN CASE WHEN event_id % 97 = 0 THEN 'finished' ELSE 'failed_units' END ELSE CASE WHEN event_id % 89 = 0 THEN 'broken' ELSE 'submitted' END END AS kind FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY (epoch_us(ts) // 1000), event_id) AS n FROM e),
d AS (SELECT task_id, min(n) FILTER (WHERE kind IN ('finished', 'broken')) AS ended, arg_min(kind, n) FILTER (WHERE kind IN ('finished', 'broken')) AS how, count(*) FILTER (WHERE kind = 'succeeded') AS good, count(*) FILTER (WHERE kind = 'failed_units') AS bad,
  bool_or(kind IN ('started', 'succeeded', 'failed_units')) AS began, min((epoch_us(ts) // 1000)) AS first, max((epoch_us(ts) // 1000)) AS last FROM o GROUP BY task_id),
w AS (SELECT *, ended IS NULL AND last + 14400000 <= (SELECT max((epoch_us(ts) // 1000)) - 600000 FROM events) AS silent FROM d)
SELECT task_id, CASE WHEN how = 'finished' THEN 'completed' WHEN how = 'broken' OR silent THEN 'failed' WHEN began THEN 'processing' ELSE 'pending' END AS status, good AS successful_units, bad AS failed_units, last - first AS elapsed_ms, CASE WHEN how = 'broken' THEN 'broken' WHEN silent THEN 'no event within the expected time' END AS error FROM w""")
def sm02_task_status(spark, sf_dir):
    """SM-02: events of users as events of tasks, whose status is keyed state of a stream; timers fail the silent ones."""
    base = shared_folder(spark, "status")
    kind = F.col("event_type")
    told = F.when(kind == "signup", status.SUBMITTED).when(kind == "click", status.STARTED).when(kind == "view", status.SUCCEEDED)
    told = told.when(kind == "purchase", F.when(F.col("event_id") % 97 == 0, status.FINISHED).otherwise(status.FAILED_UNITS)).otherwise(F.when(F.col("event_id") % 89 == 0, status.BROKEN).otherwise(status.SUBMITTED))
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    events = source.select(F.lpad(F.col("event_id").cast("string"), 20, "0").alias("event_id"), F.col("user_id").alias("task_id"), told.alias("kind"), F.col("ts").alias("at"), F.lit(1).alias("units"), F.when(told == status.BROKEN, "broken").alias("error"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        stream = status.statuses(events, "4 hours", "10 minutes")
        stream.writeStream.format("parquet").option("path", f"{base}/changes").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return status.latest(spark.read.parquet(f"{base}/changes")).drop("version", "processed_units")
