"""Queries of scalar functions and line operators over texts, urls, orders and events, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexgraph.functions import text as T
from lexgraph.operators import lines

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


@query("SELECT doc_id, md5(nfc_normalize(text)) AS composed FROM documents")
def st01_nfc(spark, sf_dir):
    """ST-01: canonical composition of every text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.nfc("text").cast("binary")).alias("composed"))


@query("""SELECT page_id, regexp_replace(regexp_replace(strip_accents(replace(lower(trim(url)), 'đ', 'd')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug,
  upper(replace(replace(trim(url), '-', '_'), '/', '_')) AS provision, split_part(url, '/', 3) AS host, CASE WHEN length(url) <= 8 THEN '****' ELSE left(url, 4) || '...' || right(url, 4) END AS masked FROM pages""")
def st05_url_slugs(spark, sf_dir):
    """ST-02, ST-04, ST-05, ST-29, ST-38: slugs, provision ids and masks of urls."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", T.slug(F.col("url")).alias("slug"), T.provision_id(F.col("url")).alias("provision"), F.get(F.split("url", "/"), F.lit(2)).alias("host"), T.masked(F.col("url")).alias("masked"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(strip_accents(replace(lower(trim(text)), 'đ', 'd')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug FROM documents")
def st05_text_slugs(spark, sf_dir):
    """ST-05: slugs of accented texts in four languages."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.slug(F.col("text")).cast("binary")).alias("slug"))


@query("""WITH u AS (SELECT o_orderkey, concat('DOC_', o_custkey, '_D', o_orderkey % 40, CASE WHEN o_orderkey % 3 > 0 THEN concat('_K', o_orderkey % 9) ELSE '' END, CASE WHEN o_orderkey % 3 = 2 THEN concat('_D', chr(CAST(97 + o_orderkey % 20 AS INT))) ELSE '' END) AS unit FROM orders)
SELECT o_orderkey, unit, split_part(unit, '_D', 1) AS document, CASE o_orderkey % 3 WHEN 2 THEN 'Point' WHEN 1 THEN 'Clause' ELSE 'Article' END AS label,
  CAST(CASE o_orderkey % 3 WHEN 2 THEN chr(CAST(97 + o_orderkey % 20 AS INT)) WHEN 1 THEN CAST(o_orderkey % 9 AS VARCHAR) ELSE CAST(o_orderkey % 40 AS VARCHAR) END AS VARCHAR) AS number FROM u""")
def st25_external_ids(spark, sf_dir):
    """ST-24, ST-25, PR-14, SRC-07: document, label and number from unit ids."""
    o = F.col("o_orderkey")
    unit = F.concat(F.lit("DOC_"), F.col("o_custkey").cast("string"), F.lit("_D"), (o % 40).cast("string"), F.when(o % 3 > 0, F.concat(F.lit("_K"), (o % 9).cast("string"))).otherwise(""), F.when(o % 3 == 2, F.concat(F.lit("_D"), F.char(97 + o % 20))).otherwise(""))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", unit.alias("unit"))
    named = rows.withColumn("document", T.document_of_unit(F.col("unit")))
    return named.withColumn("x", T.external_label(F.col("unit"), F.col("document"))).select("o_orderkey", "unit", "document", "x.label", "x.number")


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + 30 END AS DATE) AS e,
  CAST(least(o_orderkey % 50 + 1, o_orderkey % 70 + 2) * CASE WHEN o_orderkey % 2 = 0 THEN 1000000 ELSE 1000 END AS BIGINT) AS low, CAST(greatest(o_orderkey % 50 + 1, o_orderkey % 70 + 2) * CASE WHEN o_orderkey % 2 = 0 THEN 1000000 ELSE 1000 END AS BIGINT) AS high,
  CAST(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey % 12 + 1 END AS INT) AS points, CAST(o_orderkey % 6 + 1 AS INT) AS m_low, CAST(o_orderkey % 6 + 3 AS INT) AS m_high FROM orders""")
def ma02_sentences(spark, sf_dir):
    """DT-01, DT-02, DT-04, MA-01 to MA-04: dates and amounts written into sentences and parsed back."""
    o, s = F.col("o_orderkey"), lambda c: c.cast("string")
    day = lambda c: F.concat(F.lit("ngày "), s(F.dayofmonth(c)), F.lit(" tháng "), s(F.month(c)), F.lit(" năm "), s(F.year(c)))
    unit = F.when(o % 2 == 0, "triệu").otherwise("nghìn")
    text = F.concat(
        F.lit("Văn bản có hiệu lực thi hành từ "), day(F.col("o_orderdate")), F.when(o % 4 == 0, "").otherwise(F.concat(F.lit(", hết hiệu lực kể từ "), day(F.to_date("o_orderdate") + 30))),
        F.lit("; phạt tiền từ "), s(o % 50 + 1), F.lit(" "), unit, F.lit(" đến "), s(o % 70 + 2), F.lit(" "), unit, F.when(o % 5 == 0, ", không bị trừ điểm").otherwise(F.concat(F.lit(", trừ điểm GPLX "), s(o % 12 + 1), F.lit(" điểm"))),
        F.lit(", tước GPLX từ "), s(o % 6 + 1), F.lit(" đến "), s(o % 6 + 3), F.lit(" tháng"),
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t"))
    t = F.col("t")
    return rows.select("o_orderkey", T.date_in(t, T.EFFECT_FROM).alias("d"), T.date_in(t, T.EFFECT_TO).alias("e"), T.fine(t).alias("f"), T.points(t).cast("int").alias("points"), T.suspension(t).alias("m")).select("o_orderkey", "d", "e", "f.low", "f.high", "points", F.col("m.low").alias("m_low"), F.col("m.high").alias("m_high"))


@query("SELECT o_orderkey, replace(format('{:,}', CAST(round(o_totalprice) AS BIGINT)), ',', '.') || 'đ' AS vnd, round(o_totalprice / 7, 2) AS seventh FROM orders")
def ma09_amounts(spark, sf_dir):
    """MA-07, MA-09: rendered and rounded amounts."""
    return table(spark, sf_dir, "orders").select("o_orderkey", T.vnd(F.round("o_totalprice").cast("long")).alias("vnd"), F.round(F.col("o_totalprice") / 7, 2).alias("seventh"))


@query("SELECT conv_id, turn, contains(lower(text), 'the') OR contains(lower(text), 'avec') AS warned, length(text) - length(replace(text, ' ', '')) AS blanks, replace(role, 'assistant', 'a') AS short_role FROM conversations")
def st30_detectors(spark, sf_dir):
    """ST-30, ST-31, FL-12, FL-14: phrase detectors over dialogue."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", T.mentions(F.col("text"), ["the", "avec"]).alias("warned"), (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).cast("long").alias("blanks"), F.replace("role", F.lit("assistant"), F.lit("a")).alias("short_role"))


@query("""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter(w, lambda x, i: i = 1 OR lower(x) <> lower(w[i - 1]))[1:30], ' ') AS squeezed FROM w""")
def wn16_squeezed_words(spark, sf_dir):
    """WN-16, SO-11: consecutive repeated words collapse (30 words is the operator's cap)."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.squeeze_words(F.col("text")).alias("squeezed"))


@query("SELECT event_id, CAST(props->>'k' AS BIGINT) AS k, coalesce(props->>'content', props->>'text', props->>'k') AS payload, (props->>'missing') IS NULL AS gone, event_type || ':' || coalesce(props->>'k', '-') AS tag FROM events")
def js01_payloads(spark, sf_dir):
    """AR-02, JS-01, JS-02, JS-03, JS-06: fields of JSON payloads, the first one present wins."""
    p = F.col("props")
    field = lambda k: F.get_json_object(p, f"$.{k}")
    return table(spark, sf_dir, "events").select("event_id", field("k").try_cast("long").alias("k"), F.coalesce(field("content"), field("text"), field("k")).alias("payload"), field("missing").isNull().alias("gone"), F.concat(F.col("event_type"), F.lit(":"), F.coalesce(field("k"), F.lit("-"))).alias("tag"))


@query("SELECT o_custkey, ceil(count(*) / 4) AS n_chunks, array_to_string(list(o_orderkey ORDER BY o_orderkey)[1:4], ',') AS first_chunk FROM orders GROUP BY o_custkey")
def ar01_chunks(spark, sf_dir):
    """AR-01: lists in chunks of four."""
    held = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("x"))
    n = F.ceil(F.size("x") / 4)
    chunks = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.slice("x", (i * 4 + 1).cast("int"), F.lit(4)))
    return held.select("o_custkey", n.cast("double").alias("n_chunks"), F.array_join(F.transform(F.get(chunks, F.lit(0)), lambda v: v.cast("string")), ",").alias("first_chunk"))


LINES = "l AS (SELECT doc_id AS id, CAST(i - 1 AS INT) AS ord, s[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), unnest(generate_series(1, len(s))) AS g(i))"


@query(f"WITH {LINES} SELECT id, ord, md5(text) AS line FROM l WHERE NOT regexp_matches(text, '^[ \\t\\n\\r\\f]*[0-9]{{1,4}}[ \\t\\n\\r\\f]*$') AND trim(text) <> ''")
def fl01_clean_lines(spark, sf_dir):
    """FL-01, FL-02, FL-03: lines without page numbers, boilerplate and empty ones."""
    return lines.without_noise(lines.lines(table(spark, sf_dir, "documents"), "doc_id", "text")).select("id", "ord", F.md5(F.col("text").cast("binary")).alias("line"))


@query(f"""WITH {LINES}, d AS (SELECT *, length(text) - length(replace(text, '(', '')) - (length(text) - length(replace(text, ')', ''))) AS x, length(text) - length(replace(text, '"', '')) AS q FROM l),
s AS (SELECT *, sum(q) OVER (PARTITION BY id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM d)
SELECT id, count(*) AS n_lines, CAST(sum(CASE WHEN coalesce(before, 0) % 2 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_inside FROM s GROUP BY id""")
def wn07_quote_state(spark, sf_dir):
    """WN-07: lines that start inside a quotation, counted per document."""
    state = lines.quote_state(lines.lines(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return state.groupBy("id").agg(F.count("*").alias("n_lines"), F.sum(F.col("inside").cast("int")).cast("long").alias("n_inside"))


@query(f"WITH {LINES}, h AS (SELECT *, last_value(CASE WHEN length(text) < 40 THEN ord END IGNORE NULLS) OVER (PARTITION BY id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM l) SELECT id, section, count(*) AS n_lines, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM h GROUP BY id, section")
def wn08_sections(spark, sf_dir):
    """WN-08, WN-11, WN-14: lines assigned to the latest heading (here: a short line)."""
    rows = lines.sections(lines.lines(table(spark, sf_dir, "documents"), "doc_id", "text"), F.length("text") < 40)
    return rows.groupBy("id", "section").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).cast("long").alias("n_chars"))


@query(f"""WITH {LINES}, b AS (SELECT *, length(text) < 12 AS bold FROM l), w AS (SELECT *, lag(text) OVER p AS pt, lag(bold) OVER p AS pb FROM b WINDOW p AS (PARTITION BY id ORDER BY ord)),
n AS (SELECT *, CASE WHEN pt IS NOT NULL AND NOT regexp_matches(pt, '[.;:"”)][ \\t\\n\\r\\f]*$') AND NOT pb AND NOT bold AND NOT regexp_matches(text, '^(Điều[ ]+[0-9]|Chương[ ]+[IVXLCDM]|[a-zđ]\\)|[0-9]+[a-zđ]?\\.[ \\t])') THEN 0 ELSE 1 END AS fresh FROM w),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY ord) AS island FROM n)
SELECT id, min(ord) AS ord, md5(string_agg(trim(text), ' ' ORDER BY ord)) AS merged, bool_or(bold) AS bold FROM i GROUP BY id, island""")
def wn09_merged_lines(spark, sf_dir):
    """WN-09: broken lines merge into the one before them (bold: very short lines)."""
    rows = lines.lines(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("bold", F.length("text") < 12)
    return lines.merge_broken(rows).select("id", "ord", F.md5(F.col("text").cast("binary")).alias("merged"), "bold")


@query("SELECT user_id, event_id, first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_purchase FROM events")
def wn13_fill_forward(spark, sf_dir):
    """WN-13: the value of the next row that has one."""
    rows = table(spark, sf_dir, "events").withColumn("p", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return rows.select("user_id", "event_id", lines.fill_forward(rows, "user_id", ["ts", "event_id"], "p").alias("next_purchase"))
