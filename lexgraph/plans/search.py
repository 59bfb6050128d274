"""Queries over documents, embeddings, benchmark items and labels: retrieval and evaluation, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexgraph.operators import evaluate, retrieval, substrings
from lexgraph.operators.textindex import TextIndex
from lexgraph.operators.vectorindex import VectorIndex
from lexgraph.storage import exists, shared_folder

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


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


#: The stated query set of every search: rows whose id is divisible by this, against all rows.
EVERY = 50


def _vector_queries(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


DOT = "least(greatest(list_sum(list_transform(generate_series(1, len(e.embedding)), lambda i: CAST(e.embedding[i] AS DOUBLE) * CAST(q.embedding[i] AS DOUBLE))), -1.0), 1.0)"
KNN = f"""dense AS (SELECT query_id, id, dense_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, id) AS rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id AS id, round({DOT}, 6) AS dense_score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q)) WHERE rank <= 20)"""


@query(f"WITH {KNN} SELECT * FROM dense")
def tx01_knn(spark, sf_dir):
    """TX-01, MA-06, MA-07, MA-08: exact k-NN of several query vectors (top 20 is the operator's k)."""
    return retrieval.knn(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), 20)


_vector_indexes: dict[tuple[str, str], VectorIndex] = {}


def _vector_index(spark, sf_dir) -> VectorIndex:
    """The stored index of all vectors, appended in two batches; an application builds it once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _vector_indexes or not exists(spark, _vector_indexes[key].path):
        vectors = _vectors(spark, sf_dir).select("id", "embedding")
        index = VectorIndex.fit(vectors, shared_folder(spark, "vector-index"))
        index.append(vectors.where("id % 2 = 0"), "even")
        index.append(vectors.where("id % 2 <> 0"), "odd")
        index.calibrate(20)
        _vector_indexes[key] = index
    return _vector_indexes[key]


@query(f"WITH {KNN} SELECT * FROM dense")
def tx01_certified_index(spark, sf_dir):
    """TX-01: the stored index, probing every list that can hold a neighbour: the result of exact search."""
    return _vector_index(spark, sf_dir).certified(_vector_queries(spark, sf_dir), 20)


@query(None)
def tx01_vector_index(spark, sf_dir):
    """TX-01: the stored index, probing as many lists as its measured recall needs; tested against exact search."""
    return _vector_index(spark, sf_dir).search(_vector_queries(spark, sf_dir), 20)


@query(f"WITH {KNN} SELECT query_id, d.id, dense_score, rank FROM dense d JOIN embeddings e ON e.vec_id = d.id WHERE e.label = 3")
def so01_filter_after_knn(spark, sf_dir):
    """SO-01, FL-05: the document filter applies after the k cut, so fewer than k rows may come back."""
    hits = retrieval.knn(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), 20)
    return hits.join(_vectors(spark, sf_dir).where("label = 3").select("id"), "id", "left_semi").select("query_id", "id", "dense_score", "rank")


WORDS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
BM25 = f"""base AS (SELECT doc_id AS id, {WORDS.format("text")} AS w FROM documents),
stats AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM base),
asked AS (SELECT DISTINCT item_id AS query_id, unnest({WORDS.format("text")}) AS term FROM benchmark WHERE item_id % 50 = 0),
held AS (SELECT term, id, dl, count(*) AS tf FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM base) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM held GROUP BY term),
scored AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 4) AS sparse_score FROM held JOIN df USING (term) JOIN asked USING (term), stats GROUP BY ALL),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sparse_score DESC, id) AS rank FROM scored) WHERE rank <= 20)"""


def _units(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source", "lang")


def _text_queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").where(F.col("item_id") % EVERY == 0).select(F.col("item_id").alias("query_id"), "text")


_indexes: dict[tuple[str, str], TextIndex] = {}


def _index(spark, sf_dir) -> TextIndex:
    """The stored index of all documents; an application builds it once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes or not exists(spark, _indexes[key].path):
        index = TextIndex(spark, shared_folder(spark, "text-index"))
        index.append(_units(spark, sf_dir), "all")
        _indexes[key] = index
    return _indexes[key]


@query(f"WITH {BM25} SELECT * FROM sparse")
def tx02_bm25(spark, sf_dir):
    """TX-02, TX-03, SO-02: BM25 of several queries over all documents, from the stored index."""
    return _index(spark, sf_dir).bm25(_text_queries(spark, sf_dir), 20)


@query(f"WITH {BM25} SELECT * FROM sparse")
def snk12_appended_index(spark, sf_dir):
    """SNK-12: the index built by two appended batches, the second of which comes twice."""
    index = TextIndex(spark, shared_folder(spark, "appended-index"))
    units = _units(spark, sf_dir)
    index.append(units.where("id % 3 = 0"), "first")
    for _ in range(2):
        index.append(units.where("id % 3 <> 0"), "second")
    return index.bm25(_text_queries(spark, sf_dir), 20)


@query(f"WITH words AS (SELECT doc_id, unnest({WORDS.format('text')}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df FROM words GROUP BY term")
def tx03_dictionary(spark, sf_dir):
    """TX-03: every term of the stored index with the number of documents that hold it, from block headers."""
    return _index(spark, sf_dir).dictionary()


@query(f"""WITH {KNN}, {BM25}, best AS (SELECT query_id, max(dense_score) AS best FROM dense GROUP BY 1),
u AS (SELECT query_id, id, dense_score, 1.0 / (60 + rank) AS p, rank AS seen FROM dense UNION ALL SELECT query_id, id, NULL, 1.0 / (60 + rank), rank + 1000000 FROM sparse),
f AS (SELECT query_id, id, max(dense_score) AS dense_score, round(sum(p), 6) AS rrf, min(seen) AS seen FROM u GROUP BY ALL),
r AS (SELECT f.*, best, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, seen, id) AS rank FROM f LEFT JOIN best USING (query_id) WHERE best IS NULL OR best >= 0.5)
SELECT query_id, id, dense_score, rrf, rank FROM r WHERE rank <= 10 AND (rank = 1 OR best IS NULL OR dense_score IS NULL OR dense_score >= greatest(best * 0.8, best - 0.15))""")
def tx05_hybrid_fusion(spark, sf_dir):
    """TX-05, TX-07, AG-10, FL-09, FL-10, SO-03, WN-01: hybrid retrieval with floor and dynamic cut-off."""
    dense = retrieval.knn(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), 20)
    sparse = _index(spark, sf_dir).bm25(_text_queries(spark, sf_dir), 20)
    return retrieval.fuse(dense, sparse, 10)


@query(f"""WITH {KNN}, {BM25}, l AS (SELECT query_id, 0 AS variant, id, rank FROM dense UNION ALL SELECT query_id, 1, id, rank FROM sparse UNION ALL SELECT query_id, 2, id, 21 - rank FROM sparse),
t AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 6) AS rrf, min(variant * 1000 + rank) AS seen FROM l GROUP BY ALL)
SELECT * FROM (SELECT query_id, id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, seen, id) AS rank FROM t) WHERE rank <= 10""")
def tx06_multi_query_fusion(spark, sf_dir):
    """TX-06, SE-03, SE-06: unweighted fusion of query variants as rows of one plan."""
    dense = retrieval.knn(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), 20).select("query_id", F.lit(0).alias("variant"), "id", "rank")
    sparse = _index(spark, sf_dir).bm25(_text_queries(spark, sf_dir), 20).select("query_id", F.lit(1).alias("variant"), "id", "rank")
    return retrieval.fuse_many(dense.union(sparse).union(sparse.select("query_id", F.lit(2), "id", 21 - F.col("rank"))), 10)


@query(f"""WITH {BM25}, d AS (SELECT query_id, sparse_score, doc_id AS id, source, rank FROM sparse JOIN documents ON doc_id = id),
par AS (SELECT query_id, source, max(sparse_score) AS ps FROM d GROUP BY ALL), pr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ps DESC, source) AS parent_rank FROM par),
i AS (SELECT d.query_id, d.source AS parent, parent_rank, id, sparse_score, row_number() OVER (PARTITION BY d.query_id, d.source ORDER BY sparse_score DESC, id) AS in_parent FROM d JOIN pr ON pr.query_id = d.query_id AND pr.source = d.source)
SELECT query_id, parent, id, in_parent, row_number() OVER (PARTITION BY query_id ORDER BY parent_rank, in_parent, id) AS rank FROM i WHERE in_parent <= 3""")
def tx04_hierarchical(spark, sf_dir):
    """TX-04, JN-10, WN-02, WN-03: best units of each article, in the order of the articles."""
    from pyspark.sql import Window as W

    units = _units(spark, sf_dir)
    hits = _index(spark, sf_dir).bm25(_text_queries(spark, sf_dir), 20).join(units.select("id", "source"), "id")
    parents = hits.groupBy("query_id", F.col("source").alias("parent")).agg(F.max("sparse_score").alias("ps")).withColumn("parent_rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("ps"), "parent")))
    shaped = hits.select("query_id", F.col("source").alias("parent"), "id", F.col("sparse_score").alias("unit_score"), F.col("id").alias("ord")).join(parents.drop("ps"), ["query_id", "parent"])
    return retrieval.best_per_parent(shaped).select("query_id", "parent", "id", "in_parent", "rank")


@query(f"""WITH {KNN}, d AS (SELECT query_id, d.id, concat('L', e.label) AS class, rank FROM dense d JOIN embeddings e ON e.vec_id = d.id),
m AS (SELECT *, list_position(['L1', 'L3', 'L5'], class) AS pl, row_number() OVER (PARTITION BY query_id, class ORDER BY rank) AS fi FROM d)
SELECT * FROM (SELECT query_id, id, class, rank, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN fi = 1 AND pl > 0 THEN pl ELSE 4 END, rank, id) AS new_rank FROM m) WHERE new_rank <= 6""")
def so04_diversify(spark, sf_dir):
    """SO-04, PR-13: the best hit of each target class first."""
    hits = retrieval.knn(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), 20).join(_vectors(spark, sf_dir).select("id", F.concat(F.lit("L"), F.col("label").cast("string")).alias("class")), "id")
    return retrieval.diversify(hits.select("query_id", "id", "class", "rank"), ["L1", "L3", "L5"], 6)


@query("""WITH c AS (SELECT source AS query_id, doc_id, lower(concat_ws(' ', lang, text)) AS hay FROM documents), m AS (SELECT *, contains(hay, 'password') OR contains(hay, 'license') AS has, contains(hay, ' the ') AS bad FROM c),
w AS (SELECT *, bool_or(has) OVER (PARTITION BY query_id) AS anyhas FROM m) SELECT query_id, doc_id FROM w WHERE NOT anyhas OR has OR NOT bad""")
def fl11_guard(spark, sf_dir):
    """FL-11: must and must-not terms with the fallback."""
    chunks = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), "doc_id", F.col("lang").alias("title"), "text")
    return retrieval.guard(chunks, ["password", "license"], [" the "]).select("query_id", "doc_id")


@query("WITH d AS (SELECT lang AS query_id, doc_id, contains(lower(concat_ws(' ', source, text)), ' the ') AS bad FROM documents), w AS (SELECT *, bool_and(bad) OVER (PARTITION BY query_id) AS allbad FROM d) SELECT query_id, doc_id FROM w WHERE allbad OR NOT bad")
def fl11_guard_only_must_not(spark, sf_dir):
    """FL-11, second form: only must-not terms; violators go unless all would."""
    chunks = table(spark, sf_dir, "documents").select(F.col("lang").alias("query_id"), "doc_id", F.col("source").alias("title"), "text")
    return retrieval.guard(chunks, [], [" the "]).select("query_id", "doc_id")


def _contains(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


PHRASES = " + ".join(f"CASE WHEN {_contains('ql', triggers)} AND {_contains('low', targets)} THEN 3 ELSE 0 END" for triggers, targets in retrieval.EXPANSIONS)


@query(f"""WITH q AS (SELECT item_id AS query_id, lower(text) AS ql, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) > 1) AS w FROM benchmark WHERE item_id % 50 = 0),
tk AS (SELECT *, list_distinct(w) AS tokens, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) AS bigrams FROM q),
d AS (SELECT *, list_filter(tokens, lambda t: contains(low, t)) AS matched FROM (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents), tk),
b AS (SELECT *, 2 * len(list_filter(bigrams, lambda p: contains(low, p))) + {PHRASES} - CASE WHEN {_contains("ql", retrieval.LIGHTS)} AND contains(low, '{retrieval.OVERTAKING}') AND NOT contains(low, '{retrieval.LIGHT}') THEN 4 ELSE 0 END AS bonus FROM d)
SELECT query_id, doc_id, CASE WHEN low = '' OR len(tokens) = 0 OR (len(matched) = 0 AND bonus <= 0) THEN 0.0 ELSE round(greatest(len(matched) / len(tokens) * 10
  + least(coalesce(list_sum(list_transform(matched, lambda t: (length(low) - length(replace(low, t, ''))) / length(t))), 0.0), 20.0) * 0.1 + bonus, 0.0), 4) END AS density FROM b""")
def st20_lexical_density(spark, sf_dir):
    """ST-20, SE-08, SO-11: lexical density of every document for every question of the stated set."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return substrings.lexical_densities(texts, _text_queries(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@query("""WITH p AS (SELECT lang AS grp, doc_id AS id FROM documents WHERE n_chars > 1000), t AS (SELECT d.lang AS grp, l.doc_id AS id FROM labels l JOIN documents d USING (doc_id) WHERE quality = 1),
c AS (SELECT coalesce(p.grp, t.grp) AS grp, count(p.id) AS np, count(t.id) AS nt, count(*) FILTER (WHERE p.id IS NOT NULL AND t.id IS NOT NULL) AS nb FROM p FULL JOIN t ON p.grp = t.grp AND p.id = t.id GROUP BY 1),
m AS (SELECT grp, CASE WHEN np > 0 THEN nb / np ELSE 0.0 END AS pr, CASE WHEN nt > 0 THEN nb / nt ELSE 0.0 END AS rc FROM c)
SELECT grp AS lang, round(pr, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END, 6) AS f1 FROM m""")
def ag12_precision_recall(spark, sf_dir):
    """AG-12, MA-10: long documents as predictions of good ones, per language."""
    docs = table(spark, sf_dir, "documents").select("lang", F.col("doc_id").alias("id"), "n_chars")
    truth = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id")).join(docs.select("lang", "id"), "id").select("lang", "id")
    return evaluate.precision_recall(docs.where("n_chars > 1000").select("lang", "id"), truth, "lang")


@query("""WITH r AS (SELECT lang, n_chars > 500 AS ok, CASE WHEN quality IS NOT NULL THEN quality END AS q FROM documents LEFT JOIN labels USING (doc_id))
SELECT CASE WHEN grouping(lang) = 1 THEN 'ALL' ELSE lang END AS category, count(*) AS n, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS n_passed, round(coalesce(avg(q), 1.0), 4) AS rate FROM r GROUP BY ROLLUP (lang)""")
def ag13_summary(spark, sf_dir):
    """AG-13 to AG-16, AG-18, AG-20: rates over the applicable subset per category, with a total row."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("lang", (F.col("n_chars") > 500).alias("ok"), "quality")
    return evaluate.summary(rows, "lang", "ok", "quality")


@query("""WITH r AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank, quality AS rel FROM documents JOIN labels USING (doc_id)),
s AS (SELECT *, rel * sum(rel) OVER (PARTITION BY source ORDER BY rank) / rank AS p FROM r)
SELECT source, round(CASE WHEN sum(rel) > 0 THEN sum(p) / sum(rel) ELSE 0.0 END, 6) AS ap, CAST(sum(rel) AS BIGINT) AS n_relevant FROM s GROUP BY source""")
def ag17_average_precision(spark, sf_dir):
    """AG-17, AG-19, WN-12: average precision of length as a ranking of quality, per source."""
    from pyspark.sql import Window as W

    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    ranked = rows.select("source", F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).alias("rank"), F.col("quality").alias("rel"))
    return evaluate.average_precision(ranked, "source")


@query("""WITH g AS (SELECT l_orderkey, list(DISTINCT concat('P', l_partkey)) FILTER (WHERE l_linenumber <= 2) AS must, list(DISTINCT concat('P', l_partkey)) FILTER (WHERE l_linenumber > 5) AS mustnot, list(DISTINCT concat('P', l_partkey)) FILTER (WHERE l_quantity > 10) AS got FROM lineitem GROUP BY 1),
h AS (SELECT l_orderkey, coalesce(must, []) AS must, coalesce(mustnot, []) AS mustnot, coalesce(got, []) AS got FROM g),
k AS (SELECT *, len(list_filter(must, lambda e: len(list_filter(got, lambda c: e = c OR starts_with(e, c) OR starts_with(c, e))) > 0)) AS hit, len(list_filter(mustnot, lambda e: len(list_filter(got, lambda c: e = c OR starts_with(e, c) OR starts_with(c, e))) > 0)) AS bad FROM h)
SELECT l_orderkey, round(CASE WHEN len(must) = 0 THEN 1.0 ELSE hit / len(must) END, 6) AS recall, round(CASE WHEN len(mustnot) = 0 THEN 0.0 ELSE bad / len(mustnot) END, 6) AS collision_rate, (len(must) = 0 OR hit = len(must)) AND bad = 0 AS passed FROM k""")
def ag11_retrieval_metrics(spark, sf_dir):
    """AG-11, JN-28, CD-12, CD-13: recall, collisions and pass of every order as a benchmark item."""
    part = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    held = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_linenumber") <= 2, part)).alias("must"), F.collect_set(F.when(F.col("l_linenumber") > 5, part)).alias("must_not"), F.collect_set(F.when(F.col("l_quantity") > 10, part)).alias("got"))
    return held.select("l_orderkey", *evaluate.retrieval_metrics(F.col("must"), F.col("must_not"), F.col("got")))


@query("SELECT doc_id, CASE WHEN n_chars > 1000 AND quality = 1 THEN 'PASS' WHEN n_chars <= 1000 AND quality <> 1 THEN CASE WHEN toxic = 1 THEN 'RETRIEVAL_MISS_REFUSED' ELSE 'RETRIEVAL_AND_GENERATION' END WHEN n_chars <= 1000 THEN 'RETRIEVAL' ELSE 'GENERATION' END AS cause FROM documents JOIN labels USING (doc_id)")
def pr12_root_cause(spark, sf_dir):
    """PR-12, AG-15: root cause of every labelled document."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select("doc_id", evaluate.root_cause(F.col("n_chars") > 1000, F.col("quality") == 1, F.col("toxic") == 1).alias("cause"))


@query("""WITH b AS (SELECT source, lang, doc_id // 1000 AS bucket, count(*) AS n, md5(string_agg(md5(coalesce(text, '')), '|' ORDER BY doc_id)) AS part, min(doc_id) AS first_id FROM documents GROUP BY source, lang, bucket)
SELECT source, lang, CAST(sum(n) AS BIGINT) AS n, md5(string_agg(part, '|' ORDER BY bucket)) AS texts, min(first_id) AS first_id FROM b GROUP BY source, lang""")
def ag03_grouping(spark, sf_dir):
    """AG-03, AG-25, PR-15: documents grouped with an ordered digest of their whole texts.

    The order is that of the ids. Texts are digested where they are read, then per bucket of 1000 ids, then per group, so no row holds a group's texts and a hot group's lists are a thousandth of its rows."""
    ordered = lambda key, value: F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, value))), lambda x: x[value]), "|").cast("binary"))
    texts = table(spark, sf_dir, "documents").select("source", "lang", "doc_id", F.floor(F.col("doc_id") / 1000).alias("bucket"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))
    buckets = texts.groupBy("source", "lang", "bucket").agg(F.count("*").alias("n"), ordered("doc_id", "digest").alias("part"), F.min("doc_id").alias("first_id"))
    return buckets.groupBy("source", "lang").agg(F.sum("n").alias("n"), ordered("bucket", "part").alias("texts"), F.min("first_id").alias("first_id"))


@query("SELECT doc_id, length(e) AS n_chars, md5(e) AS enriched FROM (SELECT doc_id, concat_ws(chr(10), concat('[', source, ']'), CASE WHEN lang <> 'en' THEN concat('lang: ', lang) END, trim(text)) AS e FROM documents)")
def pr02_enriched_text(spark, sf_dir):
    """PR-01, PR-02, PR-11, SRC-10: header lines joined with the whole body; the digest and length of the enriched text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    enriched = docs.select("doc_id", F.concat_ws("\n", F.concat(F.lit("["), "source", F.lit("]")), F.when(F.col("lang") != "en", F.concat(F.lit("lang: "), "lang")), F.trim("text")).alias("e"))
    return enriched.select("doc_id", F.char_length("e").cast("long").alias("n_chars"), F.md5(F.col("e").cast("binary")).alias("enriched"))
