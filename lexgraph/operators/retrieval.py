"""Hybrid retrieval as one plan for a batch of queries: exact k-NN, BM25, rank fusion, floors, guards, diversity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import nearest
from .graph import small

#: Constants of rank fusion, of the similarity floor and of the dynamic cut-off.
RRF_K, FLOOR, RATIO, DROP = 60, 0.50, 0.80, 0.15
#: BM25's usual constants.
K1, B = 1.2, 0.75


def cosine(a: Column, b: Column) -> Column:
    """MA-06: clamped dot product of unit vectors, summed in order as doubles; 0 if the sizes differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.least(F.greatest(dot, F.lit(-1.0)), F.lit(1.0))).otherwise(F.lit(0.0))


#: Queries that one pass of :func:`knn` sends to every task.
QUERY_BLOCK = 20_000


def knn(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """TX-01, SO-01: the k most similar vectors of each query (exact; ties to the smaller id).

    Queries are a stated set against all rows, in blocks: ``QUERY_BLOCK`` queries at most are sent to every task in one pass over the vectors, and each task keeps its own k best per query before the shuffle
    (Spark plans the rank limit on both sides of it). More queries take more passes; a query is in one block only, so its ranking is whole."""
    n = queries.count()
    blocks = -(-n // QUERY_BLOCK) or 1
    best = None
    for block in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        scored = _scored(vectors, part, k)
        ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("dense_score"), "id"))).where(F.col("rank") <= k)
        best = ranked if best is None else best.union(ranked)
    return best


def _scored(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, dense_score) with all pairs that can be among the k best: finite vectors of the queries' most frequent size by matrix products, pairs with others one by one."""
    one_by_one = lambda v, q: v.join(F.broadcast(q)).select("query_id", "id", F.round(cosine(F.col("embedding"), F.col("query_vector")), 6).alias("dense_score"))
    usual = queries.groupBy(F.size("query_vector").alias("size")).count().where("size > 0").orderBy(F.desc("count"), "size").first()
    if usual is None or not vectors.schema["id"].dataType.simpleString() == "bigint" or not queries.schema["query_id"].dataType.simpleString() in ("bigint", "int", "string"):
        return one_by_one(vectors, queries)
    size = usual["size"]
    even, plain = nearest.regular("embedding", size) & F.col("id").isNotNull(), nearest.regular("query_vector", size)
    asked = queries.where(plain).select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector")).toArrow()
    scored = nearest.best_pairs(vectors.where(even), asked, size, k).select("query_id", "id", F.round("score", 6).alias("dense_score"))
    scored = scored.union(one_by_one(vectors.where(~even), queries))
    odd = queries.where(~plain)
    return scored if odd.isEmpty() else scored.union(one_by_one(vectors.where(even), odd))


def terms(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def postings(units: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """SNK-12, TX-02: (term, id, tf, dl), the table that stands for a full-text index."""
    words = units.select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("w")).select("id", F.size("w").alias("dl"), F.explode("w").alias("term"))
    return words.groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))


def bm25(units: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """TX-02, TX-03, SO-02: top k per query by BM25 over distinct query terms. queries: query_id, text.

    Only postings of query terms are counted; lengths and document counts cover all units."""
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    wanted = small(asked.select("term").distinct())
    base = units.select(F.col("id"), terms(F.col("text")).alias("w"))
    stats = base.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avgdl"))
    held = base.select("id", F.size("w").alias("dl"), F.explode("w").alias("term")).join(wanted, "term").groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    scored = held.join(df, "term").join(asked, "term").crossJoin(F.broadcast(stats))  # stats is one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    totals = scored.select("query_id", "id", part.alias("s")).groupBy("query_id", "id").agg(F.round(F.sum("s"), 4).alias("sparse_score"))
    ranked = totals.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("sparse_score"), "id")))
    return ranked.where(F.col("rank") <= k)


def fuse(dense: DataFrame, sparse: DataFrame, top_k: int, w_dense: float = 1.0, w_sparse: float = 1.0, floor: float | None = FLOOR, dynamic: bool = True) -> DataFrame:
    """TX-05, AG-10, SO-03, WN-01, FL-09, FL-10: reciprocal rank fusion with similarity floor and dynamic cut-off.

    dense: query_id, id, rank, dense_score; sparse: query_id, id, rank. If a query's best dense score is below the floor its result is empty. Within the first ``top_k`` the first row
    stays, others stay without a dense score or with one of at least max(0.8 of the best, the best - 0.15); nothing is filled up."""
    a = dense.select("query_id", "id", "dense_score", (F.lit(w_dense) / (RRF_K + F.col("rank"))).alias("p"), F.col("rank").alias("seen"))
    b = sparse.select("query_id", "id", F.lit(None).cast("double").alias("dense_score"), (F.lit(w_sparse) / (RRF_K + F.col("rank"))).alias("p"), (F.col("rank") + 1_000_000).alias("seen"))
    best = dense.groupBy("query_id").agg(F.max("dense_score").alias("best"))
    fused = a.union(b).groupBy("query_id", "id").agg(F.max("dense_score").alias("dense_score"), F.round(F.sum("p"), 6).alias("rrf"), F.min("seen").alias("seen")).join(best, "query_id", "left")
    if floor is not None:
        fused = fused.where(F.col("best").isNull() | (F.col("best") >= floor))
    ranked = fused.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rrf"), "seen", "id"))).where(F.col("rank") <= top_k)
    if dynamic:
        ranked = ranked.where((F.col("rank") == 1) | F.col("best").isNull() | F.col("dense_score").isNull() | (F.col("dense_score") >= F.greatest(F.col("best") * RATIO, F.col("best") - DROP)))
    return ranked.select("query_id", "id", "dense_score", "rrf", "rank")


def fuse_many(lists: DataFrame, top_k: int) -> DataFrame:
    """TX-06: unweighted fusion of the lists of a query's variants. lists: query_id, variant, id, rank."""
    total = lists.groupBy("query_id", "id").agg(F.round(F.sum(F.lit(1.0) / (RRF_K + F.col("rank"))), 6).alias("rrf"), F.min(F.struct("variant", "rank")).alias("seen"))
    ranked = total.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rrf"), "seen", "id")))
    return ranked.where(F.col("rank") <= top_k).select("query_id", "id", "rrf", "rank")


def guard(chunks: DataFrame, must: Sequence[str], must_not: Sequence[str]) -> DataFrame:
    """FL-11: rows that lack every must term and hold a must-not term go. If no row of the query has a must term all stay; with must-not terms only, violators go unless all would."""
    hay = F.lower(F.concat_ws(" ", "title", "text"))
    holds = lambda words: F.exists(F.array(*[F.lit(w.lower()) for w in words]).cast("array<string>"), lambda t: F.contains(hay, t))
    marked = chunks.withColumn("has", holds(must)).withColumn("bad", holds(must_not))
    # one small row per query is joined back, so no query's texts are gathered
    facts = marked.groupBy(F.col("query_id").alias("__q")).agg(F.max("has").alias("__any"), F.min("bad").alias("__all_bad"))
    judged = marked.join(facts, F.col("query_id").eqNullSafe(F.col("__q")))
    stays = ~F.col("__any") | F.col("has") | ~F.col("bad") if must else F.col("__all_bad") | ~F.col("bad")
    return judged.where(stays).drop("has", "bad", "__q", "__any", "__all_bad")


def diversify(ranked: DataFrame, classes: Sequence[str], top_k: int) -> DataFrame:
    """SO-04: the best row of each class in the order of ``classes``, then the rest by rank, cut to ``top_k``. ranked: query_id, id, class, rank."""
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("class"))
    first = F.row_number().over(W.partitionBy("query_id", "class").orderBy("rank"))
    order = F.when((F.col("__first") == 1) & (F.col("__place") > 0), F.col("__place")).otherwise(len(classes) + 1)
    out = ranked.withColumn("__place", place).withColumn("__first", first).withColumn("__order", order)
    out = out.withColumn("new_rank", F.row_number().over(W.partitionBy("query_id").orderBy("__order", "rank", "id")))
    return out.where(F.col("new_rank") <= top_k).drop("__place", "__first", "__order")


def best_per_parent(units: DataFrame, n: int = 3) -> DataFrame:
    """WN-02, WN-03, TX-04: per (query, parent) the n best units, then ranked by parent rank and place in it; a unit counts at its first parent. units: query_id, parent_rank, parent, id, unit_score, ord."""
    own = units.withColumn("in_parent", F.row_number().over(W.partitionBy("query_id", "parent").orderBy(F.desc("unit_score"), "ord"))).where(F.col("in_parent") <= n)
    once = own.withColumn("__n", F.row_number().over(W.partitionBy("query_id", "id").orderBy("parent_rank", "in_parent"))).where("__n = 1").drop("__n")
    return once.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("parent_rank", "in_parent", "id")))


#: Phrases of a question and the phrases of a text that answer to them.
EXPANSIONS = [
    (("đèn đỏ", "đèn tín hiệu", "vượt đèn"), ("đèn tín hiệu", "đèn tín hiệu giao thông", "hiệu lệnh của đèn")),
    (("xe máy", "mô tô"), ("xe mô tô", "xe gắn máy", "xe mô tô, xe gắn máy")),
    (("nồng độ cồn", "uống rượu", "uống bia"), ("nồng độ cồn", "trong máu hoặc hơi thở")),
    (("mũ bảo hiểm",), ("mũ bảo hiểm",)),
    (("tốc độ", "quá tốc độ"), ("quá tốc độ",)),
    (("ngược chiều",), ("ngược chiều",)),
    (("tai nghe", "đeo tai nghe", "thiết bị âm thanh"), ("thiết bị âm thanh", "trừ thiết bị trợ thính")),
]
#: Questions about lights, and what a text about overtaking says and lacks.
LIGHTS, OVERTAKING, LIGHT = ("đèn đỏ", "đèn tín hiệu", "vượt đèn"), "vượt xe", "đèn"


def _any(hay: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(hay, F.lit(word))
    return found


def density_query(text: Column) -> Column:
    """What :func:`lexical_density` needs of a question, as a struct to be computed once per question: distinct tokens of two or more characters, bigrams of all of them, and the groups of phrases it asks for."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.filter(F.split(low, r"[^\p{L}\p{N}_]+"), lambda t: F.char_length(t) > 1)
    n = F.greatest(F.size(words) - 1, F.lit(0))
    bigrams = F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda x, y: F.concat(x, F.lit(" "), y))
    asked = F.filter(F.array(*[F.when(_any(low, triggers), F.array(*[F.lit(t) for t in targets])) for triggers, targets in EXPANSIONS]), lambda x: x.isNotNull())
    return F.struct(F.array_distinct(words).alias("tokens"), bigrams.alias("bigrams"), asked.alias("phrases"), _any(low, LIGHTS).alias("lights"))


def lexical_density(asked: Column, low: Column) -> Column:
    """ST-20, SE-08, SO-11: coverage * 10 + min(tf, 20) * 0.1 + 2 per bigram + 3 per answered group of phrases - 4 for a text about overtaking where lights are asked for; by substrings, 0 at least, 0 if nothing counts.

    ``asked`` is a column of :func:`density_query`, ``low`` the text in lower case; give both as columns of an earlier projection, so that neither is computed again per token."""
    tokens = asked["tokens"]
    matched = F.filter(tokens, lambda t: F.contains(low, t))
    tf = F.aggregate(matched, F.lit(0).cast("double"), lambda s, t: s + (F.char_length(low) - F.char_length(F.replace(low, t))) / F.char_length(t))
    bonus = 2 * F.size(F.filter(asked["bigrams"], lambda p: F.contains(low, p))) + 3 * F.size(F.filter(asked["phrases"], lambda group: F.exists(group, lambda p: F.contains(low, p))))
    bonus = bonus - F.when(asked["lights"] & F.contains(low, F.lit(OVERTAKING)) & ~F.contains(low, F.lit(LIGHT)), 4).otherwise(0)
    score = F.size(matched) / F.size(tokens) * 10 + F.least(tf, F.lit(20.0)) * 0.1 + bonus
    nothing = (F.coalesce(low, F.lit("")) == "") | (F.size(tokens) == 0) | (F.size(matched) == 0) & (bonus <= 0)
    return F.when(nothing, F.lit(0.0)).otherwise(F.round(F.greatest(score, F.lit(0.0)), 4))


def hashed_vectors(texts: DataFrame, dims: int = 256) -> DataFrame:
    """CON-03, UD-05: (id, counts, embedding) of texts (id, text) without a model: words counted in ``dims`` slots of their hash, scaled to length 1; blank texts are zero vectors.

    Words are counted by (id, slot) with map-side combining; a row is built from at most ``dims`` counts, whatever the length of its text."""
    slot = lambda t: (F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("long") % dims).cast("int")
    counts = texts.select("id", F.explode(terms(F.coalesce("text", F.lit("")))).alias("t")).groupBy(F.col("id").alias("__id"), slot(F.col("t")).alias("slot")).agg(F.count("*").alias("n"))
    held = counts.groupBy("__id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("m"))
    joined = texts.select("id").join(held, F.col("id").eqNullSafe(F.col("__id")), "left").withColumn("m", F.coalesce("m", F.create_map().cast("map<int,bigint>")))
    shown = joined.select("id", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0).cast("long"))).alias("counts"))
    norm = F.sqrt(F.aggregate("counts", F.lit(0.0), lambda s, x: s + x * x))
    shown = shown.withColumn("norm", norm)
    return shown.select("id", "counts", F.transform("counts", lambda x: F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(0.0)).alias("embedding"))


def index_stats(units: DataFrame, indexed: DataFrame) -> DataFrame:
    """AG-06: documents, units, indexed and failed ones. units: id, document_id; indexed: id."""
    done = indexed.select(F.col("id").alias("__id")).distinct()
    joined = units.join(done, F.col("id") == F.col("__id"), "left")
    return joined.agg(F.count_distinct("document_id").alias("n_documents"), F.count("*").alias("n_units"), F.count("__id").alias("n_indexed"), (F.count("*") - F.count("__id")).alias("n_failed"))
