"""Automata, the stored text and vector indexes, and the dictionary of substrings against plain forms."""

import random

import pytest
from pyspark.sql import functions as F

from lexgraph.functions import legal
from lexgraph.operators import patterns, retrieval, substrings
from lexgraph.operators.textindex import TextIndex
from lexgraph.operators.vectorindex import VectorIndex


@pytest.mark.parametrize("rows", [patterns.SHARD_ROWS, 700])
def test_longest_alias(spark, rows):
    """10,000 aliases in one shard and in many, against a scan."""
    rng = random.Random(1)
    name = lambda n: "".join(rng.choice("abcĐđ ") for _ in range(n))
    aliases = [(f"e{k}", name(rng.randrange(2, 9)), k) for k in range(10_000)] + [("last", "AB", -1), ("none", None, 0)]
    texts = [(k, name(rng.randrange(40))) for k in range(60)] + [(1000, None), (1001, ""), (1002, "AB")]
    got = dict(patterns.longest_alias(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(aliases, "entity string, alias string, ord long"), rows=rows).collect())

    def plain(text):
        found = [(len(a), -o, e) for e, a, o in aliases if a is not None and text is not None and a.lower() in text.lower()]
        return max(found)[2] if found else None

    assert got == {i: plain(t) for i, t in texts}


def test_empty_registries(spark):
    texts = spark.createDataFrame([(1, "abc"), (2, None)], "id long, text string")
    none = spark.createDataFrame([], "entity string, alias string, ord long")
    assert dict(patterns.longest_alias(texts, none).collect()) == {1: None, 2: None}
    blank = spark.createDataFrame([("e", "", 1)], "entity string, alias string, ord long")
    assert dict(patterns.longest_alias(texts, blank).collect()) == {1: "e", 2: None}
    assert patterns.contained(texts, spark.createDataFrame([("",), (None,)], "pattern string")).count() == 0


def test_contained(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("ab ") for _ in range(rng.randrange(1, 5))) for _ in range(40)]
    texts = [(k, "".join(rng.choice("ab ") for _ in range(30))) for k in range(30)] + [(99, None)]
    got = {tuple(r) for r in patterns.contained(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(w,) for w in words], "pattern string"), rows=10).collect()}
    assert got == {(i, w) for i, t in texts for w in words if t and w in t}


def test_references_by_registry():
    """The registry is looked up by an automaton: the longest name, the first of equally long ones."""
    known = {f"luật số {k}": f"{k}/2020/QH14" for k in range(10_000)} | {"luật đường bộ": "35/2024/QH15", "đường bộ": "1/2001/X"}
    assert legal.references("khoản 1 Điều 2 của Luật Đường bộ", "9/2025/X", (None, None, None), known) == [("35_2024_QH15_D2_K1", "THAM_CHIEU")]
    assert legal.references("khoản 1 Điều 2 của Luật số 77", "9/2025/X", (None, None, None), known) == [("77_2020_QH14_D2_K1", "THAM_CHIEU")]
    assert legal.references("Điều 2 của Luật Lạ", "9/2025/X", (None, None, None), known) == [(None, "THAM_CHIEU")]


WORDS = [f"{a}{b}" for a in "abcdefghij" for b in "uvwxyz"]


def _units(rng, n):
    weight = [1 / (k + 1) for k in range(len(WORDS))]
    return [(k, " ".join(rng.choices(WORDS, weight, k=rng.randrange(1, 40)))) for k in range(n)]


@pytest.fixture(scope="module")
def units(spark):
    rng = random.Random(3)
    rows = [*_units(rng, 900), (900, None), (901, ""), (5000, "au"), (9000, "au bu")]
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "id long, text string, term string, n int").repartition(3)


@pytest.mark.parametrize(("k", "block"), [(3, 64), (20, 4096), (1000, 16)])
def test_stored_postings(spark, units, tmp_path, k, block):
    """Many questions over two appended batches, one of which comes twice, equal the scores of all units."""
    rng = random.Random(4)
    questions = [(q, " ".join(rng.choices(WORDS, k=rng.randrange(1, 8)))) for q in range(25)] + [(100, "zz unknown"), (101, None), (102, "au"), (103, "au au bu jz jy")]
    asked = spark.createDataFrame(questions, "query_id long, text string")
    index = TextIndex(spark, str(tmp_path / "index"), buckets=8, block=block)
    index.append(units.where("id % 2 = 0"), "a")
    index.append(units.where("id % 2 = 1"), "b")
    index.append(units.where("id % 2 = 1"), "b")
    want = retrieval.bm25(units, asked, k).select("query_id", "id", "sparse_score", "rank").collect()
    assert sorted(map(tuple, index.bm25(asked, k).select("query_id", "id", "sparse_score", "rank").collect())) == sorted(map(tuple, want))
    counts = {t: n for t, n in index.dictionary().collect()}
    assert counts == {r.term: r.n for r in retrieval.postings(units).groupBy("term").agg(F.count("*").alias("n")).collect()}


def test_reads_asked_buckets_only(spark, units, tmp_path):
    index = TextIndex(spark, str(tmp_path / "index"), buckets=16)
    index.append(units, "a")
    asked = spark.createDataFrame([(1, "au")], "query_id long, text string")
    plan = index.bm25(asked, 5)._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan
    bucket = index._asked(asked)[1]
    assert len(bucket) == 1
    files = [r[0] for r in index.postings(bucket).select(F.input_file_name()).distinct().collect()]
    assert files and all(f"bucket={bucket[0]}/" in f for f in files)


def test_word_holds_token(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abà_1") for _ in range(rng.randrange(1, 9))) for _ in range(300)}
    tokens = {"".join(rng.choice("abà_1") for _ in range(rng.randrange(1, 5))) for _ in range(60)} | {"zzz", "aaaa"}
    index = substrings.gram_index(spark.createDataFrame([(w,) for w in words], "word string"))
    got = {tuple(r) for r in substrings.containing(index, spark.createDataFrame([(t,) for t in tokens], "token string")).collect()}
    assert got == {(t, w, float(w.count(t))) for w in words for t in tokens if t in w}


def test_densities(spark):
    """Decided per word equals decided per text."""
    rng = random.Random(6)
    pool = ["đèn", "đỏ", "vượt", "xe", "máy", "xe_máy", "a1", "ba", "mũ bảo hiểm", "thiết bị âm thanh", "vượt xe", "đèn tín hiệu", "tốc độ", "quá tốc độ"]
    say = lambda n: "".join(rng.choice(pool) + rng.choice([" ", " ", " ", "  ", ", ", "\n", ""]) for _ in range(rng.randrange(n)))
    texts = [(i, say(30)) for i in range(40)] + [(90, None), (91, ""), (92, "VƯỢT XE")]
    questions = [(q, say(8)) for q in range(15)] + [(50, None), (51, "đèn đỏ đèn đỏ"), (52, "vượt đèn")]
    docs, asked = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(questions, "query_id long, text string")
    got = {(r.query_id, r.id): r.density for r in substrings.lexical_densities(docs, asked).collect()}
    per_text = docs.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("low")).crossJoin(asked.select("query_id", retrieval.density_query(F.col("text")).alias("asked")))
    want = {(r.query_id, r.id): r.density for r in per_text.select("query_id", "id", retrieval.lexical_density(F.col("asked"), F.col("low")).alias("density")).collect()}
    assert got == want and any(want.values())


def test_vector_lists(spark, tmp_path):
    rng = random.Random(8)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]

    def unit(c):
        v = [x + rng.gauss(0, 0.5) for x in c]
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v]

    rows = [(k, unit(rng.choice(centres))) for k in range(1500)]
    vectors = spark.createDataFrame([*rows, (7000, None), (7001, [1.0])], "id long, embedding array<double>")
    index = VectorIndex.fit(vectors.where("id < 7000"), str(tmp_path / "v"), lists=24)
    index.append(vectors.where("id % 2 = 0"), "a")
    for _ in range(2):
        index.append(vectors.where("id % 2 = 1"), "b")
    assert index.vectors().count() == 1500
    assert index.calibrate(10, 0.95, 40) >= 0.95 and index.probes < 24
    asked = vectors.where("id % 50 = 0 and id < 7000").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    assert index.recall(asked, 10) >= 0.9
    exact = retrieval.knn(vectors.where("id < 7000"), asked, 10)
    assert sorted(map(tuple, index.certified(asked, 10).collect())) == sorted(map(tuple, exact.collect()))
