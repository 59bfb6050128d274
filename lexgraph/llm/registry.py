"""The queries opN_<name> and pipeline, and their SQL; ``__spark_entry__`` adds them when this package is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, centroids, chat, contamination, extraction, packing, quality, secrets, setjoin, sharding, suffixes, trie, warc
from .tables import read, with_workers

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer() -> tuple[str, str]:
    """Path of the public rank file and the pattern that splits text before its merges."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(with_workers(spark), sf_dir, "pages"))


def op2_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.query(read(spark, sf_dir, "conversations"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(read(with_workers(spark), sf_dir, "pages"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.jaccard_groups(read(with_workers(spark), sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(read(with_workers(spark), sf_dir, "documents")).drop("kept")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(read(with_workers(spark), sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(read(spark, sf_dir, "documents"), sharding.LIMIT)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(with_workers(spark), sf_dir, "documents"), *tokenizer())


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digested(*centroids.cluster(read(with_workers(spark), sf_dir, "embeddings"), k=8, rounds=10, size=64))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.query(read(with_workers(spark), sf_dir, "conversations"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.digested(packing.sequences(read(with_workers(spark), sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_warc_round_trip, op2_chat_rotation, op3_main_text, op4_ngram_jaccard_join, op5_benchmark_decontamination,
        op6_suffix_dedup, op7_quality_rules, op8_extendible_sharding, op9_byte_bpe, op10_secret_scan,
        op11_centroid_clustering, op12_prefix_trie, op13_packing,
    )
}

OP1_SQL = """
WITH page AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
shared AS (SELECT payload_digest, max(page_id) AS first FROM page WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN s.first IS NULL OR s.first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN s.first <> page_id THEN s.first END AS refers_to
FROM page LEFT JOIN shared s USING (payload_digest)"""

_LOWERED = f"translate(coalesce(text, ''), '{contamination.UPPER}', '{contamination.LOWER}')"
_WORDS = r"'[^\x20\x09-\x0D]+'"

OP4_SQL = f"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all({_LOWERED}, {_WORDS}) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM doc, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS g(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS d, doc_id AS r FROM n UNION SELECT reach.d, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r),
least AS (SELECT d, min(r) AS component_id FROM reach GROUP BY d)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM doc LEFT JOIN n USING (doc_id) LEFT JOIN least ON d = doc_id"""

OP7_SQL = f"""
WITH doc AS (
  SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS t, md5(coalesce(text, '')) AS k, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_WORDS})) AS l FROM documents),
spots AS (SELECT doc_id, unnest(generate_series(1, len(w) - 7)) AS i, unnest(list_transform(generate_series(1, len(w) - 7), lambda i: array_to_string(w[i : i + 7], ' '))) AS g FROM doc WHERE len(w) > 7),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM spots),
again AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM win WHERE c > 1) GROUP BY doc_id),
line AS (
  SELECT doc_id, host, k, unnest(list_transform(l, lambda x: len(regexp_extract_all(x, {_WORDS})))) AS n,
    unnest(list_transform(l, lambda x: array_to_string(regexp_extract_all(translate(x, '{contamination.UPPER}', '{contamination.LOWER}'), {_WORDS}), ' '))) AS norm FROM doc),
hosts AS (SELECT host, count(DISTINCT k) AS docs FROM doc GROUP BY host),
frequent AS (SELECT host, norm FROM line JOIN hosts USING (host) GROUP BY host, norm, hosts.docs HAVING count(DISTINCT k) >= 30 AND count(DISTINCT k) >= 0.1 * hosts.docs),
gone AS (SELECT doc_id, sum(n) AS n FROM line SEMI JOIN frequent ON frequent.host = line.host AND frequent.norm = line.norm GROUP BY doc_id),
base AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(again.n, 0) AS n_repeat_words, len(w) - coalesce(gone.n, 0) AS rest FROM doc LEFT JOIN again USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR rest < 10 OR rest < 0.5 * n_words) AS kept FROM base"""

ORACLE_SQL: dict[str, str] = {
    "op4_ngram_jaccard_join": OP4_SQL,
    "op7_quality_rules": OP7_SQL,
    "op1_warc_round_trip": OP1_SQL,
    "op2_chat_rotation": chat.SQL,
    "op5_benchmark_decontamination": contamination.sql(),
    "op8_extendible_sharding": sharding.SQL,
    "op11_centroid_clustering": centroids.sql(),
    "op12_prefix_trie": trie.SQL,
}
