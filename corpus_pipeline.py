"""The corpus pipeline: quality rules, near duplicates, benchmark passages, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a table; it is written as Parquet and read again as the next stage's docs. All but the last stage
return the columns of ``documents``. Null and repeated rows follow the docstrings of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgraph.llm import bpe, contamination, quality, secrets, setjoin
from lexgraph.llm.registry import tokenizer
from lexgraph.llm.tables import cut, read, row_key, with_workers

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _of(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, and the boilerplate lines of the others. A row's verdict is found by its id, text and host; ``n_chars`` follows a changed text."""
    docs = _of(docs)
    return quality.without_boilerplate(docs, cut(quality.quality_rules(docs), "pipeline-verdicts"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id. Rows are found by id and text, so another text of that id isn't kept for it; of repeated rows one stays."""
    docs = _of(docs)
    stay = setjoin.representatives(cut(setjoin.jaccard_groups(docs), "pipeline-groups")).select(F.col("row_key").alias("stay_key"))
    return docs.join(stay, row_key(docs["doc_id"], docs["text"]) == F.col("stay_key"), "left_semi").dropDuplicates(["doc_id", "text"])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    docs = _of(docs)
    found = contamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))
    leaks = found.where("contaminated").select(F.col("row_key").alias("leak_key")).distinct()
    return docs.join(leaks, row_key(docs["doc_id"], docs["text"]) == F.col("leak_key"), "left_anti")


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret span of a text is replaced by ``[SECRET]``; n_chars follows. No document goes."""
    docs = _of(docs)
    return secrets.redact(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document: doc_id, lang, source, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.round_trip(_of(docs), *tokenizer(), keep=["lang", "source"])


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_duplicates_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scans", secrets_stage),
    ("byte_bpe", tokens_stage),
]

#: Links, components and the tokenizer have no practical SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    with_workers(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
