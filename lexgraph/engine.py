"""The facade: ask a batch of questions, look up provisions, list documents, ingest."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgraph.operators import graph, retrieval, temporal


@dataclass(frozen=True)
class Settings:
    """SRC-13, SRC-14: what a deployment may set."""

    top_k: int = 5
    candidates: int = 20
    floor: float = retrieval.FLOOR
    dense_weight: float = 1.0
    sparse_weight: float = 1.0
    prefilter: bool = False

    @classmethod
    def from_env(cls, env: dict[str, str], base: dict | None = None, prefix: str = "LEXGRAPH_") -> Settings:
        """Environment over file over defaults."""
        values = dict(base or {})
        for name, kind in cls.__annotations__.items():
            if (raw := env.get(prefix + name.upper())) is not None:
                values[name] = raw.lower() in ("1", "true", "yes") if kind == "bool" else float(raw) if kind == "float" else int(raw)
        return cls(**values)


@dataclass
class Engine:
    """Tables: units (id, text, document_id), vectors (id, embedding), nodes, edges, versions."""

    spark: SparkSession
    units: DataFrame
    vectors: DataFrame
    nodes: DataFrame
    versions: DataFrame | None = None
    settings: Settings = Settings()
    generate: Callable[[DataFrame], DataFrame] | None = None

    def retrieve(self, questions: DataFrame, document_id: str | None = None) -> DataFrame:
        """TX-07, FL-05, CD-16: hybrid retrieval for questions (query_id, text, query_vector); the document filter follows the k-NN cut unless ``prefilter``."""
        s, units = self.settings, self.units
        if document_id:
            units = units.where(F.col("document_id") == document_id)
        vectors = self.vectors.join(units.select("id"), "id", "left_semi") if document_id and s.prefilter else self.vectors
        dense = retrieval.knn(vectors, questions.where("query_vector is not null").select("query_id", "query_vector"), s.candidates)
        if document_id and not s.prefilter:
            dense = dense.join(units.select("id"), "id", "left_semi")
        sparse = retrieval.bm25(units.select("id", "text"), questions.select("query_id", "text"), s.candidates)
        return retrieval.fuse(dense, sparse, s.top_k, s.dense_weight, s.sparse_weight, s.floor)

    def ask(self, questions: DataFrame, as_of: str | None = None) -> DataFrame:
        """Evidence rows per question; ``generate`` (a pluggable text model over evidence) adds answers, without one evidence is returned."""
        found = self.retrieve(questions).join(self.units, "id").join(graph.ancestors(self.nodes), "id", "left")
        if self.versions is not None:
            rows = self.versions.where(temporal.valid_at(F.lit(as_of).cast("date"))) if as_of else temporal.latest(self.versions, "provision_id", "version_id")
            found = found.join(rows.withColumnRenamed("provision_id", "id"), "id", "left")
        return self.generate(found) if self.generate else found

    def lookup(self, unit_id: str) -> DataFrame:
        """JN-30."""
        return self.nodes.where(F.col("id") == unit_id)

    def documents(self, skip: int = 0, limit: int = 20) -> DataFrame:
        """JN-29, SRC-17."""
        articles = self.nodes.where("label = 'Article'").select(F.substring_index("id", "_D", 1).alias("id")).groupBy("id").agg(F.count("*").alias("n_articles"))
        return self.nodes.where("label = 'Document'").join(articles, "id", "left").na.fill(0, ["n_articles"]).orderBy("id").offset(skip).limit(limit)


def sync(stages: Sequence[tuple[str, Callable[[], object]]], required: int = 3, dry_run: bool = False) -> list[tuple[str, str, str]]:
    """CON-07, CD-06, CD-17: named stages in order, each a step that writes its tables: (stage, status, message) of each.

    A failure among the first ``required`` stages skips the rest; a later one is a warning. ``dry_run`` only lists them."""
    report: list[tuple[str, str, str]] = []
    failed = False
    for k, (name, run) in enumerate(stages):
        if dry_run or failed:
            report.append((name, "skipped" if failed else "planned", ""))
            continue
        try:
            run()
            report.append((name, "done", ""))
        except Exception as e:  # noqa: BLE001  a stage may fail in any way; its report says how
            failed = k < required
            report.append((name, "failed" if failed else "warning", f"{type(e).__name__}: {e}"))
    return report
