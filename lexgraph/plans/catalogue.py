"""The engine's queries over the star schema and the text tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from lexgraph.storage import with_workers

from . import amendments, changes, corpus, entity_import, paths, scalars, search, sentences, star

Query = Callable[[SparkSession, str], DataFrame]
MODULES = [star, search, scalars, corpus, amendments, entity_import, sentences, changes, paths]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.QUERIES["tx05_hybrid_fusion"](spark, sf_dir)


def _anywhere(f: Query) -> Query:
    """``f``, whose Python workers find this package whatever folder the session was started in."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(with_workers(spark), sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {name: _anywhere(f) for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
