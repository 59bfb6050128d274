"""Many fixed patterns against many texts: Aho-Corasick automata that are broadcast, one pass over each text.

A pattern table is dealt into shards of bounded rows and bytes. A shard is collected, sent to the executors once, and built into an automaton once per worker; texts pass through it in Arrow
batches. A registry of any usual size is one shard; a larger one takes as many passes over the texts as it has shards, chained without a shuffle, and gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexgraph.storage import kept, with_workers

#: Bounds of what one shard holds on average; shards are cut by a hash, so the largest is near the average.
SHARD_ROWS = 200_000
SHARD_BYTES = 16 << 20

_built: dict[int, tuple] = {}


def automaton(words: dict[str, object]):
    """An automaton of the non-empty keys, whose hits give the values; None without any."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, value in words.items():
        if word:
            found.add_word(word, value)
    if not len(found):
        return None
    found.make_automaton()
    return found


def _of_worker(sent: Broadcast):
    """The automaton of a broadcast shard; a worker keeps the last few, with their broadcasts, so that a key isn't given again."""
    if id(sent) not in _built:
        if len(_built) > 3:
            _built.clear()
        _built[id(sent)] = (sent, automaton(sent.value))
    return _built[id(sent)][1]


def shards(patterns: DataFrame, by: str, rows: int = SHARD_ROWS, size: int = SHARD_BYTES) -> list[DataFrame]:
    """``patterns`` in parts of about ``rows`` rows and ``size`` bytes of column ``by``."""
    table = kept(patterns, "patterns")
    n, held = table.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(by)), F.lit(0))).first()
    parts = max(1, -(-n // rows), -(-held // size))
    return [table if parts == 1 else table.where(F.pmod(F.xxhash64(by), F.lit(parts)) == k) for k in range(parts)]


class Longest:
    """The value of the longest known name that a text contains; of equally long ones that of the first. Names are compared in lower case."""

    def __init__(self, names: dict[str, str]):
        best: dict[str, tuple[int, int, str]] = {}
        for k, (name, value) in enumerate(names.items()):
            low = name.lower()
            best[low] = max(best.get(low, (-1, 0, "")), (len(name), -k, value))
        self.empty = best.get("")
        self.automaton = automaton(best)

    def __call__(self, text: str) -> str | None:
        hits = (value for _, value in self.automaton.iter(text.lower())) if self.automaton else ()
        found = max(hits, default=self.empty)
        return found[2] if found else None


def longest_alias(texts: DataFrame, aliases: DataFrame, text_col: str = "text", rows: int = SHARD_ROWS) -> DataFrame:
    """JN-25: per text (id, text) the entity whose alias is the longest one contained, ties to the smaller ord; null if none is. aliases: entity, alias, ord.

    Both sides are compared in lower case. An empty alias is contained in every text; null texts and aliases match nothing."""
    spark = with_workers(texts.sparkSession)
    known = aliases.where("alias is not null").select(F.lower("alias").alias("low"), F.length("alias").alias("l"), F.col("ord").cast("long").alias("ord"), F.col("entity").cast("string").alias("entity"))
    known = known.groupBy("low").agg(F.max(F.struct("l", (-F.col("ord")).alias("o"), "entity")).alias("b")).select("low", "b.l", "b.o", "b.entity")
    state = texts.select(F.col("id"), F.lower(text_col).alias("low"), F.lit(None).cast("int").alias("l"), F.lit(None).cast("long").alias("o"), F.lit(None).cast("string").alias("entity"))
    for part in shards(known, "low", rows):
        words = {r.low: (r.l, r.o, r.entity) for r in part.collect()}
        state = state.mapInArrow(_best(spark.sparkContext.broadcast(words), words.get("")), state.schema)
    return state.select("id", "entity")


def _best(sent: Broadcast, empty: tuple | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _of_worker(sent)
        for batch in batches:
            texts, *before = (batch.column(k).to_pylist() for k in range(1, 5))
            out = []
            for text, *old in zip(texts, *before, strict=True):
                best = tuple(old) if old[0] is not None else None
                if text is not None:
                    for value in (x for x in (empty,) if x):
                        best = value if best is None or value > best else best
                    for _, value in found.iter(text) if found else ():
                        if best is None or value > best:
                            best = value
                out.append(best or (None, None, None))
            columns = [pa.array([x[k] for x in out], batch.schema.field(2 + k).type) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], schema=batch.schema)

    return run


def contained(texts: DataFrame, patterns: DataFrame, rows: int = SHARD_ROWS) -> DataFrame:
    """(id, pattern) for every text (id, text) and every distinct non-empty pattern (pattern) that it contains, once each and as written."""
    spark = with_workers(texts.sparkSession)
    plain = texts.select("id", F.col("text").cast("string").alias("text"))
    schema = StructType([plain.schema["id"]]).add("pattern", "string")
    out = None
    for part in shards(patterns.select("pattern").where("pattern <> ''").distinct(), "pattern", rows):
        words = {r.pattern: r.pattern for r in part.collect()}
        found = plain.mapInArrow(_contained(spark.sparkContext.broadcast(words)), schema)
        out = found if out is None else out.union(found)
    return out


def _contained(sent: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _of_worker(sent)
        for batch in batches:
            at, hits = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                if text and automata:
                    found = {value for _, value in automata.iter(text)}
                    at += [k] * len(found)
                    hits += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(hits, pa.string())], names=["id", "pattern"])

    return run
