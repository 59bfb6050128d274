"""Operator 6: tasks that write, and memory of the anchors, follow the texts and not the settings."""

import random
import tracemalloc

import pyarrow as pa
from brute import ordered, repeats

from lexgraph.llm import suffixes, tables


def test_written_by_few_tasks(spark, documents, texts, tmp_path, monkeypatch):
    """Many partitions of a shuffle make no small files; the rows are those of the plain definition."""
    monkeypatch.setattr(tables, "checkpoint_dir", lambda spark: str(tmp_path))
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = suffixes.deduplicate(documents).drop("kept")
        got.write.parquet(str(tmp_path / "out"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert ordered(spark.read.parquet(str(tmp_path / "out")).collect()) == ordered(repeats(texts, 400))
    assert len(list((tmp_path / "out").glob("part-*"))) == 1
    assert len(list(tmp_path.glob("suffix-classes-*/part-*"))) == 1


def test_more_tasks_for_more_texts():
    assert [suffixes.tasks(*x) for x in ((0,), (65_536,), (65_537,), (10, 4 << 20), (10, (4 << 20) + 1), (300_000_000, 45 << 30))] == [1, 1, 2, 1, 2, 11520]


def test_anchors_in_bounded_memory():
    rng = random.Random(4)
    batch = pa.RecordBatch.from_arrays([pa.array([b"k"] * 400), pa.array([rng.randbytes(5_000).hex() for _ in range(400)])], names=["row_key", "text"])
    tracemalloc.start()
    try:
        found = sum(x.num_rows for x in suffixes._anchor_rows(400, 32)([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found > 10_000
    assert peak < 192 << 20
