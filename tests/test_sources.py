"""The .docx data source in batches and streams, and traversals of any depth."""

import json
import os
import random
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from lexgraph.operators import evaluate, traversal
from lexgraph.sources import docx, readers

_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _write(path, paragraphs, cells=()):
    p = lambda t, b=False: f"<w:p><w:r>{'<w:rPr><w:b/></w:rPr>' if b else ''}<w:t>{t}</w:t></w:r></w:p>"
    table = "<w:tbl><w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in cells) + "</w:tr></w:tbl>" if cells else ""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {_NS}><w:body>{table}{''.join(p(t, b) for t, b in paragraphs)}</w:body></w:document>")


def test_docx_source(spark, tmp_path):
    docx.register(spark)
    (tmp_path / "sub").mkdir()
    for k in range(5):
        _write(tmp_path / ("sub" if k % 2 else ".") / f"d{k}.docx", [(f"Điều {k}.", True), ("x", False)], ["CHÍNH PHỦ"])
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "other.txt").write_text("x")
    df = spark.read.format("docx").option("bytes_per_task", 700).load(str(tmp_path))
    assert df.rdd.getNumPartitions() > 1
    want = readers.read_docx(spark, str(tmp_path)).select(F.regexp_extract("path", "[^/]+$", 0), "ord", "text", "bold").collect()
    assert sorted(map(str, df.select(F.regexp_extract("path", "[^/]+$", 0), "ord", "text", "bold").collect())) == sorted(map(str, want))
    assert "BadZipFile" in df.where("error is not null").first()["error"]
    one = str(tmp_path / "sub" / "d1.docx")
    assert [r.text for r in df.where(F.col("path") == one).orderBy("ord").collect()] == ["Điều 1.", "x"]
    assert df.where(F.col("path").endswith("d3.docx") & (F.col("ord") == 1)).count() == 1
    cells = spark.read.format("docx").option("part", "cells").load(str(tmp_path))
    assert {r.text for r in cells.where("error is null").collect()} == {"CHÍNH PHỦ"}
    assert spark.read.format("docx").load(str(tmp_path / "none")).count() == 0


def test_conditions_reach_the_listing(tmp_path):
    for name in ("a1", "a2", "b1"):
        _write(tmp_path / f"{name}.docx", [("x", False)])
    reader = docx.DocxReader({"path": str(tmp_path)})
    rest = list(reader.pushFilters([docx.StringContains(("path",), "/a"), docx.In(("path",), (str(tmp_path / "a2.docx"), "y")), docx.EqualTo(("text",), "x")]))
    assert [type(f) for f in rest] == [docx.EqualTo]
    assert [n for p in reader.partitions() for n in p.names] == [str(tmp_path / "a2.docx")]
    assert len(docx.dealt([docx.Found(str(k), 10, 0) for k in range(7)], 25)) == 4


def test_docx_stream(spark, tmp_path):
    docx.register(spark)
    source = tmp_path / "in"
    source.mkdir()

    def put(name, age):
        _write(source / f"{name}.docx", [(name, False)])
        at = time.time() - age
        os.utime(source / f"{name}.docx", (at, at))

    def run():
        stream = spark.readStream.format("docx").option("settle", 5).load(str(source))
        stream.select("text").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.text for r in spark.read.schema("text string").parquet(str(tmp_path / "out")).collect())

    put("a", 100)
    put("b", 90)
    assert run() == ["a", "b"]
    put("c", 50)
    put("young", 0)  # waits until nothing can be as old as it
    assert run() == ["a", "b", "c"]
    assert run() == ["a", "b", "c"]


def test_reachable(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(60)] + [(1, 1), (2, None), (100, 101), (101, 100)]
    starts = [(r, r) for r in range(0, 40, 5)] + [(100, 100), (7, 9), (None, 1), (555, 555)]
    after: dict = {}
    for a, b in edges:
        if b is not None:
            after.setdefault(a, set()).add(b)
    want = set()
    for root, first in starts:
        if root is None:
            continue
        seen, front, depth = {first: 0}, [first], 0
        while front:
            depth += 1
            front = sorted({b for a in front for b in after.get(a, ())} - seen.keys())
            seen.update({b: depth for b in front})
        want |= {(root, i, d) for i, d in seen.items()}
    e = spark.createDataFrame(edges, "src long, dst long")
    s = spark.createDataFrame(starts, "root long, id long")
    assert {tuple(r) for r in traversal.reachable(s, e).collect()} == want
    assert {tuple(r) for r in traversal.reachable(s, e, 2).collect()} == {x for x in want if x[2] <= 2}


def test_hierarchies(spark):
    nodes = [("R", None)] + [(f"R_{a}", "R") for a in "abc"] + [(f"R_{a}_{k}", f"R_{a}") for a in "abc" for k in range(3)] + [("R_a_0_x", "R_a_0")]
    df = spark.createDataFrame(nodes, "id string, parent_id string")
    up = dict(nodes)
    want = set()
    for i in up:
        at, d = i, 0
        while at:
            want.add((i, at, d))
            at, d = up[at], d + 1
    assert {tuple(r) for r in traversal.ancestry(df).collect()} == want
    down = df.where("parent_id is not null").select(F.col("parent_id").alias("src"), F.col("id").alias("dst"))
    across = spark.createDataFrame([("R_a", "R_b_1"), ("R_c", "R_a")], "src string, dst string")
    got = {tuple(r) for r in traversal.neighbours(spark.createDataFrame([("R_a", "R_a")], "root string, id string"), down, across, 2).collect()}
    assert got == {("R_a", "R", "parent", 1), *[("R_a", f"R_a_{k}", "child", 1) for k in range(3)], ("R_a", "R_a_0_x", "child", 2), ("R_a", "R_b_1", "reference", 1), ("R_a", "R_c", "reference", 1)}


def test_amendment_indexes(spark, tmp_path):
    def event(source, target, *items):
        return {"source_document": source, "target_document": target, "items": [{"source_unit": u, "actions": [{"action_id": a, "operation": "BAI_BO", "targets": [{"target_unit": f"{a}t"}]} for a in acts]} for u, acts in items]}

    for name, events in (("b", [event("1/2020/X", "2/2020/NĐ-CP", ("u1", ["a1", "a2"]), ("u2", []))]), ("a", [event("3/2020/X", None, ("u3", ["a3"])), event("2/2020/NĐ-CP", "9/9/9", ("u4", ["a4"]))]), ("c", [])):
        (tmp_path / name / "deep").mkdir(parents=True)
        (tmp_path / name / "deep" / "amendment_index.json").write_text(json.dumps(events), encoding="utf-8")
    (tmp_path / "a" / "other.json").write_text("[]")
    shown = lambda df: sorted((r.semantic_index, r.source_unit, r.action_id) for r in df.collect())
    assert shown(readers.read_amendments(spark, str(tmp_path)))[:4] == [(1, "u3", "a3"), (2, "u4", "a4"), (3, "u1", "a1"), (3, "u1", "a2")]
    kept = readers.read_amendments(spark, str(tmp_path), "2_2020_ND-CP")
    assert [(r.semantic_index, r.source_unit, r.action_id, r.target_document) for r in kept.orderBy("semantic_index", "action").collect()] == [(1, "u4", "a4", "9/9/9"), (2, "u1", "a1", "2/2020/NĐ-CP"), (2, "u1", "a2", "2/2020/NĐ-CP"), (3, "u2", None, "2/2020/NĐ-CP")]


def test_tiers(spark):
    df = spark.createDataFrame([(True, True), (True, None), (True, False), (False, True), (None, True)], "d boolean, j boolean")
    passed = lambda tier: [r[0] for r in df.select(evaluate.overall_passed(F.col("d"), F.col("j"), tier)).collect()]
    assert passed("deterministic") == [True, True, True, False, False] and passed("full") == [True, False, False, False, False]
    with pytest.raises(ValueError, match="tier"):
        evaluate.overall_passed(F.col("d"), F.col("j"), "half")
