"""Unit assembly, datasets, displays, stages and amendment mapping on small tables."""

import json

from pyspark.sql import functions as F

from lexgraph import engine
from lexgraph.operators import amendments, assembly, entities, retrieval
from lexgraph.sources import datasets, sinks


def test_instruction_and_containers(spark):
    rows = spark.createDataFrame([("Bãi bỏ “khoản 1”", "t"), ("x", "mở “ngoặc"), (None, None), ('a "b" c', 'có "hai"')], "text string, title string")
    assert [r[0] for r in rows.select(assembly.instruction(F.col("text"), F.col("title"))).collect()] == ["Bãi bỏ ", "", "", "a "]
    told = [("Sửa đổi một số điều", False, False, False), ("3. Bổ sung một số khoản như sau:", False, True, False), ("3. Bổ sung một số khoản như sau:", True, True, False), ("Bãi bỏ khoản 1", False, False, False), ("Điều 5", False, False, True), (None, False, False, False)]
    rows = spark.createDataFrame(told, "text string, point boolean, clause boolean, heading boolean")
    assert [r[0] for r in rows.select(assembly.is_container(*[F.col(c) for c in rows.columns])).collect()] == [True, True, False, False, True, False]


def test_datasets(spark, tmp_path):
    nested = [{"test_id": "T1", "category": "A", "question": "q", "retrieval": {"must_have": ["x"], "must_not_have": []}, "generation": {"sanctions": {"a": {"fine_min": 1, "fine_max": None, "points_deducted": 2}, "b": {"fine_min": 5}}, "warning_required": True}, "ground_truth": "g"}]
    (tmp_path / "nested.json").write_text(json.dumps(nested), encoding="utf-8")
    row = datasets.read_dataset(spark, str(tmp_path / "nested.json")).first()
    assert (row.id, row.expected_provision_ids, row.expected_fine_min, row.expected_fine_max, row.expected_points_deducted, row.is_amended_case) == ("T1", ["x"], 5, None, 2, True)
    flat = [{"id": "S1", "category": "a", "question": 'nói "có"; không\nhết', "expected_provision_ids": ["p", "q r"], "expected_fine_min": 3, "is_amended_case": True, "expected_warning_keywords": []}, {"id": "S2", "category": "b", "question": "z"}]
    (tmp_path / "flat.json").write_text(json.dumps(flat), encoding="utf-8")
    samples = datasets.read_dataset(spark, str(tmp_path / "flat.json"))
    datasets.save_sheet(samples, str(tmp_path / "sheet"))
    back = {r.id: r for r in datasets.read_sheet(spark, str(tmp_path / "sheet")).collect()}
    assert back["S1"].expected_provision_ids == ["p", "q r"] and back["S1"].question == flat[0]["question"] and back["S1"].is_amended_case and back["S1"].category == "A"
    assert back["S2"].expected_fine_min is None and back["S2"].expected_provision_ids == [] and not back["S2"].is_amended_case
    assert [r.id for r in datasets.first_items(samples, 1).collect()] == ["S1"]


def test_display(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    assert sinks.rendered(df) == '{"k":1,"v":"a"}\n{"k":2}' and sinks.rendered(df, "table") == "k | v\n1 | a\n2 |" and sinks.rendered(df, rows=1) == '{"k":1,"v":"a"}'


def test_stages():
    seen = []

    def fails():
        raise ValueError("no")

    ok = lambda: seen.append(1)
    assert [x[1] for x in engine.sync([("a", ok), ("b", fails), ("c", ok), ("d", ok)])] == ["done", "failed", "skipped", "skipped"] and len(seen) == 1
    assert [x[1] for x in engine.sync([("a", ok), ("b", ok), ("c", ok), ("d", fails)])] == ["done", "done", "done", "warning"]
    assert [x[1] for x in engine.sync([("a", fails)], dry_run=True)] == ["planned"]


def test_blank_vectors(spark):
    rows = spark.createDataFrame([(1, "một hai một"), (2, " "), (3, None), (None, "x")], "id long, text string")
    got = {r.id: r.embedding for r in retrieval.hashed_vectors(rows, 16).collect()}
    assert set(got) == {1, 2, 3, None} and not any(got[2]) and not any(got[3]) and abs(sum(x * x for x in got[1]) - 1) < 1e-9


def test_amendment_levels(spark):
    """Created clauses and points, names resolved, two files numbered on."""
    tree = json.dumps({"clauses": [{"number": "2", "content": "c", "points": [{"number": "a", "content": "p"}]}], "points": [{"number": "b", "content": "q"}]})

    def item(level, root, unit, number):
        action = {"operation": "BO_SUNG", "targets": [], "created_units": [{"unit_id": unit, "unit_level": level, "number": number}]}
        return {"source_unit": "S", "replacement_root_level": root, "replacement_tree": tree, "actions": [action]}

    rows = [("b", 1, [item("POINT", "POINT_LIST", "V_D1_K2_Db", "b")]), ("a", 1, [item("CLAUSE", "CLAUSE_LIST", "old", "2"), item("CLAUSE", "CLAUSE", "V_D1_K3", "3")]), ("c", 1, [])]
    events = spark.createDataFrame([(f, e, json.dumps(i)) for f, e, i in rows], "file string, event long, j string").select("file", "event", F.from_json("j", f"array<{amendments.ITEM}>").alias("items"))
    names = spark.createDataFrame([("old", "V_D1_K2")], "alias string, id string")
    nodes, edges, problems = amendments.map_events(events, names)
    assert {(r.label, r.id) for r in nodes.collect() if r.label in ("Clause", "Point")} == {("Clause", "V_D1_K2"), ("Point", "V_D1_K2_Da"), ("Point", "V_D1_K2_Db")}
    assert {(r.start_id, r.end_id) for r in edges.where("type = 'ADDS'").collect()} == {("S_SU1_A1", "V_D1_K2"), ("S_SU3_A1", "V_D1_K2_Db")}
    assert [(r.action, r.problem) for r in problems.collect()] == [("S_SU2_A1", "no_created_unit")]
    assert amendments.created_index(edges).count() == 2
    assert all(df.count() == 0 for df in amendments.map_events(events.where("false")))


def test_entities_of_nothing(spark):
    nodes, edges = entities.import_records(spark.createDataFrame([], entities.RECORDS))
    assert nodes.count() == 0 and edges.count() == 0
