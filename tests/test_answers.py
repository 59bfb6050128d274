"""Answer checks, rules from closing articles, key pool, frames and corpus helpers."""

import json

import pytest
from pyspark.sql import functions as F

from lexgraph.functions import answers, rules
from lexgraph.operators import documents
from lexgraph.sources.keypool import KeyPool
from lexgraph.streaming import frames


def test_fact_check(spark):
    schema = f"answer string, sanctions {answers.SANCTIONS}, rx array<string>, bad array<string>, cit array<string>, dates array<string>, ref boolean, warn boolean, ew string"
    car = {"xe_o_to": (18_000_000, 20_000_000, 4, None, None)}
    rows = [
        ("Phạt tiền từ 18 triệu đến 20 triệu đồng, trừ 4 điểm theo khoản 9 Điều 6", car, [r"điều\s+6"], ["xe đạp"], ["Khoản 9 Điều 6"], None, False, False, None),
        ("Phạt tiền từ 4 triệu đến 6 triệu đồng, trừ 4 điểm", car, [], [], [], ["01/01/2025"], False, False, None),
        ("Nội dung nằm ngoài phạm vi", {}, None, None, None, None, True, False, None),
        ("Không có gì", {}, None, ["có gì"], None, None, False, True, "đã bị bãi bỏ"),
        (None, {}, None, None, None, None, False, True, None),
    ]
    df = spark.createDataFrame(rows, schema)
    got = [r[0] for r in df.select(answers.fact_check(*[F.col(c) for c in df.columns])).collect()]
    assert [g.passed for g in got] == [True, False, True, False, False]
    assert got[0].citations and not got[1].dates and not got[1].sanctions and got[3].warning and not got[3].words and not got[4].warning


def test_cited_provisions(spark):
    df = spark.createDataFrame([(["168_2024_ND-CP_D6"], "theo Khoản 2 Điều 5 Nghị định 168/2024/NĐ-CP và 36_2024_QH15_D7_K1", None), ([], "không nêu", ["a/b-c"])], "c array<string>, a string, r array<string>")
    got = [r[0] for r in df.select(answers.cited_provisions(F.col("c"), F.col("a"), F.col("r"))).collect()]
    assert got[0] == ["168_2024_ND_CP_D5", "168_2024_ND_CP_D5_K2", "168_2024_ND_CP_D6", "36_2024_QH15_D7_K1"] and got[1] == ["A_B_C"]


def test_text_helpers(spark):
    df = spark.createDataFrame([('phạt: a) một; b) hai. c) ba "x y" z',)], "t string")
    one = df.select(answers.point_lines(F.col("t")), answers.query_terms(F.col("t"), 20)).first()
    assert one[0] == 'phạt:\n   a) một;\n   b) hai.\n   c) ba "x y" z' and one[1][-2:] == ['"x y"', "z"]


def test_effective_rules(spark):
    rows = [
        ("168/2024/NĐ-CP", "Hiệu lực thi hành", "53", "1", "1. Nghị định này có hiệu lực thi hành từ ngày 01 tháng 01 năm 2025; quy định tại điểm m khoản 3 Điều 6 có hiệu lực thi hành từ ngày 01 tháng 01 năm 2026"),
        ("168/2024/NĐ-CP", "Hiệu lực thi hành", "53", "2", "Văn bản khác hết hiệu lực kể từ ngày 31 tháng 02 năm 2025"),
        ("168/2024/NĐ-CP", "Hiệu lực", "54", None, "Khoản 1 Điều 9 có hiệu lực theo quy định của pháp luật"),
        ("168/2024/NĐ-CP", "Phạm vi", "1", "1", "Nghị định này có hiệu lực thi hành từ ngày 01 tháng 01 năm 2025"),
    ]
    df = spark.createDataFrame(rows, "document string, title string, article string, clause string, text string")
    got = {r.rule_id: r for r in rules.effective_rules(df).collect()}
    assert {k: (r.rule_type, str(r.effective_from), r.targets) for k, r in got.items()} == {
        "168_2024_ND-CP_ER_53_1_1": ("GENERAL", "2025-01-01", []), "168_2024_ND-CP_ER_53_1_2": ("EXPLICIT", "2026-01-01", ["168_2024_ND-CP_D6_K3_Dm"]), "168_2024_ND-CP_ER_54_0_1": ("EXTERNAL_RULE", "None", ["168_2024_ND-CP_D9_K1"]),
    }


def test_key_pool():
    now = [100.0]
    pool = KeyPool({"a": ["k1", "k2"], "b": ["k3"]}, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    assert pool.get() == ("a", "k1")
    pool.limited("a", "k1")
    assert pool.get() == ("a", "k2")
    pool.failed("a", "k2")
    assert pool.get() == ("b", "k3")
    pool.limited("b", "k3", 500)
    assert pool.get() == ("a", "k2") and now[0] == 115.0
    pool.limited("a", "k2", 500)
    with pytest.raises(TimeoutError):
        pool.get(max_wait=1)
    with pytest.raises(ValueError):
        KeyPool({}).get()


def test_frames():
    got = list(frames.answer_frames("DIRECT_LOOKUP", "một hai ba bốn", {"nodes": 1}))
    assert "".join(json.loads(g.split("data: ")[1])["text"] for g in got if g.startswith("event: token")) == "một hai ba bốn"
    assert got[-1].startswith("event: done") and sum(g.startswith("event: stage") for g in got) == 5
    assert list(frames.answer_frames("HYBRID_SEARCH", None))[-1].startswith("event: error")


def test_documents(spark):
    edges = spark.createDataFrame([("A_1", "B_1"), ("B_2", "A_2"), ("A_3", "C_1")], "action string, target string")
    assert documents.between_documents(edges, "A_", "B_").count() == 2 and documents.between_documents(edges, "C_").count() == 1
    units = spark.createDataFrame([("x", 4), ("y", 3), ("z", 2)], "id string, level int")
    nodes = spark.createDataFrame([("x", "Point"), ("y", "Article"), ("z", "Article")], "id string, label string")
    assert sorted(map(tuple, documents.extraction_links(units, nodes).collect())) == [("x", "Point"), ("z", "Article")]
    acts = spark.createDataFrame([("a1", None, "D1", " 2 ", "D9", "5", "2024-01-01")], "action_id string, target_unit string, old_document string, old_number string, new_document string, new_number string, effective_date string")
    got = documents.appendix_actions(acts, spark.createDataFrame([("q",)], "id string"), spark.createDataFrame([("D1", "2020-01-01")], "document_id string, effective_from string")).collect()
    assert [(r.unit, r.valid_from, r.produced_by) for r in got] == [("D1_PL2", "2020-01-01", None), ("D1_PL2", "2024-01-01", "a1")]
