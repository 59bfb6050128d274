"""Sources, sinks, streaming, fusion and timelines on small fixtures with known answers."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lexgraph.engine import Engine, Settings
from lexgraph.operators import graph, lines, retrieval, temporal
from lexgraph.sources import readers, sinks
from lexgraph.streaming import ingest


def docx(paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r>{'<w:rPr><w:b/></w:rPr>' if b else ''}<w:t>{t}</w:t></w:r></w:p>" for t, b in paragraphs)
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>CHÍNH PHỦ</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>Hà Nội, ngày 26 tháng 12 năm 2024</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{table}{body}</w:body></w:document>')
    return out.getvalue()


def test_docx(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx([("Điều 1. Phạm vi", True), ("  ", False), ("nội dung", False)]))
    (tmp_path / "b.docx").write_bytes(b"no zip")
    got = sorted(((r.ord, r.text, r.bold) for r in readers.read_docx(spark, str(tmp_path)).where("error is null").collect()))
    assert got == [(0, "Điều 1. Phạm vi", True), (1, "nội dung", False)]
    assert readers.read_docx(spark, str(tmp_path)).where("error is not null").count() == 1
    (tmp_path / "b.docx").unlink()
    head = readers.read_docx_headers(spark, str(tmp_path)).first()
    assert head.authority == "CHÍNH PHỦ" and str(head.header_date) == "2024-12-26"


def test_rules_and_units(spark, tmp_path):
    rule = {"rule_id": "r1", "rule_type": "GENERAL", "targets": [], "effective_from": "2024-01-01"}
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text(json.dumps({"rules": [rule, rule | {"rule_id": "r2"}]}))
    (tmp_path / "r" / "b.json").write_text(json.dumps([rule | {"rule_id": "r3"}]))
    assert sorted(r.rule_id for r in readers.read_rules(spark, str(tmp_path / "r")).collect()) == ["r1", "r2", "r3"]
    units = [{"id": "u1", "noi_dung": " x ", "vi_tri": {"so_hieu_van_ban": "D1"}}, {"id": "u2"}, {"id": " ", "noi_dung": "y"}, {"id": "u3", "noi_dung_chuan_hoa": "", "noi_dung_goc": "z", "level": 3}]
    (tmp_path / "D1_semantic_units.json").write_text(json.dumps(units))
    (tmp_path / "D2_semantic_units.json").write_text(json.dumps([{"id": "v", "noi_dung": "v"}]))
    assert sorted((r.id, r.text, r.level) for r in readers.read_units(spark, str(tmp_path), "D1").collect()) == [("u1", "x", 4), ("u3", "z", 3)]
    assert readers.read_units(spark, str(tmp_path)).count() == 3
    assert readers.pending(spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a",)], "id string")).first().id == "b"


def fused(spark, dense, sparse, **more):
    d = spark.createDataFrame([("q", i, k + 1, s) for k, (i, s) in enumerate(dense)], "query_id string, id string, rank int, dense_score double")
    s = spark.createDataFrame([("q", i, k + 1) for k, i in enumerate(sparse)], "query_id string, id string, rank int")
    return [(r.id, r.rrf) for r in retrieval.fuse(d, s, more.pop("top_k", 10), **more).orderBy("rank").collect()]


@pytest.mark.parametrize(
    ("dense", "sparse", "more", "want"),
    [
        ([("A", 0.95), ("B", 0.85)], ["B", "C"], {"dynamic": False}, ["B", "A", "C"]),
        ([("A", 0.42), ("B", 0.38)], ["C"], {}, []),
        ([("A", 0.50), ("B", 0.49)], [], {}, ["A", "B"]),
        ([("A", 0.80), ("B", 0.75), ("C", 0.63), ("D", 0.52)], [], {}, ["A", "B"]),
        ([("A", 0.60), ("B", 0.30)], [], {}, ["A"]),
        ([("A", 0.90), ("B", 0.55), ("C", 0.51)], [], {"dynamic": False}, ["A", "B", "C"]),
        ([("A", 0.85)], ["A", "Z"], {}, ["A", "Z"]),
    ],
)
def test_fusion(spark, dense, sparse, more, want):
    assert [i for i, _ in fused(spark, dense, sparse, **more)] == want


def test_fusion_score(spark):
    assert fused(spark, [("A", 0.95), ("B", 0.85)], ["B", "C"])[0] == ("B", round(1 / 62 + 1 / 61, 6))


def test_rule_statuses(spark):
    units = spark.createDataFrame([(u, "D") for u in "ABCZ"], "unit_id string, document_id string")
    rules = spark.createDataFrame(
        [("g", "D", "GENERAL", [], "2024-01-01", None, 0), ("a", "D", "EXPLICIT", ["A"], "2024-02-01", None, 1), ("a2", "D", "EXPLICIT", ["A"], "2024-03-01", None, 2), ("c", "D", "EXTERNAL_RULE", ["C"], None, None, 3)],
        "rule_id string, document_id string, rule_type string, targets array<string>, f string, t string, rule_ord long",
    ).select("rule_id", "document_id", "rule_type", "targets", F.to_date("f").alias("effective_from"), F.to_date("t").alias("effective_to"), "rule_ord")
    day = F.to_date(F.lit("2024-06-01"))
    got = {r.unit_id: (r.status, r.rule_id) for r in temporal.evaluate(units, rules, day).collect()}
    assert got == {"A": ("ACTIVE", "a2"), "B": ("ACTIVE", "g"), "C": ("EXTERNAL", None), "Z": ("ACTIVE", "g")}
    early = {r.unit_id: r.status for r in temporal.evaluate(units, rules, F.to_date(F.lit("2023-01-01"))).collect()}
    assert early["B"] == "NOT_YET_EFFECTIVE"
    assert {r.status for r in temporal.evaluate(units, rules.where("false"), day).collect()} == {"UNKNOWN"}


def test_text_fold(spark):
    acts = spark.createDataFrame(
        [("p", 1, "ADD", "", "một hai"), ("p", 2, "REPLACE", "hai", "ba"), ("p", 3, "AFTER", "một", " rưỡi"), ("p", 4, "DELETE", "vắng", ""), ("p", 5, "DELETE", "rưỡi", "")], "k string, n int, op string, old_text string, new_text string"
    )
    assert tuple(temporal.fold_text(acts, "k", ["n"]).first()) == ("p", "một ba", 4)


def test_lines(spark):
    docs = spark.createDataFrame([("d", "Điều 1. Tên\nphần đầu\nphần sau.\n12\n\nmở “trích\ntrong”\nhết")], "id string, text string")
    rows = lines.without_noise(lines.lines(docs, "id", "text"))
    assert [r.text for r in rows.orderBy("ord").collect()] == ["Điều 1. Tên", "phần đầu", "phần sau.", "mở “trích", "trong”", "hết"]
    state = {r.text: r.inside for r in lines.quote_state(rows).collect()}
    assert state["trong”"] and not state["hết"] and not state["phần đầu"]
    merged = lines.merge_broken(rows.withColumn("bold", F.col("ord") == 0))
    assert [r.text for r in merged.orderBy("ord").collect()] == ["Điều 1. Tên", "phần đầu phần sau.", "mở “trích trong”", "hết"]


def test_streams(spark, tmp_path):
    base = spark.range(20).select((F.col("id") % 15).alias("event_id"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"), (F.col("id") % 15 * 2).alias("v"))
    base.repartition(3).write.parquet(str(tmp_path / "in"))
    s = lambda: ingest.stream(spark, str(tmp_path / "in"), "event_id long, ts timestamp, v long", max_files=1)
    for _ in range(2):  # a second run finds nothing new
        ingest.ingest(s(), str(tmp_path / "out"), str(tmp_path / "cp"), "event_id", "ts")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 15
    ingest.ingest_checked(s(), str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "cp2"), lambda b: b.withColumn("ok", F.col("v") < 20))
    assert spark.read.parquet(str(tmp_path / "ok")).count() + spark.read.parquet(str(tmp_path / "bad")).count() == 20


def test_sinks(spark, tmp_path):
    with pytest.raises(ValueError):
        sinks.identifier("a; drop")
    units = spark.createDataFrame([("a", "x y x"), ("b", "y")], "id string, text string")
    sinks.save_postings(units, str(tmp_path / "p"), 2)
    assert {(r.term, r.id, r.tf) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {("x", "a", 2), ("y", "a", 1), ("y", "b", 1)}
    old, new = spark.createDataFrame([(1, "o"), (2, "o")], "k int, v string"), spark.createDataFrame([(2, "n")], "k int, v string")
    assert sorted(map(tuple, sinks.merged_by_key(old, new, "k").collect())) == [(1, "o"), (2, "n")]


def test_engine(spark):
    units = spark.createDataFrame([("R1_D1", "alpha beta", "R1"), ("R1_D2", "beta gamma", "R1")], "id string, text string, document_id string")
    vectors = spark.createDataFrame([("R1_D1", [1.0, 0.0]), ("R1_D2", [0.0, 1.0])], "id string, embedding array<float>")
    nodes = spark.createDataFrame([("R1", None, "Document"), ("R1_D1", "R1", "Article"), ("R1_D2", "R1", "Article")], "id string, parent_id string, label string")
    engine = Engine(spark, units, vectors, nodes, settings=Settings.from_env({"LEXGRAPH_TOP_K": "3"}))
    asked = spark.createDataFrame([(1, "gamma", [0.0, 1.0])], "query_id int, text string, query_vector array<float>")
    assert engine.ask(asked).orderBy("rank").first().id == "R1_D2"
    assert engine.documents().first().n_articles == 2 and engine.lookup("R1").count() == 1
    assert engine.settings.top_k == 3


def test_prefix_owner_is_bounded(spark):
    rows, owners = spark.createDataFrame([("A_D10_K1",)], "id string"), spark.createDataFrame([("A_D1",), ("A",)], "owner_id string")
    assert graph.prefix_owner(rows, owners).first().owner_id == "A"
