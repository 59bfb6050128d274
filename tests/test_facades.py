"""Small functions over laws, versions and lines."""

from pyspark.sql import functions as F

from lexgraph.functions import legal
from lexgraph.operators import lines, temporal


def test_laws(spark):
    rows = spark.createDataFrame([("Luật  Trật tự an toàn",), ("luật đường bộ mới",), ("Luật Đường bộ và Luật Đất đai",), ("luật đường bộc",), (None,)], "name string")
    assert [r[0] for r in rows.select(legal.law_number(F.col("name"), {"luật đất đai": "31/2024/QH15", "luật": "0"})).collect()] == ["0", "0", "31/2024/QH15", "0", None]
    assert [r[0] for r in rows.select(legal.law_number(F.col("name"), {})).collect()] == ["36/2024/QH15", "35/2024/QH15", "35/2024/QH15", None, None]
    assert legal.registered(spark.createDataFrame([("100/2019/NĐ-CP",)], "number string")).first()["canonical_id"] == "100_2019_ND-CP"
    got = spark.createDataFrame([("khoản 2 Điều 7",)], "t string").select(legal.detect_targets(F.col("t"), F.lit("V"))).first()[0]
    assert [tuple(t) for t in got] == [("V", "7", "2", None)]


def test_units_in_sql(spark):
    legal.register_functions(spark)
    rows = spark.sql("SELECT u.* FROM VALUES ('Điều 1. Tên\n1. Một\na) x\nkhác'), (NULL) AS d(text), LATERAL legal_units(d.text) u").collect()
    assert [tuple(r) for r in rows] == [("ARTICLE", "1", "Tên"), ("CLAUSE", "1", "Một"), ("POINT", "a", "x")]


def test_versions(spark):
    versions = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "id string, version_id long")
    nodes = spark.createDataFrame([("a", "Article"), ("b", "Chapter"), ("c", "Point")], "id string, label string")
    none = spark.createDataFrame([("a", "z")], "id string, target_id string")
    got = {r.id: r for r in temporal.provision_details(nodes, versions, none, none.withColumnRenamed("target_id", "operation")).collect()}
    assert got["a"].current_version.version_id == 2 and got["a"].cross_references[0].target_id == "z" and got["c"].current_version is None
    assert [r[0] for r in nodes.select(temporal.level_of(F.col("label"))).collect()] == ["ARTICLE", None, "POINT"]
    assert temporal.rules_of(spark.createDataFrame([("r", "a"), ("s", "q")], "rule_id string, target_id string"), nodes).count() == 1
    assert spark.range(1).select(temporal.evaluated_at()).first()[0].endswith("Z")


def test_paragraphs(spark):
    rows = spark.createDataFrame([("d", 0, " Điều 1. Tên ", True), ("d", 1, "12", False), ("d", 2, "một câu", False), ("d", 3, "tiếp theo.", False), ("d", 4, " ", False)], "id string, ord int, text string, bold boolean")
    assert [r.text for r in lines.normalised(rows).orderBy("ord").collect()] == ["Điều 1. Tên", "một câu tiếp theo."]
