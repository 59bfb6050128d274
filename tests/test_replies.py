"""Replies, questions and grounding on sentences with known answers."""

from pyspark.sql import functions as F

from lexgraph.functions import replies as R


def one(spark, f, *values):
    row = spark.createDataFrame([tuple(values)], ", ".join(f"c{k} string" for k in range(len(values))))
    return row.select(f(*[F.col(c) for c in row.columns]).alias("x")).first()["x"]


def test_clean_answer(spark):
    clean = lambda text, has=True: one(spark, lambda c: R.clean_answer(c, F.lit(has)), text)
    assert clean("<evidence>Trả lời: có</evidence>") == "có"
    assert clean("mở đầu\n# Một\na\n## Hai\nb\n# *Một*\nc\nd\n# Ba\ne") == "mở đầu\n# Một\na\n## Hai\nb\n# Ba\ne"
    assert clean("Điều kiện: a) x; b) y\n\n\n\nhết\n---\n") == "Điều kiện:\n   a) x;\n   b) y\n\nhết"
    text = "# Quy tắc\nđi chậm\n# Ghi chú\nđiều này không quy định mức phạt"
    assert clean(text) == text and clean(text, False) == "# Quy tắc\nđi chậm"
    assert clean("ghi chú: không có mức phạt", False) == "ghi chú: không có mức phạt" and clean(None) == "" and clean(" \n") == ""


def test_replies(spark):
    assert one(spark, R.reply_object, '```json\n{"a": [1, 2,], "b": "x",}\n```') == '{"a": [1, 2], "b": "x"}'
    assert one(spark, lambda c: R.reply_field(c, "query"), 'text {"query": "đèn", "n": 1} more') == "đèn"
    assert one(spark, lambda c: R.reply_field(c, "query"), '{"query": "còn lại", "broken": ') == "còn lại" and one(spark, lambda c: R.reply_field(c, "query"), None) is None
    assert tuple(one(spark, R.routing_decision, '{"action": "direct_lookup", "unit_id": "X_D1"}', "hỏi")) == ("DIRECT_LOOKUP", "X_D1", "hỏi")
    assert tuple(one(spark, R.routing_decision, "no json", "hỏi")) == ("HYBRID_SEARCH", None, "hỏi")


def test_documents_and_intents(spark):
    assert [one(spark, R.resolve_document, x) for x in ("168_2024_ND-CP", "NĐ 168", "100/2019/NĐ-CP", " ", None)] == ["168_2024_ND-CP", "168_2024_ND-CP", "100_2019_ND-CP", None, None]
    ask = lambda q: tuple(one(spark, R.document_intent, q))
    assert ask("Bạn biết luật gì?") == ("system_meta_query", None, None)
    assert ask("Nghị định 151 được sửa đổi bởi nghị định 236 ra sao") == ("document_amendment", "236_2026_ND-CP", "151_2024_ND-CP")
    assert ask("luật 118 sửa đổi luật 36") == ("document_amendment", "118_2025_QH15", "36_2024_QH15")
    assert ask("bổ sung gì trong nghị định 168") == ("document_amendment", None, "168_2024_ND-CP")
    assert ask("chạy xe không đèn") == ("violation_sanction", None, None)
    assert one(spark, R.rewritten, "luật 118 sửa đổi luật 36")["variants"] == ["luật 118 sửa đổi luật 36"]


def test_grounding(spark):
    row = spark.createDataFrame(
        [("Theo Điều 6 và Điều 9, ô tô phải dừng trước đèn đỏ", "xe dừng ở đâu", ["đèn đỏ", "còi"], ["đèn"], ["xe_o_to", "xe_mo_to"], ["ND_D6_K1"], ["Điều 7. Tên"], ["Điều 6", "Điều 9", "Điều 7"])],
        "answer string, question string, must_not array<string>, keywords array<string>, entities array<string>, ids array<string>, titles array<string>, citations array<string>",
    )
    got = row.select(R.ungrounded(*[F.col(c) for c in row.columns]).alias("x")).first()["x"]
    assert [tuple(g) for g in got] == [("drift", "đèn đỏ"), ("entity", "xe_mo_to"), ("citation", "Điều 9")]
    empty = row.withColumn("answer", F.lit(None).cast("string")).select(R.ungrounded(*[F.col(c) for c in row.columns]).alias("x")).first()["x"]
    assert empty == []
