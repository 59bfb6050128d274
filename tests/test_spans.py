"""References and targets as columns equal the sentence-wise forms on random sentences of all fourteen forms."""

import random

from pyspark.sql import functions as F

from lexgraph.functions import legal, spans

ALIASES = {"luật đường bộ": "35/2024/QH15", "luật trật tự, an toàn giao thông đường bộ": "36/2024/QH15", "đường bộ": "1/2001/X"}


def sentence(rng):
    n, l = lambda: f"{rng.randrange(1, 40)}{rng.choice(['', '', 'a', 'đ'])}", lambda: rng.choice("abcdđeg")  # noqa: E731, E741
    this = rng.choice(["Luật này", "Nghị định này", "của Thông  tư này"])
    law = rng.choice(["Luật Đường bộ", "của Luật Trật tự, an toàn giao thông đường bộ", "Luật Lạ và", "luật Đất đai theo"])
    forms = [
        f"điểm {l()} khoản {n()} Điều {n()} {this}", f"khoản {n()} Điều {n()} {this}", f"điểm {l()} khoản {n()} Điều {n()} {law}", f"khoản {n()} Điều {n()} {law}", f"Điều {n()} của Nghị định số 100/2019/NĐ-CP", f"Điều {n()} {law}",
        f"Điều {n()} {this}", f"điểm {l()} khoản {n()} Điều này", f"khoản {n()} Điều này", f"điểm {l()} khoản này", "Điều này", "khoản này", "điểm này", this,
        f"điểm {l()}, {l()} và điểm {l()} khoản {n()}, khoản {n()} Điều này", f"khoản {n()}, khoản {n()} Điều {n()} và khoản {n()} {this}", f"điểm {l()}1, {l()} khoản {n()} và {n()} Điều {n()}", f"khoản {n()}; điểm {l()}", f"Điều {n()}, Điều {n()}",
    ]
    glue = [" ", ", ", "; ", ". ", " trừ trường hợp ", " căn cứ ", " theo ", " và ", "\n", " quy định tại "]
    return rng.choice(["", "Căn cứ ", "Xe máy 漢 "]) + "".join(rng.choice(forms) + rng.choice(glue) for _ in range(rng.randrange(5)))


def test_columns_equal_sentences(spark):
    rng = random.Random(1)
    rows = [(k, sentence(rng), "9/2025/NĐ-CP", rng.choice(["7", "8a", None]), rng.choice(["1", None]), rng.choice(["b", None])) for k in range(400)] + [(900, None, "1/2/X", "1", None, None), (901, "", None, "1", None, None)]
    df = spark.createDataFrame(rows, "id long, text string, document string, article string, clause string, point string")
    shown = df.select("id", spans.targets(F.coalesce("text", F.lit(""))).alias("t"), spans.references(*[F.col(c) for c in ("text", "document", "article", "clause", "point")], ALIASES).alias("r")).collect()
    texts = {r[0]: r for r in rows}
    for row in shown:
        _, text, document, *place = texts[row.id]
        assert [tuple(t) for t in row.t] == legal.targets(text or ""), text
        assert [tuple(r) for r in row.r] == legal.references(text or "", document, tuple(place), ALIASES), text
    seen = {k for k, (pattern, *_) in enumerate(legal._FORMS) for r in rows if r[1] and pattern.search(r[1])}
    assert seen == set(range(14))
