"""Keyed tables, incremental version texts and the quotation scan against plain forms."""

import datetime as dt
import os
import random

import pytest

from lexgraph.operators import graph, omnibus, quotes, temporal
from lexgraph.operators.versions import TextVersions
from lexgraph.sources.keyed import KeyedTable, merge_edges

NODE = "label string, id long, flag string, state string"


def _stamps(path):
    return {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def _changes(rng, n, keys):
    return [("C", rng.choice(keys), k, rng.choice(["a", "b", None]), rng.choice(["x", "y", None])) for k in range(n)]


def test_merge_equals_full_upsert(spark, tmp_path):
    rng = random.Random(1)
    table = KeyedTable(spark, str(tmp_path / "nodes"), NODE, ["label", "id"], buckets=8)
    schema = "label string, id long, ord long, flag string, state string"
    first = [*_changes(rng, 200, range(60)), (None, 1, 0, "a", "a"), ("C", None, 0, "a", "a")]
    second = [(a, b, o + 1000, c, d) for a, b, o, c, d in _changes(rng, 40, range(50, 80))]
    table.merge(spark.createDataFrame(first, schema), "ord")
    table.merge(spark.createDataFrame(second, schema), "ord")
    every = spark.createDataFrame([r for r in first + second if r[0] and r[1] is not None], schema)
    none = spark.createDataFrame([], NODE)
    want = graph.upsert_nodes(none, every, ["flag", "state"])
    assert sorted(map(str, table.rows().select("label", "id", "flag", "state").collect())) == sorted(map(str, want.collect()))
    before = _stamps(table.path)
    assert table.merge(spark.createDataFrame(second, schema), "ord") == [] and _stamps(table.path) == before  # a batch that comes again writes nothing
    touched = table.merge(spark.createDataFrame([("C", 3, 5000, "new", None)], schema), "ord")
    assert len(touched) == 1 and len(set(_stamps(table.path)) - set(before)) == 1  # one bucket is rewritten
    assert table.rows().where("id = 3").first()["flag"] == "new"
    assert table.merge(spark.createDataFrame([], schema), "ord") == []


def test_edges_need_both_ends(spark, tmp_path):
    nodes = KeyedTable(spark, str(tmp_path / "n"), "id string, label string", ["id"])
    edges = KeyedTable(spark, str(tmp_path / "e"), "src string, rel string, dst string", ["src", "rel", "dst"], ["src"])
    nodes.merge(spark.createDataFrame([(i, "L", 0) for i in "abc"], "id string, label string, ord int"), "ord")
    batch = spark.createDataFrame([("a", "R", "b"), ("a", "R", "b"), ("a", "R", "z"), ("y", "R", "b"), (None, "R", "b"), ("c", "R", "a")], "src string, rel string, dst string")
    assert merge_edges(edges, nodes, batch) and merge_edges(edges, nodes, batch) == []
    assert sorted(map(tuple, edges.rows().collect())) == [("a", "R", "b"), ("c", "R", "a")]


def test_document_wise_replacement(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "d"), "doc string, unit string, text string", ["doc", "unit"], ["doc"], buckets=4)
    schema = "doc string, unit string, text string"
    owners = lambda *d: spark.createDataFrame([(x,) for x in d], "doc string")
    table.replace(spark.createDataFrame([(f"d{k}", f"u{j}", "t") for k in range(9) for j in range(3)], schema), owners(*[f"d{k}" for k in range(9)]))
    change = spark.createDataFrame([("d1", "u0", "new"), ("d1", "u9", "t"), ("d1", "u9", "u"), ("d7", "u0", "not an owner"), ("d1", None, "t")], schema)
    assert len(table.replace(change, owners("d1", "d2", None))) in (1, 2)
    got = {tuple(r) for r in table.rows().collect()}
    assert {r for r in got if r[0] in ("d1", "d2")} == {("d1", "u0", "new"), ("d1", "u9", "u")} and len(got) == 7 * 3 + 2
    assert table.replace(change, owners("d1", "d2")) == []
    table.replace(spark.createDataFrame([], schema), owners(*[f"d{k}" for k in range(9)]))
    assert table.rows().count() == 0
    with pytest.raises(ValueError, match="bucket"):
        KeyedTable(spark, "x", schema, ["unit"], ["doc"]).replace(change, change)


ACTIONS = "key string, at timestamp, action_id string, op string, old_text string, new_text string"


def test_texts_by_snapshots(spark, tmp_path):
    """Batches in order, late, and repeated give what folding the whole history gives."""
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    ops = ["ADD", "REPLACE", "AFTER", "BEFORE", "DELETE", "ADD", "ADD"]
    acts = [(f"k{rng.randrange(12)}", start + dt.timedelta(hours=rng.randrange(200)), f"a{k:04d}", rng.choice(ops), rng.choice(["a", "ab", "b"]), rng.choice(["a ", "ab", "b c", ""])) for k in range(300)]
    by_time = sorted(acts, key=lambda a: a[1:3])
    batches = [by_time[:100], by_time[100:140], by_time[100:140], by_time[160:250], by_time[140:170], by_time[250:]]  # the fourth leaves a gap that the fifth fills late
    state = TextVersions(spark, str(tmp_path / "v"), buckets=4)
    told = [state.apply(spark.createDataFrame(b, ACTIONS)) for b in batches]
    assert told[0]["anew"] == 0 and told[1]["anew"] == 0 and told[1]["onto"] > 0 and told[2] == {"actions": 0, "onto": 0, "anew": 0} and told[4]["anew"] > 0
    want = temporal.fold_text(spark.createDataFrame(acts, ACTIONS), "key", ["at", "action_id"])
    assert sorted(map(tuple, state.texts().collect())) == sorted(map(tuple, want.collect()))
    # the snapshots were written but not the log: the batch that comes again mends it
    broken = TextVersions(spark, str(tmp_path / "w"), buckets=4)
    broken.apply(spark.createDataFrame(by_time[:200], ACTIONS))
    merge, broken.log.merge = broken.log.merge, lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError, match="lost"):
        broken.apply(spark.createDataFrame(by_time[200:], ACTIONS))
    broken.log.merge = merge
    broken.apply(spark.createDataFrame(by_time[200:], ACTIONS))
    assert sorted(map(tuple, broken.texts().collect())) == sorted(map(tuple, want.collect()))


def plain_pieces(texts):
    """One pass over a document's lines."""
    out = []
    for key, said in texts.items():
        item, clause, point, spoken, state = 0, None, None, False, (0, 0)
        for ord_, raw in sorted(said, key=lambda x: x[0]):
            line = (raw or "").strip()
            if not line:
                continue
            piece = line
            if state == (0, 0):
                c, p = quotes._CLAUSE.match(line), quotes._POINT.match(line)
                if c or p:
                    item, spoken = item + 1, False
                    clause, point = (c[1], None) if c else (clause, p[1])
                piece = quotes._opened(line)
                before = line[: len(line) - len(piece)]
                if before and (not piece or c or p or not spoken):
                    out.append((key, ord_, item, clause, point, "instruction", before))
                    spoken = True
            if piece:
                out.append((key, ord_, item, clause, point, "quote", piece))
            state = (max(0, state[0] + piece.count("“") - piece.count("”")), state[1] ^ piece.count('"') % 2)
    return out


LINES = ["1. Sửa khoản 2:", "2. Bỏ từ “a” tại Điều 3", "a) Thêm “b", "b) x", "tiếp theo", "“mở", "đóng”", 'nói "một', 'hai"', "", None, "”", "3. c: “d” và “e", "““hai lớp", "chữ ” và “ chữ"]


@pytest.mark.parametrize("width", [1, 3, 7, 10_000])
def test_pieces_on_random_cuts(spark, width):
    rng = random.Random(width)
    texts = {f"d{d}": [(k, rng.choice(LINES)) for k in range(rng.randrange(1, 60))] for d in range(12)}
    rows = spark.createDataFrame([(d, k, t, 1) for d, said in texts.items() for k, t in said], "id string, ord int, text string, item int")
    got = quotes.pieces(rows, width).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_pieces(texts)))


def test_transitions():
    """A chunk's function equals reading it, from every state."""
    rng = random.Random(3)
    parts = ["a", " ", "“", "”", '"', "1. ", "a) ", "bỏ từ "]
    for _ in range(3000):
        said = [x for x in ("".join(rng.choice(parts) for _ in range(rng.randrange(1, 7))).strip() for _ in range(rng.randrange(12))) if x]
        function = quotes.transition(said)
        for state in [(d, q) for d in range(6) for q in (0, 1)]:
            read = state
            for line in said:
                read = quotes.advanced(read, line)
            assert quotes.applied(state, function) == read


OMNIBUS = """Mở đầu
*Điều 1. Sửa đổi, bổ sung một số điều của Luật Đường bộ
1. Sửa đổi khoản 4 Điều 8 như sau:
“4. Phải:
Điều 3. trong ngoặc
hết.”
*Điều 2. Sửa đổi Điều 5 của Nghị định số 151/2024/NĐ-CP
1. Sửa đổi khoản 2 như sau:
“2. Mới.”
2. Sửa đổi khoản 3 Điều 7 như sau:
a) Bãi bỏ điểm b
*Điều 3. Sửa đổi quy định về biển báo
1. Bãi bỏ Điều 9
*Điều 4. Hiệu lực thi hành
1. Bãi bỏ Điều 1"""


def test_omnibus(spark):
    rows = [("9/2025/X", k, t.lstrip("*"), t.startswith("*")) for k, t in enumerate(OMNIBUS.split("\n"))]
    lines = spark.createDataFrame(rows, "id string, ord int, text string, bold boolean")
    registry = spark.createDataFrame([("35/2024/QH15", "Luật Đường bộ", 0), ("36/2024/QH15", "Luật", 1), ("151/2024/ND-CP", None, 2)], "number string, alias string, ord int")
    keywords = spark.createDataFrame([("9/2025/X", "72/2024/Y", "biển báo", 0), ("9/2025/X", "1/1/Z", "quy định", 1), ("8/2025/X", "0/0/0", "Hiệu lực", 0)], "source string, document string, keyword string, ord int")
    got = omnibus.blocks(lines)
    assert {(r.number, r.title) for r in got.select("number", "title").distinct().collect()} == {(t.split(".")[0][6:], t[1:]) for t in OMNIBUS.split("\n") if t.startswith("*")}
    events = omnibus.record(lines, registry, keywords).collect()
    shown = sorted((r.document, r.operation, [tuple(t) for t in r.targets], r.source) for r in events)
    assert shown == sorted([
        ("35/2024/QH15", "SUA_DOI", [("8", "4", None)], "9/2025/X"), ("151/2024/ND-CP", "SUA_DOI", [("2", "2", None)], "9/2025/X"), ("151/2024/ND-CP", "BAI_BO", [("7", "3", "b")], "9/2025/X"), ("72/2024/Y", "BAI_BO", [("9", None, None)], "9/2025/X"),
    ])
