"""Hashes against texts that were made to collide, bounded batches of the archive reader, and columns with names used inside."""

import random

import numpy as np
import pyarrow as pa
import pytest
from brute import ordered, repeats

from lexgraph.llm import quality, setjoin, suffixes, textbatch, warc


def complementary() -> tuple[str, str]:
    """A Thue-Morse string and its complement: any polynomial hash modulo 2**64 with an odd base takes them for one."""
    swap, text = str.maketrans("ab", "ba"), "a"
    while len(text) < 1024:
        text += text.translate(swap)
    return text, text.translate(swap)


def test_spans():
    rng = random.Random(1)
    text = bytes(rng.choice(b"ab ") for _ in range(3000))
    data = np.frombuffer(text, np.uint8)
    starts = np.array([rng.randrange(3000) for _ in range(4000)] + [3000])
    ends = np.minimum(3000, starts + np.array([rng.randrange(40) for _ in starts]))
    for seed in (0, 1):
        of: dict[bytes, set[int]] = {}
        for s, e, h in zip(starts, ends, textbatch.chunk_hash(data, starts, ends, seed), strict=True):
            of.setdefault(text[s:e], set()).add(int(h))
        assert all(len(x) == 1 for x in of.values()) and len(set().union(*of.values())) == len(of)


def test_words_made_to_collide(spark):
    a, b = complementary()
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    got = setjoin.jaccard_groups(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert ordered(got) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


def test_lines_made_to_collide(spark):
    a, b = complementary()
    rows = [(1, f"{a}\n{b}", "h"), (2, f"{a}\n{a}", "h"), (3, " ".join([a] * 8 + [b] * 8), "h")]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert (got[1].n_dup_lines, got[2].n_dup_lines, got[3].n_repeat_words) == (0, 1, 0)
    # as lines and as texts: 30 documents hold one line, 30 others its complement
    many = [(i, f"{(a, b)[i % 2]}\n" + " ".join(f"w{i}x{k}" for k in range(30)), "h") for i in range(58)]
    assert not any(r.n_removed_lines for r in quality.quality_rules(spark.createDataFrame(many, "doc_id long, text string, source string")).collect())
    two = np.frombuffer((a + b).encode(), np.uint8)
    assert len(set(textbatch.text_keys(two, np.array([0, 1024, 2048])).tolist())) == 2


@pytest.mark.parametrize("max_classes", [65_536, 1])
def test_segments_made_to_collide(spark, max_classes):
    """Two texts of 400 bytes whose middles are Thue-Morse strings of two pairs of letters: 256 bytes are enough for a polynomial whose terms of the pairs agree in 22 bits. Nothing repeats but in the copy."""
    a, b = complementary()
    head = "bccl fxzvjitgtbsvfnumzxqlroqibalokmnqfrfhhafkfeqqlqvrfoznxqylzsllofymwxo"
    tail = "uqhpipqq zlvoolsxrxopvhk w ftiypjjzw qrqqutsnjxgpqlvtcz kxa gxdbsubishvd"
    texts = [head + x[:128].replace("a", "0W").replace("b", "5i") + tail for x in (a, b)]
    rows = [(1, texts[0]), (2, texts[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(suffixes.deduplicate(docs, max_classes=max_classes).drop("kept").collect()) == ordered(repeats(rows, 400))
    rows += [(3, "x" + texts[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ordered(suffixes.deduplicate(docs, max_classes=max_classes).drop("kept").collect())
    assert got == ordered(repeats(rows, 400)) and [r[2] for r in got] == [0, 400, 400]


def test_reader_passes_on_by_bytes(tmp_path):
    """A batch of many records comes back in batches of bounded bytes."""
    folder = f"file://{tmp_path}"
    page = "x" * 200_000
    rows = pa.RecordBatch.from_pylist([{"page_id": i, "url": f"u{i}", "html": page, "digest": __import__("hashlib").sha1(page.encode()).hexdigest(), "refers_to": None, "revisit": False} for i in range(300)])
    index = pa.Table.from_batches(list(warc._write(folder, 1 << 30, 1, "1970-01-01T00:00:00Z")(iter([rows])))).combine_chunks().to_batches()
    out = list(warc._read(folder, 1 << 16, 8 << 20)(iter(index)))
    assert len(out) > 1 and max(b.nbytes for b in out) < warc.BATCH_BYTES + 300_000
    assert [x for b in out for x in b.column(0).to_pylist()] == list(range(300))
    assert all(len(x) == 200_000 for b in out for x in b.column(5).to_pylist())


def test_columns_named_as_inside(spark):
    line = "this line stands in every document"
    names = ["own_key", "judged_key", "removed_lines", "rest", "row_key", "__key", "kept"]
    rows = [(i, line + "\n" + " ".join(f"w{i}x{k}" for k in range(30)), "h", *range(len(names))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    out = quality.without_boilerplate(docs, quality.quality_rules(docs))
    assert out.columns == docs.columns and out.count() == 40
    assert not any(line in r.text for r in out.collect()) and out.first()["kept"] == len(names) - 1
