"""The pipeline on a small folder, stage by stage against plain definitions, and the driver's entry without the subpackage."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from brute import jaccard, leaks, ordered, quality, secrets, sha

import corpus_pipeline
from lexgraph.llm import bpe
from lexgraph.llm import secrets as secret_operator
from lexgraph.llm.registry import tokenizer

COLUMNS = corpus_pipeline.COLUMNS


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    leak = texts[-8][1].split()[200:215]
    rows = [(i, t, "en", f"s{(i or 0) % 2}", len(t or "")) for i, t in texts]
    rows += [(70, "clean words " + " ".join(f"u{k}" for k in range(40)) + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "de", "s1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(leak)), (2, "nowhere to be found in any text at all here")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, " ".join(leak)


def test_stages(spark, folder):
    path, rows, leak = folder
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    held = rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, path)
        assert got.columns == COLUMNS
        pairs = [(r[0], r[1]) for r in held]
        if name == "quality_rules":
            bad = {p for p, q in zip(pairs, quality(pairs), strict=True) if q[-1]}
            held = [r for r in held if (r[0], r[1]) not in bad]
        elif name == "ngram_jaccard_join":
            named = {(i, c) for i, _, c in jaccard(pairs)}
            stay = {i for i, c in named if i == c}
            held = list(dict.fromkeys(r for r in held if r[0] in stay))
        elif name == "benchmark_decontamination":
            hit = {(q[0], q[1]) for q in leaks(pairs, [(1, leak), (2, "nowhere to be found in any text at all here")]) if q[-1]}
            held = [r for r in held if (r[0], len(__import__("re").findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r[1] or "").lower()))) not in hit]
        else:
            assert [q for q in secrets(pairs) if q[1] or q[2] or q[3]]
            found = {r.doc_id for r in secret_operator.scan(docs).where("spans <> ''").collect()}
            every = [tuple(r) for r in got.collect()]
            after = {r[0]: r for r in every}
            for r in held:
                if r[0] in found:
                    assert "24be64439e3e49cf" not in after[r[0]][1] and after[r[0]][4] == len(after[r[0]][1])
                else:
                    assert r in every
            held = [after[r[0]] if r[0] in found else r for r in held]
        assert ordered(got.collect()) == ordered(held), name
        docs = spark.createDataFrame(held, docs.schema)
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    assert set(final) == {r[0] for r in held} and 70 in final
    for r in (r for r in held if r[0] != 7):  # two texts have this id
        ids = bpe.encode([r[1]], *tokenizer())[0]
        assert final[r[0]].n_tokens == len(ids) and final[r[0]].ids_sha256 == sha(np.array(ids, dtype="<u4").tobytes()) and final[r[0]].decoded_sha256 == sha(r[1])


SAID = " ".join(f"w{k}" for k in range(60))
OTHER = " ".join(f"v{k}" for k in range(60))


def test_near_duplicates_of_repeated_ids(spark, tmp_path):
    """A second text of an id goes when it is another document's copy; groups without ids each keep one row."""
    rows = [(3, SAID), (7, OTHER), (7, SAID), (8, OTHER + " more"), (None, SAID + " x y"), (None, "lone words " + SAID[:40]), (None, "lone words " + SAID[:40]), (9, ""), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates_stage(spark, docs, str(tmp_path)).collect()
    assert ordered((r.doc_id, r.text) for r in got) == ordered([(3, SAID), (7, OTHER), (None, "lone words " + SAID[:40]), (9, ""), (9, None)])


def test_quality_stage_removes_lines(spark, tmp_path):
    rows = [(i, f"The Same  notice\n{' '.join(f'w{i}x{k}' for k in range(40))}\n\nend{i}", "en", "h", 7) for i in range(40)] + [(90, "\n" + OTHER + "\n", "en", "h", 9)]
    got = {r.doc_id: r for r in corpus_pipeline.quality_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), str(tmp_path)).collect()}
    assert len(got) == 41 and got[90].text == rows[-1][1] and got[90].n_chars == 9
    assert all(got[i].text == rows[i][1].split("\n", 1)[1] and got[i].n_chars == len(got[i].text) for i in range(40))


def test_stages_of_nothing(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder[0]).count() == 0


def test_entry_without_the_subpackage(tmp_path):
    root = Path(__file__).resolve().parents[2]
    for p in ("__spark_entry__.py", "lexgraph"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
    import shutil

    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "lexgraph", tmp_path / "lexgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
