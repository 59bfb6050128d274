"""The prefix trie against dictionaries of all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from lexgraph.llm import trie


def plain(rows, group=100, most=6):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % most
        built[c] = own.get(c - c % group, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    below = defaultdict(set)
    for k in members:
        if k:
            below[k[:-1]].add(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in below[k]) or 1
        saved[k] = (len(members[k]) - 1) * (len(k[-1][1]) if k else 0) + sum(saved[x] for x in below[k])
        ends = ",".join(map(str, sorted(c for c in members[k] if len(built[c]) == len(k))))
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(below[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    rows = []
    for c in [*range(60), *range(100, 130), 500, 501, 777]:
        for t in range(rng.choice([1, 2, 3, 5, 8])):
            rows.append((c, t if t or rng.random() < 0.8 else None, rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "bb", None, "ccc"]) if t < 6 else "漢" * t))
    rows += [(7, 1, "user", "zz"), (7, 1, "user", "zy"), (7, 1, "user", "zy"), (None, 1, "u", "t")]  # ties, a repeated row, no conversation
    rows += [(c, t, "u", f"copy{t}") for c in range(200, 240) for t in range(12)]
    rows += [(c, 100 + t, "u", f"{c}{t}" * (50 if t == 7 else 1)) for c in (13, 14) for t in range(400)]
    return rows


@pytest.mark.parametrize(("local_rows", "local_turns"), [(2048, 1 << 19), (2, 1 << 19), (5, 20)])
def test_trie(spark, rows, local_rows, local_turns):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, bucket int, key string")
    got = trie.prefix_trie(*trie.rebuilt(trie.encoded(df)), local_rows=local_rows, local_turns=local_turns).collect()
    assert ordered(got) == ordered(plain(rows))


def test_no_conversations(spark):
    df = spark.createDataFrame([(None, 1, "user", "a")], "conv_id long, turn long, role string, text string")
    assert trie.query(df).collect() == []
    assert trie.query(df.where("false")).collect() == []


def test_partitioning():
    rng = random.Random(2)
    seqs = [trie.Sequence(i, [rng.randrange(9)], [1]) for i in range(200)]
    parts = trie.split(list(range(200)), seqs, 0)
    assert [seqs[p[0]].syms[0] for p in parts] == list(range(9))
    assert sorted(r for p in parts for r in p) == list(range(200)) and all(len({seqs[r].syms[0] for r in p}) == 1 for p in parts)
