"""Packing: every token once, tight windows, ids as the library gives them."""

import random
import zlib

import numpy as np
import pytest

from lexgraph.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("seed", range(20))
def test_windows(seed):
    rng = random.Random(seed)
    window = rng.choice([8, 16, 64, 2048])
    slack = min(16, window // 8)
    lengths = [rng.choice([1, rng.randrange(1, 3 * window), rng.randrange(1, window)]) for _ in range(rng.randrange(300))]
    found: dict[int, list] = {}
    for pieces in packing.pack(lengths, window, slack):
        total = sum(n for _, _, n in pieces)
        assert total <= window and (window - total <= slack or total & (total - 1) == 0)
        for item, start, n in pieces:
            found.setdefault(item, []).append((start, n))
    for item, length in enumerate(lengths):
        at = 0
        for start, n in sorted(found[item]):
            assert start == at and n > 0
            at += n
        assert at == length


def test_tightest_window():
    rng = random.Random(3)
    tree, held = packing.Tightest(50), []
    for k in range(3000):
        if rng.random() < 0.5:
            tree.put(c := rng.randrange(1, 51), k)
            held.append((c, k))
            continue
        need = rng.randrange(1, 51)
        best = min((c for c, _ in held if c >= need), default=None)
        got = tree.take(need)
        assert (got[1] if got else None) == best
        if got:
            held.remove((best, got[0]))


def test_whole_items_fill_windows():
    """Items that fit together are not cut."""
    assert sorted(len(s) for s in packing.pack([1024] * 6 + [2048, 512, 1536])) == [1, 2, 2, 2, 2]
    assert packing.pack([5000], 2048)[-1] == [(0, 4992, 8)]


TEXTS = [None, "", " ", "   ", "a\n\n  b \t c  ", "it's 3's'S don't", "²³ x² ½", "漢字 漢字　ひらがな", "\x1c!x\x1d y", "<|endoftext|> a", "é ñ ١٢ 힣 ؀", "x" * 3000, "word " * 3000, "a b", "a b"]


def test_encoding():
    encoder = packing.Encoder(PATH)
    rng = random.Random(5)
    pool = [*"abzé漢字 \n\t'.,!1²\x1c\x85\xa0 　", "'s", " the", "٣", "ǅ"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(3000)]
    want = [x.ids for x in encoder.library.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # the second time from what is kept
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.packed(texts)] == want


class Counted:
    """The library's tokenizer, with the number of characters that it was given."""

    def __init__(self, inner):
        self.inner, self.characters = inner, 0

    def encode_batch_fast(self, batch, **options):
        self.characters += sum(len(x) if isinstance(x, str) else sum(map(len, x)) for x in batch)
        return self.inner.encode_batch_fast(batch, **options)


def test_a_match_is_encoded_once():
    """Whatever stands beside it: words with other punctuation, in other texts, or at a text's start are no new work."""
    encoder = packing.Encoder(PATH)
    words = [f" w{chr(97 + i % 26) * (i % 7 + 1)}" for i in range(60)]
    texts = ["".join(w + mark for w in words) for mark in ("", ",", ".", ";", "!?", "'s", "\n", ")\n\n ", " (")]
    want = [x.ids for x in encoder.library.encode_batch(texts, add_special_tokens=False)]
    counts = [Counted(getattr(encoder, x, None)) for x in ("library", "model")]
    encoder.library, encoder.model = counts
    for part in (texts[:4], texts[4:], texts):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.packed(part)] == want[texts.index(part[0]) :][: len(part)]
    assert sum(x.characters for x in counts) <= sum(map(len, {*words, ",", ".", ";", "!?", "'s", "\n", ")", "\n\n", " (", " ", "("}))


def test_matches():
    """The pattern's matches by classes of bytes, against the library's own, with contractions and white space of every kind; and with little room for what is kept."""
    encoder = packing.Encoder(PATH)
    pools = [" '\nstmdrevlLS1.", "  ' \xa0\x85\t'srevlmdt x漢가ひ‐’é\x1f\x00Ȁ", "ab ½٣1-\n\r\n  '"]
    rng = random.Random(7)
    texts = ["", *("".join(rng.choice(pool) for _ in range(rng.randrange(40))) for pool in pools for _ in range(1500))]
    want = [x.ids for x in encoder.library.encode_batch(texts, add_special_tokens=False)]
    for i in range(0, len(texts), 900):
        encoder.held += packing.CACHE_BYTES // 2
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.packed(texts[i : i + 900])] == want[i : i + 900]
    assert encoder.packed([""]) == [b""] and encoder.packed([]) == []


@pytest.mark.parametrize("group_tokens", [1 << 20, 4000])
def test_sequences(spark, group_tokens):
    encoder = packing.Encoder(PATH)
    df = spark.createDataFrame([(i if i != 4 else None, t, 9, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, start int, ids string").coalesce(1)
    rows = packing.digested(packing.sequences(df, PATH, group_tokens=group_tokens)).collect()
    by_doc: dict = {}
    by_sequence: dict = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in enumerate(TEXTS):
        ids = np.array([*encoder.library.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(by_doc[i if i != 4 else None], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and (2048 - at <= packing.SLACK or at & (at - 1) == 0)
    assert packing.sequences(df.where("false"), PATH).collect() == []
