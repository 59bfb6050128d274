"""Operator 9, byte-level BPE encoding and decoding over Arrow batches.

The tokenizers library encodes; its vocabulary and merges are derived from a public rank file (base64 token, rank),
whose path is a parameter. A rank file allows *every* pair of tokens whose concatenation is a token, so each split of
a token into two tokens becomes a merge, in the order of the ranks. Text is split by ``pattern`` first, each match is
mapped from bytes to printable characters, and encoded separately; a match that is a token by itself stays whole.

Decoding reverses the byte table: the ids' byte strings are concatenated before anything is decoded as UTF-8, so
characters that are split over tokens come back whole. :func:`encode_frame` returns ids and, on request, the
character offsets of each token, where the parts of a split character carry that character's offsets.

Defined results: a null or empty text has no tokens; special tokens are ordinary text; repeated rows each get a row;
further columns are ignored. Each batch is handled in slices of bounded bytes, so memory doesn't follow the input.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import textbatch as tb
from .tables import with_workers

_loaded: dict[tuple[str, str], tuple] = {}


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 for itself, the others from code point 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def load(path: str, pattern: str):
    """(encoder, byte string of each id); kept by the worker process."""
    if (path, pattern) in _loaded:
        return _loaded[path, pattern]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks = read_ranks(path)
    characters = byte_characters()
    shown = {token: "".join(characters[b] for b in token) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        merges += [(shown[token[:k]], shown[token[k:]]) for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks]
    encoder = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    encoder.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    _loaded[path, pattern] = encoder, table
    return _loaded[path, pattern]


#: Characters outside blocks whose letters and numbers are the same in every Unicode version that a library may carry:
#: a text with one of them is split by the tokenizer itself.
UNSETTLED = re.compile(r"[^\x00-\u0527\u2010-\u2027\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")

_pieces: dict[tuple[str, str], dict[str, bytes]] = {}
#: Memory that a worker's kept matches may take, and the longest match (in characters) that is kept.
CACHE_BYTES = 160 << 20
CACHED_CHARS = 48
#: What an entry of the dictionary takes beside its characters and ids: two objects' headers and the entry.
_ENTRY_BYTES = 200
_held: dict[tuple[str, str], int] = {}


def encode_packed(texts: list[str], path: str, pattern: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers.

    A text is its pattern's matches, each encoded by itself; so a short match goes to the tokenizer once and its ids are kept until ``CACHE_BYTES``
    are reached, then forgotten: a bound of memory, not of what is encoded. Longer matches, and texts that the library splits by itself, are never kept.
    """
    encoder, _ = load(path, pattern)
    known = _pieces.setdefault((path, pattern), {})
    if _held.get((path, pattern), 0) > CACHE_BYTES:
        known.clear()
        _held[path, pattern] = 0
    split = regex.compile(pattern, regex.V0).findall
    parts = [[text] if UNSETTLED.search(text) else split(text) for text in texts]
    new = list(set().union(*parts).difference(known)) if parts else []
    once: dict[str, bytes] = {}
    for piece, found in zip(new, encoder.encode_batch_fast(new, add_special_tokens=False), strict=True):
        ids = np.array(found.ids, dtype="<u4").tobytes()
        if len(piece) <= CACHED_CHARS:
            known[piece] = ids
            _held[path, pattern] = _held.get((path, pattern), 0) + _ENTRY_BYTES + 4 * len(piece) + len(ids)
        else:
            once[piece] = ids
    return [b"".join(known[x] if x in known else once[x] for x in p) if once else b"".join(map(known.__getitem__, p)) for p in parts]


def encode(texts: list[str], path: str, pattern: str) -> list[list[int]]:
    return [np.frombuffer(x, dtype="<u4").tolist() for x in encode_packed(texts, path, pattern)]


def decode_packed(packed: list[bytes], path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that all texts' ids stand for, concatenated, and each text's offsets in them."""
    flat, at = table_bytes(path, pattern)
    ids = np.frombuffer(b"".join(packed), dtype="<u4")
    long = at[ids + 1] - at[ids]
    stop = np.concatenate([[0], np.cumsum(long)])
    out = flat[np.arange(stop[-1]) + np.repeat(at[ids] - stop[:-1], long)]
    return out, stop[np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed])]).astype(np.int64)]


def table_bytes(path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """The byte table as one buffer and the offsets of each id's bytes."""
    if (path, pattern) not in _tables:
        table = load(path, pattern)[1]
        _tables[path, pattern] = np.frombuffer(b"".join(table), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in table])]).astype(np.int64)
    return _tables[path, pattern]


_tables: dict[tuple[str, str], tuple[np.ndarray, np.ndarray]] = {}


def decode_bytes(ids: list[int], path: str, pattern: str) -> bytes:
    _, table = load(path, pattern)
    return b"".join(map(table.__getitem__, ids))


def decode(ids: list[int], path: str, pattern: str, errors: str = "replace") -> str:
    """Text of ``ids``; a character cut off at either end follows ``errors``, one split inside is whole."""
    return decode_bytes(ids, path, pattern).decode("utf-8", errors)


def _texts(rows: pa.RecordBatch) -> list[str]:
    return [x or "" for x in rows.column(rows.schema.get_field_index("text")).to_pylist()]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, _, _ in tb.slices(batch, "text"):
            yield rows


def encode_frame(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """doc_id, ids array<int> and, with ``offsets``, starts and ends (code points of the text) of each token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _slices(batches):
            texts = _texts(rows)
            ids_col = rows.column(rows.schema.get_field_index("doc_id"))
            if not offsets:
                yield pa.RecordBatch.from_arrays([ids_col, pa.array(encode(texts, path, pattern), pa.list_(pa.int32()))], names=["doc_id", "ids"])
                continue
            done = load(path, pattern)[0].encode_batch(texts, add_special_tokens=False)
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([ids_col, *(pa.array(x, kind) for x in ([e.ids for e in done], [[a for a, _ in e.offsets] for e in done], [[b for _, b in e.offsets] for e in done]))], names=["doc_id", "ids", "starts", "ends"])

    with_workers(docs.sparkSession)
    schema = "doc_id long, ids array<int>" + (", starts array<int>, ends array<int>" if offsets else "")
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, schema)


def decode_frame(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text of each row of ``encoded`` (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids")).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array([decode(x or [], path, pattern) for x in ids], pa.string())], names=["doc_id", "text"])

    with_workers(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(texts: list[str], path: str, pattern: str) -> list[tuple[int, str, str]]:
    """Of each text: tokens, SHA-256 of the ids as little-endian 32-bit integers, and of the bytes they decode to."""
    packed = encode_packed(texts, path, pattern)
    back, at = decode_packed(packed, path, pattern)
    return [(len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(back[at[i] : at[i + 1]]).hexdigest()) for i, x in enumerate(packed)]


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Encode and decode each row; doc_id, the columns of ``keep`` and the digests of :func:`digests`."""
    with_workers(docs.sparkSession)
    keep = keep or []
    kept = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), *[docs[c] for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _slices(batches):
            n, ids, back = zip(*digests(_texts(rows), path, pattern), strict=True)
            names = ["doc_id", *keep]
            yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(c)) for c in names), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=[*names, "n_tokens", "ids_sha256", "decoded_sha256"])

    extra = "".join(f", `{c}` {kept.schema[c].dataType.simpleString()}" for c in keep)
    return kept.mapInArrow(run, f"doc_id long{extra}, {DIGESTS}")
