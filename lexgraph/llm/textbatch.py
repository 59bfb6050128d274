"""Vectorised text primitives over Arrow batches: bytes, words, rolling hashes.

Everything works on one flat byte buffer per slice of a batch, so the cost per row is a few numpy
calls per slice, and memory is bounded by the slice (``SLICE_BYTES``), not by the batch.
A single text longer than the slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
U64 = np.uint64
_GOLD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x.astype(U64, copy=True)
    x += U64(_GOLD)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_CODES = mix(np.arange(256, dtype=U64))
BASE = 0x2545F4914F6CDD1D  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(BASE, -1, 1 << 64)

#: The white space of the contracts, bytes 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1024)
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of a batch in slices of about ``limit`` bytes: rows, UTF-8 bytes, offsets (int64, from 0). Null texts are empty."""
    column = batch.column(batch.schema.get_field_index(text))
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    column = pc.fill_null(column, "").cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(n, max(stop, start + 1), start + 60_000)
        at = offsets[start : stop + 1]
        yield batch.slice(start, stop - start), data[at[0] : at[-1]], at - at[0]
        start = stop


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions in the slice) of the words, and the text index of each word."""
    inside = ~space[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    opens[edge] = inside[edge]
    closes[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash modulo 2**64; ``len(data) + 1`` entries."""
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(BYTE_CODES[data] * powers(BASE, len(data)), out=out[1:])
    return out


def chunk_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes and length, independent for each ``seed``.

    Every eight bytes are mixed with their place in the span before they are added up, and so is the length with the sum. Unlike a polynomial modulo 2**64,
    which maps a Thue-Morse string and its complement to one value whatever its base, the terms follow no algebraic rule of the bytes."""
    length = ends - starts
    chunks = (length + 7) >> 3
    stop = np.cumsum(chunks)
    total = int(stop[-1]) if len(stop) else 0
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    place = np.arange(total) - np.repeat(stop - chunks, chunks)
    at = np.repeat(starts, chunks) + 8 * place
    value = words[at].astype(U64)
    left = np.repeat(ends, chunks) - at
    short = np.flatnonzero(left < 8)
    value[short] &= (U64(1) << (8 * left[short]).astype(U64)) - U64(1)
    places = mix(np.arange(int(chunks.max(initial=0)), dtype=U64) + U64((seed * _GOLD + 1) % (1 << 64)))
    sums = np.zeros(total + 1, dtype=U64)
    np.cumsum(mix(value ^ places[place]), out=sums[1:])
    return mix((sums[stop] - sums[stop - chunks]) ^ mix(length.astype(U64) + U64((seed * _GOLD) % (1 << 64))))


def shingle_hash(words: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each run of ``k`` words inside one text: hash, owner, index of the first word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(owner[: n] == owner[k - 1 :])
    value = np.zeros(len(first), dtype=U64)
    for j in range(k):
        value = mix(value * U64(3) + words[first + j])
    return value, owner[first], first


def text_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each whole text."""
    return chunk_hash(data, offsets[:-1], offsets[1:])


def row_keys(ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit key of (id, text): repeated rows share it, a repeated id with another text doesn't."""
    missing = np.asarray(pc.is_null(ids))
    numbers = np.asarray(pc.fill_null(ids.cast(pa.int64()), 0)).astype(np.int64).view(U64)
    return mix(mix(numbers) + missing.astype(U64) * U64(977)) ^ text_keys(data, offsets)
