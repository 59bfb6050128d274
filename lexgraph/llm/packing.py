"""Operator 13, packing: best-fit decreasing into windows of a fixed number of tokens.

Each task encodes its documents and packs them in groups of at most ``group_tokens`` tokens, so nothing is shuffled and memory follows the group, not
the partition. Inside a group:

1. A document longer than a window is first cut into full windows; what is left of it is an item.
2. Items are taken by decreasing length, and each goes into the *tightest* open window that has room for it. A segment tree over the remaining
   capacities finds that window in one climb and one descent.
3. Windows that would still be padded by more than ``slack`` tokens are opened again: their items are put in a row, cut into full windows, and the last
   ones into powers of two, which need no padding. So no sequence is padded by more than ``slack`` tokens, whatever the lengths are.

The tokenizers library's BPE model encodes. A slice of texts is cut, as bytes, into the matches of the pattern of the library's byte-level pre-tokenizer, which
are encoded each by itself. Arrow tells the matches of a slice apart, so that only different ones are looked up; new ones go to the model in rows of a thousand, and
their ids are told apart by the bytes that the ids stand for. Texts with characters whose class may differ between Unicode versions go to the library whole.

Defined results: a null or empty text is a document of the end id alone; the names of special tokens are ordinary text; repeated rows are documents of their
own; a null doc_id stays null; an empty table has no pieces; further columns are ignored. Sequence ids are unique, but not without gaps; they follow the number of
the input partition, so a task that runs again gives the same pieces when its rows come in the same order, as from files.
"""

from __future__ import annotations

import itertools
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .bpe import byte_characters
from .tables import with_workers

WINDOW = 2048
SLACK = 16
GROUP_TOKENS = 4 << 20
END_ID = 1
#: Memory that a worker's kept matches may take, beside those of one slice; what is encoded doesn't depend on it.
CACHE_BYTES = 200 << 20
_ENTRY_BYTES = 180
#: Bytes of text whose matches are told apart together.
SLICE_BYTES = 4 << 20
#: Characters that may be classed otherwise by the library's Unicode version: such a text isn't cut.
UNSETTLED = r"[^\x00-\x1b\x20-ԧ‐-‧ぁ-ゖァ-ヺ一-龥가-힣]"
#: Classes of the pattern's characters, by code point: white space, letters, numbers, others.
SPACE, LETTER, NUMBER, OTHER = range(4)
CLASSES = np.array([SPACE if c in (*range(9, 14), 0x20, 0x85, 0xA0) else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(1 << 16)], dtype=np.uint8)
_ROW = 1000

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def matches(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where matches of ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` begin in each text of a slice (settled characters in UTF-8), and the slice's end."""
    n = len(data)
    kind = CLASSES[data]
    two = np.flatnonzero(data >= 0xC0)
    if len(two):
        three = two[data[two] >= 0xE0]
        two = two[data[two] < 0xE0]
        kind[two] = kind[two + 1] = CLASSES[(data[two].astype(np.int64) & 31) << 6 | data[two + 1] & 63]
        kind[three] = kind[three + 1] = kind[three + 2] = CLASSES[(data[three].astype(np.int64) & 15) << 12 | (data[three + 1].astype(np.int64) & 63) << 6 | data[three + 2] & 63]
    edge = np.zeros(n + 4, dtype=bool)  # where texts begin; beyond the slice, too
    edge[offsets] = edge[n:] = True
    begins = edge.copy()
    begins[1:n] |= kind[1:] != kind[:-1]
    # the last white space before another character is a match, or the first character of the next match if it is 0x20
    after = np.flatnonzero(begins[1:n] & ~edge[1:n] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
    last = after - 1 - (data[after - 1] >= 0x80)
    begins[last] = True
    begins[after[data[last] == 0x20]] = False
    # contractions, where a match begins with the apostrophe
    at = np.flatnonzero(begins[:n] & (np.concatenate([data, [0]])[:n] == 0x27))
    ahead = np.concatenate([data, np.zeros(3, np.uint8)])
    one, next_one = ahead[at + 1], ahead[at + 2]
    short = np.isin(one, list(b"stmd")) & ~edge[at + 1]
    long = np.isin(one.astype(np.int64) << 8 | next_one, [0x7265, 0x7665, 0x6C6C]) & ~edge[at + 1] & ~edge[at + 2]
    begins[at[short | long] + 1] = False
    begins[at[short] + 2] = True
    begins[at[long] + 3] = True
    return np.flatnonzero(begins[: n + 1])


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, by a file of the tokenizers library for byte-level BPE."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        kind = parts["pre_tokenizer"] or {}
        if parts["normalizer"] or kind.get("type") != "ByteLevel" or kind["add_prefix_space"] or not kind["use_regex"]:
            raise ValueError(f"{path}: not the plain byte-level pre-tokenizer")
        self.model = Tokenizer(self.library.model)  # of matches whose bytes are shown as characters
        of = {c: b for b, c in enumerate(byte_characters())}
        self.shown = {b: c for c, b in of.items()}
        self.long = np.zeros(self.library.get_vocab_size(), dtype=np.int64)
        for token, number in self.library.get_vocab(with_added_tokens=False).items():
            self.long[number] = sum(c in of for c in token)
        self._forget()

    def _forget(self) -> None:
        """``known`` has the place of a match's ids in ``ids``: where they begin, times 2**31, and how many they are."""
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, dtype="<u4")
        self.used = self.held = 0

    def _learn(self, new: list[bytes]) -> list[int]:
        shown = "\u0200".join([x.decode("latin-1") for x in new]).translate(self.shown).split("\u0200")
        rows = [shown[i : i + _ROW] for i in range(0, len(shown), _ROW)]
        ids = np.concatenate([np.array(x.ids, dtype="<u4") for x in self.model.encode_batch_fast(rows, is_pretokenized=True, add_special_tokens=False)])
        ends = np.cumsum(list(map(len, new)))
        stop = np.searchsorted(np.cumsum(self.long[ids]), ends) + 1
        start = np.concatenate([[0], stop[:-1]])
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used + len(ids), dtype="<u4")])
        self.ids[self.used : self.used + len(ids)] = ids
        places = ((self.used + start) << 31 | (stop - start)).tolist()
        self.used += len(ids)
        self.held += _ENTRY_BYTES * len(new) + int(ends[-1]) + 4 * len(ids)
        self.known.update(zip(new, places, strict=True))
        return places

    def _settled(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        if self.held > CACHE_BYTES:
            self._forget()
        begins = matches(data, offsets)
        cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins) - 1, [None, pa.py_buffer(begins), pa.py_buffer(data)]).dictionary_encode()
        different = cells.dictionary.to_numpy(zero_copy_only=False)
        place = np.fromiter(map(self.known.get, different, itertools.repeat(-1)), np.int64, len(different))
        if len(new := np.flatnonzero(place < 0)):
            place[new] = self._learn(different[new].tolist())
        which = np.asarray(cells.indices)
        count = (place & ((1 << 31) - 1))[which]
        stop = np.concatenate([[0], np.cumsum(count)])
        packed = self.ids[np.arange(stop[-1]) + np.repeat((place >> 31)[which] - stop[:-1], count)].tobytes()
        ends = 4 * stop[np.searchsorted(begins, offsets)]
        return [packed[a:b] for a, b in itertools.pairwise(ends.tolist())]

    def packed(self, texts: pa.Array | list[str]) -> list[bytes]:
        """The ids of each text; a null is empty."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "").cast(pa.large_string())
        texts.validate(full=True)  # bytes that are no UTF-8 are an error
        apart = pc.match_substring_regex(texts, UNSETTLED)
        whole = iter(self.library.encode_batch_fast(texts.filter(apart).to_pylist(), add_special_tokens=False))
        plain = pa.RecordBatch.from_arrays([texts.filter(pc.invert(apart))], names=["text"])
        cut = itertools.chain.from_iterable(self._settled(data, offsets) for _, data, offsets in tb.slices(plain, "text", SLICE_BYTES))
        return [np.array(next(whole).ids, dtype="<u4").tobytes() if a else next(cut) for a in apart.to_pylist()]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """Kept by the worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Tightest:
    """Open windows by remaining capacity; a segment tree counts them, so the smallest capacity that suffices is found in logarithmic time."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, n: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += n
            node >>= 1

    def put(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(window, its capacity) of the tightest window with room for ``need``; it is taken out."""
        count, node = self.count, need + self.leaves
        while not count[node]:
            while node & 1:  # right children have nothing to their right below the same parent
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node *= 2
            if not count[node]:
                node += 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return self.open[capacity].pop(), capacity


Piece = tuple[int, int, int]


def _settled(length: int, window: int, slack: int) -> bool:
    return window - length <= slack or length & (length - 1) == 0


def pack(lengths: list[int], window: int = WINDOW, slack: int = SLACK) -> list[list[Piece]]:
    """Sequences of pieces (item, start, length) for items of the given positive lengths."""
    done: list[list[Piece]] = []
    rest: list[Piece] = []
    for item, length in enumerate(lengths):
        full = length // window
        done += [[(item, k * window, window)] for k in range(full)]
        if length % window:
            rest.append((item, full * window, length % window))
    rest.sort(key=lambda x: -x[2])
    tree = Tightest(window)
    windows: list[list[Piece]] = []
    for piece in rest:
        need = piece[2]
        found = tree.take(need)
        if found is None:
            windows.append([piece])
            tree.put(window - need, len(windows) - 1)
            continue
        number, capacity = found
        windows[number].append(piece)
        if capacity > need:
            tree.put(capacity - need, number)
    loose: list[Piece] = []
    for pieces in windows:
        if _settled(sum(x[2] for x in pieces), window, slack):
            done.append(pieces)
        else:
            loose += pieces
    return done + _cut(loose, window)


def _cut(pieces: list[Piece], window: int) -> list[list[Piece]]:
    """The pieces in a row, cut into full windows and then into powers of two."""
    total = sum(x[2] for x in pieces)
    sizes = [window] * (total // window) + [1 << b for b in reversed(range(window.bit_length())) if total % window >> b & 1]
    out: list[list[Piece]] = []
    room = 0
    for item, start, length in pieces:
        while length:
            if not room:
                room = sizes[len(out)]
                out.append([])
            n = min(room, length)
            out[-1].append((item, start, n))
            start, length, room = start + n, length - n, room - n
    return out


def sequences(docs: DataFrame, path: str, window: int = WINDOW, slack: int = SLACK, end_id: int = END_ID, group_tokens: int = GROUP_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, start (in its document), length, ids (little-endian unsigned 32-bit integers), doc_tokens, sequence_id, offset (in its sequence)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 40
        made, held = 0, 0
        ids: list[int | None] = []
        packed: list[bytes] = []
        end = np.array([end_id], dtype="<u4").tobytes()
        encode = encoder(path).packed

        def flush() -> pa.RecordBatch:
            nonlocal made, held
            lengths = [len(x) // 4 for x in packed]
            rows = [(ids[i], start, n, packed[i][4 * start : 4 * (start + n)], lengths[i], task + made + k, at) for k, pieces in enumerate(pack(lengths, window, slack)) for (i, start, n), at in zip(pieces, _offsets(pieces), strict=True)]
            made = rows[-1][5] - task + 1
            held = 0
            ids.clear()
            packed.clear()
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for rows, _, _ in tb.slices(batch, "text", SLICE_BYTES):
                for number, found in zip(rows.column(0).to_pylist(), encode(rows.column(1)), strict=True):
                    if ids and held + len(found) // 4 + 1 > group_tokens:
                        yield flush()
                    ids.append(number)
                    packed.append(found + end)
                    held += len(found) // 4 + 1
        if ids:
            yield flush()

    with_workers(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def _offsets(pieces: list[Piece]) -> list[int]:
    at, out = 0, []
    for _, _, n in pieces:
        out.append(at)
        at += n
    return out


def digested(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    crc: Column = F.crc32("ids")
    return pieces.select("doc_id", "start", "length", crc.alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
