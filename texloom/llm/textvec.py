"""Words, lines and word windows of whole Arrow text columns as numpy arrays.

Texts are read as UTF-8 bytes straight from the Arrow buffers. A 256-entry table gives
every byte its folded value, 0 for separators; so words, their 64-bit fingerprints and the
fingerprints of word windows come from a few array operations, without a Python object per
word. All fingerprints are the same on every machine and in every run.

Memory: about 40 bytes for each byte of the texts of one chunk (see `chunks`); a chunk holds
one text at least, so a very long text costs 40 times its own size.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


mixed = _mixed
BYTE_VALUE = _mixed(np.arange(1, 257, dtype=np.uint64))
_BASES = {"byte": 0xD1342543DE82EF95, "word": 0xDA942042E4DD58B5}
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    have = _POWERS.get(kind)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 20)
        base, out = _BASES[kind], []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = (out[0], out[1])
        if size <= 1 << 24:
            _POWERS[kind] = have
    return have[0][:n], have[1][:n]


def _sums(values: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of values[i] * base**i, and the inverse powers."""
    up, down = _powers(kind, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return total, down


def _table(separators: bytes, lower: bool) -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[65:91] += 32
    t[np.frombuffer(separators, np.uint8)] = 0
    return t


#: White-space words `[^\x20\x09-\x0D]+`, as they are and with A-Z lower-cased. The NUL byte
#: is a word character there, so it takes the value of a byte that UTF-8 never holds.
SPACE = _table(b" \t\n\x0b\x0c\r", False)
SPACE_LOWER = _table(b" \t\n\x0b\x0c\r", True)
SPACE[0] = SPACE_LOWER[0] = 0xFF
#: Letters, digits and everything beyond ASCII, A-Z lower-cased: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
ALNUM_LOWER = _table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), True)


class Texts:
    """The bytes of some rows of a binary or string column; null counts as empty."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
            if isinstance(column, pa.ChunkedArray):
                column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
        if column.null_count:
            column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        self.n = len(column)
        kind = np.int64 if wide else np.int32
        _, offsets, data = column.buffers()
        if self.n == 0 or offsets is None:
            self.offsets, self.bytes = np.zeros(self.n + 1, np.int64), np.zeros(0, np.uint8)
            return
        at = np.frombuffer(offsets, kind)[column.offset : column.offset + self.n + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.bytes, self.offsets = raw[at[0] : at[-1]], at - at[0]

    def row_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, side="right") - 1


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give free memory back to the system: idle workers stay, and an executor counts all their pages."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def chunks(batch: pa.RecordBatch | pa.Table, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch | pa.Table]:
    """Slices of a batch of `limit` bytes of text, or one row where that is longer."""
    col = batch.column(column)
    sizes = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    release()


class Words:
    """The words of some texts.

    start, end: byte positions; row: the text of each word; first: index of each text's first
    word, and the number of words at last; h: fingerprints of the folded words.
    """

    def __init__(self, texts: Texts, table: np.ndarray):
        folded = table[texts.bytes]
        inside = folded != 0
        edge = np.zeros(len(inside) + 1, bool)
        edge[texts.offsets] = True
        before = np.zeros(len(inside), bool)
        before[1:] = inside[:-1]
        before[edge[:-1]] = False
        after = np.zeros(len(inside), bool)
        after[:-1] = inside[1:]
        after[edge[1:]] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, texts.offsets)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(texts.n), self.count)
        total, down = _sums(np.where(inside, BYTE_VALUE[folded], np.uint64(0)), "byte")
        self.h = _mixed((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))
        self.inside = inside

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and fingerprint of each window of `size` words of one text."""
        n = len(self.h) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.row[:n] == self.row[size - 1 :])
        return at, self.spans(at, at + size)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Fingerprints of word sequences [start, end)."""
        total, down = _sums(self.h, "word")
        return _mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def covered(n: int, at: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """Which of n words lie in windows of `size` words that begin at `at`."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + size, -1)
    return np.cumsum(change[:-1]) > 0


def per_row(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of true flags (or sum) in each row, rows given by their first index."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


class Lines:
    """The lines of some texts, split at newlines; an empty text has one empty line."""

    def __init__(self, texts: Texts):
        cuts = np.flatnonzero(texts.bytes == 10)
        starts = np.sort(np.concatenate([texts.offsets[:-1], cuts + 1]))
        ends = np.sort(np.concatenate([texts.offsets[1:], cuts]))
        self.start, self.end = starts, ends
        # a newline that ends a text makes an empty last line, which begins where the next text begins
        rows = np.searchsorted(cuts, texts.offsets)
        self.count = np.diff(rows) + 1
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.row = np.repeat(np.arange(texts.n), self.count)
        total, down = _sums(BYTE_VALUE[texts.bytes], "byte")
        self.h = _mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """Number of flagged bytes in each line."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.end] - total[self.start]


def repeats(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: whether its fingerprint occurs before in the same row; whether it does elsewhere in it."""
    key = _mixed(h + _mixed(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.zeros(len(k), bool)
    same[1:] = k[1:] == k[:-1]
    later, twice = np.zeros(len(k), bool), np.zeros(len(k), bool)
    later[order] = same
    both = same.copy()
    both[:-1] |= same[1:]
    twice[order] = both
    return later, twice
