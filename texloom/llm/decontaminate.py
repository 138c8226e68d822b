"""Benchmark decontamination: a hash set of normalised test windows, broadcast to all tasks.

Texts are cut into words (A-Z lower-cased). A benchmark window is 13 consecutive words of an
item, or all words of a shorter item. Every task looks its documents' windows up in the set,
compares the words of each hit byte by byte, and marks the words inside. Documents stay where
they are: nothing is shuffled, and one scan of them does.

The set is packed: for each distinct window its 64-bit fingerprint, its place in the items'
normalised text and its items, some 30 bytes in all. It is broadcast while it holds at most
`max_windows` windows and eight bytes of text for each of these, 300 MB at the default. A
larger benchmark is cut into slices below that bound, between any two windows, of which the
driver holds one at a time; the documents are scanned once for each, and hits of the slices
are united per document.

Defined cases: null and empty texts have no words and no hits; items without words never
occur; items with a null id take part in marking words, and are named by the empty string in
item lists; repeated item ids count once; repeated documents are judged one by one; extra
columns are ignored, and no column of the result can clash with them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texloom.llm import textvec as tv

WINDOW = 13
MAX_WINDOWS = 8_000_000
TEXT_BYTES = 8  # of normalised text for each window of the bound
GROUP_BYTES = 1 << 20  # text of the items that are cut into words together
COMPARED = 1 << 22  # bytes compared in one array operation


class Windows(NamedTuple):
    """Windows of `k` words: fingerprints, places and lengths in a normalised text, and items."""

    k: int
    h: np.ndarray
    at: np.ndarray
    length: np.ndarray
    item: np.ndarray


def normalised(texts: tv.Texts, words: tv.Words) -> tuple[np.ndarray, np.ndarray]:
    """All words, each with one space after it, and the place of each word (and of the end)."""
    places = np.concatenate([[0], np.cumsum(words.end - words.start + 1)])
    out = np.full(places[-1], 32, np.uint8)
    of_word = np.ones(len(out), bool)
    of_word[places[1:] - 1] = False
    out[of_word] = tv.ALNUM_LOWER[texts.bytes[words.inside]]
    return out, places


def equal_bytes(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether a[at_a : at_a + length] equals b[at_b : at_b + length], for each of the places; lengths are positive."""
    out = np.zeros(len(length), bool)
    ends = np.cumsum(length)
    i = 0
    while i < len(length):
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + COMPARED, side="right")))
        n = length[i:j]
        first = ends[i:j] - n - before
        step = np.arange(ends[j - 1] - before) - np.repeat(first, n)
        same = a[np.repeat(at_a[i:j], n) + step] == b[np.repeat(at_b[i:j], n) + step]
        out[i:j] = np.logical_and.reduceat(same, first)
        i = j
    return out


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges [start, end), and the range that each comes from."""
    n = end - start
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + start[which], which


class DistinctWindows:
    """Distinct windows of `k` words in order of their fingerprints, with the items that hold each."""

    def __init__(self, windows: Windows, data: np.ndarray):
        self.k = windows.k
        order = np.lexsort((windows.item, windows.length, windows.h))
        h, at, length, item = (x[order] for x in windows[1:])
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (length[1:] == length[:-1])
        pairs = np.flatnonzero(again)
        again[pairs] = equal_bytes(data, at[pairs - 1], data, at[pairs], length[pairs])
        first = np.flatnonzero(~again)
        self.h, self.at, self.length = h[first], at[first].astype(np.uint32), length[first].astype(np.uint32)
        self.items, self.first_item = item.astype(np.int32), np.append(first, len(h)).astype(np.uint32)

    @cached_property
    def maybe(self) -> tuple[np.ndarray, np.uint64]:
        """Which leading bits of fingerprints occur; most windows of a text end here."""
        bits = min(26, max(10, int(8 * len(self.h)).bit_length()))
        shift = np.uint64(64 - bits)
        seen = np.zeros(1 << bits, bool)
        seen[self.h >> shift] = True
        return seen, shift

    def near(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into h, window here) of equal fingerprints."""
        seen, shift = self.maybe
        at = np.flatnonzero(seen[h >> shift])
        lo, hi = (np.searchsorted(self.h, h[at], side=side) for side in ("left", "right"))
        window, which = _ranges(lo, hi)
        return at[which], window


class WindowSet:
    """Benchmark windows: the items' ids and normalised text, and distinct windows by size."""

    def __init__(self, ids: list[str], data: np.ndarray, windows: list[Windows]):
        self.ids, self.data = ids, data
        self.by_size = []
        for k in sorted({w.k for w in windows}):
            same = [w for w in windows if w.k == k]
            self.by_size.append(DistinctWindows(Windows(k, *(np.concatenate([w[i] for w in same]) for i in range(1, 5))), data))

    def scan(self, texts: tv.Texts, words: tv.Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which words are hit, and the items found in each row."""
        hit = np.zeros(len(words.h), bool)
        items: dict[int, set[str]] = {}
        text = None
        for known in self.by_size:
            at, h = words.windows(known.k)
            which, window = known.near(h)
            if not len(which):
                continue
            text = text or normalised(texts, words)
            data, places = text
            at = at[which]
            length = places[at + known.k] - places[at]
            good = length == known.length[window]
            at, window, length = at[good], window[good], length[good]
            good = equal_bytes(data, places[at], self.data, known.at[window].astype(np.int64), length)
            at, window = at[good], window[good]
            hit |= tv.covered(len(hit), at, known.k)
            pairs = np.unique(np.stack([words.row[at], window]), axis=1)
            item, which = _ranges(known.first_item[pairs[1]].astype(np.int64), known.first_item[pairs[1] + 1].astype(np.int64))
            for row, i in np.unique(np.stack([pairs[0][which], known.items[item]]), axis=1).T.tolist():
                items.setdefault(row, set()).add(self.ids[i])
        return hit, items


def _item_windows(texts: list[str | None], size: int) -> tuple[np.ndarray, list[Windows]]:
    """Normalised text and windows of some items; `item` counts from 0."""
    column = tv.Texts(pa.array([t or "" for t in texts], pa.string()))
    words = tv.Words(column, tv.ALNUM_LOWER)
    data, places = normalised(column, words)
    out = []
    for k in sorted({min(size, int(n)) for n in words.count} - {0}):
        if k == size:
            at, h = words.windows(size)
        else:
            at = words.first[:-1][words.count == k]
            h = words.spans(at, at + k)
        out.append(Windows(k, h, places[at], places[at + k] - places[at], words.row[at]))
    return data, out


def benchmark_slices(benchmark: DataFrame, id_col: str, text_col: str, size: int, max_windows: int) -> Iterator[WindowSet]:
    """The benchmark's windows in sets below the bound, one at a time on the driver; one empty set where it has none."""
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator(prefetchPartitions=True)
    ids: list[str] = []
    data: list[np.ndarray] = []
    windows: list[Windows] = []
    n_windows = n_bytes = yielded = 0

    def whole() -> WindowSet:
        return WindowSet(ids, np.concatenate([*data, np.zeros(0, np.uint8)]), windows)

    for group in _groups(rows):
        text, found = _item_windows([t for _, t in group], size)
        names = ["" if i is None else str(i) for i, _ in group]
        done = [0] * len(found)
        while True:
            if n_windows and (n_windows >= max_windows or n_bytes + len(text) > TEXT_BYTES * max_windows):
                yield whole()
                yielded += 1
                ids, data, windows, n_windows, n_bytes = [], [], [], 0, 0
            base, shift = len(ids), n_bytes
            for j, w in enumerate(found):
                room = slice(done[j], done[j] + max_windows - n_windows)
                windows.append(Windows(w.k, w.h[room], w.at[room] + shift, w.length[room], w.item[room] + base))
                done[j] += len(windows[-1].h)
                n_windows += len(windows[-1].h)
            ids += names
            data.append(text)
            n_bytes += len(text)
            if all(d == len(w.h) for d, w in zip(done, found, strict=True)):
                break
    if n_windows or not yielded:
        yield whole()


def _groups(rows: Iterator) -> Iterator[list[tuple]]:
    group, n = [], 0
    for r in rows:
        group.append((r.i, r.t))
        n += len(r.t or "")
        if n >= GROUP_BYTES:
            yield group
            group, n = [], 0
    if group:
        yield group


def find_hits(
    docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """One row per document: doc_id, text_key, n_words, hit_words array<int> (word indices), items array<string>.

    text_key, the text's MD5 where the benchmark needs several slices and else null, tells rows of one doc_id apart.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    shared = _broadcasts(source, benchmark_slices(benchmark, item_id, item_text, window, max_windows))
    parts = [_scan(source, one, len(shared) > 1) for one in shared]
    if len(parts) == 1:
        return parts[0]
    every = reduce(DataFrame.unionByName, parts).groupBy("doc_id", "text_key")
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    # equal rows meet in one group; the count of rows of one slice brings them back
    return (
        every.agg(F.max("n_words").alias("n_words"), merged("hit_words"), merged("items"), (F.count("*") / len(parts)).cast("int").alias("_n"))
        .withColumn("_n", F.explode(F.sequence(F.lit(1), "_n")))
        .drop("_n")
    )


def _broadcasts(docs: DataFrame, slices: Iterator[WindowSet]) -> list[Broadcast]:
    """A handle for each slice; the driver drops a set as soon as it is written out."""
    return [docs.sparkSession.sparkContext.broadcast(one) for one in slices]


def _scan(source: DataFrame, shared: Broadcast, keyed: bool) -> DataFrame:
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text_key string, n_words long, hit_words array<int>, items array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in tv.chunks(batch, "text"):
                texts = tv.Texts(part.column("text"))
                words = tv.Words(texts, tv.ALNUM_LOWER)
                hit, found = known.scan(texts, words)
                inside = np.flatnonzero(hit)
                local = (inside - words.first[words.row[inside]]).astype(np.int32)
                at = np.concatenate([[0], np.cumsum(tv.per_row(hit, words.first))]).astype(np.int32)
                keys = [hashlib.md5(t or b"").hexdigest() for t in part.column("text").to_pylist()] if keyed else [None] * part.num_rows
                yield pa.record_batch(
                    [
                        part.column("doc_id"),
                        pa.array(keys, pa.string()),
                        pa.array(words.count, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(local)),
                        pa.array([sorted(found.get(i, ())) for i in range(part.num_rows)], pa.list_(pa.string())),
                    ],
                    names=["doc_id", "text_key", "n_words", "hit_words", "items"],
                )

    return source.mapInArrow(run, schema)


def judged(hits: DataFrame) -> DataFrame:
    """The digest columns and the verdict: hit words are a twentieth of all, or more."""
    n_hit = F.size("hit_words").cast("long")
    return hits.select(
        "doc_id",
        "text_key",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, *, spans_only: bool = False, window: int = WINDOW, max_windows: int = MAX_WINDOWS
) -> DataFrame:
    """`docs` without contaminated documents, or (spans_only) with the hit passages cut out of their texts.

    All other columns stay. Rows with equal text are judged alike.
    """
    shared = _broadcasts(docs, benchmark_slices(benchmark, "item_id", "text", window, max_windows))
    if len(shared) == 1:

        def run(batches):
            known = shared[0].value
            for batch in batches:
                for part in tv.chunks(batch, "text"):
                    texts = tv.Texts(part.column("text"))
                    words = tv.Words(texts, tv.ALNUM_LOWER)
                    hit, _ = known.scan(texts, words)
                    n = tv.per_row(hit, words.first)
                    if spans_only:
                        yield _with_text(part, _cut(texts, words, hit, part.column("text")))
                    else:
                        yield part.filter(pa.array(~((n > 0) & (20 * n >= words.count))))

        return docs.mapInArrow(run, docs.schema)
    taken = {c.lower() for c in docs.columns}
    key, hits = ("_" * (1 + max(map(len, taken))) + c for c in ("key", "hits"))  # longer than any name of theirs
    found = find_hits(docs, benchmark, window=window, max_windows=max_windows)
    keyed = docs.withColumn(key, F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    if not spans_only:
        bad = judged(found).where("contaminated").select(F.col("text_key").alias(key)).distinct()
        return keyed.join(bad, key, "left_anti").select(*docs.columns)
    marks = found.where(F.size("hit_words") > 0).groupBy(F.col("text_key").alias(key)).agg(F.first("hit_words").alias(hits))
    columns = docs.columns

    def cut(batches):
        for batch in batches:
            for part in tv.chunks(batch, "text"):
                texts = tv.Texts(part.column("text"))
                words = tv.Words(texts, tv.ALNUM_LOWER)
                hit = np.zeros(len(words.h), bool)
                for first, at in zip(words.first, part.column(hits).to_pylist(), strict=False):
                    hit[first + np.array(at or [], np.int64)] = True
                yield _with_text(part.select(columns), _cut(texts, words, hit, part.column("text")))

    return keyed.join(marks, key, "left").select(*columns, hits).mapInArrow(cut, docs.schema)


def _with_text(part: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
    at = part.schema.get_field_index("text")
    return part.set_column(at, part.schema.field("text"), pa.array(texts, part.schema.field("text").type))


def _cut(texts: tv.Texts, words: tv.Words, hit: np.ndarray, column: pa.Array) -> list[str | None]:
    """Texts without the bytes from the first to the last word of each hit run."""
    keep = np.ones(len(texts.bytes) + 1, np.int64)
    change = np.zeros(len(texts.bytes) + 1, np.int64)
    joined = hit[:-1] & hit[1:] & (words.row[:-1] == words.row[1:]) if len(hit) else np.zeros(0, bool)
    np.add.at(change, words.start[hit], 1)
    np.add.at(change, words.end[hit], -1)
    gaps = np.flatnonzero(joined)
    np.add.at(change, words.end[gaps], 1)
    np.add.at(change, words.start[gaps + 1], -1)
    keep = np.cumsum(change[:-1]) == 0
    valid = column.is_valid().to_pylist()
    return [
        texts.bytes[a:b][keep[a:b]].tobytes().decode("utf-8", "replace") if ok else None
        for a, b, ok in zip(texts.offsets[:-1], texts.offsets[1:], valid, strict=True)
    ]
