"""Ranked lexical search: the best documents of every query item, by presence masks.

Terms are runs of letters, digits and anything beyond ASCII, A-Z lower-cased. Two scans of the documents, where they
lie; nothing of a document is shuffled:

1. Statistics: documents with a term, terms in all, and the document frequency of every term of the items.
2. Search: in each block of documents, terms of the items become rows of small integers (a posting's impact) and
   bitmaps of the documents that hold them. For each item the bitmaps of its terms, laid side by side, give every
   document's presence mask; documents of one mask are a group. A mask's maximum score is the sum of its terms'
   weights times their largest impact in the block. Masks are evaluated by falling maximum, exactly, until the
   next maximum is below the item's k-th best score so far; groups after that can't hold a better document.

A task keeps the k best of each item over all its blocks, so later blocks stop sooner, and sends them on once; the
last step ranks them by item. Only the vocabulary of the items is broadcast: items are taken in slices of `MAX_BYTES`
of text, each with its own two scans (an item that is longer is a slice of its own). Terms are compared by their bytes.

Scores are whole numbers; see `weights` and `impacts`. Ties go to the smaller id.

Defined cases: null and empty texts, and texts without a term, hold nothing and are found by nothing; items without
a term, or whose terms no document holds, have no rows; repeated items, and items of one id, are ranked each by
itself; repeated documents are ranked one by one; a null doc_id ranks after all others of its score; extra columns
are ignored, whatever their names. No documents: no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from texloom.llm import textvec as tv

BEST = 20
MAX_BYTES = 4 << 20  # of item texts in one slice
CELLS = 8 << 20  # vocabulary times documents of a block
FIRST = 64  # documents in the first batch of masks
_LAST = np.iinfo(np.int64).max  # stands for a null id


class Vocabulary:
    """The terms of a slice of items: sorted fingerprints, their bytes, and each item's terms with repeats counted."""

    def __init__(self, texts: list[str | None]):
        column = tv.Texts(pa.array([t or "" for t in texts], pa.string()))
        words = tv.Words(column, tv.ALNUM_LOWER)
        folded = tv.ALNUM_LOWER[column.bytes].tobytes()
        terms = [folded[a:b] for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)]
        number: dict[bytes, int] = {}
        keys: list[int] = []
        for t, h in zip(terms, words.h.tolist(), strict=True):
            if t not in number:
                number[t] = len(number)
                keys.append(h)
        order = np.argsort(np.array(keys, np.uint64), kind="stable")
        self.h = np.array(keys, np.uint64)[order]
        names = list(number)
        self.terms = [names[i] for i in order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.items = []
        for a, b in zip(words.first[:-1], words.first[1:], strict=True):
            held = Counter(place[number[t]] for t in terms[a:b])
            self.items.append((np.array(sorted(held), np.int64), np.array([held[k] for k in sorted(held)], np.int64)))
        self.size = np.array([len(t) for t in self.terms], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.data = np.frombuffer(b"".join(self.terms), np.uint8)
        self.clash = len(self.h) > 1 and bool((self.h[1:] == self.h[:-1]).any())

    def find(self, texts: tv.Texts, words: tv.Words) -> tuple[np.ndarray, np.ndarray]:
        """Words of the texts that are terms: their indices and the terms' numbers. Bytes are compared."""
        if not len(self.h) or not len(words.h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.clash:  # two terms of one fingerprint: look them up by their bytes
            folded, number = tv.ALNUM_LOWER[texts.bytes].tobytes(), {t: i for i, t in enumerate(self.terms)}
            found = [number.get(folded[a:b], -1) for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)]
            term = np.array(found, np.int64)
            at = np.flatnonzero(term >= 0)
            return at, term[at]
        near = np.minimum(np.searchsorted(self.h, words.h), len(self.h) - 1)
        at = np.flatnonzero(self.h[near] == words.h)
        term = near[at]
        same = (words.end[at] - words.start[at]) == self.size[term]
        at, term = at[same], term[same]
        # all bytes of all these words against those of their terms, in one go
        n = self.size[term]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        equal = tv.ALNUM_LOWER[texts.bytes[np.repeat(words.start[at], n) + step]] == self.data[np.repeat(self.at[term], n) + step]
        good = np.add.reduceat(equal, np.cumsum(n) - n) == n if len(n) else np.zeros(0, bool)
        return at[good], term[good]


@lru_cache(maxsize=1)
def vocabulary(shared: Broadcast) -> Vocabulary:
    """The vocabulary of a slice, made once in each worker."""
    return Vocabulary(shared.value)


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 * ln((2N + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(10**9 tf) div (1000 tf + 12 m), where m = 75 + (25 n N) div L; below a million."""
    m = 75 + (25 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _blocks(batches: Iterator[pa.RecordBatch], known: Vocabulary) -> Iterator[tuple[pa.RecordBatch, tv.Words, np.ndarray, np.ndarray]]:
    """Slices of documents, their words, and the (row * terms + term) of each posting with its count."""
    v = max(1, len(known.h))
    rows = max(1, CELLS // v)
    for batch in batches:
        for chunk in tv.chunks(batch, "text"):
            for at in range(0, chunk.num_rows, rows):
                part = chunk.slice(at, rows)
                texts = tv.Texts(part.column("text"))
                words = tv.Words(texts, tv.ALNUM_LOWER)
                at_word, term = known.find(texts, words)
                posting, tf = np.unique(words.row[at_word] * v + term, return_counts=True)
                yield part, words, posting, tf


def _statistics(source: DataFrame, shared: Broadcast) -> DataFrame:
    """term (-1: documents with a term, -2: terms in all) and its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(shared)
        v = max(1, len(known.h))
        df, docs, terms = np.zeros(v, np.int64), 0, 0
        for _, words, posting, _ in _blocks(batches, known):
            df += np.bincount(posting % v, minlength=v)
            docs += int((words.count > 0).sum())
            terms += len(words.h)
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.concatenate([[-1, -2], some])), pa.array(np.concatenate([[docs, terms], df[some]]))], names=["term", "n"])

    return source.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


class Ranking:
    """The k best documents of an item so far."""

    def __init__(self, k: int):
        self.k, self.score, self.doc = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """A group whose maximum is below this can't add a document."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        new = score >= self.least
        score, doc = np.concatenate([self.score, score[new]]), np.concatenate([self.doc, doc[new]])
        order = np.lexsort((doc, -score))[: self.k]
        self.score, self.doc = score[order], doc[order]


def evaluate(impact: np.ndarray, weight: np.ndarray, doc: np.ndarray, best: Ranking) -> int:
    """Rank the documents of a block for one item: `impact` has a row for each of its terms, `weight` their weights.

    The number of documents that were scored.
    """
    bits = np.packbits(impact > 0, axis=0)
    if len(bits) <= 8:
        mask = np.zeros((8, bits.shape[1]), np.uint8)
        mask[: len(bits)] = bits
        key = np.ascontiguousarray(mask.T).view(np.uint64).reshape(-1)
    else:
        key = np.ascontiguousarray(bits.T).view(np.dtype((np.void, len(bits)))).reshape(-1)
    _, first, group = np.unique(key, return_index=True, return_inverse=True)
    most = (impact[:, first] > 0).T @ (weight * impact.max(axis=1))
    order = np.argsort(-most, kind="stable")
    sizes = np.bincount(group, minlength=len(first))[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    by_mask = np.argsort(place[group], kind="stable")  # documents in the order of their masks
    ends = np.cumsum(sizes)
    done, scored, batch = 0, 0, FIRST
    while done < len(order) and most[order[done]] >= best.least:
        until = max(done + 1, int(np.searchsorted(ends, scored + batch, side="right")))
        until = done + int((most[order[done:until]] >= best.least).sum())
        some = by_mask[scored : ends[until - 1]]
        best.add(weight @ impact[:, some], doc[some])
        done, scored, batch = until, int(ends[until - 1]), 4 * batch
    return scored


def _ranked(source: DataFrame, shared: Broadcast, df: Broadcast, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item (its place in the slice), doc, score: the k best of each item among the documents of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(shared)
        v = max(1, len(known.h))
        weight = weights(df.value, n_docs)
        best = [Ranking(k) for _ in known.items]
        for part, words, posting, tf in _blocks(batches, known):
            if not len(posting):
                continue
            rows = np.unique(posting // v)
            doc = part.column("doc").fill_null(_LAST).to_numpy()[rows]
            impact = np.zeros((v, len(rows)), np.int64)
            impact[posting % v, np.searchsorted(rows, posting // v)] = impacts(tf, words.count[posting // v], n_docs, n_terms)
            there = impact.max(axis=1) > 0
            for (terms, often), mine in zip(known.items, best, strict=True):
                held = there[terms]
                if held.any():
                    evaluate(impact[terms[held]], weight[terms[held]] * often[held], doc, mine)
        item = np.repeat(np.arange(len(best)), [len(b.doc) for b in best])
        doc = np.concatenate([b.doc for b in best]) if best else np.zeros(0, np.int64)
        score = np.concatenate([b.score for b in best]) if best else np.zeros(0, np.int64)
        yield pa.record_batch([pa.array(item.astype(np.int32)), pa.array(doc, pa.int64(), mask=doc == _LAST), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return source.mapInArrow(run, "item int, doc_id long, score long").where("score > 0")


def item_slices(items: DataFrame, item_id: str, item_text: str, max_bytes: int) -> Iterator[list]:
    """(id, text) of the items, in slices of at most `max_bytes` of text, one at a time on the driver."""
    held, room = [], max_bytes
    for r in items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).toLocalIterator():
        size = len((r.t or "").encode())
        if held and size > room:
            yield held
            held, room = [], max_bytes
        held.append((r.i, r.t))
        room -= size
    if held:
        yield held


def search(
    docs: DataFrame, items: DataFrame, *, k: int = BEST, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """item_id, rank, doc_id, score of each item's k best documents."""
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("binary").alias("text"))
    id_type = items.schema[item_id].dataType.simpleString()
    found = []
    for part in item_slices(items, item_id, item_text, max_bytes):
        shared = spark.sparkContext.broadcast([t for _, t in part])
        counted = {r.term: r.n for r in _statistics(source, shared).collect()}
        n_docs, n_terms = counted.pop(-1, 0) or 0, counted.pop(-2, 0) or 0
        if not counted:
            continue
        df = np.zeros(max(counted) + 1, np.int64)
        df[list(counted)] = list(counted.values())
        df = np.concatenate([df, np.zeros(len(Vocabulary([t for _, t in part]).h) - len(df), np.int64)])
        top = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = _ranked(source, shared, spark.sparkContext.broadcast(df), n_docs, n_terms, k).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(part)], f"item int, item_id {id_type}")
        found.append(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)
