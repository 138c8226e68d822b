"""Substring dedup: passages that an earlier document holds are removed, word by word.

A window is 13 consecutive words of one document. A word goes if a window that covers it also
starts, with the same words, in a document of smaller id. Four steps:

1. Recurring windows. Every task fingerprints its documents' windows (48 bits, and a shard by other
   bits), keeps for each fingerprint the smallest document of the task's chunk, and deals these out
   by shard as packed blocks. A shard sorts its block and finds each window's first document. What
   repeats inside the chunk already, word for word, is sent on as such and isn't dealt. So a passage in a
   third of all documents reaches its shard once per chunk, not once per document.
2. Passages. First documents give out the stretches of text that others seem to repeat, the others
   their runs of such windows, as words; runs of equal words that meet in a chunk are one.
3. Automata. Passages are dealt out by first document, those of one that many texts repeat with a salt,
   to shards of a few megabytes. Each compiles one Aho-Corasick automaton over the word sequences of its
   passages and streams the first documents through it, which locates every occurrence word by word.
   Only located passages are removed, wherever they stand; of a passage that isn't found whole in a document
   before each one that repeats it, each window is sought by itself.
4. Disputed windows. One that its first document doesn't hold has the fingerprint of other words. Such
   windows meet by their words, and the smallest document among them is their first: whatever documents
   hold one, the smallest either was found above or is disputed too.

So equal fingerprints of different words remove nothing and hide nothing.

Only narrow rows, repeated passages and disputed windows are shuffled, and texts once, by id: all joins with them share one
exchange. No task and not the driver holds more than a shard, a chunk or a slice; all numbers of shards
grow with the corpus.

Defined cases: null and empty texts, and those of fewer than 13 words, lose nothing; rows of
one doc_id are not earlier than each other, and each loses its own repeats; a null doc_id counts as later
than every other; ids are integers; the other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from texloom.llm import textvec as tv

WINDOW = 13
SHARD_WINDOWS = 3_000_000
MIN_SHARDS = 32
CHUNK = 4 << 20
PIECE = 1000  # windows of a run in one passage; longer runs are cut, overlapping by all words of a window but one
SHARD_BYTES = 2 << 20  # text of the passages in one automaton, where a quarter of all text repeats; four times as much where all does
HEAVY_BYTES = 4 << 20  # a first document whose passages are longer is streamed by several shards
BROADCAST_ROWS = 400_000
ROOM = 1 << 40
NULLS = (1 << 63) - ROOM  # ids from here on stand for null ids, told apart by their texts; a table's own ids there are moved down
NOWHERE = (1 << 63) - 1
BITS = 48


def _dealt(docs: DataFrame, size: int, shards: int) -> DataFrame:
    """Blocks of first-in-chunk windows by shard, and the repeats inside chunks (shard < 0)."""
    width = BITS // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.chunks(batch, "text", CHUNK):
                part = part.take(pa.array(np.argsort(part.column("doc").to_numpy(), kind="stable")))
                doc = part.column("doc").to_numpy()
                windows = [_windows(piece, size) for piece in tv.chunks(part, "text")]
                base = np.cumsum([0] + [p.num_rows for p in tv.chunks(part, "text")])
                base_word = np.cumsum([0] + [len(spelled) for _, _, _, spelled in windows])
                h = np.concatenate([w[2] for w in windows])
                row = np.concatenate([w[0] + b for w, b in zip(windows, base[:-1], strict=True)])
                at = np.concatenate([w[1] + np.int32(b) for w, b in zip(windows, base_word[:-1], strict=True)])
                if not len(h):
                    continue
                order = np.argsort(h, kind="stable")  # rows go by document, so equal windows do too
                h, d, at = h[order], doc[row[order]], at[order]
                first = np.ones(len(h), bool)
                first[1:] = h[1:] != h[:-1]
                group = np.cumsum(first) - 1
                low = d[np.flatnonzero(first)][group]
                mixed = _mixed_groups([w[3] for w in windows], at, first, group, size)
                new = first.copy()
                new[1:] |= d[1:] != d[:-1]
                later = new & (d > low) & (low < NULLS)
                held = np.zeros(len(h), bool)
                held[:-1] = first[:-1] & ~first[1:]  # of those, any that others in the chunk repeat
                told = (later | (held & (d < NULLS))) & ~mixed
                deal = first | (new & mixed)
                out = [_by_shard(h[deal], d[deal], shards, width), _by_doc(h[told], d[told], low[told], max(64, shards), width)]
                yield pa.record_batch(
                    [pa.array(np.concatenate([o[0] for o in out]), pa.int32())] + [pa.array(out[0][k] + out[1][k], pa.binary()) for k in (1, 2, 3)],
                    names=["shard", "h", "doc", "n"],
                )

    return docs.mapInArrow(run, "shard int, h binary, doc binary, n binary")


def _packed(h: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view(np.uint64).reshape(-1)


def _short(h: np.ndarray, width: int) -> np.ndarray:
    return h & np.uint64((1 << 8 * width) - 1)


def _windows(part: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.DictionaryArray]:
    """Row, first word and fingerprint of the windows of a slice, and its words as numbers."""
    texts = tv.Texts(part.column("text"))
    words = tv.Words(texts, tv.SPACE)
    at, h = words.windows(size)
    ends = np.concatenate([[0], np.cumsum(words.end - words.start)]).astype(np.int64)
    spelled = pa.Array.from_buffers(pa.large_binary(), len(words.start), [None, pa.py_buffer(ends), pa.py_buffer(texts.bytes[words.inside])])
    return words.row[at], at.astype(np.int32), h, spelled.dictionary_encode()


def _mixed_groups(spelled: list[pa.DictionaryArray], at: np.ndarray, first: np.ndarray, group: np.ndarray, size: int) -> np.ndarray:
    """Which windows, in groups of equal fingerprints, are of a group of different words."""
    again = np.flatnonzero(~first)
    word = np.concatenate([c.indices.to_numpy() for c in pa.chunked_array(spelled).unify_dictionaries().chunks])
    a, b = at[again], at[np.flatnonzero(first)][group[again]]
    same = np.ones(len(again), bool)
    for k in range(size):
        same &= word[a + k] == word[b + k]
    mixed = np.zeros(int(group[-1]) + 1, bool)
    mixed[group[again[~same]]] = True
    return mixed[group]


def _by_shard(h: np.ndarray, d: np.ndarray, shards: int, width: int) -> tuple:
    """For each shard, its windows in order of documents, as packed arrays."""
    shard = (h >> np.uint64(40)) % np.uint64(shards)
    order = np.lexsort((d, shard))
    h, d, shard = h[order], d[order], shard[order]
    cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(h) else np.zeros(0, int)
    hs, ds, ns = [], [], []
    for a, b in zip(cut, [*cut[1:], len(h)], strict=True):
        ids, n = np.unique(d[a:b], return_counts=True)
        hs.append(_packed(h[a:b], width))
        ds.append(ids.tobytes())
        ns.append(n.astype(np.uint32).tobytes())
    return shard[cut].astype(np.int32), hs, ds, ns


def _by_doc(h: np.ndarray, d: np.ndarray, low: np.ndarray, spread: int | None, width: int) -> tuple:
    """For each document, its repeated windows and their first documents (itself, where others repeat it); n holds the document."""
    order = np.argsort(d, kind="stable")
    h, d, low = h[order], d[order], low[order]
    cut = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])) if len(h) else np.zeros(0, int)
    ends = [*cut[1:], len(h)] if len(cut) else []
    hs = [_packed(h[a:b], width) for a, b in zip(cut, ends, strict=True)]
    ls = [low[a:b].tobytes() for a, b in zip(cut, ends, strict=True)]
    shard = (-1 - d[cut] % spread).astype(np.int32) if spread else d[cut]
    return shard, hs, ls, [d[a : a + 1].tobytes() for a in cut]


def _confirmed(width: int):
    def run(table: pa.Table) -> pa.Table:
        """The repeats of one shard: for each document, fingerprints and first documents."""
        hs, ds, ns = ([x or b"" for x in table.column(c).to_pylist()] for c in ("h", "doc", "n"))
        if table.column("shard")[0].as_py() < 0:  # known already
            return _result([np.frombuffer(n, np.int64)[0] for n in ns], hs, ds)
        h = _unpacked(b"".join(hs), width)
        d = np.repeat(np.frombuffer(b"".join(ds), np.int64), np.frombuffer(b"".join(ns), np.uint32))
        order = np.argsort(h)
        h, d = h[order], d[order]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        starts = np.flatnonzero(first)
        which = np.cumsum(first) - 1
        low, high = np.minimum.reduceat(d, starts)[which], np.maximum.reduceat(d, starts)[which]
        told = (low < high) & (low < NULLS)
        docs, hs, ls, _ = _by_doc(h[told], d[told], low[told], None, width)
        return _result(docs, hs, ls)

    return run


def _result(docs, hs: list, ls: list) -> pa.Table:
    return pa.table([pa.array(docs, pa.int64()), pa.array(hs, pa.binary()), pa.array(ls, pa.binary())], names=["doc", "h", "low"])


def _runs(pos: np.ndarray, low: np.ndarray, piece: int | None) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of runs of adjacent windows of one first document."""
    new = np.ones(len(pos), bool)
    new[1:] = (np.diff(pos) != 1) | (low[1:] != low[:-1])
    starts = np.flatnonzero(new)
    if piece:
        nth = np.arange(len(pos)) - starts[np.cumsum(new) - 1]
        starts = np.flatnonzero(nth % piece == 0)
    return starts, np.concatenate([starts[1:], [len(pos)]]) - 1


def _passages(part: pa.RecordBatch, size: int, width: int) -> list[tuple]:
    """(first document, held, digest, words, documents, word positions, marks of rows) of a slice: what first documents hold, and the distinct runs of others."""
    words = tv.Words(tv.Texts(part.column("text")), tv.SPACE)
    data = tv.Texts(part.column("text")).bytes
    at, h = words.windows(size)
    h = _short(h, width)
    edges = np.searchsorted(words.row[at], np.arange(part.num_rows + 1))
    doc, known, firsts = part.column("doc").to_pylist(), part.column("h").to_pylist(), part.column("low").to_pylist()
    held, found = [], {}
    for i in range(part.num_rows):
        fh, fl = _unpacked(b"".join(known[i]), width), np.frombuffer(b"".join(firsts[i]), np.int64)
        own = slice(edges[i], edges[i + 1])
        mark = None
        for mine in (True, False):
            some = (fl == doc[i]) == mine
            if not some.any() or own.start == own.stop:
                continue
            order = np.lexsort((fl[some], fh[some]))
            keys, lows = fh[some][order], fl[some][order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (lows[1:] != lows[:-1])
            keys, lows = keys[new], lows[new]
            spot = np.searchsorted(keys, h[own])
            window = np.arange(own.start, own.stop)
            while True:  # once for each of a window's first documents: several where fingerprints meet, or rows of one id
                inside = spot < len(keys)
                window, spot = window[inside], spot[inside]
                hit = keys[spot] == h[window]
                window, spot = window[hit], spot[hit]
                if not len(window):
                    break
                pos, low = at[window], lows[spot]
                for a, b in zip(*(x.tolist() for x in _runs(pos, low, None if mine else PIECE)), strict=True):
                    x, y = int(pos[a]), int(pos[b]) + size
                    text = b" ".join(data[words.start[x] : words.end[y - 1]].tobytes().split())
                    if mine:
                        held.append((doc[i], True, b"", text, b"", b"", b""))
                    else:
                        mark = mark or _mark(part.column("text")[i].as_py())
                        found.setdefault((int(low[a]), text), []).append((doc[i], x - int(words.first[i]), mark))
                spot = spot + 1
    out = held
    for (x, text), places in found.items():
        out.append((x, False, hashlib.md5(text).digest(), text, *(np.array(v, np.int64).tobytes() for v in zip(*places, strict=True))))
    return out


_PASSAGE = "x long, held boolean, digest binary, words binary, docs binary, spots binary, marks binary"


def _mark(text: bytes | None) -> int:
    """Tells rows of one id apart by their texts."""
    return int.from_bytes(hashlib.md5(text or b"").digest()[:8], "little", signed=True)


def _numbered(rows: list[bytes], ids: dict) -> list[tuple[int, ...]]:
    return [tuple(map(ids.__getitem__, r.split(b" "))) for r in rows]


def _automaton(patterns: list[tuple[int, ...]]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    of: dict = {}
    for k, p in enumerate(patterns):
        of.setdefault(p, []).append(k)
    for p, ks in of.items():
        automaton.add_word(p, ks)
    automaton.make_automaton()
    return automaton


def _located(patterns: list[tuple[int, ...]], streamed: list[tuple[int, tuple[int, ...]]]) -> dict[int, int]:
    """The smallest streamed document that holds each pattern, of those that any holds."""
    best: dict[int, int] = {}
    if patterns and streamed:
        automaton = _automaton(patterns)
        for x, text in streamed:
            for _, ks in automaton.iter(text):
                for k in ks:
                    if x < best.get(k, NULLS):
                        best[k] = x
    return best


def _found_in(passages: list[bytes], held: list[tuple[int, bytes]], size: int, least: list[int] | None = None) -> list[tuple[int, int, int, int]]:
    """(passage, first document, from, to): the stretches of passages that the streamed documents hold word for word.

    least: the smallest document that repeats each passage; windows are sought where the passage isn't whole in an earlier one.
    """
    ids: dict = defaultdict(count().__next__)
    patterns = _numbered(passages, ids)
    streamed = list(zip([x for x, _ in held], _numbered([t for _, t in held], ids), strict=True))
    whole = _located(patterns, streamed)
    out = [(k, x, 0, len(patterns[k])) for k, x in whole.items()]
    done = {k for k, x in whole.items() if least is None or x < least[k]}
    rest = [(k, a) for k, p in enumerate(patterns) if k not in done for a in range(len(p) - size + 1)]
    for j, x in _located([patterns[k][a : a + size] for k, a in rest], streamed).items():
        k, a = rest[j]
        out.append((k, x, a, a + size))
    return out


def _disputed(words: bytes, doc: np.ndarray, spot: np.ndarray, mark: np.ndarray, found: list[tuple[int, int, int]], size: int) -> Iterator[tuple]:
    """(documents, marks, word positions, words) of a passage's windows that no document before these holds, of those that streamed."""
    first = np.full(words.count(b" ") + 2 - size, NOWHERE, np.int64)
    for x, a, b in found:
        first[a : b - size + 1] = np.minimum(first[a : b - size + 1], x)
    spelled = None
    for a in np.flatnonzero(first >= doc.min()).tolist():
        spelled = spelled or words.split(b" ")
        some = doc <= first[a]
        yield doc[some], mark[some], spot[some] + a, b" ".join(spelled[a : a + size])


def _places(patterns: dict[bytes, list], held: list[tuple[int, bytes]], size: int) -> pa.RecordBatch:
    """doc, mark, a, b: word spans of located passages in the documents that repeat them, and of disputed windows, with their words."""
    entries = [(words, *(np.frombuffer(b"".join(e), np.int64) for e in columns)) for words, columns in patterns.items()]
    columns = [[np.zeros(0, np.int64)] for _ in range(4)]
    spelled: list[bytes | None] = []
    found = defaultdict(list)

    def tell(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, n: int, words: bytes | None) -> None:
        for column, values in zip(columns, (doc, mark, start, start + n), strict=True):
            column.append(values)
        spelled.extend([words] * len(doc))

    for k, x, a, b in _found_in([e[0] for e in entries], held, size, [int(e[1].min()) for e in entries]):
        _, doc, spot, mark = entries[k]
        found[k].append((x, a, b))
        later = doc > x
        tell(doc[later], mark[later], spot[later] + a, b - a, None)
    for k, entry in enumerate(entries):
        for doc, mark, start, words in _disputed(*entry, found[k], size):
            tell(doc, mark, start, size, words)
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.record_batch([pa.array(np.concatenate(c), kind) for c, kind in zip(columns, kinds, strict=True)] + [pa.array(spelled, pa.binary())], names=["doc", "mark", "a", "b", "words"])


def located_spans(passages: DataFrame, size: int, corpus_bytes: int) -> DataFrame:
    """doc, mark, a, b: the word spans of documents that an earlier document holds word for word."""
    shards = max(1, -(-corpus_bytes // (4 * SHARD_BYTES)))
    heavy = passages.where("not held").groupBy("x").agg(F.ceil(F.sum(F.octet_length("words")) / HEAVY_BYTES).cast("int").alias("fan")).where("fan > 1")
    # a heavy first document has HEAVY_BYTES of passages at least, so there are at most so many of them
    heavy = F.broadcast(heavy) if corpus_bytes // HEAVY_BYTES <= BROADCAST_ROWS else heavy.hint("merge")
    salted = passages.join(heavy, "x", "left").withColumn("fan", F.coalesce("fan", F.lit(1)))
    salts = F.when(F.col("held"), F.sequence(F.lit(0), F.col("fan") - 1)).otherwise(F.array(F.expr("cast(pmod(xxhash64(digest), fan) as int)")))
    dealt = salted.withColumn("salt", F.explode(salts)).withColumn("shard", F.pmod(F.xxhash64("x", "salt"), F.lit(shards))).drop("fan", "salt", "digest")
    n = int(passages.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, patterns, held = None, {}, []
        for batch in batches:
            for part in tv.chunks(batch, "words"):
                columns = [part.column(c).to_pylist() for c in ("shard", "held", "x", "words", "docs", "spots", "marks")]
                for shard, mine, x, words, *places in zip(*columns, strict=True):
                    if shard != now:
                        if patterns:
                            yield _places(patterns, held, size)
                        now, patterns, held = shard, {}, []
                    if mine:
                        held.append((x, words))
                    else:
                        for column, value in zip(patterns.setdefault(words, [[], [], []]), places, strict=True):
                            column.append(value)
        if patterns:
            yield _places(patterns, held, size)

    places = dealt.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(run, "doc long, mark long, a int, b int, words binary")
    # disputed windows meet by their words; located spans stay as they are, by document
    meet = Window.partitionBy("words", F.when(F.col("words").isNull(), F.col("doc")))
    first = F.min("doc").over(meet)
    return places.withColumn("low", first).where(F.col("words").isNull() | ((F.col("low") < F.col("doc")) & (F.col("low") < NULLS))).drop("words", "low")


def _stripped(part: pa.RecordBatch) -> tuple[list[int], list[int], list[bytes]]:
    """Words, removed words and the kept text of each row."""
    words = tv.Words(tv.Texts(part.column("text")), tv.SPACE)
    gone = np.zeros(len(words.h) + 1, np.int64)
    for i, spans in enumerate(part.column("spans").to_pylist()):
        base, mark = int(words.first[i]), spans and _mark(part.column("text")[i].as_py())
        for s in spans or ():
            if s["mark"] == mark:
                gone[base + s["a"]] += 1
                gone[base + s["b"]] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    removed = tv.per_row(~keep, words.first)
    kept = []
    for i, text in enumerate(part.column("text").to_pylist()):
        parts = (text or b"").split()
        kept.append(b" ".join(parts if not removed[i] else compress(parts, keep[words.first[i] : words.first[i + 1]].tolist())))
    return words.count.tolist(), removed.tolist(), kept


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, shard_windows: int = SHARD_WINDOWS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (the kept words, one space between them)."""
    of_null = F.lit(NULLS) + F.xxhash64(F.col(text)).bitwiseAND(F.lit(ROOM - 1))
    own = F.col(doc_id).cast("long")
    gaps = [NULLS - (k << 59) for k in range(16)]
    size, *taken = docs.select(F.sum(F.octet_length(text)), *[F.max(own.between(g, g + ROOM - 1)) for g in gaps]).first()
    size, gap = size or 0, next((g for g, t in zip(gaps, taken, strict=True) if not t), None)
    if gap is None:
        raise ValueError(f"ids leave no room of 2**40 at any of {gaps}")
    moved = own if gap == NULLS else F.when(own >= gap, own - ROOM).otherwise(own)  # ids above the gap close it, so their order stays
    source = docs.select(F.coalesce(moved, of_null).alias("doc"), F.col(text).cast("binary").alias("text"))
    shards = max(MIN_SHARDS, -(-int(size) // (6 * shard_windows)))  # a word takes about six bytes
    width = BITS // 8
    found = _dealt(source, window, shards).groupBy("shard").applyInArrow(_confirmed(width), "doc long, h binary, low binary")
    pairs = found.groupBy("doc").agg(F.collect_list(F.struct("h", "low")).alias("p"))
    per_doc = pairs.select("doc", F.transform("p", lambda x: x["h"]).alias("h"), F.transform("p", lambda x: x["low"]).alias("low"))
    known = source.join(per_doc.hint("merge"), "doc").select("doc", "text", "h", "low")

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.bool_(), *[pa.binary()] * 5]
        for batch in batches:
            for part in tv.chunks(batch, "text"):
                rows = _passages(part, window, width)
                yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["x", "held", "digest", "words", "docs", "spots", "marks"])

    places = located_spans(known.mapInArrow(passages, _PASSAGE), window, int(size))
    spans = places.groupBy("doc").agg(F.collect_set(F.struct("mark", "a", "b")).alias("spans"))
    joined = source.join(spans.hint("merge"), "doc", "left").select("doc", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.chunks(batch, "text"):
                n, removed, kept = _stripped(part)
                doc = part.column("doc").to_numpy()
                none = doc >= NULLS
                ids = np.where(~none & (doc >= gap), doc + ROOM, doc) if gap < NULLS else doc
                yield pa.record_batch(
                    [pa.array(ids, pa.int64(), mask=none), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_words", "n_removed", "kept"],
                )

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary").select(
        "doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text")
    )
