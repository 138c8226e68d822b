"""Substring dedup on bytes with a run-length index: what an earlier document holds goes, byte by byte.

A byte goes if a string of 50 bytes that covers it also starts in a document of smaller id.

0. Copies. Of equal texts (by MD5) only that of smallest id goes on; the others are covered whole.
1. Anchors. Of the 31 places of 20 bytes inside any 50 bytes, those of smallest fingerprint are anchors. Equal strings
   have equal anchors, so a repeat shows in an anchor that two documents hold. Tasks deal their anchors out by shard, one
   document for each anchor and chunk, and shards tell which recur; what recurs inside a chunk is told at once.
2. Contexts. The bytes around a recurring anchor, 30 before it to 50 after its start, hold every string of 50 bytes
   with it. A task sends a context on once, from its smallest document; later documents of the task with the same
   context are covered then and there. So a passage in a third of all rows is one row for each task.
3. Run-length indexes. Contexts meet by anchor. One that equals the one of smallest document is covered by it. Where others
   differ, the first goes into a run-length index (see `run_index`), through which they stream: matching statistics of 50 or more, at a place whose
   earliest holder is a smaller document, mark bytes. Contexts with strings that no first context holds
   are indexed once more, among themselves; there each knows its own place. An index holds whole anchors and some `INDEX_BYTES`
   of text; an anchor with more than `HEAVY_BYTES` of contexts gives out their strings of 50 bytes instead, those of later
   documents only where it hasn't met the string lately, so no task holds more than that.
4. Strings meet by their bytes, the smallest document first; spans meet by document and are merged. Merged spans go
   back to their texts by id.

Equal fingerprints only bring contexts together; bytes go by matches in the index alone, or where contexts
are equal byte by byte. Texts are shuffled once, by id.

Defined cases: null and empty texts, and those of fewer than 50 bytes, lose nothing; rows of one doc_id are not earlier
than each other; a null doc_id counts as later than every other, and none of them as earlier than another; ids are
integers below 2**63 - 2**40 (other types raise an error); texts may be strings or binary; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texloom.llm import textvec as tv
from texloom.llm.run_index import RunIndex
from texloom.llm.store import written
from texloom.llm.substring_dedup import BROADCAST_ROWS, NULLS, _by_doc, _by_shard, _confirmed, _short, _unpacked

LENGTH = 50
GRAM = 20
REACH = LENGTH - GRAM  # bytes before and behind an anchor that a string with it can hold
CHUNK = 4 << 20
PIECE = 1 << 18
SHARD_ANCHORS = 3_000_000
MIN_SHARDS = 32
INDEX_BYTES = 1 << 19
HEAVY_BYTES = 5 << 18  # with INDEX_BYTES and terminators below MAX_SYMBOLS
WIDTH = 4  # bytes of an anchor's fingerprint beside its shard: about one anchor in a thousand is told without need
KNOWN = 100_000  # contexts, or strings of one anchor, that a task remembers


def _slid(x: np.ndarray, size: int, pick: np.ufunc) -> np.ndarray:
    """Least or greatest of every `size` neighbours."""
    done = 1
    while 2 * done <= size:
        x = pick(x[:-done], x[done:])
        done *= 2
    rest = size - done
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(texts: tv.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and fingerprint of the anchors of some texts, by place."""
    n = len(texts.bytes)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total, down = tv._sums(tv.BYTE_VALUE[texts.bytes], "byte")
    h = tv.mixed((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    order = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    least = _slid(order, REACH + 1, np.minimum)  # of each string of 50 bytes
    sizes = np.diff(texts.offsets)
    inside = np.repeat(texts.offsets[1:] - LENGTH, sizes)[: len(least)] >= np.arange(len(least))
    # an anchor is the least of a string: the greatest least of all strings around it is its own value
    least = np.where(inside, least, 0)
    pad = np.zeros(REACH, np.uint32)
    most = _slid(np.concatenate([pad, least, pad]), REACH + 1, np.maximum)
    place = np.flatnonzero((order == most) & (most > 0))
    return texts.row_of(place), place, h[place]


def _dealt(docs: DataFrame, shards: int) -> DataFrame:
    """The first document of each anchor and chunk by shard, and the documents of anchors that recur inside a chunk (shard < 0)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.chunks(batch, "text", CHUNK):
                doc, found, base = part.column("doc").to_numpy(), [], 0
                for piece in tv.chunks(part, "text", PIECE):
                    row, _, h = anchors(tv.Texts(piece.column("text")))
                    found.append((doc[base + row], h))
                    base += piece.num_rows
                d, h = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
                if not len(h):
                    continue
                order = np.lexsort((d, h))
                h, d = h[order], d[order]
                first = np.ones(len(h), bool)
                first[1:] = h[1:] != h[:-1]
                starts = np.flatnonzero(first)
                group = np.cumsum(first) - 1
                low, high = d[starts][group], d[np.concatenate([starts[1:], [len(h)]]) - 1][group]
                new = first.copy()
                new[1:] |= d[1:] != d[:-1]
                told = new & (low < high) & (low < NULLS)
                out = [_by_shard(h[first], d[first], shards, WIDTH), _by_doc(h[told], d[told], low[told], max(64, shards), WIDTH)]
                yield pa.record_batch(
                    [pa.array(np.concatenate([o[0] for o in out]), pa.int32())] + [pa.array(out[0][k] + out[1][k], pa.binary()) for k in (1, 2, 3)],
                    names=["shard", "h", "doc", "n"],
                )

    return docs.mapInArrow(run, "shard int, h binary, doc binary, n binary")


#: h and context: a context to judge, found at `a`; without a context: a covered span from `a` to `h`.
_CONTEXTS = "h long, context binary, doc long, tid int, a int"


def _recurring(part: pa.RecordBatch, texts: tv.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of the texts that are told for their documents."""
    row, place, h = anchors(texts)
    keys, good = _short(h, WIDTH), np.zeros(len(h), bool)
    edges = np.searchsorted(row, np.arange(part.num_rows + 1))
    for i, known in enumerate(part.column("h").to_pylist()):
        own = slice(edges[i], edges[i + 1])
        if own.start < own.stop:
            told = np.sort(_unpacked(b"".join(known), WIDTH))
            good[own] = told[np.minimum(np.searchsorted(told, keys[own]), len(told) - 1)] == keys[own]
    return row[good], place[good], h[good]


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts to judge, and the spans of those that an earlier document of the task holds."""
    seen: dict[tuple[int, bytes], int] = {}
    for batch in batches:
        for part in tv.chunks(batch, "text", PIECE):
            texts = tv.Texts(part.column("text"))
            row, place, h = _recurring(part, texts)
            begin, end = texts.offsets[row], texts.offsets[row + 1]
            low, high = np.maximum(place - REACH, begin), np.minimum(place + LENGTH, end)
            data, doc, tid = texts.bytes.tobytes(), part.column("doc").to_pylist(), part.column("tid").to_pylist()
            out: list[tuple] = []
            open_row, span = -1, [0, 0]
            for r, key, a, b, base in zip(row.tolist(), h.view(np.int64).tolist(), low.tolist(), high.tolist(), begin.tolist(), strict=True):
                context, mine = data[a:b], doc[r]
                known = seen.get((key, context))
                if known is not None and known < mine and known < NULLS:
                    if r == open_row and a - base <= span[1]:
                        span[1] = b - base
                    else:
                        if open_row >= 0:
                            out.append((span[1], None, doc[open_row], tid[open_row], span[0]))
                        open_row, span = r, [a - base, b - base]
                    continue
                seen[key, context] = mine
                out.append((key, context, mine, tid[r], a - base))
            if open_row >= 0:
                out.append((span[1], None, doc[open_row], tid[open_row], span[0]))
            if len(seen) > KNOWN:
                seen.clear()
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["h", "context", "doc", "tid", "a"])


#: A span [a, b) of a text, as `a` and `b` in one number; or, with a string, one of 50 bytes at `a` that is still to be judged.
_MARKS = "doc long, tid int, span long, string binary"


class _Block:
    """Contexts of whole anchors: the first of each, and all others."""

    def __init__(self):
        self.same: list[tuple] = []  # spans of contexts that equal their anchor's first
        self.firsts: list[tuple[bytes, int]] = []  # of anchors with other contexts
        self.rows: list[tuple[int, bytes, int, int, int]] = []  # anchor, context, doc, tid, place
        self.bytes = 0

    def add(self, rows: list[tuple[int, bytes, int, int, int]]) -> None:
        """The rows of one anchor, by document; one row alone repeats nothing."""
        if len(rows) > 1:
            _, first, low, _, _ = rows[0]
            others = [r for r in rows if r[1] != first]
            if low < NULLS:
                self.same += [(d, t, a, a + len(c), None) for _, c, d, t, a in rows[1:] if d > low and c == first]
            if others:
                self.firsts.append((first, low))
                self.rows += others
                self.bytes += len(first) + sum(len(r[1]) for r in others)

    def judged(self) -> Iterator[tuple]:
        """Spans that earlier documents cover."""
        yield from self.same
        if not self.rows:
            return
        index = RunIndex([c for c, _ in self.firsts], np.array([d for _, d in self.firsts], np.int64), LENGTH)
        rest, spans = _covered(index, self.rows)
        yield from spans
        groups: dict[int, list] = {}
        for r in rest:
            groups.setdefault(r[0], []).append(r)
        among = [r for g in groups.values() if len(g) > 1 for r in g]
        low: dict[bytes, int] = {}
        for _, c, d, _, _ in among:
            low[c] = min(d, low.get(c, d))
        if low:
            yield from _covered(RunIndex(list(low), np.array(list(low.values()), np.int64), LENGTH), among, {c: k for k, c in enumerate(low)})[1]


def _covered(index: RunIndex, rows: list[tuple[int, bytes, int, int, int]], held: dict[bytes, int] | None = None) -> tuple[list[tuple], list[tuple]]:
    """Rows of which a string isn't covered, and the spans that earlier documents cover. `held`: numbers of the rows' contexts in the index."""
    number: dict[bytes, int] = {} if held is None else held
    if held is None:
        for r in rows:
            number.setdefault(r[1], len(number))
        length, place, ends = index.statistics(list(number))
        hit = length >= LENGTH
        earliest = np.full(len(length), NULLS)
        earliest[hit] = index.earliest(place[hit])
    else:
        ends = index.ends
    begin = np.concatenate([[0], ends[:-1] + 1])
    which = np.array([number[r[1]] for r in rows], np.int64)
    doc, at = np.array([r[2] for r in rows], np.int64), np.array([r[4] for r in rows], np.int64)
    n = ends[which] - begin[which] - LENGTH + 1  # strings of each row
    own = np.repeat(np.arange(len(rows)), n)
    step = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    string = begin[which][own] + step
    low = index.earliest(string) if held is not None else earliest[string]
    good = (low < doc[own]) & (low < NULLS)
    whole = np.bincount(own, ~good, minlength=len(rows)) == 0
    start = good.copy()
    start[1:] &= ~good[:-1] | (own[1:] != own[:-1])
    stop = good.copy()
    stop[:-1] &= ~good[1:] | (own[1:] != own[:-1])
    spans = [(rows[i][2], rows[i][3], a, b, None) for i, a, b in zip(own[start].tolist(), (at[own] + step)[start].tolist(), ((at[own] + step)[stop] + LENGTH).tolist(), strict=True)]
    return [rows[i] for i in np.flatnonzero(~whole).tolist()], spans


def _marks(found: list[tuple]) -> pa.RecordBatch:
    doc, tid, a, b, string = zip(*found, strict=True) if found else [()] * 5
    span = (np.array(a, np.int64) << 32) + np.array(b, np.int64)
    return pa.record_batch([pa.array(doc, pa.int64()), pa.array(tid, pa.int32()), pa.array(span), pa.array(string, pa.binary())], names=["doc", "tid", "span", "string"])


def _strings(context: bytes, doc: int, tid: int, at: int, met: dict[bytes, int]) -> Iterator[tuple]:
    """The strings of a context, or the span where one was met in a smaller document."""
    if len(met) > KNOWN:
        met.clear()
    for k in range(len(context) - LENGTH + 1):
        string = context[k : k + LENGTH]
        low = met.setdefault(string, doc)
        yield doc, tid, at + k, at + k + LENGTH, None if low < doc and low < NULLS else string


def _judge(heavy_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spans from contexts, which come by anchor, those of one anchor by document."""
        block, now, held, heavy, met = _Block(), None, [], False, {}  # held: rows of the anchor at hand
        for batch in batches:
            for part in tv.chunks(batch, "context", 1 << 18):
                columns = [part.column(c).to_pylist() for c in ("h", "context", "doc", "tid", "a")]
                passed: list[tuple] = []
                for h, context, doc, tid, a in zip(*columns, strict=True):
                    if context is None:
                        passed.append((doc, tid, a, h, None))
                        continue
                    if h != now:
                        if not heavy:
                            block.add(held)
                        if block.bytes > INDEX_BYTES:
                            yield _marks(list(block.judged()))
                            block = _Block()
                        now, held, size, heavy, met = h, [], 0, False, {}
                    size += len(context)
                    held.append((h, context, doc, tid, a))
                    if heavy or size > heavy_bytes:
                        heavy = True
                        passed += [s for _, c, d, t, at in held for s in _strings(c, d, t, at, met)]
                        held = []
                yield _marks(passed)
        if not heavy:
            block.add(held)
        yield _marks(list(block.judged()))
        tv.release()

    return run


def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged spans (doc, tid, span). Marks come by string, those of one string by document; spans come first, by text."""
    string, low = None, NULLS
    for batch in batches:
        spans = batch.filter(pc.is_null(batch.column("string")))
        if spans.num_rows:
            doc, tid, span = (spans.column(k).to_numpy() for k in ("doc", "tid", "span"))
            other = np.ones(len(doc), bool)
            other[1:] = (doc[1:] != doc[:-1]) | (tid[1:] != tid[:-1])
            text = np.cumsum(other) << 32  # ends of later texts are greater
            a, b = span >> 32, span & 0xFFFFFFFF
            reach = np.maximum.accumulate(b + text)
            new = other.copy()
            new[1:] |= (a + text)[1:] > reach[:-1]
            starts = np.flatnonzero(new)
            ends = np.concatenate([starts[1:], [len(a)]]) - 1
            merged = (a[starts] << 32) + (reach[ends] - text[ends])
            yield pa.record_batch([pa.array(doc[starts]), pa.array(tid[starts]), pa.array(merged)], names=["doc", "tid", "span"])
        late = []
        for s, d, t, x in zip(*(batch.filter(pc.is_valid(batch.column("string"))).column(k).to_pylist() for k in ("string", "doc", "tid", "span")), strict=True):
            if s != string:
                string, low = s, d
            elif low < d and low < NULLS:
                late.append((d, t, x))
        if late:
            kinds = [pa.int64(), pa.int32(), pa.int64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*late, strict=True), kinds, strict=True)], names=["doc", "tid", "span"])


def _stripped(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Bytes, removed bytes, removed runs and the kept bytes of each row."""
    texts = tv.Texts(part.column("text"))
    change = np.zeros(len(texts.bytes) + 1, np.int64)
    spans = part.column("spans")
    row = np.repeat(np.arange(part.num_rows), pc.list_value_length(spans).fill_null(0).to_numpy(zero_copy_only=False))
    tid, span = (spans.flatten().field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    mine = tid == part.column("tid").to_numpy()[row]
    row, span = row[mine], span[mine]
    np.add.at(change, texts.offsets[row] + (span >> 32), 1)
    np.add.at(change, texts.offsets[row] + (span & 0xFFFFFFFF), -1)
    gone = np.cumsum(change[:-1]) > 0
    starts = gone.copy()
    starts[1:] &= ~gone[:-1]
    starts[texts.offsets[:-1][np.diff(texts.offsets) > 0]] |= gone[texts.offsets[:-1][np.diff(texts.offsets) > 0]]
    kept_before = np.concatenate([[0], np.cumsum(~gone)])[texts.offsets]
    kept = texts.bytes[~gone].tobytes()
    return np.diff(texts.offsets), tv.per_row(gone, texts.offsets), tv.per_row(starts, texts.offsets), [kept[a:b] for a, b in zip(kept_before[:-1], kept_before[1:], strict=True)]


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shard_anchors: int = SHARD_ANCHORS, heavy_bytes: int = HEAVY_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay)."""
    kind = docs.schema[doc_id].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{doc_id} is {kind}; ids must be integers")
    of_null = F.lit(NULLS) + F.xxhash64(F.col(text)).bitwiseAND(F.lit((1 << 40) - 1))
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    tid = F.xxhash64(body).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")  # tells the texts of one id apart
    source = docs.select(F.coalesce(F.col(doc_id).cast("long"), of_null).alias("doc"), tid.alias("tid"), body.alias("text"))
    size = docs.select(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(MIN_SHARDS, -(-int(size) // (13 * shard_anchors)))  # an anchor for about 13 bytes

    long = source.where(F.octet_length("text") >= LENGTH).select("doc", "tid", F.unhex(F.md5("text")).alias("digest"), F.octet_length("text").alias("b"))
    first = long.groupBy("digest").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where((F.col("low") < F.col("high")) & (F.col("low") < NULLS))
    copies = written(long.join(first.hint("merge"), "digest").where("doc > low").select("doc", "tid", F.col("b").cast("long").alias("span")).distinct(), "byte-copies")
    ids = copies.select("doc", "tid")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids.hint("merge")

    told = _dealt(source.join(ids, ["doc", "tid"], "left_anti"), shards).groupBy("shard").applyInArrow(_confirmed(WIDTH), "doc long, h binary, low binary")
    per_doc = told.groupBy("doc").agg(F.collect_list("h").alias("h"))
    known = source.join(per_doc.hint("merge"), "doc").select("doc", "tid", "text", "h")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = known.mapInArrow(contexts, _CONTEXTS)
    # covered spans need no company: they are dealt by document
    met = found.repartition(n, F.when(F.col("context").isNull(), F.xxhash64("doc", "a")).otherwise(F.col("h"))).sortWithinPartitions("h", "doc")
    marks = met.mapInArrow(_judge(heavy_bytes), _MARKS)
    dealt = marks.repartition(n, F.when(F.col("string").isNull(), F.xxhash64("doc")).otherwise(F.xxhash64("string")))
    found = dealt.sortWithinPartitions("string", "doc", "tid", "span").mapInArrow(settled, "doc long, tid int, span long")
    spans = found.unionByName(copies)
    # all in one job, so that texts are shuffled once; spans are dealt before they are grouped: narrow rows travel, not lists
    per_text = spans.repartition(n, "doc").groupBy("doc").agg(F.collect_list(F.struct("tid", "span")).alias("spans"))
    joined = source.join(per_text.hint("merge"), "doc", "left").select("doc", "tid", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.chunks(batch, "text"):
                total, removed, runs, kept = _stripped(part)
                ids = part.column("doc").to_numpy()
                yield pa.record_batch(
                    [pa.array(ids, pa.int64(), mask=ids >= NULLS), pa.array(total), pa.array(removed), pa.array(runs), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
