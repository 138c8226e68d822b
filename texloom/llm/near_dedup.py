"""Near-duplicate documents by MinHash with a signature-coordinate inverted join.

A document's set is its distinct 5-word shingles. Its signature holds `COORDINATES` minima
under as many hash functions. Documents are linked when their sets' Jaccard similarity
reaches a threshold; linked documents form a component.

1. Equal sets become one class (pre-aggregated by a 128-bit set digest): copies are counted,
   never paired.
2. Each class is posted under its (coordinate, value) tokens. Two similar classes agree on at
   least m coordinates (see `matches_needed`), so they share a token among the
   COORDINATES - m + 1 rarest tokens of each: only this prefix is joined, and the long lists are skipped; there
   signatures are compared in place.
3. Per list, the smallest class is the centre; the others are compared with it only. Pairs
   with enough matches are verified on the full sets, and verified links merge components.
   Then the centre, with all its pairs done, leaves the list, and lists whose rest lies in one
   component are finished: two documents that are linked by way of others needn't be paired.
4. In lists that still span components after `STAR_ROUNDS`, all pairs between components are
   judged inside one task, by signature and then on the full sets, in blocks of `BLOCK` classes;
   only links leave the task. So every pair that could still join two components is judged, and
   no list of pairs is ever made.

A link at the threshold has too few matches with a chance below `MISS`, a closer one far less
often; all links that pass are exact.

Defined cases: null and empty texts have an empty set and are linked with nothing; texts of
fewer than five words are one shingle; rows of one doc_id are one node, which links whatever any of its texts links; a null doc_id gets a
null component and is kept; other columns are ignored or pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texloom.llm import textvec as tv
from texloom.llm.store import written

SHINGLE = 5
COORDINATES = 32
MISS = 1e-6
STAR_ROUNDS = 1
BLOCK = 512
BROADCAST_ROWS = 400_000
FANOUT = 256
HEAVY = 256  # classes of a token in one part of the join with token counts

_XOR = tv.mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_ODD = tv.mixed(np.arange(101, COORDINATES + 101, dtype=np.uint64)) | np.uint64(1)


def matches_needed(threshold: int) -> int:
    """The most coordinates that a pair at the threshold misses with a chance below MISS."""
    p, tail = threshold / 100, 0.0
    for m in range(COORDINATES):
        tail += comb(COORDINATES, m) * p**m * (1 - p) ** (COORDINATES - m)
        if tail >= MISS:
            return m
    return COORDINATES


def shingles(part: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Row and fingerprint of the distinct shingles of each text, rows ascending."""
    words = tv.Words(tv.Texts(part.column(column)), tv.SPACE_LOWER)
    at, h = words.windows(SHINGLE)
    row = words.row[at]
    short = np.flatnonzero((words.count > 0) & (words.count < SHINGLE))
    if len(short):
        row = np.concatenate([row, short])
        h = np.concatenate([h, words.spans(words.first[short], words.first[short + 1])])
        order = np.argsort(row, kind="stable")
        row, h = row[order], h[order]
    new = ~tv.repeats(row, h)[0]
    return row[new], h[new]


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, digest of the set (d1, d2) and sig array<int>; null sig for empty sets."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.chunks(batch, "text"):
                row, h = shingles(part)
                n = np.bincount(row, minlength=part.num_rows)
                some = np.flatnonzero(n)
                starts = np.concatenate([[0], np.cumsum(n[some])[:-1]]).astype(np.int64)
                d = np.zeros((2, part.num_rows), np.uint64)
                sig = np.zeros((len(some), COORDINATES), np.uint32)
                if len(some):
                    d[0, some] = np.add.reduceat(tv.mixed(h), starts)
                    d[1, some] = np.add.reduceat(tv.mixed(h ^ np.uint64(0x5851F42D4C957F2D)), starts)
                    for k in range(COORDINATES):
                        sig[:, k] = np.minimum.reduceat(((h ^ _XOR[k]) * _ODD[k]) >> np.uint64(32), starts)
                sizes = np.where(n > 0, COORDINATES, 0)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(sig.reshape(-1).view(np.int32))
                )
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(d[0].view(np.int64)), pa.array(d[1].view(np.int64)), lists],
                    names=["doc_id", "n_shingles", "d1", "d2", "sig"],
                )

    return source.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, sig array<int>")


def _prefixes(classes: DataFrame, matches: int) -> DataFrame:
    """token, rep: the rarest tokens of each class that another class has too."""
    tokens = classes.select("rep", F.posexplode("sig").alias("k", "v")).select(
        "rep", (F.shiftleft(F.col("k").cast("long"), 32) + F.col("v").cast("long").bitwiseAND(0xFFFFFFFF)).alias("token")
    )
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = written(shared.withColumn("fan", F.expr(f"cast(df div {HEAVY} + 1 as int)")), "near-counts")
    # a token of very many classes is joined in several parts
    heavy = shared.where("fan > 1").select("token", "fan")
    heavy = F.broadcast(heavy) if heavy.count() <= BROADCAST_ROWS else heavy.hint("merge")
    dealt = tokens.join(heavy, "token", "left").select("token", "rep", F.expr("if(fan is null, 0, cast(pmod(xxhash64(rep), fan) as int))").alias("salt"))
    parts = shared.select("token", "df", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("salt"))
    lists = dealt.join(parts, ["token", "salt"]).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    # tokens that no other class has come first in the order of rarity and use up the prefix
    take = F.greatest(F.lit(0), F.size("t") - F.lit(matches - 1))
    return lists.select("rep", F.explode(F.slice("t", 1, take)).alias("t")).select("t.token", "rep")


def _with_signatures(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) whose signatures match often enough and whose sizes allow the threshold."""
    side = lambda s: classes.select(F.col("rep").alias(s), F.col("sig").alias(f"s{s}"), F.col("n_shingles").alias(f"n{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda z: z))
    sizes = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * threshold
    return both.where(sizes & (same >= matches_needed(threshold))).select("a", "b")


def _verified(pairs: DataFrame, source: DataFrame, threshold: int) -> DataFrame:
    """Pairs whose full sets reach the threshold. Texts travel to the pair's task, once for each
    centre (and again for every `FANOUT` of its partners) and once for each pair."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / FANOUT).cast("int").alias("m"))
    keyed = pairs.join(salts, "a").select("a", "b", F.expr("cast(pmod(xxhash64(b), m) as int)").alias("salt"))
    routes = keyed.select("a", "salt", F.col("b").alias("id"), F.lit(1).alias("role")).unionByName(
        keyed.select("a", "salt").distinct().select("a", "salt", F.col("a").alias("id"), F.lit(0).alias("role"))
    )
    routes = written(routes, "near-routes")
    if routes.count() <= BROADCAST_ROWS:
        routes = F.broadcast(routes)
    rows = source.join(routes, source["doc_id"] == routes["id"]).select("a", "salt", "role", "id", "text")
    n = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "a", "salt").sortWithinPartitions("a", "salt", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centres = None, []
        for batch in batches:
            for part in tv.chunks(batch, "text"):
                row, h = shingles(part)
                cut = np.searchsorted(row, np.arange(part.num_rows + 1))
                keys = zip(part.column("a").to_pylist(), part.column("salt").to_pylist(), strict=True)
                found = []
                for i, (key, role, b) in enumerate(zip(keys, part.column("role").to_pylist(), part.column("id").to_pylist(), strict=True)):
                    own = np.sort(h[cut[i] : cut[i + 1]])
                    if key != at:
                        at, centres = key, []
                    if role == 0:
                        centres.append(own)
                        continue
                    for c in centres:
                        inter = len(np.intersect1d(c, own, assume_unique=True))
                        if 100 * inter >= threshold * (len(c) + len(own) - inter) and inter:
                            found.append((key[0], b))
                            break
                yield pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node reachable) for all nodes of `edges` (a, b), by contraction.

    Each round every node hooks on to its smallest neighbour or itself, the trees are flattened by
    pointer jumping, and the edges between their roots are the next round's edges, until none is
    left. A root that no neighbour hooked on to has a smaller neighbour in the next round, so the
    roots of a component halve in two rounds: rounds and jumps grow with the logarithm of its
    size, however ids lie along a chain.
    """
    ends = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = None
    both = written(ends.distinct(), "near-edges")
    while labels is None or not both.isEmpty():
        tops = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("top")), "near-hooks")
        while True:
            jump = tops.select(F.col("node").alias("mid"), F.col("top").alias("far"))
            moved = written(tops.join(jump, tops["top"] == jump["mid"]).select("node", F.col("far").alias("top"), F.col("top").alias("was")), "near-tops")
            tops = moved.select("node", "top")
            if moved.where("top < was").isEmpty():
                break
        if labels is None:
            labels = tops.select("node", F.col("top").alias("comp"))
        else:
            of = tops.select(F.col("node").alias("root"), "top")
            labels = written(labels.join(of, labels["comp"] == of["root"], "left").select("node", F.coalesce("top", "comp").alias("comp")), "near-labels")
        side = lambda s: tops.select(F.col("node").alias(s), F.col("top").alias(f"top_{s}"))
        raised = both.join(side("a"), "a").join(side("b"), "b").where("top_a != top_b")
        both = written(raised.select(F.col("top_a").alias("a"), F.col("top_b").alias("b")).distinct(), "near-edges")
    return labels


def _block_links(lists: DataFrame, classes: DataFrame, source: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) between components within lists: every pair of a list is judged in one task, by
    signature first and then on the full sets, and only links leave it, one for each class and component.

    A list of more than `BLOCK` classes is dealt out by pairs of blocks. A pair that shares several
    lists is judged in that of its smallest common token.
    """
    sized = lists.join(lists.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb")), "token")
    own = sized.withColumn("blk", F.expr("cast(pmod(xxhash64(rep), nb) as int)"))
    # a class meets every block pair that its block is part of
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "token", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "rep", "comp"
    )
    tokens = lists.groupBy("rep").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    ids = tokens.select("rep")
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    texts = source.join(ids, source["doc_id"] == ids["rep"]).select("rep", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.chunks(batch, "text"):
                row, h = shingles(part)
                cut = np.searchsorted(row, np.arange(part.num_rows + 1))
                data = [np.sort(h[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
                d1 = np.array([tv.mixed(x).sum(dtype=np.uint64) for x in data], np.uint64).view(np.int64)
                yield pa.record_batch([part.column("rep"), pa.array(d1), pa.array([x.tobytes() for x in data], pa.binary())], names=["rep", "d1", "hashes"])

    own_sets = texts.mapInArrow(sets, "rep long, d1 long, hashes binary").dropDuplicates(["rep", "d1"])
    about = own_sets.join(classes.select("rep", "d1", "sig"), ["rep", "d1"]).join(tokens, "rep").drop("d1")
    n, least = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), matches_needed(threshold)
    dealt = spread.join(written(about, "near-sets"), "rep").repartition(n, "token", "i", "j").sortWithinPartitions("token", "i", "j")

    def links_of(t: pa.Table) -> Iterator[tuple[int, int]]:
        rep, comp, blk = (t.column(c).to_numpy() for c in ("rep", "comp", "blk"))
        token, i, j = (t.column(c)[0].as_py() for c in ("token", "i", "j"))
        sig = np.array(t.column("sig").to_pylist(), np.int32)
        known, own = t.column("tokens").to_pylist(), [np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()]
        size = np.array([len(x) for x in own])
        left, right = np.flatnonzero(blk == i), np.flatnonzero(blk == j)
        for x in left:
            y = right[(comp[right] != comp[x]) & ((rep[right] > rep[x]) | (i != j))]
            y = y[np.minimum(size[y], size[x]) * 100 >= np.maximum(size[y], size[x]) * threshold]
            y = y[(sig[y] == sig[x]).sum(axis=1) >= least]
            mine, joined = set(known[x]), set()
            for k in y.tolist():
                if comp[k] in joined or min(mine.intersection(known[k])) != token:
                    continue
                at = np.minimum(np.searchsorted(own[x], own[k]), size[x] - 1)
                inter = int((own[x][at] == own[k]).sum())
                if 100 * inter >= threshold * (size[x] + size[k] - inter):
                    joined.add(comp[k])
                    yield int(rep[x]), int(rep[k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def done(table: pa.Table) -> pa.RecordBatch:
            key = np.stack([table.column(c).to_numpy() for c in ("token", "i", "j")])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), table.num_rows]
            found = [p for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1 for p in links_of(table.slice(a, b - a))]
            return pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                table = pa.Table.from_batches([batch.slice(at, BLOCK)])
                table = table if rest is None else pa.concat_tables([rest, table])
                key = np.stack([table.column(c).to_numpy() for c in ("token", "i", "j")])
                last = int(np.flatnonzero((key == key[:, -1:]).all(axis=0))[0])  # the last group may go on
                if last:
                    yield done(table.slice(0, last))
                rest = table.slice(last)
        if rest is not None:
            yield done(rest)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _labelled(lists: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.select(F.col("node").alias("rep"), F.col("comp").alias("label"))
    return lists.join(known, "rep", "left").select("token", "rep", F.coalesce("label", "rep").alias("comp"))


def link(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. `threshold` in hundredths."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    sigs = written(signatures(docs, doc_id, text), "near-sigs")
    digest = ["d1", "d2", "n_shingles"]
    classes = written(
        sigs.where("n_shingles > 0 and doc_id is not null").groupBy(*digest).agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "near-classes"
    )
    lists = written(_prefixes(classes, matches_needed(threshold)), "near-lists").withColumn("comp", F.col("rep"))
    labels = tested = edges = None
    # an id whose rows hold different sets is one node, so it links their classes
    several = sigs.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*digest)).alias("x"), F.max(F.struct(*digest)).alias("y")).where("x != y")
    several = written(several.select("doc_id"), "near-several")
    if not several.isEmpty():
        tied = sigs.join(several, "doc_id").join(classes.select(*digest, "rep"), digest)
        edges = written(tied.where("rep != doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct(), "near-tied")
        labels = components(edges)
        lists = _labelled(lists, labels)
    for round_ in range(STAR_ROUNDS + 1):
        span = lists.groupBy("token").agg(F.min("rep").alias("centre"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        open_lists = written(lists.join(span.where("lo < hi").select("token", "centre"), "token"), "near-open")
        if open_lists.isEmpty():
            break
        if round_ == STAR_ROUNDS:
            new = written(_block_links(open_lists.select("token", "rep", "comp"), classes, source, threshold), "near-links")
            lists = open_lists.limit(0).select("token", "rep", "comp")
        else:
            centres = open_lists.where("rep = centre").select("token", F.col("comp").alias("own"))
            pairs = open_lists.where("rep > centre").join(centres, "token").where("comp != own").select(F.col("centre").alias("a"), F.col("rep").alias("b"))
            pairs = _with_signatures(pairs.distinct(), classes, threshold)
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = written(pairs, "near-pairs")
            tested = pairs if tested is None else tested.unionByName(pairs)
            new = written(_verified(pairs, source, threshold), "near-links")
            lists = open_lists.where("rep > centre").select("token", "rep", "comp")
        if not new.isEmpty():
            edges = new if edges is None else edges.unionByName(new)
            labels = components(edges)
            lists = _labelled(lists, labels)
    of = classes.select(*digest, "rep")
    out = sigs.select("doc_id", *digest).join(of, digest, "left")
    if labels is not None:
        out = out.join(labels.select(F.col("node").alias("rep"), "comp"), "rep", "left")
    else:
        out = out.withColumn("comp", F.lit(None).cast("long"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def drop_near_duplicates(docs: DataFrame, *, threshold: int = 80) -> DataFrame:
    """`docs` without the documents of each component but the one of smallest id."""
    gone = written(link(docs, threshold=threshold).where("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "near-gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone.hint("merge")
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
