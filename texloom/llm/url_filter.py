"""URL filters: lists of host and path rules held as Bloom filter cascades.

A rule `host/path` fits its host and all subdomains where the URL's path starts with its own.
A URL's keys are its host suffixes joined with its path prefixes, of just the sizes that occur
in the rules. The keys of all URLs are the complete key universe. Level 0 of a cascade encodes
the listed keys, level 1 the universe's false positives there, level 2 the listed keys that
level 1 takes for false positives, and so on until nothing is left over. Then a key of the
universe is listed exactly if the first level that lacks it is odd: membership without a join
and without the list.

Levels are built by distributed aggregation of their bits. A cascade is broadcast only while
its bits stay below `MAX_BITS`; longer lists are dealt out to several cascades by hash, each
below the bound, which are broadcast and probed one after the other.

The longest fitting rule decides; a rule on both lists blocks. A URL that no rule fits is
allowed.

Defined cases: a null URL, and one without `://`, has an empty host and path and fits no
rule; hosts keep ports and user names; repeated rows are judged one by one; a universe or a
list may be empty; other columns are ignored.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from texloom.llm.store import written
from texloom.llm.textvec import mixed

BITS_PER_KEY = 10
HASHES = 5
MAX_LEVELS = 64  # each level holds the false positives of the one before, a small share of them; beyond this an error is raised
MAX_BITS = 1 << 28


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_keys(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Host suffixes of so many labels, each with the path's prefixes of so many characters."""
    n = F.size(F.split(host, r"\."))
    hosts = F.array_compact(F.array(*[F.when((n >= k) & (host != ""), F.substring_index(host, ".", -k)) for k in labels]))
    paths = F.array_compact(F.array(*[F.when(F.length(path) >= k, F.left(path, F.lit(k))) for k in lengths]))
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))


def _positions(h: np.ndarray, level: int, bits: int) -> np.ndarray:
    """The bits of each key hash at a level, one row for each hash function."""
    a = mixed(h ^ mixed(np.array([level + 1], np.uint64)))
    b = mixed(a) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) % np.uint64(bits) for i in range(HASHES)])


@dataclass
class Cascade:
    """Levels of (number of bits, words of 64 bits)."""

    levels: list[tuple[int, np.ndarray]] = field(default_factory=list)

    def passes(self, h: np.ndarray, level: int) -> np.ndarray:
        bits, words = self.levels[level]
        p = _positions(h, level, bits)
        return ((words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1)).astype(bool).all(axis=0)

    def listed(self, h: np.ndarray) -> np.ndarray:
        """Exact membership for key hashes of the universe."""
        depth = np.full(len(h), len(self.levels))
        for i in reversed(range(len(self.levels))):
            depth[~self.passes(h, i)] = i
        return depth % 2 == 1


def _filtered(keys: DataFrame, levels: list, level: int) -> DataFrame:
    """Keys (h) that pass the level."""
    shared = keys.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = Cascade(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(cascade.passes(batch.column("h").to_numpy().view(np.uint64), level)))

    return keys.mapInArrow(run, "h long")


def _level(keys: DataFrame, level: int, n: int) -> tuple[int, np.ndarray]:
    """Bits of a level, or-ed together by word before they come to the driver (bounded by MAX_BITS)."""
    bits = max(64, -(-n * BITS_PER_KEY // 64) * 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.unique(_positions(batch.column("h").to_numpy().view(np.uint64), level, bits))
            word, first = np.unique(p >> np.uint64(6), return_index=True)
            masks = np.bitwise_or.reduceat(np.uint64(1) << (p & np.uint64(63)), first) if len(p) else p
            yield pa.record_batch([pa.array(word.astype(np.int64)), pa.array(masks.view(np.int64))], names=["word", "mask"])

    words = np.zeros(bits // 64, np.uint64)
    rows = keys.mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    words[rows["word"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
    return bits, words


def build_cascades(listed: DataFrame, universe: DataFrame, max_bits: int = MAX_BITS) -> list[Cascade]:
    """Cascades for the keys (column `key`) of `listed`, exact over those keys and `universe`; one for each shard of keys by hash."""
    h = F.xxhash64("key").alias("h")
    both = universe.select(h, F.lit(0).alias("own")).unionByName(listed.select(h, F.lit(1).alias("own")))
    keys = written(both.where("h is not null").groupBy("h").agg(F.max("own").alias("own")), "url-keys")
    n = keys.where("own = 1").count()
    shards = max(1, math.ceil(n * BITS_PER_KEY * 2 / max_bits))
    out = []
    for s in range(shards):
        part = keys.where(F.pmod("h", F.lit(shards)) == s) if shards > 1 else keys
        inside, outside = part.where("own = 1").select("h"), part.where("own = 0").select("h")
        cascade = Cascade()
        while size := inside.count():
            level = len(cascade.levels)
            if level == MAX_LEVELS:
                raise ArithmeticError(f"{size} keys can't be told apart by {MAX_LEVELS} levels")
            cascade.levels.append(_level(inside, level, size))
            inside, outside = written(_filtered(outside, cascade.levels, level), "url-level"), inside
        out.append(cascade)
    return out


def mark_listed(df: DataFrame, keys: str, to: str, cascades: list[Cascade]) -> DataFrame:
    """`df` with an array column `to`: the positions of listed keys in the array column `keys`."""
    shards = len(cascades)
    out = df.withColumn("_h", F.transform(keys, lambda k: F.xxhash64(k))).withColumn(to, F.expr("cast(array() as array<int>)"))
    schema = out.schema
    for s, cascade in enumerate(cascades):
        shared = df.sparkSession.sparkContext.broadcast(cascade.levels)

        def run(batches, s=s, shared=shared):
            own = Cascade(shared.value)
            for batch in batches:
                lists = batch.column("_h")
                h = lists.flatten().to_numpy()
                sizes = np.diff(lists.offsets.to_numpy())
                hit = own.listed(h.view(np.uint64)) & (np.mod(h, shards) == s) if own.levels else np.zeros(len(h), bool)
                row = np.repeat(np.arange(len(sizes)), sizes)
                nth = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                found = [list(x or ()) for x in batch.column(to).to_pylist()]
                for r, k in zip(row[hit].tolist(), nth[hit].tolist(), strict=True):
                    found[r].append(k)
                yield batch.set_column(batch.schema.get_field_index(to), to, pa.array(found, pa.list_(pa.int32())))

        out = out.mapInArrow(run, schema)
    return out.drop("_h")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], *, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict for every row; rules are (allow or block, `host/path`)."""
    spark: SparkSession = pages.sparkSession
    df = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    split = [r.partition("/") for _, r in rules]
    labels = sorted({h.count(".") + 1 for h, _, _ in split})
    lengths = sorted({len(s + p) for _, s, p in split})
    keyed = df.withColumn("_keys", url_keys(F.col("host"), F.col("path"), labels, lengths) if rules else F.expr("cast(array() as array<string>)"))
    universe = keyed.select(F.explode("_keys").alias("key")).distinct()
    for kind in ("allow", "block"):
        own = spark.createDataFrame([(r,) for k, r in rules if k == kind], "key string")
        keyed = mark_listed(keyed, "_keys", f"_{kind}", build_cascades(own, universe))
    hits = _hits()
    best = F.get(hits, F.lit(0))
    return keyed.select("page_id", "host", "path", best["rule"].alias("rule"), F.coalesce(best["verdict"], F.lit("allow")).alias("verdict"))


def _hits() -> Column:
    """Listed keys, the longest first; a block before an allow of the same key."""
    hit = lambda order, verdict: lambda i: F.struct(
        (-F.length(F.get("_keys", i))).alias("n"), F.lit(order).alias("o"), F.get("_keys", i).alias("rule"), F.lit(verdict).alias("verdict")
    )
    return F.array_sort(F.concat(F.transform("_block", hit(0, "block")), F.transform("_allow", hit(1, "allow"))))
