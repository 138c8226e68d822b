"""Queries without SQL, held against plain Python on the smallest tables: chunks, the segment report, translation with a cache."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from texloom.functions import latex as lx
from texloom.operators import merge, segment
from texloom.plans import catalog
from texloom.plans import fixtures as fx

SF = "/root/testdata/sf0.001"
KEY = ["paper_id", "rel_path"]


def pieces(text, limit):
    """Chunks of a text: units of the coarsest separator in it, packed while they fit; what is too long is cut again."""
    room = 3 * limit + 2
    if len(text) <= room:
        return [text]
    sep = next((s for s in ("\n\n", "\n", ". ", "。") if s in text), None)
    if sep is None:
        return [text[i : i + 3 * limit] for i in range(0, len(text), 3 * limit)]
    parts = text.split(sep)
    units = [p + sep for p in parts[:-1]] + [parts[-1]] * (parts[-1] != "")
    if len(units) == 1:
        inner = pieces(text[: -len(sep)], limit)
        return [*inner[:-1], inner[-1] + sep]
    cuts, now, at = [], "", 0
    for u in units:
        at += len(u)
        bare = len(now + u) - (0 if at == len(text) and not text.endswith(sep) else len(sep))
        # a separator at the very end of the text counts
        bare = len(now + u) if at == len(text) else bare
        if now and bare > room:
            cuts.append(now)
            now = u
        else:
            now += u
    cuts.append(now)
    return cuts if all(len(c) - len(sep) <= room for c in cuts) else [p for c in cuts for p in pieces(c, limit)]


def test_pieces_of_random_texts():
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice(["a", "bc ", ". ", "\n", "\n\n", "。", "dddddd"]) for _ in range(rng.randint(0, 60)))
        limit = rng.randint(1, 9)
        assert segment.split_text(text, limit) == pieces(text, limit), (text, limit)


def _nodes(spark):
    found = defaultdict(list)
    for r in segment.nodes(fx.sources(spark, SF)).orderBy(*KEY, "node_idx").collect():
        found[r.paper_id, r.rel_path].append(r)
    return found


def test_chunks_of_whole_sources(spark):
    got = Counter((r.paper_id, r.rel_path, r.chunk_idx, r.owner_t_idx, r.text) for r in catalog.QUERIES["chunks_split"](spark, SF).collect())
    want = Counter()
    for file, nodes in _nodes(spark).items():
        own = [(n.t_idx, p) for n in nodes if not n.preserve for p in pieces(n.text, 100)]
        want.update((*file, i, t, p) for i, (t, p) in enumerate(own))
    assert got == want and len(want) > 1000


def test_report_of_whole_sources(spark):
    got = {(r.paper_id, r.rel_path): (r.n_nodes, r.n_translatable, r.n_display_math, r.n_chunks) for r in catalog.QUERIES["segment_report"](spark, SF).collect()}
    want = {}
    for file, nodes in _nodes(spark).items():
        own = [n.text for n in nodes if not n.preserve]
        want[file] = (len(nodes), len(own), sum("$$" in t or "\\[" in t for t in own), sum(len(pieces(t, 1024)) for t in own))
    assert got == want


def test_a_cache_of_several_versions_gives_the_right_files(spark):
    sources = fx.sources(spark, SF)
    old = {(r.paper_id, r.rel_path) for r in sources.where(F.pmod(F.xxhash64(*KEY), F.lit(2)) == 0).collect()}
    rows = [(*file, n.t_idx, "".join(("旧" if file in old else "译") + p for p in pieces(n.text, 1024))) for file, nodes in _nodes(spark).items() for n in nodes if not n.preserve]
    done = spark.createDataFrame(rows, "paper_id long, rel_path string, t_idx int, translated string")
    whole = merge.merged_files(merge.finished_nodes(segment.nodes(sources), done))
    whole = whole.withColumn("merged", F.when(F.col("rel_path") == "main.tex", lx.with_cjk_preamble("merged")).otherwise(F.col("merged")))
    want = {(r.paper_id, r.rel_path): r.merged for r in whole.collect()}
    got = {(r.paper_id, r.rel_path): r.merged for r in catalog.QUERIES["translated_with_cache"](spark, SF).collect()}
    assert got == want and 0 < len(old) < len(want)
