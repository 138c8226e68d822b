"""Translation of whole corpora with files as rows: what is shuffled and held, and that rows and tables of nodes agree."""

import os

import pytest
from pyspark.sql import functions as F

from texloom.operators import cache, merge, segment
from texloom.plans import catalog
from texloom.plans import fixtures as fx
from texloom.plans.held import shared_dir

KEY = ["paper_id", "rel_path"]
SF = "/root/testdata/sf0.001"


def held_bytes(spark):
    top = f"{shared_dir(spark).removeprefix('file://')}/texloom"
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(top) for f in names if f.endswith(".parquet"))


@pytest.mark.parametrize("name", ["translated_corpus", "translated_with_cache"])
def test_a_translated_corpus_takes_few_copies_of_its_texts(spark, name):
    sf = "/root/testdata/sf0.01"
    before = held_bytes(spark)
    merged = catalog.QUERIES[name](spark, sf)
    # the files with their nodes once, and once more with their translations
    assert held_bytes(spark) - before < 3 * os.path.getsize(f"{sf}/documents.parquet")
    assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()


def test_file_rows_hold_the_nodes_and_chunks(spark):
    rows = segment.file_rows(fx.sources(spark, SF), 100).persist()
    nodes = segment.nodes(fx.sources(spark, SF))
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))
    assert same(segment.explode_nodes(segment.with_texts(rows)).fillna(-1), nodes.fillna(-1))
    chunks = segment.chunks(nodes, 100)
    assert same(segment.chunk_rows(rows), chunks)
    assert same(cache.file_keys(fx.sources(spark, SF), chunks).drop("cache_key"), rows)
    # every third chunk failed; some files have none that did
    done = lambda t, i: F.when(i % 3 != 2, F.concat(F.lit("译 50% a_b "), t))
    by_row = rows.withColumn("translated", F.transform(segment.chunks_of(), done))
    by_chunk = chunks.withColumn("translated", done(F.col("text"), F.col("chunk_idx")))
    assert same(cache.rows_to_store(by_row), cache.to_store(cache.file_keys(fx.sources(spark, SF), chunks), by_chunk))
    whole = merge.node_translations(by_chunk.withColumn("final", F.coalesce("translated", "text")))
    finished = merge.finished_nodes(nodes, whole)
    assert same(merge.finished_rows(by_row).fillna(-1).fillna(""), finished.fillna(-1).fillna(""))
    assert same(merge.merged_rows(by_row).select(*KEY, "merged"), merge.merged_files(finished))


def test_the_last_cached_version_of_a_hash_counts_if_it_fits(spark):
    file = "paper_id string, rel_path string, src_hash string, n_chunks long"
    files = spark.createDataFrame([("p", "a", "h", 2), ("p", "b", "h", 2), ("p", "c", "h", 1), ("p", "d", None, 0)], file)
    rows = [("p", "a", "h", ["x", "y"], 1), ("p", "a", "h", ["u", "v"], 2), ("p", "a", "g", ["q", "r"], 3), ("p", "b", "h", ["x"], 1), ("q", "c", "h", ["z"], 1)]
    cached = spark.createDataFrame(rows, "paper_id string, rel_path string, src_hash string, chunks array<string>, version long")
    assert {r.rel_path: r.cached for r in cache.with_cached(files, cached).collect()} == {"a": ["u", "v"], "b": None, "c": None, "d": None}
