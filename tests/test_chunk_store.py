"""Versions of cached files: which one fits, what a batch reads, compaction, and resuming with files that change."""

import re

from pyspark.sql import functions as F

from texloom.operators import cache, translate
from texloom.plans import jobs
from texloom.sources.chunk_store import ChunkStore, joined_by_bucket

SCHEMA = "paper_id string, rel_path string, content string"
ROWS = "paper_id string, rel_path string, cache_key string, src_hash string, chunks array<string>"
FREE = translate.Pace(retries=2, calls_per_second=0, tasks=2)



def factory():
    def made():
        return lambda texts, prompt: ["译" + t for t in texts]

    return made


def test_of_several_versions_the_one_of_the_files_hash_is_used(spark):
    sources = spark.createDataFrame([("p", "a.tex", "First words. \\cite{a} Second words."), ("p", "b.tex", "Third words.")], SCHEMA)
    done = jobs.translate_corpus(sources, spark.createDataFrame([], ROWS), factory(), pace=FREE, with_glossary=False)
    right = {(r.rel_path, r.merged) for r in done["merged"].collect()}
    stored = done["cache"].collect()
    wrong = [(r.paper_id, r.rel_path, r.cache_key, "0" * 32, ["old version"] * len(r.chunks)) for r in stored]
    short = [(r.paper_id, r.rel_path, r.cache_key, r.src_hash, r.chunks[:-1]) for r in stored]
    cached = spark.createDataFrame(wrong + [tuple(r) for r in stored] + short[:1] * 2 + wrong, ROWS)
    again = jobs.translate_corpus(sources, cached.where("size(chunks) > 0"), factory(), pace=FREE, with_glossary=False)
    merged = [(r.rel_path, r.merged) for r in again["merged"].collect()]
    assert len(merged) == 2 and {p for p, _ in merged} == {"a.tex", "b.tex"}
    # a row of the right hash with too few chunks is older than one with all of them, so it hides nothing
    assert dict(merged)["b.tex"] == dict(right)["b.tex"]


def test_fitting_takes_the_last_version_and_comparing_prefers_the_hash(spark):
    files = spark.createDataFrame([("p", "a", "h2", "k", 2), ("p", "b", "h9", "k", 1)], "paper_id string, rel_path string, src_hash string, cache_key string, n_chunks long")
    rows = [("p", "a", "h1", ["x", "y"], 1), ("p", "a", "h2", ["u", "v"], 2), ("p", "a", "h2", ["w", "z"], 3), ("p", "a", "h3", ["n", "m"], 4), ("p", "b", "h7", ["o"], 1), ("p", "b", "h8", ["q"], 5)]
    cached = spark.createDataFrame(rows, "paper_id string, rel_path string, src_hash string, chunks array<string>, version long")
    assert [(r.rel_path, r.chunks) for r in cache.fitting(files, cached).collect()] == [("a", ["w", "z"])]
    assert {(r.rel_path, tuple(r.chunks)) for r in cache.comparable(files, cached).collect()} == {("a", ("w", "z")), ("b", ("q",))}
    assert {(r.rel_path, r.hash_differs) for r in cache.stale(files, cached).collect()} == {("a", True), ("b", True)}


def test_retranslating_touches_the_compared_version_alone(spark):
    text = "This is a rather long plain English sentence, which nobody has translated yet."
    sources = spark.createDataFrame([("p", "f", text)], SCHEMA)
    right = sources.select(F.md5(F.col("content").cast("binary"))).first()[0]
    cached = spark.createDataFrame([("p", "f", "k", "h", [text]), ("p", "f", "k", right, [text])], ROWS)
    got = {r.src_hash: r.chunks for r in jobs.retranslate(sources, cached, factory(), FREE).collect()}
    assert got == {"h": [text], right: ["译" + text]}


def rows(spark, version, papers, text):
    return spark.createDataFrame([(p, "a.tex", "k", f"h{version}", [f"{text}{p}"]) for p in papers], ROWS)


def test_store_keeps_versions_and_a_repeated_one_replaces_itself(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), buckets=8)
    store.put(rows(spark, 0, "pqr", "a"), 0)
    store.put(rows(spark, 1, "pq", "b"), 1)
    store.put(rows(spark, 1, "p", "c"), 1)
    again = ChunkStore(spark, str(tmp_path / "s"))
    assert again.buckets == 8
    assert {(r.paper_id, r.version, r.chunks[0]) for r in again.read().collect()} == {("p", 0, "ap"), ("q", 0, "aq"), ("r", 0, "ar"), ("p", 1, "cp")}
    assert {(r.paper_id, r.chunks[0]) for r in again.newest().collect()} == {("p", "cp"), ("q", "aq"), ("r", "ar")}
    assert {r.version for r in again.read(before=1).collect()} == {0}
    store.put(rows(spark, 2, [], ""), 1)  # a repeat without rows leaves none of the first try
    assert {r.version for r in again.read().collect()} == {0}


def test_a_catalog_that_has_forgotten_the_table_finds_it_again(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), buckets=4)
    store.put(rows(spark, 0, "pq", "a"), 7)
    spark.sql(f"drop table {store._table(spark, 0)}")
    assert {(r.paper_id, r.version) for r in ChunkStore(spark, str(tmp_path / "s")).read().collect()} == {("p", 7), ("q", 7)}


def test_compaction_keeps_the_last_versions_and_old_generations_go(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), buckets=4)
    for v in range(4):
        store.put(rows(spark, v, "pq" if v < 2 else "p", "x"), v)
    assert store.compact(keep=2) == 4
    assert {(r.paper_id, r.version) for r in store.read().collect()} == {("p", 3), ("p", 2), ("q", 1), ("q", 0)}
    assert store.compact() == 2 and store.compact() == 2
    assert not (tmp_path / "s" / "rows-1").exists() and (tmp_path / "s" / "rows-2").exists()
    store.put(rows(spark, 9, "q", "y"), 9)
    assert {(r.paper_id, r.version) for r in ChunkStore(spark, str(tmp_path / "s")).newest().collect()} == {("p", 3), ("q", 9)}


def test_a_batch_reads_its_own_buckets_and_joins_without_a_shuffle_of_the_store(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), buckets=16)
    store.put(rows(spark, 0, [f"p{n}" for n in range(200)], "a"), 0)
    wanted = spark.createDataFrame([("p3",), ("p4",)], "paper_id string")
    plan = store.read(wanted).groupBy("paper_id").count()._jdf.queryExecution().executedPlan().toString()
    chosen = int(re.search(r"SelectedBucketsCount: (\d+) out of 16", plan)[1])
    assert 1 <= chosen <= 2
    files = spark.range(200).select(F.concat(F.lit("p"), "id").alias("paper_id"), F.lit("a.tex").alias("rel_path"), F.lit("h0").alias("src_hash"), F.lit("k").alias("cache_key"), F.lit(1).cast("long").alias("n_chunks"))
    with joined_by_bucket(spark):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            fit = cache.fitting(files, store.read())
            plan = fit._jdf.queryExecution().executedPlan().toString()
            assert fit.count() == 200
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # from the join down to the scan of the store no exchange stands
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line and "texloom_chunks" in line)
    depth = lambda line: len(re.match(r"[\s:+\-|]*", line)[0])
    above, at = [], depth(lines[scan])
    for line in reversed(lines[:scan]):
        if depth(line) < at:
            above.append(line)
            at = depth(line)
    assert any("Join" in line for line in above) and not any("Exchange" in line for line in above), plan


def test_a_file_that_changes_is_merged_in_its_last_version(spark, tmp_path):
    texts = {1: "First plain words.", 2: "Second plain words. More of them."}

    def come(number):
        spark.createDataFrame([("p", "a.tex", texts[number])], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        calls = []
        jobs.resume(stream, str(tmp_path / "store"), factory(), str(tmp_path / "check"), pace=FREE, with_glossary=False, compact_every=2)
        merged = spark.read.parquet(str(tmp_path / "store" / "merged"))
        last = merged.agg(F.max("batch")).first()[0]
        return [r.merged for r in merged.where(F.col("batch") == last).collect()], calls

    for number in (1, 2, 2, 1):
        got, _ = come(number)
        assert got == ["译" + texts[number]]
    store = ChunkStore(spark, str(tmp_path / "store" / "cache"))
    assert store.generation == 2 and {r.rel_path for r in store.read().collect()} == {"a.tex"}


def test_two_versions_in_one_batch_count_once(spark, tmp_path):
    schema = SCHEMA + ", version long"
    rows_ = [("p", "a.tex", "Second words here.", 2), ("p", "a.tex", "First words here.", 1), ("p", "b.tex", "Other words here.", 1)]
    spark.createDataFrame(rows_, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    jobs.resume(stream, str(tmp_path / "store"), factory(), str(tmp_path / "check"), pace=FREE, with_glossary=False)
    merged = spark.read.parquet(str(tmp_path / "store" / "merged"))
    assert sorted((r.rel_path, r.merged) for r in merged.collect()) == [("a.tex", "译Second words here."), ("b.tex", "译Other words here.")]
    plain = spark.createDataFrame([r[:3] for r in rows_], SCHEMA)
    assert jobs.last_versions(plain).count() == 2
