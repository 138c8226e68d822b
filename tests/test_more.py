"""Jobs and operators that work across runs: stores, writers, resuming, pacing, reconciling."""

import time

import pytest
from pyspark.sql import functions as F

from texloom.operators import cache, nodes, segment, terms, translate
from texloom.plans import jobs
from texloom.plans.held import held
from texloom.sources import latex as src
from texloom.sources.chunk_store import ChunkStore
from texloom.streaming import progress

SCHEMA = "paper_id string, rel_path string, content string"
CACHE = "paper_id string, rel_path string, cache_key string, src_hash string, chunks array<string>"
FREE = translate.Pace(retries=1, calls_per_second=0, tasks=2)
BODY = "\\documentclass{article}\n\\begin{document}\nThe old words, GPT-Net, GPT-Net, GPT-Net, GPT-Net, ends.\n\\end{document}\n"


def test_glossaries_are_used_again(spark):
    def with_prompt():
        """Answers glossary questions (bare terms) and shows whether the prompt names a term."""
        return lambda texts, prompt: ["\n".join(f"{t} => 网" for t in x.split("\n")) if x == "GPT-Net" else ("译G" if "GPT-Net → 网" in prompt else "译") + x for x in texts]

    sources = spark.createDataFrame([("p", "main.tex", BODY)], SCHEMA)
    empty = spark.createDataFrame([], CACHE)
    first = jobs.translate_corpus(sources, empty, with_prompt, pace=FREE)
    store = held(first["glossary"], "store")
    assert [(r.term, r.target) for r in store.collect()] == [("GPT-Net", "网")]
    assert "译GThe old" in first["merged"].first().merged

    def silent():
        return lambda texts, prompt: [None if x == "GPT-Net" else ("译G" if "GPT-Net → 网" in prompt else "译") + x for x in texts]

    again = jobs.translate_corpus(sources, empty, silent, glossaries=store, pace=FREE)
    assert again["glossary"].count() == 0 and "译GThe old" in again["merged"].first().merged
    changed = jobs.translate_corpus(sources.withColumn("content", F.replace("content", F.lit("ends"), F.lit("stops"))), empty, silent, glossaries=store, pace=FREE)
    assert "译The old" in changed["merged"].first().merged


def test_half_full_cache_and_small_chunks(spark):
    long = "\n\n".join(f"Sentence number {i} of the text with words." for i in range(30))
    sources = spark.createDataFrame([("p", "a.tex", long), ("p", "b.tex", long + " end")], SCHEMA)
    rows = segment.chunks(segment.nodes(sources), 40)
    stored = cache.to_store(cache.file_keys(sources, rows), rows.withColumn("translated", F.concat(F.lit("旧"), "text"))).where("rel_path = 'a.tex'")
    out = jobs.translate_corpus(sources, stored, lambda: lambda texts, p: ["译" + t for t in texts], max_tokens=40, pace=FREE, with_glossary=False)
    merged = {r.rel_path: r.merged for r in out["merged"].collect()}
    n = rows.where("rel_path = 'a.tex'").count()
    assert n > 5 and merged["a.tex"].count("旧") == n and merged["a.tex"].replace("旧", "") == long
    assert "旧" not in merged["b.tex"] and merged["b.tex"].replace("译", "") == long + " end"
    assert {r.rel_path for r in out["results"].collect()} == {"b.tex"}


def test_merged_files_are_written_and_sources_kept(spark, tmp_path):
    root = tmp_path / "papers" / "2024" / "papers"
    (root / "p1" / "sec").mkdir(parents=True)
    (root / "p1" / "main.tex").write_text("one")
    (root / "p1" / "sec" / "a.tex").write_text("two")
    for text in ("译一", "译二"):
        sources = held(src.read_sources(spark, f"file://{root}"), "sources")
        assert {(r.paper_id, r.rel_path, r.content) for r in sources.collect()} == {("p1", "main.tex", "one"), ("p1", "sec/a.tex", "two")}
        assert src.write_merged(sources.select("paper_id", "rel_path", F.lit(text).alias("merged")), sources, f"file://{root}") == 2
        assert (root / "p1" / "sec" / "a.tex").read_text() == text and (root / "p1" / "sec" / "a.tex.orig").read_text() == "two"
    assert not list(root.rglob("*.part"))


def test_cache_files_feed_the_hit_join(spark, tmp_path):
    sources = spark.createDataFrame([("p", "a.tex", "Some plain words here.")], SCHEMA)
    files = cache.file_keys(sources, segment.chunks(segment.nodes(sources)))
    h = files.first().src_hash
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "k.chunks.json").write_text('{"tex": "a.tex", "src_hash": "%s", "chunks": ["x"]}' % h)
    (tmp_path / "p" / "bad.chunks.json").write_text("{")
    stored = cache.read_json(spark, str(tmp_path))
    assert [(r.paper_id, r.rel_path, r.chunks) for r in stored.where("rel_path is not null").collect()] == [("p", "a.tex", ["x"])]
    assert cache.hits(files, stored).count() == 1 and cache.misses(files, stored).count() == 0


def test_resume_tries_open_files_again(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(factory):
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        jobs.resume(stream, str(tmp_path / "store"), factory, str(tmp_path / "check"), pace=FREE, with_glossary=False)

    def read(kind):
        if kind == "cache":
            return {(r.version, r.rel_path) for r in ChunkStore(spark, str(tmp_path / "store" / "cache")).read().collect()}
        rows = spark.read.parquet(str(tmp_path / "store" / kind))
        return {(r.batch, r.rel_path) for r in rows.collect()}

    write([("p", "a.tex", "First plain words."), ("p", "b.tex", "Second broken words.")])
    run(lambda: lambda texts, p: [None if "broken" in t else "译" + t for t in texts])
    assert read("cache") == {(0, "a.tex")} and read("open") == {(0, "b.tex")}
    write([("p", "c.tex", "Third plain words.")])
    run(lambda: lambda texts, p: ["译" + t for t in texts])
    assert read("cache") == {(0, "a.tex"), (1, "b.tex"), (1, "c.tex")} and {x for x in read("open") if x[0] == 1} == set()


def test_registry_usage_and_pace(spark):
    translate.register("upper", lambda: lambda texts, p: [t.upper() for t in texts])
    assert translate.get("upper")()(["a"], "") == ["A"]
    with pytest.raises(KeyError, match="upper"):
        translate.get("none")
    rows = spark.createDataFrame([("p", "f", 0, "x" * 30, "y" * 9), ("p", "f", 1, "x" * 3, None)], "paper_id string, rel_path string, chunk_idx int, text string, translated string")
    assert tuple(translate.usage(rows).first()) == ("p", 2, 11, 3)
    last, calls = [-1e9], []
    start = time.monotonic()
    for _ in range(4):
        translate._called(lambda texts, p: calls.append(1) or texts, ["a"], "", translate.Pace(calls_per_second=20, tasks=2), last)
    assert len(calls) == 4 and time.monotonic() - start >= 0.29


def test_prompts_reach_their_paper_and_glossaries_are_built(spark):
    rows = spark.createDataFrame([("p", "f", 0, "plain words"), ("q", "f", 0, "plain words")], "paper_id string, rel_path string, chunk_idx int, text string")
    prompts = spark.createDataFrame([("p", " more")], "paper_id string, prompt string")
    got = translate.translate(rows, lambda: lambda texts, p: [f"译{p}" for _ in texts], prompt="base", prompts=prompts, pace=FREE)
    assert {(r.paper_id, r.translated) for r in got.collect()} == {("p", "译base more"), ("q", "译base")}
    top = spark.createDataFrame([("p", 2, "B"), ("p", 1, "A"), ("q", 1, "C")], "paper_id string, rank int, term string")
    made = translate.build_glossary(top, lambda: lambda texts, p: [None if "C" in t else "A => 甲\nB → 乙" for t in texts], pace=FREE)
    assert {tuple(r) for r in made.collect()} == {("p", 1, "A", "甲"), ("p", 2, "B", "乙")}
    assert terms.glossary_prompts(made).first().prompt.endswith("- A → 甲\n- B → 乙")


def test_external_tasks_are_added(spark):
    schema = "task_id string, status string, stage string, message string, error string, translated_pdf string, bilingual_pdf string, original_pdf string, workdir string"
    row = lambda t, s, d: (t, s, s, "", None, None, None, None, d)
    known = spark.createDataFrame([row("a", "failed", "/a"), row("b", "running", "/b")], schema)
    external = spark.createDataFrame([row("a", "done", "/x"), row("c", "done", "/c")], schema)
    files = spark.createDataFrame([("/a", "p_cn.pdf"), ("/b", "p_cn.pdf"), ("/c", "p_cn.pdf")], "workdir string, file_name string")
    got = {r.task_id: r for r in jobs.reconcile_tasks(known, external, files).collect()}
    assert {k: (r.status, r.translated_pdf, r.changed) for k, r in got.items()} == {"a": ("done", "/a/output/p_cn.pdf", True), "b": ("running", None, False), "c": ("done", "/c/output/p_cn.pdf", True)}


def test_snapshot_then_updates(spark):
    s = spark.createDataFrame([("a", "done"), ("b", "merging")], "task_id string, stage string")
    u = spark.createDataFrame([("a", "queued"), ("b", "done"), ("c", "queued")], "task_id string, stage string")
    assert sorted(map(tuple, progress.snapshot_then_updates(s, u).collect())) == [("a", "done"), ("b", "done"), ("b", "merging"), ("c", "queued")]


def test_line_depths_and_dropped_cache(spark):
    lines = spark.createDataFrame([("p", "f", i, t) for i, t in enumerate(["a{", "{b", "}}}", "c\\{", "d"])], "paper_id string, rel_path string, node_idx int, text string")
    assert [r.depth_before for r in nodes.line_depths(lines).orderBy("node_idx").collect()] == [0, 1, 2, 0, 0]
    rows = spark.createDataFrame([("p", "a", "k", "h", ["x"]), ("p", "b", "k", "h", ["x"])], CACHE)
    assert [r.rel_path for r in cache.without(rows, "a").collect()] == ["b"] and cache.without(rows).count() == 0


def test_author_commands_and_open_environments():
    open_text = lambda t: [x for x, protected in segment.runs_of(t) if not protected]
    assert open_text("a \\author{Ann {B}} b \\thanks  {x} c \\author*{D}") == ["a ", " b ", " c \\author*{D}"]
    assert open_text("\\begin{abstract}We show $x$ in \\cite{k}.\\end{abstract}") == ["We show ", " in ", "."]
    assert open_text("\\begin{align*}a\\end{align*}b\\begin{align}c\\end{align*}") == ["b", "c"]
    laid = [(0, 10, False), (2, 6, True), (3, 4, False), (5, 8, False)]
    assert list(segment.visible(12, laid)) == [(0, 2, False), (2, 3, True), (3, 4, False), (4, 5, True), (5, 10, False), (10, 12, True)]
