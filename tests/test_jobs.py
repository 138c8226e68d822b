import io
import tarfile
import zipfile

from pyspark.sql import functions as F

from texloom.operators import cache, terms, translate
from texloom.plans import jobs
from texloom.sources import latex as src
from texloom.streaming import progress

SCHEMA = "paper_id string, rel_path string, content string"
CACHE = "paper_id string, rel_path string, cache_key string, src_hash string, chunks array<string>"
FREE = translate.Pace(retries=2, calls_per_second=0, tasks=2)


def made():
    def upper():  # nested, so that workers get it by value
        return lambda texts, prompt: ["译" + t for t in texts]

    return upper


upper = made()


def corpus(spark):
    body = "\\documentclass{article}\n\\begin{document}\nHello brave world of things. \\cite{a}\n\nMore plain words $x$ here.\n\\end{document}\n"
    return spark.createDataFrame([("p", "main.tex", body), ("p", "sec/a.tex", "Part of words \\ref{x} end text"), ("q", "main.tex", body.replace("Hello", "Another"))], SCHEMA)


def test_translate_then_full_cache(spark):
    empty = spark.createDataFrame([], CACHE)
    out = jobs.translate_corpus(corpus(spark), empty, upper, pace=FREE)
    merged = {(r.paper_id, r.rel_path): r.merged for r in out["merged"].collect()}
    assert merged["p", "sec/a.tex"] == "译Part of words \\ref{x} 译end text"
    assert "\\usepackage[UTF8]{ctex}" in merged["p", "main.tex"] and "译Hello brave world of things." in merged["p", "main.tex"]
    stats = {r.paper_id: r for r in out["stats"].collect()}
    assert all(r.total == r.translated + r.preserved for r in stats.values())
    stored = out["cache"].persist()
    again = jobs.translate_corpus(corpus(spark), stored, upper, pace=FREE)
    assert again["results"].count() == 0
    assert {(r.paper_id, r.rel_path): r.merged for r in again["merged"].collect()} == merged


def test_failed_chunks_keep_their_text_and_stay_out_of_the_cache(spark):
    def factory():
        return lambda texts, prompt: [None if "words" in t else "译" + t for t in texts]

    out = jobs.translate_corpus(corpus(spark), spark.createDataFrame([], CACHE), factory, pace=FREE, with_glossary=False)
    merged = {(r.paper_id, r.rel_path): r.merged for r in out["merged"].collect()}
    assert merged["p", "sec/a.tex"] == "Part of words \\ref{x} 译end text"
    assert out["cache"].count() == 0


def test_nudge_retry_and_blank(spark):
    def factory():
        return lambda texts, prompt: ["好" if "\n\n" in t else t for t in texts]

    rows = spark.createDataFrame([("p", "f", 0, "plain words"), ("p", "f", 1, "  "), ("p", "f", 2, "\\x 12")], "paper_id string, rel_path string, chunk_idx int, text string")
    got = {r.chunk_idx: r.translated for r in translate.translate(rows, factory, pace=FREE).collect()}
    assert got == {0: "好", 1: "  ", 2: "\\x 12"}


def test_errors_are_retried_and_bounded(spark):
    def factory():
        calls = []

        def call(texts, prompt):
            calls.append(1)
            if len(calls) == 1:
                raise RuntimeError("once")
            return ["好" for _ in texts]

        return call

    rows = spark.createDataFrame([("p", "f", 0, "plain words")], "paper_id string, rel_path string, chunk_idx int, text string")
    assert translate.translate(rows, factory, pace=FREE).first().translated == "好"
    broken = translate.translate(rows, lambda: lambda t, p: 1 / 0, pace=FREE)
    assert broken.first().translated is None


def test_surgical_update_keeps_old_where_new_is_null(spark):
    old = spark.createDataFrame([("p", "f", "k", "h", ["a", "b", "c"])], CACHE)
    new = spark.createDataFrame([("p", "f", 1, "B"), ("p", "f", 2, None)], "paper_id string, rel_path string, chunk_idx int, translated string")
    assert cache.replaced(old, new).first().chunks == ["a", "B", "c"]


def test_retranslate(spark):
    text = "This is a rather long plain English sentence, which nobody has translated yet."
    sources = spark.createDataFrame([("p", "f", text)], SCHEMA)
    cached = spark.createDataFrame([("p", "f", "k", "h", [text])], CACHE)
    assert jobs.retranslate(sources, cached, upper, FREE).first().chunks == ["译" + text]


def test_repair_rounds_stop(spark):
    nodes = jobs.segment.nodes(corpus(spark)).persist()
    done = nodes.where("not preserve").select("paper_id", "rel_path", "t_idx", F.lit("译文").alias("translated"))
    logs = spark.createDataFrame([("p", "main", "main.tex:1: bad\nl.3 x")], "paper_id string, stem string, log_text string")
    merged = {(r.paper_id, r.rel_path): r.merged for r in jobs.repair_rounds(nodes, done, lambda _: logs).collect()}
    assert "Hello brave" in merged["p", "main.tex"] and "译文" in merged["q", "main.tex"]


def test_term_filters(spark):
    words = ["GPT", "A1", "iPhone", "state-of", "the Model", "Model the", "Graph Net", "graph net", "X"]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    assert {r.t for r in df.where(terms.is_term(F.col("t"))).collect()} == {"GPT", "A1", "iPhone", "state-of", "Graph Net"}


def test_glossary_lines(spark):
    answers = spark.createDataFrame([("p", "- A => 甲\nB → 乙\nzzz => x\nA =>\nb => 丙")], "paper_id string, answer string")
    candidates = spark.createDataFrame([("p", "A", 1), ("p", "B", 2)], "paper_id string, term string, rank int")
    assert {(r.term, r.target) for r in terms.parse_glossary(answers, candidates).collect()} == {("A", "甲"), ("B", "丙")}


def test_sources_and_bundles(spark, tmp_path):
    root = tmp_path / "papers"
    (root / "p1" / "sec").mkdir(parents=True)
    (root / "p1" / "paper_cn").mkdir()
    (root / "p1" / "main.tex").write_bytes("héllo\r\nx".encode())
    (root / "p1" / "sec" / "a.tex").write_bytes("h\xe9llo\rx".encode("latin-1"))
    (root / "p1" / "paper_cn" / "b.tex").write_bytes(b"no")
    rows = sorted((r.paper_id, r.rel_path, r.content) for r in src.read_sources(spark, str(root)).collect())
    assert rows == [("p1", "main.tex", "héllo\nx"), ("p1", "sec/a.tex", "héllo\nx")]

    bundles = tmp_path / "bundles"
    bundles.mkdir()
    with zipfile.ZipFile(bundles / "z.zip", "w") as z:
        z.writestr("in/main.tex", "Z")
        z.writestr("../evil.tex", "E")
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as t:
        info = tarfile.TarInfo("main.tex")
        info.size = 1
        t.addfile(info, io.BytesIO(b"T"))
    (bundles / "t.tar.gz").write_bytes(buffer.getvalue())
    (bundles / "bad.zip").write_bytes(b"nothing")
    good, bad = src.read_bundles(spark, str(bundles))
    rooted = src.main_root(good)
    assert {(r.paper_id, r.rel_path, r.content) for r in rooted.collect()} == {("z", "main.tex", "Z"), ("t", "main.tex", "T")}
    assert [r.bundle.rsplit("/", 1)[1] for r in bad.collect()] == ["bad.zip"]


def test_progress_stream_in_batches(spark, tmp_path):
    schema = "task_id string, seq long, ts timestamp, stage string, message string, current int, total int"
    rows = [("a", 1, "queued"), ("a", 2, "translating"), ("b", 1, "queued"), ("a", 3, "done"), ("a", 4, "queued"), ("b", 2, "merging")]
    for i, (task, seq, stage) in enumerate(rows):
        one = spark.createDataFrame([(task, seq, stage)], "task_id string, seq long, stage string")
        one = one.select("task_id", "seq", F.lit("2024-01-01").cast("timestamp").alias("ts"), "stage", F.lit("m").alias("message"), F.lit(1).alias("current"), F.lit(0).alias("total"))
        one.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    progress.save_states(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    got = {r.task_id: (r.seq, r.stage, r.status) for r in progress.saved_states(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == {"a": (3, "done", "done"), "b": (2, "merging", "running")}
