import json

from texloom.operators import cache, repair, tasks
from texloom.sources import latex as src


def test_cache_files(spark, tmp_path):
    for paper, text in (("p", json.dumps({"tex": "a.tex", "src_hash": "h", "chunks": ["x", "y\n"]})), ("q", "{not json")):
        (tmp_path / paper).mkdir()
        (tmp_path / paper / "k.chunks.json").write_text(text)
    rows = {r.paper_id: r for r in cache.read_json(spark, str(tmp_path)).collect()}
    assert rows["p"].rel_path == "a.tex" and rows["p"].chunks == ["x", "y\n"] and rows["q"].chunks is None


def test_logs_and_lines(spark, tmp_path):
    (tmp_path / "main.log").write_bytes(b"x\xff\nmain.tex:12: bad\nl.7 \\foo\n  l.9\nother.tex:3: no\nmain.tex:12: again\n")
    logs = src.read_logs(spark, str(tmp_path)).selectExpr("'p' as paper_id", "stem", "log_text")
    assert "�" in logs.first().log_text
    assert sorted(r.line for r in repair.error_lines(logs).collect()) == [7, 12]


def test_radius_is_inclusive(spark):
    nodes = spark.createDataFrame([("p", "main.tex", 0, "t", False, 10, 12)], "paper_id string, rel_path string, node_idx int, text string, preserve boolean, line_start int, line_end int")
    near = lambda line: repair.near_errors(nodes, spark.createDataFrame([("p", line)], "paper_id string, line int"), 7).count()
    assert [near(n) for n in (2, 3, 19, 20)] == [0, 1, 1, 0]


def test_artifact_listing(spark, tmp_path):
    out = tmp_path / "job" / "output"
    out.mkdir(parents=True)
    for name in ("p_cn.pdf", "p_cn_wm.pdf", "p_orig.pdf"):
        (out / name).write_bytes(b"x")
    row = tasks.artifact_paths(src.list_artifacts(spark, str(tmp_path))).first()
    assert row.workdir == str(tmp_path / "job") and row.translated_pdf.endswith("/output/p_cn_wm.pdf") and row.bilingual_pdf is None and row.original_pdf.endswith("p_orig.pdf")


def test_main_file_by_score_then_path(spark):
    body = "\\begin{document}"
    rows = [("p", "b.tex", "\\documentclass" + body), ("p", "a.tex", "\\documentclass" + body), ("p", "x/main.tex", body), ("p", "paper_cn/main.tex", "\\documentclass\\title" + body), ("q", "c.tex", "none")]
    got = [(r.paper_id, r.rel_path, r.score) for r in src.main_file(spark.createDataFrame(rows, "paper_id string, rel_path string, content string")).collect()]
    assert got == [("p", "a.tex", 10)]
