"""Bundles read member by member, merged files committed whole, pauses between failed calls, order of paths."""

import io
import tarfile
import time
import zipfile

import pyarrow as pa
import pytest

from texloom.operators import translate
from texloom.sources import bundles, merged_files
from texloom.sources import latex as src


def tar(path, files, broken=False):
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode="w:gz", compresslevel=1) as out:
        for name, content in files:
            entry = tarfile.TarInfo(name)
            entry.size = len(content)
            out.addfile(entry, io.BytesIO(content))
        link = tarfile.TarInfo("link.tex")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        out.addfile(link)
    raw = data.getvalue()
    path.write_bytes(raw[: len(raw) // 2] if broken else raw)


def test_bundles_by_member(spark, tmp_path):
    import random

    noise = random.Random(1).randbytes(200_000)
    tar(tmp_path / "t.tar.gz", [("./main.tex", b"T"), ("fig.pdf", b"x" * 1000), ("../up.tex", b"E"), ("paper_cn/a.tex", b"E"), ("big.tex", b"y" * 5000), ("sec/a.tex", b"\xe9")])
    tar(tmp_path / "cut.tgz", [("first.tex", b"F"), ("noise.tex", noise), ("last.tex", noise)], broken=True)
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("main.tex", "Z")
        z.writestr("/abs.tex", "E")
    (tmp_path / "bad.zip").write_bytes(b"nothing")
    (tmp_path / "notes.txt").write_bytes(b"x")
    spark.dataSource.register(bundles.BundleSource)
    rows = spark.read.format("texloom_bundles").option("max_member", 4000).load(str(tmp_path))
    assert rows.rdd.getNumPartitions() == 5
    got = {(r.bundle.rsplit("/", 1)[1], r.rel_path, None if r.content is None else bytes(r.content)[:3], r.reason and r.reason.split(":")[0]) for r in rows.collect()}
    assert {x for x in got if x[0] in ("t.tar.gz", "z.zip", "notes.txt")} == {
        ("t.tar.gz", "main.tex", b"T", None), ("t.tar.gz", "big.tex", None, "too large"), ("t.tar.gz", "sec/a.tex", b"\xe9", None), ("z.zip", "main.tex", b"Z", None),
        ("notes.txt", None, None, "not a .tar.gz or .zip file"),
    }
    assert ("cut.tgz", "first.tex", b"F", None) in got and any(x[0] == "cut.tgz" and x[3] for x in got) and any(x[0] == "bad.zip" and x[3] for x in got)
    good, bad = src.read_bundles(spark, str(tmp_path / "*.zip"))
    assert [(r.paper_id, r.rel_path, r.content) for r in good.collect()] == [("z", "main.tex", "Z")] and bad.count() == 1
    (tmp_path / "none").mkdir()
    assert src.read_bundles(spark, str(tmp_path / "none"))[0].count() == 0


def test_a_large_bundle_is_never_one_cell(tmp_path):
    """600 MB of members are passed by; memory grows with one member only."""
    import resource

    class Zeros(io.RawIOBase):
        def __init__(self, n):
            self.n = n

        def readable(self):
            return True

        def readinto(self, b):
            k = min(len(b), self.n)
            b[:k] = bytes(k)
            self.n -= k
            return k

    path = tmp_path / "large.tar.gz"
    with tarfile.open(path, "w:gz", compresslevel=1) as out:
        for k in range(12):
            for name, size in ((f"{k}.tex", 3), (f"{k}.bin", 50 << 20)):
                entry = tarfile.TarInfo(name)
                entry.size = size
                out.addfile(entry, Zeros(size))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    rows = [r for batch in bundles.BundleReader(str(path), 1 << 20).read(bundles.Bundle(str(path))) for r in batch.to_pylist()]
    assert len(rows) == 12 and all(r["content"] == b"\0\0\0" for r in rows)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100 << 10


def staged(root):
    return [p for p in root.iterdir() if p.name.startswith(".staging")]


def test_nulls_leave_their_file_and_failed_jobs_leave_nothing(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.tex").write_text("one")
    (tmp_path / "p" / "b.tex").write_text("two")
    sources = spark.createDataFrame([("p", "a.tex", "one"), ("p", "b.tex", "two")], "paper_id string, rel_path string, content string")
    merged = spark.createDataFrame([("p", "a.tex", None), ("p", "b.tex", "译二")], "paper_id string, rel_path string, merged string")
    assert src.write_merged(merged, sources, str(tmp_path)) == 1
    assert (tmp_path / "p" / "a.tex").read_text() == "one" and (tmp_path / "p" / "b.tex").read_text() == "译二" and (tmp_path / "p" / "b.tex.orig").read_text() == "two"
    assert not (tmp_path / "p" / "a.tex.orig").exists() and not staged(tmp_path)
    rows = spark.createDataFrame([("p/a.tex", "new", "one"), ("p/b.tex", None, "two")], "path string, merged string, content string").coalesce(1)
    with pytest.raises(Exception, match="no text"):
        merged_files.write_committed(rows, str(tmp_path), ".orig")
    assert (tmp_path / "p" / "a.tex").read_text() == "one" and not staged(tmp_path)


def test_only_committed_attempts_count(tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.tex").write_text("old")
    writer = merged_files.MergedWriter(str(tmp_path), ".staging-1", ".orig")
    batch = lambda text: pa.record_batch([[x] for x in ("p/a.tex", text, "old")], names=["path", "merged", "content"])

    def breaks():
        yield batch("half")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(breaks())
    first, second = writer.write(iter([batch("whole")])), writer.write(iter([batch("speculative")]))
    assert (tmp_path / "p" / "a.tex").read_text() == "old"
    writer.commit([first])
    move = merged_files._moved(str(tmp_path), ".staging-1", ".orig")
    todo = pa.record_batch([[first.folder]], names=["attempt"])
    for _ in range(2):  # carried out again, it changes nothing
        assert [b.to_pylist() for b in move(iter([todo]))] == [[{"n": 1}]]
        assert (tmp_path / "p" / "a.tex").read_text() == "whole" and (tmp_path / "p" / "a.tex.orig").read_text() == "old"
    assert second.folder != first.folder
    writer.abort([second])
    assert not staged(tmp_path)


def test_failed_calls_pause_whatever_the_rate():
    def broken(texts, prompt):
        raise RuntimeError("no")

    start = time.monotonic()
    assert translate._called(broken, ["a"], "", translate.Pace(retries=3, calls_per_second=0, pause=0.1), [-1e9]) == [None]
    assert 0.3 <= time.monotonic() - start < 2


def test_paths_are_ordered_as_folders_are(spark):
    names = ["b.tex", "sec-x/a.tex", "sec/a.tex", "a.tex", "sec/z/a.tex", "sec/b.tex"]
    df = spark.createDataFrame([("p", n) for n in names] + [("p", "b.tex"), ("q", "z.tex")], "paper_id string, rel_path string")
    from pathlib import PurePosixPath

    got = {(r.paper_id, r.rel_path): r.file_no for r in src.in_path_order(df).collect()}
    assert [n for n, _ in sorted(((n, got["p", n]) for n in names), key=lambda x: x[1])] == [str(p) for p in sorted(map(PurePosixPath, names))]
    assert got["q", "z.tex"] == 0
