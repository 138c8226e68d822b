"""A data source of source bundles: `.tar.gz`, `.tgz` and `.zip` files, a partition for each, read member by member.

No bundle is ever one cell: archives are read as streams from the file system that the path names, and of their members
only the `.tex` files that count are read, each below `max_member` bytes. Rows are (bundle, rel_path, content, reason);
a reason stands where something couldn't be read.

Defined cases: links, absolute paths, `..` and products of earlier runs (`paper_cn`) are skipped; an empty folder has no
rows; a bundle that breaks off keeps the members read before it, and a row with the reason.
"""

from __future__ import annotations

import fnmatch
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "bundle string, rel_path string, content binary, reason string"
MAX_MEMBER = 64 << 20


@dataclass
class Bundle(InputPartition):
    path: str


class BundleSource(DataSource):
    """`spark.read.format("texloom_bundles").load(folder, file or pattern)`."""

    @classmethod
    def name(cls) -> str:
        return "texloom_bundles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BundleReader:
        return BundleReader(self.options["path"], int(self.options.get("max_member", MAX_MEMBER)))


class BundleReader(DataSourceReader):
    def __init__(self, path: str, max_member: int):
        self.path, self.max_member = path, max_member

    def partitions(self) -> list[Bundle]:
        system, place = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(place)
        if found.type == fs.FileType.Directory:
            files, pattern = system.get_file_info(fs.FileSelector(place)), "*"
        elif found.type == fs.FileType.File:
            files, pattern = [found], "*"
        else:
            folder, _, pattern = place.rpartition("/")
            files = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return [Bundle(f.path) for f in sorted(files, key=lambda f: f.path) if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern)]

    def read(self, partition: Bundle | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(partition.path) as stream:
            for path, content, reason in members(partition.path, stream, self.max_member):
                yield pa.record_batch(
                    [pa.array([partition.path]), pa.array([path], pa.string()), pa.array([content], pa.binary()), pa.array([reason], pa.string())],
                    names=["bundle", "rel_path", "content", "reason"],
                )


def _listed(name: str, stream: BinaryIO) -> Iterator[tuple]:
    """(path, size, read) of the plain files of an archive, in its own order."""
    if name.endswith(".zip"):
        archive = zipfile.ZipFile(stream)
        for entry in archive.infolist():
            if not entry.is_dir():
                yield entry.filename, entry.file_size, lambda e=entry: archive.read(e)
    else:
        with tarfile.open(fileobj=stream, mode="r|gz") as tar:
            for entry in tar:
                if entry.isfile():
                    yield entry.name, entry.size, lambda e=entry: tar.extractfile(e).read()


def members(name: str, stream: BinaryIO, max_member: int = MAX_MEMBER) -> Iterator[tuple[str | None, bytes | None, str | None]]:
    """(path, content, reason) of the sources in an archive."""
    if not name.endswith((".zip", ".tar.gz", ".tgz")):
        yield None, None, "not a .tar.gz or .zip file"
        return
    try:
        for path, size, read in _listed(name, stream):
            path = path.removeprefix("./")
            if path.startswith("/") or ".." in path.split("/") or not path.endswith(".tex") or "paper_cn" in path:
                continue
            if size > max_member:
                yield path, None, "too large"
            else:
                yield path, read(), None
    except (OSError, EOFError, tarfile.TarError, zipfile.BadZipFile, ValueError, RuntimeError) as e:
        yield None, None, f"{type(e).__name__}: {e}"
