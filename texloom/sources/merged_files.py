"""A data source that writes text files to their places, whole or not at all.

Each attempt of a task writes its files below a folder of its own, with a list of them, and names that folder in its commit
message. Only the attempts that Spark commits, one for each task, count; their lists are then carried out by a second
job, which moves files to their places and may be repeated. So a failed, repeated or speculative attempt never
touches a file, and a file is replaced in one move. Of a job that fails, the folder goes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

LIST = "list.json"


@dataclass
class Attempt(WriterCommitMessage):
    folder: str
    files: int


class MergedFiles(DataSource):
    """Rows (path, merged, content): `df.write.format("texloom_merged").option("staging", …).option("kept", …).mode("append").save(root)`."""

    @classmethod
    def name(cls) -> str:
        return "texloom_merged"

    def schema(self) -> str:
        return "path string, merged string, content string"

    def writer(self, schema, overwrite: bool) -> MergedWriter:
        return MergedWriter(self.options["path"], self.options["staging"], self.options["kept"])


class MergedWriter(DataSourceArrowWriter):
    def __init__(self, root: str, staging: str, kept: str):
        self.root, self.staging, self.kept = root, staging, kept

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        system, top = fs.FileSystem.from_uri(self.root)
        attempt = uuid.uuid4().hex
        folder, moves = f"{top}/{self.staging}/{attempt}", []
        system.create_dir(folder)
        for batch in iterator:
            for row in batch.to_pylist():
                if row["path"] is None or row["merged"] is None:
                    raise ValueError(f"no text for {row['path']!r}")
                for text, place in ((row["content"], row["path"] + self.kept), (row["merged"], row["path"])):
                    if text is not None:
                        name = f"{len(moves)}"
                        with system.open_output_stream(f"{folder}/{name}") as out:
                            out.write(text.encode())
                        moves.append((name, place))
        with system.open_output_stream(f"{folder}/{LIST}") as out:
            out.write(json.dumps(moves).encode())
        return Attempt(attempt, len(moves))

    def commit(self, messages: list[Attempt | None]) -> None:
        """Name the attempts that count: a few bytes for each task."""
        system, top = fs.FileSystem.from_uri(self.root)
        with system.open_output_stream(f"{top}/{self.staging}/committed.json") as out:
            out.write(json.dumps([m.folder for m in messages if m is not None]).encode())

    def abort(self, messages: list[Attempt | None]) -> None:
        system, top = fs.FileSystem.from_uri(self.root)
        if system.get_file_info(f"{top}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{top}/{self.staging}")


def _moved(root: str, staging: str, kept: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = fs.FileSystem.from_uri(root)
        there = lambda path: system.get_file_info(path).type != fs.FileType.NotFound
        for batch in batches:
            n = 0
            for attempt in batch.column("attempt").to_pylist():
                folder = f"{top}/{staging}/{attempt}"
                with system.open_input_stream(f"{folder}/{LIST}") as data:
                    moves = json.loads(data.read())
                for name, place in moves:
                    own, target = f"{folder}/{name}", f"{top}/{place}"
                    n += not place.endswith(kept)
                    if not there(own):
                        continue  # moved before
                    if place.endswith(kept) and there(target):
                        continue  # the first original stays
                    system.create_dir(target.rsplit("/", 1)[0])
                    system.move(own, target)
            yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    return run


def write_committed(rows: DataFrame, root: str, kept: str) -> int:
    """Write `merged` of each row (path, merged, content) to its path below `root`, and `content` beside it under the ending `kept`
    unless a file is there. The number of files written."""
    spark = rows.sparkSession
    spark.dataSource.register(MergedFiles)
    staging = f".staging-{uuid.uuid4().hex}"
    rows.write.format(MergedFiles.name()).option("staging", staging).option("kept", kept).mode("append").save(root)
    system, top = fs.FileSystem.from_uri(root)
    with system.open_input_stream(f"{top}/{staging}/committed.json") as data:
        attempts = json.loads(data.read())
    n = 0
    if attempts:
        todo = spark.createDataFrame([(a,) for a in attempts], "attempt string").repartition(len(attempts))
        n = todo.mapInArrow(_moved(root, staging, kept), "n long").agg(F.sum("n")).first()[0] or 0
    system.delete_dir(f"{top}/{staging}")
    return n
