"""A store of translated chunks that keeps versions of files, bucketed by paper.

Rows are (paper_id, rel_path, cache_key, src_hash, chunks, version). They lie in an external bucketed table: one folder for
each version (the number of the batch that wrote it) and in it one file for each bucket of papers, sorted by file.
So

* writing a version again replaces that version alone,
* reading for some papers opens the buckets of these papers alone (up to `MAX_PAPERS` papers are named to the scan),
* grouping by file and joining by keys that hold paper_id need no shuffle of the store.

`compact` keeps the last versions of each file in a new generation of the table; readers of the old one go on, as it is
deleted with the generation after next. Which generation counts, and the number of buckets, lies beside them in `generations`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

FILE = ["paper_id", "rel_path"]
COLUMNS = [*FILE, "cache_key", "src_hash", "chunks"]
BUCKETS = 64
MAX_PAPERS = 10_000
_SUBSET_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def joined_by_bucket(spark: SparkSession) -> Iterator[None]:
    """Plans made here may join a bucketed side by a part of the keys."""
    before = spark.conf.get(_SUBSET_KEYS, "true")
    spark.conf.set(_SUBSET_KEYS, "false")
    try:
        yield
    finally:
        spark.conf.set(_SUBSET_KEYS, before)


class ChunkStore:
    def __init__(self, spark: SparkSession, path: str, paper_type: DataType | str = "string", buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.paper_type = paper_type if isinstance(paper_type, str) else paper_type.simpleString()
        if exists(spark, f"{self.path}/generations"):
            known = spark.read.parquet(f"{self.path}/generations").orderBy(F.desc("generation")).first()
            self.generation, self.buckets = known.generation, known.buckets
        else:
            self.generation, self.buckets = 0, buckets
            self._commit()

    def _commit(self) -> None:
        one = self.spark.createDataFrame([(self.generation, self.buckets)], "generation int, buckets int").coalesce(1)
        one.write.mode("append").parquet(f"{self.path}/generations")

    def _folder(self, generation: int) -> str:
        return f"{self.path}/rows-{generation}"

    def _table(self, spark: SparkSession, generation: int) -> str:
        """The table's name in the session's catalog, where it is made if need be; its rows are the files below the folder."""
        folder = self._folder(generation)
        name = "texloom_chunks_" + hashlib.md5(folder.encode()).hexdigest()[:16]
        if not spark.catalog.tableExists(name):
            spark.sql(
                f"create table {name} (paper_id {self.paper_type}, rel_path string, cache_key string, src_hash string, chunks array<string>, version long)"
                f" using parquet partitioned by (version) clustered by (paper_id) sorted by (paper_id, rel_path) into {self.buckets} buckets location '{folder}'"
            )
            if exists(spark, folder):
                spark.catalog.recoverPartitions(name)
        return name

    def put(self, rows: DataFrame, version: int, *, generation: int | None = None) -> None:
        """Write a version; written again, it replaces what it was."""
        spark = rows.sparkSession
        name = self._table(spark, self.generation if generation is None else generation)
        rows.select(*COLUMNS).repartition(self.buckets, "paper_id").createOrReplaceTempView(f"{name}_new")
        spark.sql(f"insert overwrite table {name} partition (version = {int(version)}) select * from {name}_new")
        spark.catalog.dropTempView(f"{name}_new")

    def read(self, papers: DataFrame | None = None, before: int | None = None) -> DataFrame:
        """All versions, or those of some papers and of versions below `before`."""
        spark = papers.sparkSession if papers is not None else self.spark
        name = self._table(spark, self.generation)
        spark.catalog.refreshTable(name)  # another session may have written since
        rows = spark.table(name)
        if before is not None:
            rows = rows.where(F.col("version") < before)
        if papers is not None:
            ids = [r.paper_id for r in papers.select("paper_id").distinct().limit(MAX_PAPERS + 1).collect()]
            # more papers than that touch every bucket anyway
            rows = rows.where(F.col("paper_id").isin(ids)) if len(ids) <= MAX_PAPERS else rows
        return rows

    def newest(self, keep: int = 1, papers: DataFrame | None = None) -> DataFrame:
        """The last versions of each file."""
        last = Window.partitionBy(*FILE).orderBy(F.desc("version"), F.desc("src_hash"))
        return self.read(papers).withColumn("_k", F.row_number().over(last)).where(F.col("_k") <= keep).drop("_k")

    def compact(self, keep: int = 1) -> int:
        """A new generation with the last `keep` versions of each file; the number of rows it holds."""
        rows = self.newest(keep)
        new = self.generation + 1
        _delete(self.spark, self._folder(new))  # of a compaction that broke off
        name = self._table(self.spark, new)
        rows.select(*COLUMNS, "version").repartition(self.buckets, "paper_id").createOrReplaceTempView(f"{name}_new")
        self.spark.sql(f"insert into {name} partition (version) select * from {name}_new")
        self.spark.catalog.dropTempView(f"{name}_new")
        old, self.generation = self.generation, new
        self._commit()
        _delete(self.spark, self._folder(old - 1))
        return self.read().count()
