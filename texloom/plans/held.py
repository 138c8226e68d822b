"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A folder of our own is made only for a local master; elsewhere executors wouldn't see it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-texloom-"))


#: Texts take a third less than with Spark's default.
CODEC = "zstd"


def held(df: DataFrame, label: str) -> DataFrame:
    """`df` written once as Parquet and read back: what follows neither computes it again nor needs the executors that did."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/texloom/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", CODEC).parquet(path)
    return spark.read.schema(StructType(df.schema.fields)).parquet(path)


def held_by(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """`held`, in an external table bucketed by a key: what groups or joins by the key reads it without a shuffle."""
    spark, own = df.sparkSession, uuid.uuid4().hex
    name = f"texloom_{label}_{own}"
    df.write.format("parquet").option("compression", CODEC).option("path", f"{shared_dir(spark)}/texloom/{label}-{own}").bucketBy(buckets, key).saveAsTable(name)
    return spark.table(name)
