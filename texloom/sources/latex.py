"""Reading sources, bundles and logs of papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from texloom.functions import latex as lx
from texloom.sources.bundles import BundleSource
from texloom.sources.merged_files import write_committed


def decoded(content: str | Column) -> Column:
    """UTF-8 text, else Latin-1; every line end becomes a newline."""
    raw = F.col(content) if isinstance(content, str) else content
    text = F.when(F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8")).otherwise(F.decode(raw, "ISO-8859-1"))
    return F.regexp_replace(text, r"\r\n?", "\n")


KEPT = ".orig"


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    """(paper_id, rel_path, content) of all `.tex` files below the absolute path `root`, whose first folders are the papers.

    Files whose path names `paper_cn` are products of earlier runs and left out. Where a file was replaced by its
    translation, the original that `write_merged` kept is read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{tex,tex" + KEPT + "}").load(root)
    raw = raw.where(~F.col("path").contains("paper_cn"))
    kept = F.col("path").endswith(KEPT)
    replaced = raw.where(kept).select(F.expr(f"left(path, length(path) - {len(KEPT)})").alias("path"))
    inner = lx.below(F.when(kept, F.expr(f"left(path, length(path) - {len(KEPT)})")).otherwise(F.col("path")), root)
    return raw.join(replaced, "path", "left_anti").select(
        F.regexp_extract(inner, r"^([^/]*)/", 1).alias("paper_id"), F.regexp_replace(inner, r"^[^/]*/", "").alias("rel_path"), decoded("content").alias("content")
    )


def write_merged(merged: DataFrame, sources: DataFrame, root: str) -> int:
    """Write each merged file to its place below `root`, and its source beside it as `….orig` unless that is there already.

    Files without a merged text (null) stay as they are. See `merged_files` for how files are committed. Returns the number of files.
    """
    rows = merged.where("merged is not null and paper_id is not null and rel_path is not null").select("paper_id", "rel_path", "merged")
    both = rows.join(sources.select("paper_id", "rel_path", "content"), ["paper_id", "rel_path"])
    return write_committed(both.select(F.concat_ws("/", "paper_id", "rel_path").alias("path"), "merged", "content"), root, KEPT)


def in_path_order(rows: DataFrame) -> DataFrame:
    """`rows` (paper_id, rel_path, …) with `file_no`: the place of each file among those of its paper, as folders order them."""
    files = rows.select("paper_id", "rel_path").distinct()
    order = Window.partitionBy("paper_id").orderBy(lx.path_parts("rel_path"))
    return rows.join(files.withColumn("file_no", F.row_number().over(order) - 1), ["paper_id", "rel_path"])


def main_root(sources: DataFrame) -> DataFrame:
    """Paths relative to each paper's root: the top where `main.tex` lies, else the first folder that holds it,
    else the only folder there is."""
    folder = F.regexp_extract("rel_path", r"^([^/]*)/", 1)
    holder = F.when(F.col("rel_path").rlike(r"^[^/]+/main\.tex$"), folder)
    of = sources.groupBy("paper_id").agg(
        F.bool_or(F.col("rel_path") == "main.tex").alias("top"),
        F.min(holder).alias("holder"),
        F.when((F.min(folder) == F.max(folder)) & (F.min(folder) != ""), F.min(folder)).alias("only"),
    )
    root = of.select("paper_id", F.when(F.col("top"), "").otherwise(F.coalesce("holder", "only", F.lit(""))).alias("_root"))
    joined = sources.join(root, "paper_id")
    inside = (F.col("_root") == "") | F.col("rel_path").startswith(F.concat("_root", F.lit("/")))
    strip = F.when(F.col("_root") == "", F.col("rel_path")).otherwise(F.substring("rel_path", F.length("_root") + 2, F.length("rel_path")))
    return joined.where(inside).select("paper_id", strip.alias("rel_path"), "content")


def read_bundles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sources, rejects) from `.tar.gz`, `.tgz` and `.zip` bundles, a task for each bundle, members as they come.

    Links, absolute paths and `..` are skipped; members over the cap, and what can't be read, go to the rejects with a reason.
    """
    spark.dataSource.register(BundleSource)
    members = spark.read.format(BundleSource.name()).load(path)
    paper = F.regexp_replace(F.regexp_extract("bundle", r"([^/]*)$", 1), r"(\.tar\.gz|\.tgz|\.zip)$", "")
    good = members.where("reason is null")
    return good.select(paper.alias("paper_id"), "rel_path", decoded("content").alias("content")), members.where("reason is not null").select("bundle", "rel_path", "reason")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(stem, log_text) of compile logs; bad bytes are replaced."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.regexp_extract(F.input_file_name(), r"([^/]*)\.log$", 1).alias("stem"), F.make_valid_utf8("value").alias("log_text"))


def list_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(workdir, file_name) of the files in `output` folders; contents aren't read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return raw.select(
        F.regexp_replace(F.regexp_extract("path", r"^(.*)/output/[^/]*$", 1), r"^file:/*", "/").alias("workdir"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name")
    ).where("workdir <> ''")


def main_scores(sources: DataFrame) -> DataFrame:
    """(paper_id, rel_path, score) of files that can be compiled."""
    has = lambda s: F.col("content").contains(s)
    score = F.when(has("\\documentclass"), 10).otherwise(0) + F.when(has("\\title") | has("\\author"), 5).otherwise(0)
    score = score + F.when(F.lower(F.regexp_extract("rel_path", r"([^/]*)$", 1)).contains("main"), 3).otherwise(0)
    product = F.array_contains(F.split("rel_path", "/"), "paper_cn")
    return sources.where(has("\\begin{document}") & ~product).select("paper_id", "rel_path", score.alias("score"))


def main_file(sources: DataFrame) -> DataFrame:
    """The best file of each paper: highest score, then smallest path. Only scores are shuffled."""
    w = Window.partitionBy("paper_id").orderBy(F.desc("score"), "rel_path")
    return main_scores(sources).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
