"""Reverting segments near compile errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["paper_id", "rel_path"]


def error_lines(logs: DataFrame) -> DataFrame:
    """(paper_id, line): distinct lines named as `stem.tex:N:` or, at a line's begin, `l.N`."""
    named = F.regexp_extract_all("log_text", F.concat(F.lit("\\Q"), "stem", F.lit(r"\E\.tex:(\d{1,6}):")), F.lit(1))
    marked = F.regexp_extract_all("log_text", F.lit(r"(?md)^l\.(\d{1,6})"), F.lit(1))
    return logs.select("paper_id", F.explode(F.concat(named, marked)).alias("line")).select("paper_id", F.col("line").cast("int").alias("line")).distinct()


def known_lines(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).distinct()


def new_lines(old: DataFrame, found: DataFrame) -> DataFrame:
    """Lines of this round that no earlier round had; none: repairing ends."""
    return found.join(old, ["paper_id", "line"], "left_anti").distinct()


def near_errors(nodes: DataFrame, lines: DataFrame, radius: int, rel_path: str | None = None) -> DataFrame:
    """Translatable nodes that a line comes within `radius` of.

    A paper's lines are distinct integers of six digits at most, so they go with its nodes as one
    sorted array; node rows are joined once by paper and never multiplied.
    """
    arrays = lines.groupBy("paper_id").agg(F.array_sort(F.collect_set("line")).alias("_lines"))
    own = nodes.where(~F.col("preserve"))
    if rel_path is not None:
        own = own.where(F.col("rel_path") == rel_path)
    joined = own.join(arrays, "paper_id")
    return joined.where(F.exists("_lines", lambda b: b.between(F.col("line_start") - radius, F.col("line_end") + radius))).drop("_lines")


def radius_of(attempt: int) -> int:
    return 5 * (attempt + 1)
