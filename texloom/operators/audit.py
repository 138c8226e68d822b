"""Which cached chunks still need translation: a report, and the surgical update."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texloom.functions import latex as lx

KEY = ["paper_id", "rel_path"]


def targets(pairs: DataFrame) -> DataFrame:
    """Chunk pairs (text, translated) to translate again."""
    return pairs.where(lx.needs_retranslation("text", "translated"))


def report(pairs: DataFrame) -> DataFrame:
    """Counts per file, per paper and overall; `level` is 0, 1 or 3 (grouping id)."""
    marked = pairs.withColumn("_needs", lx.needs_retranslation("text", "translated"))
    return marked.rollup(*KEY).agg(F.count_if("_needs").alias("n_untranslated"), F.count("*").alias("n_chunks"), F.grouping_id().alias("level"))
