"""Window forms of the node steps, for node tables that come from elsewhere.

`segment.nodes` does the same inside each document's row; here a table
(paper_id, rel_path, node_idx, text, preserve) is partitioned by file once, and all steps share
that partitioning and order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from texloom.functions import latex as lx

KEY = ["paper_id", "rel_path"]


def _file(order: str = "node_idx"):
    return Window.partitionBy(*KEY).orderBy(order)


def _before(col: Column, order: str = "node_idx") -> Column:
    return F.coalesce(F.sum(col).over(_file(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def with_lines(nodes: DataFrame) -> DataFrame:
    """0-based first and last line of each node."""
    breaks = lx.count_of(F.col("text"), "\n")
    return nodes.withColumn("line_start", _before(breaks)).withColumn("line_end", F.col("line_start") + breaks)


def with_t_idx(nodes: DataFrame) -> DataFrame:
    """The number of each translatable node among those of its file."""
    return nodes.withColumn("t_idx", F.when(~F.col("preserve"), _before(F.when(F.col("preserve"), 0).otherwise(1))))


def detach_whitespace(nodes: DataFrame) -> DataFrame:
    """White space at the ends of translatable nodes goes to their (protected) neighbours, where there are any."""
    own = lambda name: F.col(name)
    lead, tail = F.regexp_extract("text", r"^(?U:\s*)", 0), F.regexp_extract("text", r"(?U)(?<!\s)(\s+)$", 1)
    blank = F.col("text").rlike(r"(?U)^\s*$")
    w = _file()
    give = nodes.withColumn("_first", F.row_number().over(w) == 1).withColumn("_last", F.lead("node_idx").over(w).isNull())
    give = give.withColumn("_lead", F.when(~own("preserve") & ~own("_first"), lead).otherwise(""))
    give = give.withColumn("_tail", F.when(~own("preserve") & ~own("_last") & ~(blank & ~own("_first")), tail).otherwise(""))
    kept = F.substring("text", F.length("_lead") + 1, F.length("text") - F.length("_lead") - F.length("_tail"))
    text = F.concat(F.coalesce(F.lag("_tail").over(w), F.lit("")), kept, F.coalesce(F.lead("_lead").over(w), F.lit("")))
    return give.withColumn("text", text).drop("_first", "_last", "_lead", "_tail")


def merge_neighbours(nodes: DataFrame) -> DataFrame:
    """Empty nodes go, neighbours of one kind become one node."""
    full = nodes.where(F.col("text") != "")
    change = F.coalesce((F.lag("preserve").over(_file()) != F.col("preserve")).cast("int"), F.lit(1))
    islands = full.withColumn("_new", change).withColumn("_k", F.sum("_new").over(_file().rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_idx", "text"))), lambda x: x["text"]), "")
    return islands.groupBy(*KEY, (F.col("_k") - 1).cast("int").alias("node_idx")).agg(joined.alias("text"), F.first("preserve").alias("preserve"))


def line_depths(lines: DataFrame) -> DataFrame:
    """Open braces before each line (text, node_idx of the lines of a file); the depth never falls below 0."""
    total = F.sum(lx.brace_balance("text")).over(_file().rowsBetween(Window.unboundedPreceding, 0))
    lowest = F.least(F.lit(0), F.min("_s").over(_file().rowsBetween(Window.unboundedPreceding, 0)))
    depth = lines.withColumn("_s", total).withColumn("_d", F.col("_s") - lowest)
    return depth.withColumn("depth_before", F.coalesce(F.lag("_d").over(_file()), F.lit(0))).drop("_s", "_d")
