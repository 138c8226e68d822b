"""Putting files together again: chunks to nodes, repaired nodes to texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texloom.functions import latex as lx
from texloom.operators import segment

KEY = ["paper_id", "rel_path"]


def _joined(index: str, text: str):
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(index, text))), lambda x: x[text]), "")


def node_translations(chunk_rows: DataFrame) -> DataFrame:
    """(…, t_idx, translated): chunks (with `final`) of a node in order."""
    return chunk_rows.groupBy(*KEY, F.col("owner_t_idx").alias("t_idx")).agg(_joined("chunk_idx", "final").alias("translated"))


def finished_nodes(nodes: DataFrame, translated: DataFrame, reverted: DataFrame | None = None) -> DataFrame:
    """Nodes with `final` text and `outcome`; reverted nodes, and those without translation, keep their own."""
    return _finished(nodes.join(translated, [*KEY, "t_idx"], "left"), reverted)


def _finished(nodes: DataFrame, reverted: DataFrame | None = None) -> DataFrame:
    joined = lx.with_repaired(nodes, "text", "translated", "final", "outcome")
    blank = F.coalesce(F.col("translated"), F.lit("")) == ""
    outcome = F.when(F.col("preserve"), "preserved").when(blank, "missing").otherwise(F.col("outcome"))
    if reverted is not None:
        joined = joined.join(reverted.select(*KEY, "node_idx", F.lit(True).alias("_back")), [*KEY, "node_idx"], "left")
        outcome = F.when(F.col("_back"), "reverted").otherwise(outcome)
    done = joined.withColumn("outcome", outcome)
    own = F.col("outcome").isin("preserved", "missing", "reverted")
    return done.withColumn("final", F.when(own, F.col("text")).otherwise(F.col("final"))).drop("_back")


def merged_files(finished: DataFrame) -> DataFrame:
    """(paper_id, rel_path, merged): node texts in order, then the repairs that need the whole file."""
    whole = finished.groupBy(*KEY).agg(_joined("node_idx", "final").alias("merged"))
    return whole.withColumn("merged", lx.separate_cjk("merged")).withColumn("merged", lx.collapse_document("merged"))


# ---- the same for file rows, where a file's nodes are its `runs` (see `segment.file_rows`) and `translated` holds its chunks ----


def _node(run: Column) -> Column:
    """A node's text and what its chunks became, put together; a missing chunk is the original."""
    own = F.slice(F.col("translated"), run["at"] + 1, F.size(run["parts"]))
    became = F.array_join(F.zip_with(run["parts"], own, lambda text, t: F.coalesce(t, text)), "")
    return F.struct(segment.text_of(run).alias("text"), F.when(~run["preserve"], became).alias("translated"), run["preserve"].alias("preserve"))


def finished_rows(rows: DataFrame) -> DataFrame:
    """`finished_nodes` of file rows."""
    nodes = segment.explode_nodes(rows.withColumn("runs", F.transform("runs", _node)), also=["translated"])
    return _finished(nodes)


def merged_rows(rows: DataFrame) -> DataFrame:
    """`merged_files` of file rows, which are not taken apart; other columns stay."""

    def final(run: Column) -> Column:
        done = lambda n: F.when(n["translated"] == "", n["text"]).otherwise(lx.repaired(n["text"], n["translated"])["fixed"])
        return F.when(run["preserve"], segment.text_of(run)).otherwise(lx.let(_node(run), done))

    whole = rows.where(F.size("runs") > 0).withColumn("merged", F.array_join(F.transform("runs", final), "")).drop("runs", "translated")
    return whole.withColumn("merged", lx.separate_cjk("merged")).withColumn("merged", lx.collapse_document("merged"))


def segment_stats(finished: DataFrame) -> DataFrame:
    """Counts for each paper; total = translated + preserved."""
    return finished.groupBy("paper_id").agg(
        F.count("*").alias("total"),
        F.count_if(~F.col("preserve")).alias("translated"),
        F.count_if("preserve").alias("preserved"),
        F.count_if(F.col("outcome") == "reverted").alias("reverted"),
    )
