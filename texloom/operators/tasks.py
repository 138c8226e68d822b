"""Task history: artifacts, reconciling, upserts, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texloom.functions import latex as lx

PATHS = ["translated_pdf", "bilingual_pdf", "original_pdf"]
DONE_MESSAGE, INTERRUPTED = "完成", "服务重启,任务中断"


def artifact_paths(artifacts: DataFrame) -> DataFrame:
    """(workdir, translated_pdf, bilingual_pdf, original_pdf): the stem is the smallest of the bilingual
    files, else of the translated ones; a watermarked translation is preferred."""
    stem = lambda suffix: F.min(F.when(F.col("file_name").endswith(suffix), F.expr(f"left(file_name, length(file_name) - {len(suffix)})")))
    found = artifacts.groupBy("workdir").agg(
        F.coalesce(stem("_bilingual.pdf"), stem("_cn.pdf")).alias("stem"), F.collect_set("file_name").alias("files")
    ).where("stem is not null")
    name = lambda suffix: F.concat("stem", F.lit(suffix))
    path = lambda suffix: F.when(F.array_contains("files", name(suffix)), F.concat("workdir", F.lit("/output/"), name(suffix)))
    return found.select(
        "workdir", F.coalesce(path("_cn_wm.pdf"), path("_cn.pdf")).alias(PATHS[0]), path("_bilingual.pdf").alias(PATHS[1]), path("_orig.pdf").alias(PATHS[2])
    )


def unknown(known: DataFrame, external: DataFrame) -> DataFrame:
    return external.join(known, "task_id", "left_anti")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """`new` rows replace those of their task_id; all others stay."""
    return old.join(new, "task_id", "left_anti").unionByName(new)


def reconcile(tasks: DataFrame, artifacts: DataFrame) -> DataFrame:
    """All tasks with paths from their artifacts, and `changed`.

    Running and queued tasks stay as they are. With a translated file, new or known, a task is done.
    """
    found = artifact_paths(artifacts).select(F.col("workdir").alias("_dir"), *[F.col(p).alias(f"_{p}") for p in PATHS])
    joined = tasks.join(found, F.col("workdir") == F.col("_dir"), "left")
    touched = ~F.col("status").isin("running", "queued") & F.coalesce(*[f"_{p}" for p in PATHS]).isNotNull() & (F.col("workdir") != "")
    new = {p: F.when(touched, F.coalesce(f"_{p}", p)).otherwise(F.col(p)) for p in PATHS}
    promoted = touched & new[PATHS[0]].isNotNull() & (F.col("status") != "done")
    pick = lambda value, column: F.when(promoted, value).otherwise(F.col(column))
    new |= {"status": pick("done", "status"), "stage": pick("done", "stage"), "error": pick(F.lit(None), "error"), "message": pick(DONE_MESSAGE, "message")}
    same = F.lit(True)
    for name in [*PATHS, "status"]:
        same = same & new[name].eqNullSafe(F.col(name))
    return joined.select(*[new.get(k, F.col(k)).alias(k) for k in tasks.columns], (~F.coalesce(same, F.lit(True))).alias("changed"))


def reload_counts(reconciled: DataFrame) -> DataFrame:
    return reconciled.agg(F.count_if("changed").alias("changed"), F.count("*").alias("total"))


def interrupted(tasks: DataFrame) -> DataFrame:
    """After a restart nothing runs: such tasks have failed."""
    live = F.col("status").isin("running", "queued")
    pick = lambda value, column: F.when(live, value).otherwise(F.col(column)).alias(column)
    new = {"status": pick("failed", "status"), "stage": pick("failed", "stage"), "error": pick(INTERRUPTED, "error")}
    return tasks.select(*[new.get(k, F.col(k)) for k in tasks.columns])


def history(tasks: DataFrame) -> DataFrame:
    """Newest first, unknown times last, with label and local time."""
    return tasks.select(
        "task_id", lx.history_label("title", "source", "task_id").alias("label"), "status", "created_at",
        F.date_format(F.timestamp_seconds("created_at"), "yyyy-MM-dd HH:mm").alias("created"),
    ).orderBy(F.desc_nulls_last("created_at"), "task_id")


def status_view(tasks: DataFrame) -> DataFrame:
    """Rows as an API shows them, with links to the artifacts that exist."""
    link = lambda kind, column: F.when(
        F.coalesce(F.col(column), F.lit("")) != "", F.concat(F.lit("/api/tasks/"), "task_id", F.lit(f"/download/{kind}"))
    ).alias(column)
    links: Column = F.struct(link("translated", PATHS[0]), link("bilingual", PATHS[1]), link("original", PATHS[2]))
    return tasks.select(
        "task_id", "status", "stage", "message", F.col("current").alias("progress_current"), F.col("total").alias("progress_total"),
        lx.percent("current", "total").alias("percent"), "error", links.alias("artifacts"), "title", "source", "created_at",
    )
