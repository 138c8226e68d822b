"""Progress of tasks as a stream: latest states, task records, incremental intake."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texloom.functions import latex as lx

TERMINAL = ["done", "failed"]
STATE = ["seq", "ts", "stage", "message", "current", "total"]


def _latest(events: DataFrame) -> DataFrame:
    """One struct per task, the same for a batch and a stream: its first terminal event, else its last one."""
    state = F.struct(*STATE)
    end = F.min(F.when(F.col("stage").isin(TERMINAL), state))
    best = events.groupBy("task_id").agg(end.alias("end"), F.max(state).alias("last"))
    return best.select("task_id", F.coalesce("end", "last").alias("s")).select("task_id", "s.*")


def latest_progress(events: DataFrame) -> DataFrame:
    """(task_id, seq, ts, stage, message, current, total, fraction, status): events after a task's end are ignored.

    On a stream, use output mode update or complete; state is two structs per task.
    """
    status = F.when(F.col("stage").isin(TERMINAL), F.col("stage")).when(F.col("stage") == "queued", "queued").otherwise("running")
    return _latest(events).withColumn("fraction", lx.fraction("current", "total")).withColumn("status", status)


def recent_progress(events: DataFrame, late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Events per stage in event-time windows, with bounded state: later ones than `late` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "stage").agg(F.count("*").alias("events"))


def snapshot_then_updates(snapshot: DataFrame, updates: DataFrame) -> DataFrame:
    """What a subscriber sees: the snapshot of all tasks, then updates of those that hadn't ended."""
    ended = snapshot.where(F.col("stage").isin(TERMINAL)).select("task_id")
    return snapshot.unionByName(updates.join(ended, "task_id", "left_anti"))


def save_states(events: DataFrame, path: str, checkpoint: str):
    """Write changed task states batch by batch, each batch in its own folder: a repeated batch overwrites itself."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = latest_progress(events).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def saved_states(states: DataFrame) -> DataFrame:
    """The last saved state of each task (`states` is read from the path of `save_states`)."""
    columns = [c for c in states.columns if c not in ("task_id", "batch")]
    return states.groupBy("task_id").agg(F.max_by(F.struct(*columns), "batch").alias("s")).select("task_id", "s.*")


def run_batches(source: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str):
    """Feed a stream to `step` (rows, batch number) until it is used up; a batch that broke off comes again with its number."""
    query = source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
