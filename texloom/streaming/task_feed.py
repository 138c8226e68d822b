"""The live feed of task progress: ordered updates, checked steps, and state that ends with its task.

One stateful query holds a row for each task that runs. Events of a task are taken in order of `seq`; an event of a
number that isn't above the last one is a repeat. With `patience`, an event whose number leaves a gap waits
until the gap is filled or that much event time has passed. Every event leaves the query once, as an update or rejected with a
reason:

* `repeated`: its number was seen, or passed over, before;
* `after end`: the task is done or has failed;
* `backwards`: its stage comes before the task's stage;
* `unknown stage`: no stage of this name.

When a task ends, its state stays for `keep` of event time, so that late events are still told apart, and then goes: a
timer removes it. A task that never ends loses its state when it has been silent for `silence`. Events older than the watermark
(`late`) are dropped by Spark.

A snapshot of known tasks (task_id, seq, stage) may start the state, so a subscriber sees it once and then only what
changes. A null task_id is a task of its own; null numbers and times count as 0 and as the epoch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from texloom.functions import latex as lx

TERMINAL = ["done", "failed"]
ORDER = {stage: n for n, stage in enumerate(["queued", *lx.STAGES])}
EVENT = "task_id string, seq long, ts timestamp, stage string, message string, current int, total int"
FEED = EVENT + ", reason string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 24 * 3600 * 1000


class TaskFeed(StatefulProcessor):
    """State of a task: its last number and stage and whether it ended; events that wait for a gap to be filled."""

    def __init__(self, patience_ms: int, keep_ms: int, silence_ms: int):
        self.patience_ms, self.keep_ms, self.silence_ms = patience_ms, keep_ms, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seq long, stage string, ended boolean, timer long")
        self.waiting = handle.getMapState("waiting", "seq long", "ts timestamp, stage string, message string, current int, total int")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        frames = [initialState] if isinstance(initialState, pd.DataFrame) else list(initialState)
        for row in pd.concat(frames).sort_values("seq").itertuples():
            self.last.update((int(row.seq), row.stage, row.stage in TERMINAL, 0))

    def _due(self, at: int) -> None:
        """One timer for each task, moved on with its events."""
        seq, stage, ended, timer = self.last.get() if self.last.exists() else (-1, None, False, 0)
        if timer:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)
        self.last.update((seq, stage, ended, at))

    def _judged(self, seq: int, stage: str) -> str | None:
        """Why an event is rejected; None where it is taken, which moves the state on."""
        before, at, ended, timer = self.last.get() if self.last.exists() else (-1, None, False, 0)
        if seq <= before:
            return "repeated"
        reason = "after end" if ended else "unknown stage" if stage not in ORDER and stage not in TERMINAL else None
        if reason is None and stage != "failed" and at is not None and ORDER[stage] < ORDER.get(at, 0):
            reason = "backwards"
        self.last.update((seq, at if reason else stage, ended or (reason is None and stage in TERMINAL), timer))
        return reason

    def _released(self, everything: bool) -> list[tuple]:
        """Waiting events whose turn it is, in order; all of them where a gap has lasted too long."""
        out = []
        for seq, event in sorted(((k[0], v) for k, v in self.waiting.iterator()), key=lambda x: x[0]):
            before = self.last.get()[0] if self.last.exists() else -1
            if everything or seq <= before + 1:
                self.waiting.removeKey((seq,))
                out.append((seq, *event, self._judged(seq, event[1])))
        return out

    def _frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        columns = ["seq", "ts", "stage", "message", "current", "total", "reason"]
        frame = pd.DataFrame(rows, columns=columns)
        frame.insert(0, "task_id", key[0])
        return frame.astype({"seq": "int64", "ts": "datetime64[us]", "current": "Int32", "total": "Int32"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["seq", "ts"], kind="stable")
        out, newest = [], 0
        for e in events.itertuples():
            event = (e.ts.to_pydatetime(), e.stage, e.message, _whole(e.current), _whole(e.total))
            newest = max(newest, int(e.ts.timestamp() * 1000))
            before = self.last.get()[0] if self.last.exists() else -1
            if self.patience_ms and e.seq > before + 1 and self.last.exists():
                if self.waiting.containsKey((e.seq,)):
                    out.append((e.seq, *event, "repeated"))
                else:
                    self.waiting.updateValue((e.seq,), event)
                continue
            out.append((e.seq, *event, self._judged(e.seq, e.stage)))
            if self.patience_ms:
                out += self._released(False)
        self._due(newest + self._span())
        if out:
            yield self._frame(key, out)

    def _span(self) -> int:
        if self.last.exists() and self.last.get()[2]:
            return self.keep_ms
        return self.patience_ms if self.patience_ms and any(True for _ in self.waiting.iterator()) else self.silence_ms

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self._released(True)
        seq, stage, ended, _ = self.last.get() if self.last.exists() else (-1, None, False, 0)
        if out:  # the gap is given up; the task goes on
            at = expiredTimerInfo.getExpiryTimeInMs() + (self.keep_ms if ended else self.silence_ms)
            self.handle.registerTimer(at)
            self.last.update((seq, stage, ended, at))
            yield self._frame(key, out)
        else:
            self.last.clear()
            self.waiting.clear()

    def close(self) -> None:
        pass


def _whole(x) -> int | None:
    return None if pd.isna(x) else int(x)


def feed(
    events: DataFrame, *, snapshot: DataFrame | None = None, late: str = "1 hour", patience_ms: int = 0, keep_ms: int = DAY, silence_ms: int = 30 * DAY
) -> DataFrame:
    """A stream of (task_id, seq, ts, stage, message, current, total, reason): updates (no reason) and rejected events."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    columns = [c.split(" ")[0] for c in EVENT.split(", ")]
    known = events.select(*columns).fillna({"seq": 0, "stage": "", "task_id": ""}).withColumn("ts", F.coalesce("ts", F.lit(datetime(1970, 1, 1, tzinfo=UTC))))
    start = None if snapshot is None else snapshot.select("task_id", "seq", "stage").groupBy("task_id")
    processor = TaskFeed(patience_ms, keep_ms, silence_ms)
    return known.withWatermark("ts", late).groupBy("task_id").transformWithStateInPandas(processor, FEED, "Append", "EventTime", start)


def subscribe(
    events: DataFrame, path: str, checkpoint: str, *, snapshot: DataFrame | None = None, on_batch: Callable[[DataFrame, int], None] | None = None, **options
):
    """Run the feed until its input is used up. `updates` and `rejected` below `path` get a folder for each batch, and the
    first batch of updates begins with the snapshot; a repeated batch overwrites itself."""
    first = None if snapshot is None else snapshot.select(*[c.split(" ")[0] for c in EVENT.split(", ")])

    def save(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        updates = batch.where("reason is null").drop("reason")
        if number == 0 and first is not None:
            updates = first.unionByName(updates)
        updates.write.mode("overwrite").parquet(f"{path}/updates/batch={number}")
        batch.where("reason is not null").write.mode("overwrite").parquet(f"{path}/rejected/batch={number}")
        if on_batch:
            on_batch(batch, number)
        batch.unpersist()

    query = feed(events, snapshot=snapshot, **options).writeStream.outputMode("append").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
