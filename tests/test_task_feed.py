"""The live feed of tasks: order, repeats, illegal steps, waiting, the snapshot at the start, and state that goes."""

import datetime as dt

from texloom.streaming import task_feed

START = dt.datetime(2024, 1, 1)
HOUR = 3_600_000


def put(spark, folder, rows):
    """A batch of (task, seq, hour, stage)."""
    full = [(t, q, START + dt.timedelta(hours=h), s, "m", 1, 2) for t, q, h, s in rows]
    spark.createDataFrame(full, task_feed.EVENT).coalesce(1).write.mode("append").parquet(str(folder))


def run(spark, tmp_path, batches, **options):
    got = []
    for rows in batches:
        put(spark, tmp_path / "in", rows)
        stream = spark.readStream.schema(task_feed.EVENT).parquet(str(tmp_path / "in"))
        query = task_feed.subscribe(stream, str(tmp_path / "out"), str(tmp_path / "check"), **options)
        got.append(query)
    read = lambda kind, *more: sorted((r.task_id, r.seq, r.stage, *[r[m] for m in more]) for r in spark.read.parquet(str(tmp_path / "out" / kind)).collect())
    return read("updates"), read("rejected", "reason"), got


def test_steps_are_checked_and_repeats_told_apart(spark, tmp_path):
    batches = [
        [("a", 1, 0, "queued"), ("a", 3, 1, "merging"), ("a", 2, 1, "translating"), ("b", 1, 0, "downloading"), ("b", 2, 0, "nonsense")],
        [("a", 3, 1, "merging"), ("a", 4, 2, "splitting"), ("a", 5, 2, "done"), ("b", 3, 2, "failed")],
        [("a", 6, 3, "queued"), ("b", 3, 2, "failed"), ("b", 4, 3, "done")],
    ]
    updates, rejected, _ = run(spark, tmp_path, batches)
    assert updates == [("a", 1, "queued"), ("a", 2, "translating"), ("a", 3, "merging"), ("a", 5, "done"), ("b", 1, "downloading"), ("b", 3, "failed")]
    assert rejected == [
        ("a", 3, "merging", "repeated"), ("a", 4, "splitting", "backwards"), ("a", 6, "queued", "after end"),
        ("b", 2, "nonsense", "unknown stage"), ("b", 3, "failed", "repeated"), ("b", 4, "done", "after end"),
    ]


def test_late_events_fill_a_gap_and_come_in_order(spark, tmp_path):
    batches = [[("a", 0, 0, "queued"), ("a", 2, 0, "translating"), ("a", 3, 0, "merging")], [("a", 1, 0, "splitting"), ("a", 2, 0, "translating")]]
    updates, rejected, _ = run(spark, tmp_path, batches, patience_ms=10 * HOUR, late="5 hours")
    assert [u[1] for u in updates] == [0, 1, 2, 3]
    first = {r.seq for r in spark.read.parquet(str(tmp_path / "out" / "updates")).where("batch = 0").collect()}
    assert first == {0} and rejected == [("a", 2, "translating", "repeated")]


def test_a_gap_that_lasts_is_given_up(spark, tmp_path):
    batches = [[("a", 0, 0, "queued"), ("a", 2, 0, "translating")], [("b", 0, 30, "queued")], [("b", 1, 60, "splitting")], [("a", 3, 61, "merging")]]
    updates, rejected, _ = run(spark, tmp_path, batches, patience_ms=2 * HOUR, late="1 hour", keep_ms=100 * HOUR)
    assert [u for u in updates if u[0] == "a"] == [("a", 0, "queued"), ("a", 2, "translating"), ("a", 3, "merging")] and rejected == []


def test_state_goes_after_the_end_of_a_task(spark, tmp_path):
    many = [(f"t{n}", q, 0, s) for n in range(50) for q, s in ((1, "queued"), (2, "done"))]
    batches = [many, [("x", 1, 40, "queued")], [("x", 2, 80, "splitting")], [("x", 3, 81, "merging")]]
    _, rejected, queries = run(spark, tmp_path, batches, keep_ms=10 * HOUR, late="1 hour")
    assert rejected == []
    rows = [sum(s.numRowsTotal for s in q.lastProgress.stateOperators) for q in queries]
    assert rows[0] >= 50 and rows[-1] <= 5, rows


def test_a_snapshot_starts_the_feed(spark, tmp_path):
    snapshot = spark.createDataFrame([("a", 7, START, "translating", "m", 1, 2), ("b", 3, START, "done", "m", 2, 2)], task_feed.EVENT)
    batches = [[("a", 7, 0, "translating"), ("a", 8, 1, "merging"), ("b", 4, 1, "queued"), ("c", 1, 1, "queued")]]
    updates, rejected, _ = run(spark, tmp_path, batches, snapshot=snapshot)
    assert updates == [("a", 7, "translating"), ("a", 8, "merging"), ("b", 3, "done"), ("c", 1, "queued")]
    assert rejected == [("a", 7, "translating", "repeated"), ("b", 4, "queued", "after end")]
