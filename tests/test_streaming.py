"""Task states: batch and stream agree; windows drop late rows."""

from datetime import datetime, timedelta

from tessera.streaming import tasks

SCHEMA = "event_id long, task_id long, ts timestamp, status string, progress double"


def events():
    start = datetime(2024, 1, 1)
    said = [(1, "running", 1.7), (1, "completed", None), (1, "cancelled", 0.2), (2, "pending", -3.0), (2, "running", 0.5), (2, "pending", 0.1), (2, None, 0.9), (3, "failed", None)]
    return [(i, t, start + timedelta(minutes=i), s, p) for i, (t, s, p) in enumerate(said)]


WANT = {1: ("completed", 1.0, 2, 1), 2: ("running", 0.5, 2, 2), 3: ("failed", 0.0, 1, 0)}


def test_step():
    assert tasks.step(("running", 0.3), "running", 1.7) == (("running", 1.0), True)
    assert tasks.step(("completed", 1.0), "cancelled", None) == (("completed", 1.0), False)


def test_fold_in_batch_and_stream(spark, tmp_path):
    rows = spark.createDataFrame(events(), SCHEMA)
    assert {r.task_id: tuple(r)[1:] for r in tasks.folded(rows).collect()} == WANT
    for i in range(2):  # two files, two batches
        rows.where("event_id < 4" if i == 0 else "event_id >= 4").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = tasks.task_states(stream).writeStream.outputMode("update").format("memory").queryName("task_states").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {}
    for r in spark.table("task_states").collect():
        if r.task_id not in got or r.accepted + r.refused > sum(got[r.task_id][2:]):
            got[r.task_id] = tuple(r)[1:]
    assert got == WANT


def test_windows_and_sessions(spark):
    rows = spark.createDataFrame(events(), SCHEMA)
    assert sum(r.n for r in tasks.windowed_counts(rows, "5 minutes", None).collect()) == 8
    assert {(r.task_id, r.n) for r in tasks.sessions(rows, "2 minutes").collect()} == {(1, 3), (2, 4), (3, 1)}
    latest = {r.task_id: r.status for r in tasks.latest(rows).collect()}
    assert latest == {1: "cancelled", 2: None, 3: "failed"}
