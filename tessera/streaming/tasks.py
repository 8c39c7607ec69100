"""Long-running tasks as streams of events: latest state, the state machine, expiry; and windows on event time.

Events: task_id, ts (timestamp), status, progress.  The same transition serves batch and stream.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A task's states; the last three are final.
STATES = ("pending", "running", "completed", "failed", "cancelled")
FINAL = STATES[2:]
EXPIRY = "24 hours"


def step(state: tuple[str, float], status: str | None, progress: float | None) -> tuple[tuple[str, float], bool]:
    """The state after an event, and whether the event was accepted: final states take none, and none goes back to pending."""
    now, done = state
    if status not in STATES or now in FINAL or (status == "pending" and now != "pending"):
        return state, False
    if progress is not None:
        done = min(1.0, max(0.0, progress))
    return (status, 1.0 if status == "completed" else done), True


def latest(events: DataFrame) -> DataFrame:
    """The newest event of each task; for streams in update mode too."""
    newest = events.groupBy("task_id").agg(F.max_by(F.struct("ts", "status", "progress", "event_id"), F.struct("ts", "event_id")).alias("e"), F.count(F.lit(1)).alias("n"))
    return newest.select("task_id", "e.*", "n", F.col("e.status").isin(*FINAL).alias("final"))


def progress_json(events: DataFrame) -> DataFrame:
    """Events as the messages that a listener gets."""
    return events.select("event_id", F.to_json(F.struct("task_id", "status", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "progress")).alias("progress"))).alias("data"))


def _fold(key, frames: Iterator, state) -> Iterator:
    import pandas as pd

    now, taken, refused = tuple(state.get) if state.exists else ("pending", 0.0, 0, 0), 0, 0
    status, progress, taken, refused = now
    for rows in frames:
        for r in rows.sort_values(["ts", "event_id"]).itertuples():
            (status, progress), ok = step((status, progress), r.status, None if pd.isna(r.progress) else r.progress)
            taken, refused = taken + ok, refused + (not ok)
    state.update((status, progress, taken, refused))
    yield pd.DataFrame({"task_id": [key[0]], "status": [status], "progress": [progress], "accepted": [taken], "refused": [refused]})


def task_states(stream: DataFrame) -> DataFrame:
    """(task_id, status, progress, accepted, refused) of a stream's tasks, by the state machine; update mode."""
    return stream.groupBy("task_id").applyInPandasWithState(
        _fold, "task_id long, status string, progress double, accepted long, refused long", "status string, progress double, accepted long, refused long", "update", "NoTimeout"
    )


def folded(events: DataFrame) -> DataFrame:
    """The same over a whole table, natively: an ordered fold over each task's events."""
    item = F.struct("ts", "event_id", "status", "progress")
    start = F.struct(F.lit("pending").alias("status"), F.lit(0.0).alias("progress"), F.lit(0).cast("long").alias("accepted"), F.lit(0).cast("long").alias("refused"))

    def move(s, e):
        ok = F.coalesce(e["status"].isin(*STATES) & ~s["status"].isin(*FINAL) & ~((e["status"] == "pending") & (s["status"] != "pending")), F.lit(False))
        clamped = F.when(e["status"] == "completed", 1.0).otherwise(F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), e["progress"])), s["progress"]))
        return F.struct(
            F.when(ok, e["status"]).otherwise(s["status"]).alias("status"), F.when(ok, clamped).otherwise(s["progress"]).alias("progress"),
            (s["accepted"] + ok.cast("long")).alias("accepted"), (s["refused"] + (~ok).cast("long")).alias("refused"),
        )

    lists = events.groupBy("task_id").agg(F.array_sort(F.collect_list(item)).alias("es"))
    return lists.select("task_id", F.aggregate("es", start, move).alias("s")).select("task_id", "s.*")


def unexpired(tasks: DataFrame, now, hours: int = 24) -> DataFrame:
    """Tasks but for final ones that ended too long ago."""
    return tasks.where(~(F.col("final") & (F.col("ts") < now - F.expr(f"interval {hours} hours"))))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str | None = "2 hours") -> DataFrame:
    """Events by window and status; on a stream, rows later than the watermark are dropped."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", width).alias("w"), "status").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "status", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each task: bursts of events with no longer gap between them."""
    rows = events.groupBy("task_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("task_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once_within(stream: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """A stream without repeats of a key within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
