"""Task states from a stream in any order of arrival, forgotten when they are old; and chunks held against cancellations.

``expiring_states`` keeps a task's events in list state until the watermark has passed them, so that nothing earlier can still come, and then takes them
through the state machine in order of event time.  One timer a task wakes it: at its next event, or, once it has ended and nothing waits, ``hours`` after its end, when its
state is dropped.  What comes for a task after that begins anew, as it does where old tasks are removed.  State is bounded by the events within the
watermark's delay and by the tasks that run or ended within ``hours``.

The state store must keep list state and timers: RocksDB's (``use_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.streaming.tasks import FINAL, step

LATE, HOURS = "2 hours", 24
STATE = "status string, progress double, accepted long, refused long, ended long"
OUTPUT = "task_id long, status string, progress double, accepted long, refused long, expired boolean"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store for streams that are started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class TaskStates(StatefulProcessor):
    """The state machine over a task's events, in order of event time."""

    def __init__(self, hours: float):
        self.keep_ms = int(hours * 3_600_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "event_id long, us long, status string, progress double")
        self.now = handle.getValueState("now", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r.event_id, r.us, r.status, r.progress) for r in rows if r.us is not None]
        if new:
            self.waiting.appendList(new)
            self._wake(min(us for _, us, *_ in new) // 1000 + 1)
        return iter(())

    def _wake(self, at: int) -> None:
        """One timer: behind the first event that waits, or where an ended task is forgotten.  What waits isn't read for it: the timer there is stands for that."""
        timers = list(self.handle.listTimers())
        if not timers or at < min(timers):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = sorted(self.waiting.get(), key=lambda e: (e[1], e[0]))
        due, rest = [e for e in held if e[1] // 1000 < mark], [e for e in held if e[1] // 1000 >= mark]
        status, progress, taken, refused, ended = tuple(self.now.get()) if self.now.exists() else ("pending", 0.0, 0, 0, None)
        known, out = self.now.exists(), []
        said = lambda gone: Row(task_id=key[0], status=status, progress=progress, accepted=taken, refused=refused, expired=gone)
        for _, us, new, done in due:
            if ended is not None and us // 1000 > ended + self.keep_ms:  # the task had been forgotten by then
                out.append(said(True))
                status, progress, taken, refused, ended = "pending", 0.0, 0, 0, None
            (status, progress), ok = step((status, progress), new, done)
            taken, refused, known = taken + ok, refused + (not ok), True
            if ok and status in FINAL:
                ended = us // 1000
        self.waiting.put(rest) if rest else self.waiting.clear()
        if due:
            out.append(said(False))
        if known and ended is not None and ended + self.keep_ms < mark:
            out.append(said(True))
            self.now.clear()
            ended = None
        elif known:
            self.now.update((status, progress, taken, refused, ended))
        times = [us // 1000 + 1 for _, us, *_ in rest] + ([ended + self.keep_ms + 1] if ended is not None else [])
        if times:  # later than the timer that has expired, which Spark deletes
            self.handle.registerTimer(min(times))
        return iter(out)

    def close(self) -> None:
        pass


def expiring_states(stream: DataFrame, hours: float = HOURS, late: str = LATE) -> DataFrame:
    """(task_id, status, progress, accepted, refused, expired) of a stream of events (event_id, task_id, ts, status, progress), update mode.

    A row each time that events have been taken, and one with ``expired`` when the task is forgotten.  Events without time are left out, later ones than ``late`` are
    dropped by the watermark; a null task is a task like any other; events of one time go by event_id.
    """
    rows = stream.withWatermark("ts", late).select("event_id", "task_id", "ts", F.unix_micros("ts").alias("us"), "status", "progress")
    return rows.groupBy("task_id").transformWithState(TaskStates(hours), OUTPUT, "Update", "EventTime")


def uncancelled(chunks: DataFrame, cancels: DataFrame, within: str = "24 hours", late: str = LATE) -> tuple[DataFrame, DataFrame]:
    """The chunks (task_id, ts, ...) that come before any cancellation (task_id, at) of their task, and those at or after one, at most ``within`` after it.

    Of two streams either result is a stream-stream join that the watermarks bound: a chunk waits until no cancellation before it can come any more, a
    cancellation until no chunk within its reach can.  Of two tables it is the same answer at once.  Chunks without task or time are never cancelled; of streams, those without time aren't returned.
    """
    waits = chunks.withWatermark("ts", late) if chunks.isStreaming else chunks
    stops = cancels.select(F.col("task_id").alias("_task"), F.col("at").alias("_at"))
    stops = stops.withWatermark("_at", late) if cancels.isStreaming else stops
    meets = (F.col("task_id") == F.col("_task")) & (F.col("_at") <= F.col("ts")) & (F.col("_at") >= F.col("ts") - F.expr(f"interval {within}"))
    passed = waits.join(stops, meets, "left_outer").where("_task is null").select(*chunks.columns)
    return passed, waits.join(stops, meets, "left_semi")
