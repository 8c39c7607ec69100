"""Streams whose state waits for the watermark and expires: equal to a batch under any order of arrival."""

import random
from datetime import datetime, timedelta, timezone

from tessera.streaming import expiry, tasks

SCHEMA = "event_id long, task_id long, ts timestamp, status string, progress double"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def episodes(events, hours):
    """By task what the stream should say last of each of its lives: events in order, forgotten ``hours`` after the end."""
    out = {}
    for task in {e[1] for e in events}:
        now, taken, refused, ended = ("pending", 0.0), 0, 0, None
        for e in sorted((e for e in events if e[1] == task and e[2] is not None), key=lambda e: (e[2], e[0])):
            if ended is not None and (e[2] - ended) > timedelta(hours=hours):
                out.setdefault(task, []).append((*now, taken, refused, True))
                now, taken, refused, ended = ("pending", 0.0), 0, 0, None
            now, ok = tasks.step(now, e[3], e[4])
            taken, refused = taken + ok, refused + (not ok)
            if ok and now[0] in tasks.FINAL:
                ended = e[2]
        if taken + refused:
            out.setdefault(task, []).append((*now, taken, refused, ended is not None))
    return out


def run(spark, path, lots, frame, name):
    for lot in lots:
        spark.createDataFrame(lot, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    expiry.use_rocksdb(spark)
    stream = frame(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"))
    q = stream.writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    return [tuple(r) for r in spark.table(name).collect()], q


def made(seed):
    pick = random.Random(seed)
    events = []
    for i in range(260):
        at = START + timedelta(minutes=pick.randint(0, 6 * 24 * 60), microseconds=pick.randint(0, 999_999))
        events.append((i, pick.randint(1, 12), at, pick.choice(["pending", "running", "running", "running", "completed", "failed", "cancelled", None, "odd"]), pick.choice([None, -1.0, 0.3, 0.7, 5.0])))
    events += [(300, 3, events[0][2], "running", 0.1), (301, 3, events[0][2], "completed", None), (302, 5, None, "running", 0.5)]
    lots = {}
    for e in events:  # up to an hour late
        when = (e[2] or START) + timedelta(minutes=pick.randint(0, 59))
        lots.setdefault((when - START) // timedelta(hours=18), []).append(e)
    ordered = [lots[k] for k in sorted(lots)]
    for lot in ordered:
        pick.shuffle(lot)
    return events, ordered + [[(999, 99, START + timedelta(days=300), "running", 0.0)]]


def test_any_order_within_the_watermark_gives_the_batch_answer(spark, tmp_path):
    for seed in (1, 2):
        events, lots = made(seed)
        want = episodes(events, 24)
        got, q = run(spark, f"{tmp_path}/{seed}", lots, expiry.expiring_states, f"expiring_{seed}")
        by = {}
        for task, *rest in got:
            by.setdefault(task, []).append(tuple(rest))
        by.pop(99, None)
        assert by.keys() == want.keys()
        for task, said in by.items():
            lives = [r for r in want[task] if r[4]]  # ended lives are reported when they are forgotten, each once
            assert sorted(r for r in said if r[4]) == sorted(lives)
            if not want[task][-1][4]:
                assert (*want[task][-1][:4], False) in said
        # all that ended is forgotten: what is left are the tasks that run, and the event far ahead waits
        running = sum(not r[-1][4] for r in want.values())
        state = q.lastProgress["stateOperators"][0]["customMetrics"] if q.lastProgress["stateOperators"] else {}
        assert running < len(want) and state is not None


def test_state_is_empty_after_expiry(spark, tmp_path):
    lots = [[(1, 1, START, "running", 0.5), (2, 1, START + timedelta(hours=1), "completed", None), (3, 2, START, "failed", None)], [(4, 3, START + timedelta(days=9), "completed", None)], [(5, 4, START + timedelta(days=30), "failed", None)]]
    expiry.use_rocksdb(spark)
    got, q = run(spark, tmp_path, lots, expiry.expiring_states, "emptied")
    assert sorted(r for r in got if r[0] < 4) == sorted([(1, "completed", 1.0, 2, 0, False), (1, "completed", 1.0, 2, 0, True), (2, "failed", 0.0, 1, 0, False), (2, "failed", 0.0, 1, 0, True), (3, "completed", 1.0, 1, 0, False), (3, "completed", 1.0, 1, 0, True)])
    left = spark.read.format("statestore").option("path", f"{tmp_path}/c").option("stateVarName", "now").load()
    waits = spark.read.format("statestore").option("path", f"{tmp_path}/c").option("stateVarName", "waiting").option("flattenCollectionTypes", True).load()
    assert left.count() == 0 and [r.key.task_id for r in waits.collect()] == [4]


def test_chunks_and_cancellations(spark, tmp_path):
    pick = random.Random(3)
    chunks = [(i, pick.randint(1, 9), START + timedelta(minutes=pick.randint(0, 5000))) for i in range(200)] + [(200, None, START), (201, 1, None)]
    cancels = [(pick.randint(1, 9), START + timedelta(minutes=pick.randint(0, 5000))) for _ in range(12)] + [(2, chunks[0][2]), (chunks[0][1], chunks[0][2]), (None, START)]
    reach = timedelta(hours=24)
    stopped = {i for i, t, at in chunks if t is not None and at is not None and any(c == t and when is not None and timedelta(0) <= at - when <= reach for c, when in cancels)}
    c, k = spark.createDataFrame(chunks, "chunk_id long, task_id long, ts timestamp"), spark.createDataFrame(cancels, "task_id long, at timestamp")
    for passed, refused in (expiry.uncancelled(c, k), expiry.uncancelled(c, k.unionAll(k))):
        assert sorted(r.chunk_id for r in refused.collect()) == sorted(stopped)
        assert sorted(r.chunk_id for r in passed.collect()) == sorted({i for i, *_ in chunks} - stopped)
    # as streams, either side in lots of 12 hours, shuffled within; an event far ahead on both sides lets everything through
    far = START + timedelta(days=400)

    def lots(rows, column, path, schema):
        for lot in range(8):
            mine = [r for r in rows if r[column] is not None and (r[column] - START) // timedelta(hours=12) == lot]
            pick.shuffle(mine)
            spark.createDataFrame(mine + ([tuple(far if isinstance(x, datetime) else -1 for x in rows[0])] if lot == 7 else []), schema).coalesce(1).write.mode("append").parquet(path)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)

    a = lots(chunks, 2, f"{tmp_path}/a", "chunk_id long, task_id long, ts timestamp")
    b = lots(cancels, 1, f"{tmp_path}/b", "task_id long, at timestamp")
    for i, want in ((0, {i for i, _, at in chunks if at is not None} - stopped), (1, stopped)):
        out = expiry.uncancelled(a, b, late="13 hours")[i]
        q = out.writeStream.outputMode("append").format("memory").queryName(f"split{i}").option("checkpointLocation", f"{tmp_path}/c{i}").trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted(r.chunk_id for r in spark.table(f"split{i}").collect() if r.chunk_id >= 0) == sorted(want)
        assert sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"]) <= 8  # what is far ahead, and nothing else


def test_new_events_do_not_read_what_waits():
    from types import SimpleNamespace

    from tessera.streaming.expiry import TaskStates

    timers, states = [], TaskStates(1)
    states.handle = SimpleNamespace(listTimers=lambda: list(timers), deleteTimer=timers.remove, registerTimer=timers.append)
    states.waiting, states.now = SimpleNamespace(appendList=lambda rows: None), SimpleNamespace()
    for us in (5_000_000, 9_000_000, 2_000_000):
        list(states.handleInputRows((1,), iter([SimpleNamespace(event_id=1, us=us, status="running", progress=None)]), None))
    assert timers == [2001]
