import random

from tessera.operators import graph_sync

KIND = "tenant int, id string, label string, props map<string,string>"


def state(rows, old=(), tenants=()):
    """What the store should hold: the tenants named are replaced, the others stay."""
    named = {r[0] for r in rows} | set(tenants)
    new = {(r[0], r[1]): r for r in old if r[0] not in named}
    new |= {(r[0], r[1]): r for r in rows}
    return new


def by_hand(before, after):
    said = {("added", *k) for k in after.keys() - before.keys()} | {("removed", *k) for k in before.keys() - after.keys()}
    return said | {("changed", *k) for k in after.keys() & before.keys() if after[k] != before[k]}


def made(seed, tenants):
    pick = random.Random(seed)
    return [(t, f"n{i}", pick.choice(["a", "b", None, ""]), {"k": str(i), "j": None} if i % 3 else None) for t in tenants for i in range(60)]


def held(store):
    return {(r.tenant, r.id): (r.tenant, r.id, r.label, r.props) for r in store.rows().collect()}


def test_change_set_equals_a_full_comparison(spark, tmp_path):
    pick = random.Random(1)
    old = made(1, [*range(12), None])
    store = graph_sync.Store(spark, f"{tmp_path}/s", ["id"]).create(spark.createDataFrame(old, KIND))
    before = state(old)
    assert held(store) == before
    for turn in range(3):
        rows = [r for r in before.values() if r[0] in (1, 2, None, 5 + turn)]
        rows = [(t, i, pick.choice([x, x, x, "new"]), p) for t, i, x, p in rows if pick.random() > 0.1] + [(2, f"more{turn}", "x", {"k": "1"}), (100 + turn, "first", None, None), (None, None, "y", {})]
        gone = [9] if turn == 2 else []
        after = state(rows, list(before.values()), gone)
        frame, out = spark.createDataFrame(rows, KIND).repartition(3), spark.createDataFrame([(t,) for t in gone], "tenant int")
        said = store.changes(frame, out)
        assert {tuple(r) for r in said.collect()} == by_hand(before, after) and said.columns == ["change", "tenant", "id"]
        assert {tuple(r) for r in store.update(frame, out).collect()} == by_hand(before, after)
        assert held(store) == after
        assert store.changes(frame, out).count() == 0
        before = after
    assert store.update(spark.createDataFrame([], KIND), spark.createDataFrame([(t,) for t in {k[0] for k in before}], "tenant int")).count() == len(before)
    assert store.rows().count() == 0


def test_what_is_alike_is_not_read(spark, tmp_path):
    """The plan's metrics: of the store's files, only those of the shards that differ are opened, and none where nothing does."""
    old = made(2, range(40))
    store = graph_sync.Store(spark, f"{tmp_path}/s", ["id"]).create(spark.createDataFrame(old, KIND))

    def opened(rows):
        unlike, _ = store._differing(graph_sync._placed(spark.createDataFrame(rows, KIND), ["id"]), None)
        found = store._stored(unlike)
        found.collect()
        plan, todo, files = found._jdf.queryExecution().executedPlan(), [], 0
        todo.append(plan)
        while todo:
            p = todo.pop()
            if p.nodeName() == "AdaptiveSparkPlan":
                todo.append(p.executedPlan())
                continue
            if p.nodeName().endswith("QueryStage"):
                todo.append(p.plan())
                continue
            if p.nodeName().startswith("Scan parquet") and "shard" in p.toString() and "slot" in p.toString():
                files += p.metrics().apply("numFiles").value()
            todo += [p.children().apply(i) for i in range(p.children().size())]
        return files

    whole = store.rows().inputFiles()
    assert opened(old) == 0 and len(whole) > 30
    changed = [(t, i, "other" if (t, i) == (7, "n5") else x, p) for t, i, x, p in old]
    assert 1 <= opened(changed) <= 2
