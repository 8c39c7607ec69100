import random
import time

import pytest
from pyspark.sql import functions as F

from tessera import storage
from tessera.operators import ancestry


def reach(pairs):
    up, nodes = {}, set()
    for c, p in pairs:
        nodes |= {c, p} - {None}
        if c is not None and p is not None:
            up.setdefault(c, set()).add(p)
    out = {}
    for n in nodes:
        seen, todo = {n}, [n]
        while todo:
            for p in up.get(todo.pop(), ()):
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        out[n] = seen
    return out


def check(spark, pairs, local):
    above = reach(pairs)
    asked = [(a, b) for a in above for b in above] + [("?", "?"), ("?", next(iter(above), "x")), (None, "a")]
    got = ancestry.holds(spark.createDataFrame(asked, "child string, ancestor string"), ancestry.build(spark.createDataFrame(pairs, "child string, parent string"), local))
    want = {(a, b) for a in above for b in above[a]} | {("?", "?")}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


@pytest.mark.parametrize(("seed", "local"), [(0, 10**6), (1, 10**6), (2, 10**6), (3, 10**6), (4, 0)])
def test_cycles_and_several_parents_against_brute_force(spark, seed, local):
    pick = random.Random(seed)
    n = 40
    pairs = [(f"n{pick.randrange(n)}", f"n{pick.randrange(n)}") for _ in range([30, 45, 60, 90, 45][seed])]
    pairs += [(f"c{i}", f"c{(i + 1) % 7}") for i in range(7)] + [("n1", "c3"), ("c5", "n2")]  # a circle, entered and left
    pairs += [("s", "s"), ("lone", None), (None, "top"), pairs[0]]
    check(spark, pairs, local)


def test_trees_with_second_parents(spark):
    check(spark, [(str(i), str(i // 2)) for i in range(1, 120)] + [(str(i), str(i // 3)) for i in range(3, 120, 10)], 10**6)
    check(spark, [(f"leaf{i}", "hub") for i in range(150)] + [("hub", "top"), ("leaf3", "other")], 0)
    check(spark, [], 10)


def test_points_meet_intervals_by_blocks(spark):
    pick = random.Random(5)
    spans = [(pick.choice("ab"), low, low + pick.randrange(60)) for low in (pick.randrange(-150, 0) for _ in range(60))]
    points = [(r, at) for r in "ab" for at in range(-160, 70)]
    found = ancestry._stabbed(spark.createDataFrame(points, "root string, at long"), spark.createDataFrame(spans, "root string, low long, high long"))
    want = sorted({(r, at, low, high) for r, at in points for t, low, high in spans if r == t and low <= at <= high})
    assert sorted((r.root, r["at"], r._low, r._high) for r in found.collect()) == want
    assert "block" in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("n", "local"), [(100_000, 10**6), (2_000, 100)])
def test_long_chain(spark, n, local):
    pairs = spark.range(1, n + 1).select(F.col("id").alias("child"), (F.col("id") - 1).alias("parent"))
    found = ancestry.build(pairs, local)
    asked = [(n, 0), (n, n - 1), (0, n), (5, 5), (n // 2, 1), (1, n // 2), (7, 6), (6, 7)]
    got = ancestry.holds(spark.createDataFrame(asked, "child long, ancestor long"), found).collect()
    assert {(int(a), int(b)) for a, b in got} == {(a, b) for a, b in asked if a >= b}
    assert found.labels.count() == n + 1 and found.extra.count() == 0


def test_links_with_reasons(spark):
    classes = spark.createDataFrame([("Fund", "Product"), ("Bond", "Product"), ("Bank", "Company")], "child string, parent string")
    relations = spark.createDataFrame([("R1", "issues", "Company", "Product"), ("R2", "likes", None, "Fund"), ("R3", "issues", None, None)], "id string, label string, domain string, range string")
    instances = spark.createDataFrame([("i1", "Big Bank", "Bank", 0), ("i2", "A Fund", "Fund", 1), ("i3", "a_fund ", "Bond", 2), ("i4", "Odd", None, 3), ("i5", None, "Fund", 4)], "id string, label string, type_id string, pos int")
    said = [
        ("R1", " Big Bank ", "A Fund", ["i1", "i2"], []), ("issues", "Big Bank", "a_fund", ["i1", "i3"], []), ("R2", "A Fund", "Big Bank", ["i2", "i1"], ["range"]), ("R1", "A Fund", "Big Bank", ["i2", "i1"], ["domain", "range"]),
        ("R9", "nobody", None, [None, None], ["relation", "source", "target"]), ("R3", "Odd", "Odd", ["i4", "i4"], []), ("R1", "Odd", "A Fund", ["i4", "i2"], ["domain"]), (None, "A Fund", "Odd", ["i2", "i4"], ["relation"]),
        ("R1", " Big Bank ", "A Fund", ["i1", "i2"], []),
    ]
    links = spark.createDataFrame([(*s[:3], i) for i, s in enumerate(said)], "relation string, source string, target string, reasons int")
    got = ancestry.validated_links(links.withColumnRenamed("reasons", "n"), relations, instances, ancestry.build(classes)).collect()
    assert len(got) == len(said)
    for r in got:
        assert ([r.source_id, r.target_id], r.reasons) == (said[r.n][3], said[r.n][4]), r
    assert ancestry.validated_links(links.limit(0), relations, instances, ancestry.build(classes)).count() == 0


def test_tables_on_the_way_are_deleted(spark, monkeypatch):
    """Rounds of pointer jumping and what links are checked by don't pile up on disk, and shuffled rows go with their step; slices change nothing."""
    made = storage._written.setdefault(spark.sparkContext.applicationId, [])
    before = len(made)
    found = ancestry.build(spark.createDataFrame([(f"n{i}", f"n{i // 2}") for i in range(1, 40)] + [("n7", "n2")], "child string, parent string"), 0)
    assert len(made) - before == 2 and found.labels.count() == 40 and found.extra.count() >= 1
    relations = spark.createDataFrame([("R1", "is", "n1", "n3"), ("R2", None, None, "n2")], "id string, label string, domain string, range string")
    instances = spark.createDataFrame([(f"i{i}", f"Thing{i}", f"n{i}", i) for i in range(1, 40)], "id string, label string, type_id string, pos int")
    rows = [(i, ["R1", "is", "R2", "R9", None][i % 5], [f"Thing{i % 45}", f" thing_{i % 45}", None][i % 3], f"Thing{i * 7 % 41}") for i in range(300)]
    links = spark.createDataFrame(rows, "n int, relation string, source string, target string")
    whole = ancestry.validated_links(links, relations, instances, found, ["n"])
    assert whole.columns == ["n", "relation_id", "source_id", "target_id", "reasons"]
    want = sorted(map(str, whole.collect()))
    assert len(want) == 300 and len({str(r.reasons) for r in whole.collect()}) > 5
    monkeypatch.setattr(ancestry, "SLICE_ROWS", 100)
    before = len(made)
    assert sorted(map(str, ancestry.validated_links(links, relations, instances, found, ["n"]).collect())) == want
    assert len(made) - before == 4  # the relations and three slices

    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    there = lambda: {str(f) for f in iter_of(files.getAllFiles()) if "shuffle_" in str(f)}
    old = there()
    storage.written(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "sums")
    deadline = time.time() + 20
    while there() - old and time.time() < deadline:
        time.sleep(0.2)
    assert not there() - old


def iter_of(found):
    at = found.iterator()
    while at.hasNext():
        yield at.next()
