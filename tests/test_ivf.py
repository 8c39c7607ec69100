import numpy as np
import pytest

from tessera.operators import ivf, vector


def brute(rows, queries, k, allowed=None):
    out = {}
    for qi, q in queries:
        q = np.array(q, float)
        scored = []
        for i, v, *rest in rows:
            if v is None or len(v) != len(q) or None in v or (allowed and not allowed(*rest)):
                continue
            v = np.array(v, float)
            if np.isfinite(v).all() and np.linalg.norm(v) > 0 and np.linalg.norm(q) > 0:
                scored.append((-float(v @ q / np.linalg.norm(v) / np.linalg.norm(q)), i))
        out[qi] = sorted((round(s, 6), i) for s, i in sorted(scored)[:k])
    return out


def clustered(seed, n, groups=40, size=16):
    pick = np.random.default_rng(seed)
    middle = pick.normal(size=(groups, size)) * 3
    return [(i, (middle[pick.integers(groups)] + pick.normal(size=size)).tolist(), i % 3) for i in range(n)]


KIND = "vec_id long, embedding array<double>, label int"


def test_all_cells_give_the_exact_answer(spark):
    rows = clustered(1, 700) + [(900, None, 0), (901, [], 0), (902, [0.0] * 16, 0), (903, [1.0] * 5, 1), (904, [float("nan")] + [1.0] * 15, 1), (905, [None] + [1.0] * 15, 1), (3, [2.0] * 16, 2)]
    frame = spark.createDataFrame(rows, KIND).repartition(4)
    asked = rows[::20] + [(1000, [0.0] * 16, 0), (1001, None, 0)]
    queries = spark.createDataFrame([r[:2] for r in asked], "query_id long, embedding array<double>")
    index = ivf.build(frame, 12, 16, ("label",))
    for where, allowed in ((None, None), (lambda x: x["label"] == 1, lambda label: label == 1)):
        got = {}
        for r in ivf.search(index, queries, 4, 12, where).collect():
            got.setdefault(r.query_id, []).append((-r.similarity, r.vec_id))
        want = brute(rows, [r[:2] for r in asked if r[1]], 4, allowed)
        assert {q: sorted(x) for q, x in got.items()} == {q: x for q, x in want.items() if x}


def test_few_cells_find_most_where_vectors_gather(spark):
    rows = clustered(2, 4000)
    frame = spark.createDataFrame(rows, KIND)
    queries = frame.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding")
    index = ivf.build(frame, 40)
    exact = vector.top_k(frame, queries, 5)
    r = ivf.recall(ivf.search(index, queries, 5, 4), exact).first()
    assert (r.queries, r.wanted) == (200, 1000) and r.found >= 900
    assert ivf.recall(ivf.search(index, queries, 5, 1), exact).first().found <= r.found


def test_measured_probes_reach_the_recall(spark):
    pick = np.random.default_rng(3)
    rows = [(i, pick.normal(size=12).tolist(), 0) for i in range(1500)]  # no clusters at all
    frame = spark.createDataFrame(rows, KIND)
    queries = frame.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding")
    index = ivf.build(frame, 30)
    n = ivf.probes(index, frame, 5, 0.95)
    assert 1 < n <= 30
    assert ivf.recall(ivf.search(index, queries, 5, n), vector.top_k(frame, queries, 5)).first().found >= 0.9 * 75 * 5


def test_large_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(ivf, "CELL_ROWS", 50)
    rows = [(i, [1.0, i / 100, 0.5], 0) for i in range(600)] + [(600, [-1.0, 0.0, 0.0], 0)]
    frame = spark.createDataFrame(rows, KIND)
    index = ivf.build(frame, 2)
    assert max(index.shares) > 5
    shares = index.packs.selectExpr("cell", "share", "size(ids) as n").groupBy("cell", "share").sum("n").collect()
    assert len(shares) > 6 and max(r[2] for r in shares) < 200
    queries = spark.createDataFrame([(0, [1.0, 3.0, 0.5])], "query_id long, embedding array<double>")
    assert sorted(r.vec_id for r in ivf.search(index, queries, 3, 2).collect()) == [i for _, i in sorted(brute(rows, [(0, [1.0, 3.0, 0.5])], 3)[0], key=lambda x: x[1])]


def test_empty_index_and_text_ids(spark):
    none = spark.createDataFrame([], "vec_id string, embedding array<float>")
    queries = spark.createDataFrame([("q", [1.0, 2.0])], "query_id string, embedding array<float>")
    index = ivf.build(none)
    assert ivf.search(index, queries).count() == 0 and ivf.probes(index, none) == 1
    few = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [2.0, 1.0])], "vec_id string, embedding array<float>")
    assert [(r.vec_id, r["rank"]) for r in ivf.search(ivf.build(few), queries).orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    assert ivf.search(ivf.build(few), queries.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1, 4096])
def test_many_queries_are_dealt(spark, monkeypatch, most):
    monkeypatch.setattr(vector, "MOST_QUERIES", most)
    rows = clustered(5, 300)
    frame = spark.createDataFrame(rows, KIND).repartition(3)
    queries = [(i, v) for i, v, _ in rows[::10]]
    found = vector.top_k(frame, spark.createDataFrame(queries, "query_id long, embedding array<double>"), 3)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((-r.similarity, r.vec_id))
    assert {q: sorted(x) for q, x in got.items()} == brute(rows, queries, 3)
    assert "Cartesian" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()
