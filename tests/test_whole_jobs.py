"""Registered queries and operators do the whole job, on inputs that a cut would show."""

import math
import operator

from pyspark.sql import functions as F

import __spark_entry__
from tessera import storage
from tessera.operators import graph, vector
from tessera.plans import catalog


def test_flagship_joins_all_customers(spark, tmp_path):
    for name, columns, rows in [
        ("customer", "c_custkey long, c_name string", [(1, "a"), (21, "b"), (5000, "c")]),
        ("orders", "o_orderkey long, o_custkey long", [(10, 1), (11, 21), (12, 5000)]),
        ("lineitem", "l_orderkey long, l_partkey long, l_quantity double", [(10, 7, 1.0), (11, 7, 2.0), (12, 7, 3.0), (12, 7, 4.0)]),
        ("part", "p_partkey long, p_name string", [(7, "p")]),
    ]:
        spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{name}.parquet")
    found = __spark_entry__.queries()[catalog.FLAGSHIP](spark, str(tmp_path))
    assert sorted((r.subject, r.customer, r.quantity) for r in found.collect()) == [("order 10", "a", 1), ("order 11", "b", 2), ("order 12", "c", 7)]


def test_vector_search_takes_any_number_of_queries(spark, monkeypatch):
    monkeypatch.setattr(vector, "MOST_QUERIES", 3)
    monkeypatch.setattr(vector, "PACK", 4, raising=False)
    rows = [(i, [float(i % 7), float(i % 3), 1.0]) for i in range(40)] + [(90, [0.0, 0.0, 0.0]), (91, [1.0]), (92, None)]
    v = spark.createDataFrame(rows, "vec_id int, embedding array<float>").repartition(3)
    asked = [(i, x) for i, x in rows if i % 3 == 0]
    got = vector.top_k(v, spark.createDataFrame(asked, "query_id int, embedding array<float>"), 3)
    want = []
    for q, x in asked:
        if not x or not any(x):
            continue
        size = lambda y: math.sqrt(sum(z * z for z in y))
        best = sorted((-sum(map(operator.mul, x, y)) / (size(x) * size(y)), i) for i, y in rows if y and len(y) == len(x) and any(y))[:3]
        want += [(q, i, round(-s, 6), n + 1) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_closure_has_no_depth_limit(spark):
    n = 300
    up = graph.closure(spark.createDataFrame([(i, i + 1) for i in range(n)], "child int, parent int"))
    assert up.count() == (n + 1) * (n + 2) // 2
    assert up.where(F.col("depth") != F.col("ancestor") - F.col("child")).count() == 0
    links = spark.createDataFrame([(0, n), (n, 0)], "class int, expected int")
    assert [r["class"] for r in graph.ancestor_violations(links, up).collect()] == [n]
    values = spark.createDataFrame([(n, "top")], "node int, value string")
    assert graph.nearest_value(up, values).where("node = 0").first().value == "top"
    assert graph.closure(spark.createDataFrame([(i, i + 1) for i in range(9)], "child int, parent int"), 5).agg(F.max("depth")).first()[0] == 5


def test_written_tables_can_be_forgotten(spark):
    from pathlib import Path

    storage.forget(spark)
    kept = storage.written(spark.range(5), "five")
    folder = Path(storage.shared_dir(spark).removeprefix("file://"))
    assert kept.count() == 5 and len(list(folder.glob("five-*"))) == 1
    assert storage.forget(spark) == 1 and not list(folder.glob("five-*")) and storage.forget(spark) == 0
