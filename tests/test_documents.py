import json

from pyspark.sql import functions as F

from tessera.operators import graph_documents, validation

NODE = "tenant int, id string, label string, kind string, class_label string, properties map<string,string>"
EDGE = "tenant int, src string, dst string, relation string"


def test_graphs_come_back_as_they_were(spark):
    nodes = [(1, "b", "x", "N", "C", {"k": "1", "ü": '"'}), (1, "a", None, "N", None, None), (2, "a", "y", None, "D", {})]
    edges = [(1, "a", "b", "R"), (1, "a", "b", "R"), (3, "q", "r", None)]
    docs = graph_documents.stored(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE))
    assert docs.count() == 3
    got = graph_documents.nodes(docs)
    flat = lambda rows: sorted(repr((*r[:5], r[5] and sorted(r[5].items()))) for r in rows)
    assert flat((r.tenant, r.id, r.label, r.kind, r.class_label, r.properties) for r in got.collect()) == flat(nodes)
    assert sorted(map(repr, ((r.tenant, r.src, r.dst, r.relation) for r in graph_documents.edges(docs).collect()))) == sorted(map(repr, edges))
    assert sorted(map(tuple, graph_documents.counts(docs).collect())) == [(1, 2, 2), (2, 1, 0), (3, 0, 1)]
    said = graph_documents.schema(docs)
    assert "nodes" in said and "ARRAY" in said and "properties" in said
    assert "Generate" in got._jdf.queryExecution().optimizedPlan().toString()


def test_broken_and_odd_documents(spark):
    texts = [
        '{"nodes": [{"id": "a"}, 7, {"label": "no id"}, null, {"id": 5, "label": true, "properties": [1]}], "edges": [{"src": "a"}, {"src": "a", "dst": "b"}]}', '{"nodes": [{"id": "cut', "", "[1]", '"x"', "7", "null", None, "{}",
        '{"nodes": null, "edges": 3}', json.dumps({"nodes": [{"id": "z", "label": "long " * 20_000}], "more": 1}),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "tenant int, document string")
    assert sorted(r.tenant for r in graph_documents.errors(docs).collect()) == [1, 2, 3, 4, 5, 6]
    got = {(r.tenant, r.id): (r.label, r.properties) for r in graph_documents.nodes(docs).collect()}
    assert got.keys() == {(0, "a"), (0, "5"), (10, "z")} and got[0, "5"] == ("true", None) and len(got[10, "z"][0]) == 100_000
    assert [(r.tenant, r.src, r.dst) for r in graph_documents.edges(docs).collect()] == [(0, "a", "b")]
    assert sorted(map(tuple, graph_documents.counts(docs).collect())) == [(0, 5, 2), (8, 0, 0), (9, 0, 0), (10, 1, 0)]
    none = docs.limit(0)
    assert graph_documents.nodes(none).count() == graph_documents.errors(none).count() == graph_documents.counts(none).count() == 0


def test_rows_with_their_reasons(spark):
    rows = spark.createDataFrame([("r", "a", "b", 1), (None, " ", "b", 2), ("r", "a", "　", 3), ("", None, None, 4), ("r", "a", "b", 1)], "relation string, source string, target string, reasons int")
    rows = rows.withColumnRenamed("reasons", "n")
    rules = validation.rules_of(rows, "link") | {"n is 3": F.col("n") == 3, "never": F.lit(None).cast("boolean")}
    found = validation.split(rows, rules)
    assert found.counts == {"rows": 5, "accepted": 2, "refused": 3, "relation is blank": 2, "source is blank": 2, "target is blank": 2, "n is 3": 1, "never": 0}
    assert [tuple(r) for r in found.accepted.collect()] == [("r", "a", "b", 1)] * 2 and found.accepted.columns == rows.columns
    assert {r.n: r.reasons for r in found.refused.collect()} == {2: ["relation is blank", "source is blank"], 3: ["target is blank", "n is 3"], 4: ["relation is blank", "source is blank", "target is blank"]}
    for kind in validation.REQUIRED:
        assert all(r.reasons for r in validation.checked(rows.select("n"), validation.rules_of(rows.select("n"), kind)).collect())
    empty = validation.split(rows.limit(0), rules)
    assert set(empty.counts.values()) == {0} and empty.accepted.count() == empty.refused.count() == 0


def test_large_graphs_have_several_documents(spark, monkeypatch):
    monkeypatch.setattr(graph_documents, "MOST", 10)
    nodes = spark.range(100).select(F.when(F.col("id") % 2 == 0, 1).alias("tenant"), F.format_string("n%03d", "id").alias("id"), F.lit("x").alias("label"))
    edges = spark.range(3).select(F.lit(2).alias("tenant"), F.lit("a").alias("src"), F.lit("b").alias("dst"), F.col("id").cast("string").alias("relation"))
    docs = graph_documents.stored(nodes, edges).collect()
    many = {t: [d.document for d in docs if d.tenant == t] for t in (1, None, 2)}
    assert len(many[2]) == 1 and all(len(many[t]) > 1 and max(x.count('"id"') for x in many[t]) < 30 for t in (1, None))
    docs = spark.createDataFrame(docs, "tenant int, document string")
    assert {tuple(r) for r in graph_documents.counts(docs).collect()} == {(1, 50, 0), (None, 50, 0), (2, 0, 3)}
    assert sorted(r.id for r in graph_documents.nodes(docs).collect()) == [f"n{i:03d}" for i in range(100)]
