"""What shows at larger sizes only: hashes that meet, searches that many questions share, and joins that mustn't be broadcast."""

import re

from pyspark.sql import functions as F

import __spark_entry__
from tessera import storage
from tessera.operators import extraction, matching, merging, questions, retrieval, vector


def tables(spark, folder, **rows):
    for name, (data, columns) in rows.items():
        spark.createDataFrame(data, columns).write.parquet(f"{folder}/{name}.parquet")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def graph(spark, folder):
    """Customers 109436 and 125464 have hashes with the same first eight digits, and so have the actions of orders 5790 and 102418."""
    tables(
        spark, folder,
        region=([(0, "R")], "r_regionkey int, r_name string"), nation=([(1, "N", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        customer=([(109436, "a", 1, "M"), (125464, "b", 1, "M")], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"), supplier=([(7, "S", 1)], "s_suppkey long, s_name string, s_nationkey int"),
        part=([(3, "P", "B", "T", 1)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int"), orders=([(5790, 125464), (102418, 109436), (226956, 1)], "o_orderkey long, o_custkey long"),
        lineitem=([(5790, 3, 7)] * 2, "l_orderkey long, l_partkey long, l_suppkey long"),
    )
    return lambda name: __spark_entry__.queries()[name](spark, str(folder)).collect()


def test_graph_round_trip_where_hashes_meet(spark, tmp_path):
    got = sorted(map(tuple, graph(spark, tmp_path)("graph_round_trip")))
    assert got == [("N", "IN_REGION", "R"), ("P", "SUPPLIED_BY", "S"), ("S", "LOCATED_IN", "N"), ("a", "LIVES_IN", "N"), ("b", "LIVES_IN", "N")]


def test_graph_triples_where_hashes_meet(spark, tmp_path):
    assert all((r.n, r.subjects) == (2, 2) for r in graph(spark, tmp_path)("graph_triples"))


def test_triple_type_counts_where_hashes_meet(spark, tmp_path):
    assert {r.source: r.n for r in graph(spark, tmp_path)("triple_type_counts")} == {"region": 1, "nation": 1, "customer": 2, "supplier": 1, "part": 1}


def test_turtle_lines_where_hashes_meet(spark, tmp_path):
    lines = [r.value for r in graph(spark, tmp_path)("turtle_lines")]
    assert len([x for x in lines if "Node_2945568b" in x]) == 8 and len(lines) == 6 * 2 + 2 + 2 + 5


def test_instance_nodes_where_hashes_meet(spark, tmp_path):
    found = {r.id: r.label for r in graph(spark, tmp_path)("instance_nodes")}
    assert sorted(x for i, x in found.items() if i.startswith("action_")) == ["ship 102418", "ship 226956"] and len(found) == 6


def test_searches_are_made_once_for_all_questions(spark):
    asked = spark.createDataFrame([(i, 'about "BIG"') for i in range(50)] + [(99, "风险等级 of all")], "question long, text string")
    nodes = spark.range(300).select(F.format_string("n%03d", "id").alias("id"), F.lit("NamedIndividual").alias("kind"), F.concat(F.lit("BIG 风险等级 "), (F.col("id") / 2).cast("int").cast("string")).alias("label"), F.create_map().cast("map<string,string>").alias("properties"))
    got = questions.ladder(asked, nodes, spark.createDataFrame([], "src string, dst string, relation string")).collect()
    # the first ten and twenty nodes, of which two each say the same
    assert sorted((r.question, r.rung, r.subject) for r in got) == sorted([(i, 2, f"BIG 风险等级 {k}") for i in range(50) for k in range(5)] + [(99, 3, f"BIG 风险等级 {k}") for k in range(10)])


def test_letters_of_names_are_not_broadcast(spark):
    names = spark.range(200).select(F.concat(F.lit("name "), F.col("id").cast("string")).alias("name"), F.col("id").alias("pos"))
    found = matching.attributes(spark.range(3).select(F.concat(F.lit("eman"), F.col("id").cast("string")).alias("asked")), names)
    assert re.search(r"SortMergeJoin \[c#", plan(found)) and not re.search(r"BroadcastHashJoin \[c#", plan(found))
    assert sorted(map(tuple, found.collect())) == [("eman0", "name 0", 6), ("eman1", "name 1", 6), ("eman2", "name 2", 6)]


def test_many_queries_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(vector, "MOST_QUERIES", 3)
    e = spark.range(40).select("id", F.array(F.col("id") % 7 + 1.0, F.col("id") % 3 + 0.0).alias("embedding"))
    found = vector.top_k(e.withColumnRenamed("id", "vec_id"), e.where("id % 3 = 0").withColumnRenamed("id", "query_id"), 2)
    assert "SortMergeJoin" in plan(found) and "BroadcastHashJoin" not in plan(found)
    assert found.count() == 28


def test_many_queries_of_filtered_rows_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(vector, "MOST_QUERIES", 3)
    e = spark.range(40).select("id", F.array(F.col("id") % 7 + 1.0, F.col("id") % 3 + 0.0).alias("embedding"))
    found = vector.top_k(e.withColumnRenamed("id", "vec_id"), e.where("id % 3 = 0").withColumnRenamed("id", "query_id"), 2, F.col("vec_id") % 2 == 1)
    assert "SortMergeJoin" in plan(found) and "BroadcastHashJoin" not in plan(found)
    assert all(r.vec_id % 2 == 1 for r in found.collect()) and found.count() == 28


def test_actions_take_the_first_of_types_with_one_name(spark):
    types = spark.createDataFrame([("b big", None, 2), ("b big", "拒绝申请", 1), ("a", "b big", 0), ("c", "拒绝申请", 3)], "name string, label string, pos long")
    got = matching.actions(spark.createDataFrame([("the b big one",), ("b big",), ("拒绝赎回",)], "action string"), types)
    assert sorted(map(tuple, got.collect())) == [("b big", "a", 1), ("the b big one", "a", 2), ("拒绝赎回", "b big", 3)]


def test_flagship_is_dealt_by_its_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "TASK_ROWS", 2, raising=False)
    tables(
        spark, tmp_path,
        customer=([(1, "a"), (2, "b")], "c_custkey long, c_name string"), part=([(7, "p"), (8, "p"), (9, "q")], "p_partkey long, p_name string"),
        orders=([(i, i % 2 + 1) for i in range(10)], "o_orderkey long, o_custkey long"), lineitem=([(i, k, 1.0) for i in range(10) for k in (7, 8, 9)], "l_orderkey long, l_partkey long, l_quantity double"),
    )
    found = __spark_entry__.queries()["relation_facts_all"](spark, str(tmp_path))
    assert plan(found).count("REPARTITION_BY_NUM") >= 2
    assert sorted((r.subject, r.object, r.customer, r.quantity) for r in found.collect()) == sorted((f"order {i}", o, "ab"[i % 2], n) for i in range(10) for o, n in (("p", 2), ("q", 1)))


def test_links_with_frequent_ends_are_spread(spark, monkeypatch):
    monkeypatch.setattr(extraction, "HOT", 2, raising=False)
    monkeypatch.setattr(storage, "TASK_ROWS", 10, raising=False)
    types = spark.createDataFrame([(f"T{i}", f"name {i}", "", None, i) for i in range(9)], "id string, name string, label string, properties string, pos long")
    rows = [(f"R{i}", "x", f"T{i % 9}", ("nothing", "name 1", "name 2")[i % 3]) for i in range(90)] + [("R", "y", None, "T1"), ("R", "y", "", "T1"), ("R", "y", "name 3", "T4")] * 2
    found = extraction.schema_graph(types, spark.createDataFrame(rows, "name string, label string, source_object_type string, target_object_type string"))[1]
    assert "_place" in plan(found)
    assert sorted(map(tuple, found.collect())) == sorted([(f"T{i % 9}", f"T{i % 3}", f"R{i}", "x") for i in range(90) if i % 3] + [("T3", "T4", "R", "y")])


def test_what_many_ask_for_is_dealt_to_shares(spark):
    nodes = spark.range(200).select(F.concat(F.lit("n"), F.col("id")).alias("id"), F.lit("BIG one").alias("label"), F.create_map(F.lit("a"), F.col("id").cast("string")).alias("properties"))
    rows = [(i, "BIG", "a") for i in range(30)] + [(90, "BIG", "b"), (91, "BIG", None), (92, "n7", "a"), (93, "none", "a"), (94, None, "a"), (95, "n7", "a")]
    found = retrieval.attributes(nodes, spark.createDataFrame(rows, "question long, entity string, attribute string"))
    assert "_share" in plan(found)
    want = [(i, f"n{k}", "BIG one", str(k) if i < 30 else None) for i in [*range(30), 90, 91] for k in range(200)] + [(i, "n7", "BIG one", "7") for i in (92, 95)]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))


def test_versions_are_dealt_once_and_summed_first_where_they_are_many(spark, monkeypatch):
    monkeypatch.setattr(extraction, "TASK_ROWS", 20, raising=False)
    monkeypatch.setattr(extraction, "SAMPLED", 20, raising=False)
    few = [(i, f"p{i % 40} V{i}", "ST"[i % 2], {k: f"{k}{i}" for k in "abc"[: i % 4]}, i) for i in range(200)] + [(900 + i, None, "S", {"a": None}, 900 + i) for i in range(3)]
    many = [(1000 + i, f"often {i}.0", None, {"abcdefgh"[i % 8]: str(i), **({"z": None} if i % 3 == 0 else {})} if i % 5 else None, 1000 + i) for i in range(60)]

    def wanted(rows):
        groups = {}
        for id_, label, kind, props, pos in rows:
            groups.setdefault((label and label.split(" ")[0], kind, label is None and pos), []).append((-len(props or {}), pos, id_, label, props or {}))
        for (stem, kind, _), them in groups.items():
            them.sort(key=lambda r: r[:2])
            whole = {}
            for r in them:
                whole = r[4] | whole
            yield stem, kind, them[0][2], them[0][3], len(them), sorted(whole.items())

    for rows, shuffles in ((few, 1), (few + many, 4)):
        found = extraction.collapsed_versions(spark.createDataFrame(rows, "id long, label string, type_id string, props map<string,string>, pos long"))
        assert plan(found).count("Exchange hashpartitioning") == shuffles and "REPARTITION_BY_NUM" in plan(found)
        got = [(r.stem, r.type_id, r.id, r.label, r.n, sorted((r.props or {}).items())) for r in found.collect()]
        assert sorted(got, key=str) == sorted(wanted(rows), key=str)


def test_schema_relations_are_dealt_and_frequent_ends_spread(spark, monkeypatch):
    for module in (storage, merging):
        monkeypatch.setattr(module, "TASK_ROWS", 10, raising=False)
    monkeypatch.setattr(extraction, "SAMPLED", 10, raising=False)
    monkeypatch.setattr(merging.graph, "closure", None)  # relations don't ask who inherits from whom
    nodes = spark.createDataFrame([(f"C_{i}", f"R_{i}" if i == 3 else None, f"name {i}" if i != 4 else None, "Class", {}, i) for i in range(9)], "id string, raw_id string, label string, kind string, properties map<string,string>, pos long")
    ends = [(f"C_{i % 9}", ("nothing", "C_1", "R_3")[i % 3]) for i in range(90)] + [("C_4", "C_5"), (None, "C_5"), ("C_5", None)]
    other = [("C_1", "C_0", "subclass_of", "", "", 0), ("C_1", "C_2", "action", "does", "", 0), ("C_1", "C_2", None, "x", "p", 0)]
    edges = spark.createDataFrame([(s, d, "object_property", "uses" if i % 2 else None, "p" if i % 4 else "_", i) for i, (s, d) in enumerate(ends)] + other, "src string, dst string, relation string, label string, prop_id string, pos long")
    found = merging.schema_relations(nodes, edges)
    assert "_place" in plan(found) and "REPARTITION_BY_NUM" in plan(found)
    name = lambda x: {"R_3": "name 3", "C_4": "C_4"}.get(x) or (x.replace("C_", "name ") if x else x)
    want = [("p" if i % 4 else "uses" if i % 2 else "object_property", "uses" if i % 2 else "", name(s), name(d)) for i, (s, d) in enumerate(ends)]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_lines_name_only_nodes_that_are_there(spark, tmp_path):
    tables(
        spark, tmp_path,
        region=([(0, "R")], "r_regionkey int, r_name string"), nation=([(1, "N", 0), (2, "M", 9)], "n_nationkey int, n_name string, n_regionkey int"),
        customer=([(1, "a", 1, "M"), (2, None, 8, None), (3, "c", None, "M")], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"), supplier=([(7, "S", 1)], "s_suppkey long, s_name string, s_nationkey int"),
        part=([(3, "P", "B", "T", 1)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
        lineitem=([(5, 3, 7), (5, 3, 7), (6, 3, 8), (6, 4, 7), (6, None, 7)], "l_orderkey long, l_partkey long, l_suppkey long"),
    )
    ask = lambda name: __spark_entry__.queries()[name](spark, str(tmp_path)).collect()
    assert "Broadcast" not in plan(__spark_entry__.queries()["turtle_lines"](spark, str(tmp_path)))
    lines = [r.value for r in ask("turtle_lines")]
    # types and labels of 8 nodes, three segments, brand and type, four edges; the second customer has neither name nor segment
    assert len(lines) == 8 + 8 + 3 + 2 + 4 and lines.count(None) == 2 and not [x for x in lines if x and "  ." in x]
    relations = sorted(x.split(" ")[1].split("#")[1].rstrip(">") for x in lines if x and x.count("auto_ontology#") == 3)
    assert relations == ["IN_REGION", "LIVES_IN", "LOCATED_IN", "SUPPLIED_BY"]
    assert {r.source: r.n for r in ask("triple_type_counts")} == {"region": 1, "nation": 2, "customer": 3, "supplier": 1, "part": 1}
