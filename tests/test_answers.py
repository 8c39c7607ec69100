"""Questions, answers, payloads and graphs on small cases, nulls and empty tables included."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import answers, containment, graph_documents, listings, merging, questions

NODE = "id string, kind string, label string, class_label string, properties map<string,string>"
LINK = "src string, dst string, relation string"


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("asked", "want"),
    [
        ('"G类份额"的起点金额是多少', "G类份额"), ("G类份额的起点金额", "G类份额"), ("信息披露在哪里", "信息披露"), ("估值多久", "估值"), ('what is "x y"', "x y"), ("no AF253322G", "AF253322G"),
        ("能转让吗", "*"), ("hello", "hello"), ("", ""), (None, None),
    ],
)
def test_entity_of_a_question(spark, asked, want):
    assert one(spark, questions.entity(F.lit(asked).cast("string"))) == want


def test_holders_by_brute_force(spark):
    texts = [(i, t) for i, t in enumerate(["abcabc", "b", "", None, "xabx", "ab", "产品ab"])]
    terms = ["ab", "b", "abcabcd", "", None, "品a", "ab"]
    got = containment.holders(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(t,) for t in terms], "term string"))
    assert sorted(map(tuple, got.collect())) == sorted({(i, m) for i, t in texts for m in terms if t and m and m in t})


def test_ladder_takes_the_first_search_that_finds(spark):
    nodes = spark.createDataFrame(
        [("n1", "NamedIndividual", "AF000001 基金", "p", {}), ("n2", "NamedIndividual", "B类", "p", {"产品编号": "AF000002"}), ("n3", "Class", "风险等级", "p", {}), ("n4", "NamedIndividual", None, "p", None)], NODE
    )
    edges = spark.createDataFrame([("n1", "n2", "HAS"), ("n2", "n1", "OF")], LINK)
    asked = spark.createDataFrame([(1, 'AF000001 "B类"'), (2, "AF000002"), (3, 'is "B类"'), (4, "风险等级"), (5, "none"), (6, None)], "question int, text string")
    got = {}
    for r in questions.ladder(asked, nodes, edges).collect():
        got.setdefault((r.question, r.rung), set()).add((r.type, r.subject, r.predicate, r.object))
    everyone = {("node", x, None, None) for x in ("AF000001 基金", "B类", "n4")}
    assert got == {
        (1, 1): {("node", "AF000001 基金", None, None), ("edge", "AF000001 基金", "HAS", "B类")}, (2, 1): {("node", "B类", None, None)}, (3, 2): {("node", "B类", None, None)},
        (4, 3): {("node", "风险等级", None, None)}, (5, 4): everyone, (6, 4): everyone,
    }
    assert questions.ladder(asked, nodes.limit(0), edges).count() == 0
    assert questions.ladder(asked.limit(0), nodes, edges).count() == 0


def test_intents_are_corrected(spark):
    known = spark.createDataFrame([("投资周期", 0), ("风险等级", 1)], "name string, pos int")
    rows = [
        ("AF253322G的产品期限是多少", "general_query", "管理风险", None), ("有什么风险等级", "general_query", "风险", None), ("x", "attribute_query", "x", "产品期限"), ("x", "attribute_query", "x", "无关"),
        ("AF253322G", "attribute_query", None, "风险等级"), ("AF253322G多少", "general_query", "AF253322", "风险等级"), (None, None, None, None),
    ]
    got = questions.corrected_intents(spark.createDataFrame(rows, "question string, query_type string, entity string, attribute string"), known)
    want = [
        ("attribute_query", "AF253322G", "投资周期"), ("attribute_query", None, "风险等级"), ("attribute_query", "x", "投资周期"), ("attribute_query", "x", "无关"),
        ("attribute_query", "AF253322G", "风险等级"), ("general_query", "AF253322", "风险等级"), (None, None, None),
    ]
    assert sorted((tuple(r)[1:] for r in got.collect()), key=str) == sorted(want, key=str)


def test_existing(spark):
    nodes = spark.createDataFrame([("a", "NamedIndividual", "A", "p", {}), ("b", "NamedIndividual", "B", "p", {}), ("c", "Class", "C", "p", {})], NODE)
    edges = spark.createDataFrame([("a", "b", "R"), ("b", "a", "S"), ("a", "c", "R")], LINK)
    assert [tuple(r) for r in questions.existing(edges, nodes, "R").collect()] == [("A", "R", "B")]
    assert questions.existing(edges, nodes, "none").count() == 0
    assert questions.existing(edges, nodes).count() == 2


def test_one_path_fails_alone(spark):
    none = spark.createDataFrame([], "question int")
    bad = lambda: spark.range(1).select(F.raise_error(F.lit("away")).cast("int").alias("question"))
    graph, vector, errors = answers.both_paths(bad, lambda: spark.createDataFrame([(1,)], "question int"), none, none)
    assert (graph.count(), vector.count(), list(errors)) == (0, 1, ["graph"])
    assert "away" in errors["graph"]


def test_contexts(spark):
    pair = "properties map<string,string>, matched array<struct<key:string,value:string>>, data string"
    facts = spark.createDataFrame(
        [(1, 1, "edge", "a", "r", "b", None, None, None), (1, 2, "node", "n", None, None, {"风险等级": "R2", "x": "y"}, [("k", "v"), ("", "z")], None), (1, 3, None, None, None, None, None, None, "raw"), (1, 4, "node", None, None, None, None, None, None)],
        f"question int, pos int, type string, subject string, predicate string, object string, {pair}",
    )
    hits = spark.createDataFrame([(1, 1, "t" * 400, {"产品类型": "A"}), (2, 1, None, None)], "question int, pos int, text string, properties map<string,string>")
    got = dict(map(tuple, answers.full_context(facts, hits).collect()))
    assert got[1] == "【图谱事实】\n- a -> r -> b\n- n (风险等级: R2), k: v\n- raw\n- \n\n【相关文档】\n[1] " + "t" * 300 + " | 属性：产品类型: A..."
    assert got[2] == "\n【相关文档】\n[1] ..."
    assert answers.full_context(facts.limit(0), hits.limit(0)).count() == 0
    texts, refs = answers.single_path(spark.createDataFrame([(1, 2, "f", "x"), (1, 1, None, "x"), (1, 3, "f", None)], "question int, rank int, file string, quote string"), 2)
    assert [tuple(r) for r in texts.collect()] == [(1, "[1] x\n\n[2] x")]
    assert sorted(map(tuple, refs.collect())) == [(1, 1, "未知文件", "x"), (1, 2, "f", "x")]


def test_schema_forms(spark):
    old = '{"classes":[{"id":"C1","label":"c","parent_classes":["P","Q"],"data_properties":["a",{"name":"b","data_type":"number"}]},{"id":"C2","parent_classes":"P","property_definitions":[{"name":"d","label":"D"}]}],"object_properties":[{"id":"O","domain":"C1","source_object_type":"x"}]}'
    rows = spark.createDataFrame([(1, old), (2, '{"object_types":[{"id":"N"}]}'), (3, "broken"), (4, None), (5, "{}")], "k int, payload string")
    got = {r.k: r for r in merging.either_form(rows).collect()}
    a, b = got[1].object_types
    assert (a.name, a.description, a.sub_class_of) == ("C1", "c", "P")
    assert [(p.name, p.label, p.data_type) for p in a.properties] == [("a", "a", "string"), ("b", "b", "number")]
    assert (b.sub_class_of, [(p.name, p.label) for p in b.properties]) == ("P", [("d", "D")])
    assert [(x.source_object_type, x.target_object_type) for x in got[1].link_types] == [("C1", "")]
    assert (got[2].object_types[0].id, got[2].link_types, got[2].action_types) == ("N", [], [])
    assert (got[3].object_types, got[4].object_types, got[5].object_types) == (None, None, [])
    listed = merging.payload_instances(spark.createDataFrame([('[{"label":"x"}]',), ('{"instances":[{"label":"y"},{}]}',), ("no",), (None,)], "payload string"))
    assert [None if r.instances is None else [i.label for i in r.instances] for r in listed.collect()] == [["x"], ["y", None], None, None]


def test_properties_and_labels(spark):
    hidden = F.create_map(F.lit("_source_file"), F.lit("f"), F.lit("_domain"), F.lit("own"), F.lit("_x"), F.lit("1"), F.lit("a"), F.lit("b"))
    assert one(spark, merging.stored_properties(hidden)) == {"source_file": "f", "domain": "own", "a": "b"}
    assert one(spark, merging.stored_properties(hidden, F.lit("given")))["domain"] == "given"
    defined = F.array(F.struct(F.lit("a").alias("name"), F.lit("b").alias("label")))
    both = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    assert one(spark, merging.labelled_keys(both, defined)) == {"b": "2"}
    for given, want in [("e_n_object_property_关联_x", "关联_x"), ("a_关联", "关联"), ("a_b", "a_b"), ("关联", "关联"), ("", ""), (None, None)]:
        assert one(spark, merging.readable_relation(F.lit(given).cast("string"))) == want
    for given, want in [("```json\n[1]\n```", "[1]"), ("好的，继续: [1]", "[1]"), ("Sure: [1]", "[1]"), ("[1]", "[1]"), ("", ""), (None, None)]:
        assert one(spark, text.continuation(F.lit(given).cast("string"))) == want


def test_schema_of_a_graph(spark):
    nodes = spark.createDataFrame(
        [("A", None, "a", "Class", {"p": ""}, 0), ("B", None, "b", "Class", {"q": ""}, 1), ("C", None, None, "Class", None, 2), ("AT_x", None, "act", "Class", {}, 3), ("i", None, "i", "NamedIndividual", {"z": ""}, 4)],
        "id string, raw_id string, label string, kind string, properties map<string,string>, pos int",
    )
    edges = spark.createDataFrame(
        [("B", "A", "subclass_of", None, None, 0), ("C", "B", "object_property", "subClassOf", None, 1), ("A", "C", "subclass_of", "", "", 2), ("A", "B", "object_property", "owns", "__", 3), ("AT_x", "B", "action", "", "", 4), ("i", "A", "type", "", "", 5)],
        f"{LINK}, label string, prop_id string, pos int",
    )
    classes, properties, relations, actions = merging.graph_schema(nodes, edges)
    assert {r.id: r.parents for r in classes.collect()} == {"A": ["C"], "B": ["A"], "C": ["B"]}
    assert sorted(map(tuple, properties.collect()), key=str) == sorted([("A", "p", "direct", None), ("B", "q", "direct", None), ("B", "p", "inherited", "a"), ("C", "q", "inherited", "b"), ("C", "p", "inherited", None), ("A", "q", "inherited", None)], key=str)
    assert [tuple(r) for r in relations.collect()] == [("owns", "owns", "a", "b")]
    assert [tuple(r) for r in actions.collect()] == [("AT_x", "act", "b")]
    assert [t.count() for t in merging.graph_schema(nodes.limit(0), edges.limit(0))] == [0, 0, 0, 0]


def test_instances_and_actions_join_a_graph(spark):
    instance = "id string, label string, type string, data_props map<string,string>, object_props map<string,array<string>>, pos int"
    instances = spark.createDataFrame(
        [("i1", "one", "C1", {"n": "v", "e": ""}, {"OP_拥有": ["two", "nobody"]}, 0), ("i1", "again", "C1", {}, {}, 1), ("i2", "two", "zzz", None, None, 2), ("i3", "类", "C1", {"动作类型": "x"}, None, 3), ("old", "kept", "C1", {}, {"OP_1": ["i2"]}, 4)], instance
    )
    actions = spark.createDataFrame([("buy it", "申购", "one", "C1", {"k": "v", "": "x"}, 0), ("buy it", "申购", "two", "C1", None, 1), ("odd", None, None, None, None, 2)], "label string, action_type string, target string, target_type string, parameters map<string,string>, pos int")
    classes = spark.createDataFrame([("C1", "", "类", [("n", "名")], 0), ("AT_1", "AT_1", "申购产品", None, 1)], "id string, raw_id string, label string, definitions array<struct<name:string,label:string>>, pos int")
    existing = spark.createDataFrame([("C1",), ("AT_1",), ("old",)], "id string")
    labels = spark.createDataFrame([("OP_1", "属于")], "prop_id string, label string")
    nodes, edges = merging.instances_in_graph(instances, actions, classes, existing, labels)
    got = {r.label: (r.class_label, r.properties) for r in nodes.collect()}
    assert got == {
        "one": ("类", {"名": "v"}), "two": ("", {}), "buy it": ("申购产品", {"动作类型": "申购", "目标实例": "one", "目标类型": "类", "k": "v"}), "odd": ("", {"动作类型": "", "目标实例": "", "目标类型": ""}),
    }
    found = sorted((r.src[:6], r.dst, r.label, r.relation) for r in edges.collect())
    assert found == sorted([("i1", "C1", "type", "type"), ("old", "C1", "type", "type"), ("i1", "i2", "拥有", "object_property"), ("old", "i2", "属于", "object_property"), ("action", "AT_1", "type", "type"), ("action", "i1", "申购", "action")])
    empty = [t.count() for t in merging.instances_in_graph(instances.limit(0), actions.limit(0), classes, existing, labels)]
    assert empty == [0, 0]


def test_lists(spark):
    rows = spark.createDataFrame([(1, "b", None), (2, "a", "x"), (3, None, "y")], "id int, name string, description string")
    assert [r.id for r in listings.sorted_projects(rows, "name", False).orderBy("index").collect()] == [2, 1, 3]
    assert [r.id for r in listings.other_domains(rows, 2, "").orderBy("id").collect()] == [1, 3]
    assert [r.id for r in listings.other_domains(rows, 1, "X").collect()] == [2]
    assert tuple(listings.outcomes(spark.createDataFrame([(True,), (None,), (False,)], "ok boolean")).first()) == (1, 2)
    a = (rows.withColumn("pos", F.col("id")), spark.createDataFrame([("a", "b", "r", 1)], f"{LINK}, pos int"))
    nodes, edges = listings.united(a, a)
    assert (nodes.count(), edges.count()) == (3, 1)
    assert tuple(listings.extraction_counts(spark.createDataFrame([], "object_props map<string,string>"), rows.limit(0), spark.createDataFrame([], "ok boolean"), spark.createDataFrame([], "n int")).first()) == (0, 0, 0, 0.0, 0, 0, 0, 0)


def test_plain_triples_and_download(spark):
    nodes = spark.createDataFrame([("a b", "Class", None, "", {"k": None}), (None, "Class", "x", "", {})], NODE)
    edges = spark.createDataFrame([("a b", "a b", None, None), (None, "a b", "r", "l")], f"{LINK}, label string")
    got = {(r.s.split("#")[1], r.p.split("#")[1], r.o.split("#")[-1]) for r in merging.plain_triples(nodes, edges).collect()}
    assert got == {("a%20b", "type", "Class"), ("a%20b", "label", "未知实体"), ("a%20b", "k", ""), ("k", "type", "DatatypeProperty"), ("k", "label", "k"), ("a%20b", "related_to", "a%20b"), ("related_to", "type", "ObjectProperty"), ("related_to", "label", "关联")}
    made = spark.createDataFrame([(1, "new"), (2, ""), (3, None)], "project int, content string")
    stored = spark.createDataFrame([(1, "old"), (2, "old"), (4, "old")], "project int, content string")
    assert sorted(map(tuple, merging.download(made, stored).collect())) == [(1, "new", False), (2, "old", True), (4, "old", True)]


def test_chinese_names_go_by_pinyin(spark):
    names = ["张三", "李四", "王五", "阿里", "abc", "赵六", "博时", None, "Zeta"]
    rows = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    got = [names[r.id] for r in listings.sorted_projects(rows, "name", False).orderBy("index").collect()]
    chinese = [n for n in got if n and not n.isascii()]
    assert chinese == ["阿里", "博时", "李四", "王五", "张三", "赵六"] and got[-1] is None


def test_kept_schemas_come_before_inferred_ones(spark):
    docs = spark.createDataFrame([(1, '{"schema": {"classes": [{"label": "A", "data_properties": ["x"]}, {"id": "B"}, {}], "object_properties": [{"id": "r", "domain": "A"}]}}'), (2, '{"schema": {"classes": []}}'), (3, "cut {"), (4, None)], "tenant int, document string")
    nodes = spark.createDataFrame([(t, f"n{i}", "l", "C" if i else None, {"p": "1", "id": "x"} if i == 1 else None) for t in (1, 2, 3, 5) for i in range(3)], "tenant int, id string, label string, class_label string, properties map<string,string>")
    edges = spark.createDataFrame([(t, "n1", "n2", "TO") for t in (1, 2)], "tenant int, src string, dst string, relation string")
    classes, relations = graph_documents.project_schemas(docs, nodes, edges)
    assert sorted((r.tenant, r["class"], tuple(r.properties), r.cached) for r in classes.collect()) == [(1, "A", ("x",), True), (1, "B", (), True), (1, "Unknown", (), True), (2, "C", ("p",), False), (3, "C", ("p",), False), (5, "C", ("p",), False)]
    assert sorted(map(tuple, relations.collect())) == [(1, "r", "A", "Unknown", True), (2, "TO", "C", "C", False)]
