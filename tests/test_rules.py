"""Rules on small hand-made cases."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import ids, models, text
from tessera.operators import aggregates, control, export, extraction, graph, listings, matching, rdf, retrieval, vector
from tessera.sources import files


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_ids(spark):
    assert one(spark, ids.concept_id(F.lit("　理财产品 \n"), "ObjectType")) == "C_56ccb6ce"
    assert one(spark, ids.concept_id(F.lit(" "), "Class")) == one(spark, ids.concept_id(F.lit(None).cast("string"), "Class"))
    assert one(spark, ids.action_instance_id(F.lit("x"))).startswith("action_Node_")
    assert one(spark, ids.property_uri(F.lit("name_1"))) == "name_1"
    assert one(spark, ids.property_uri(F.lit("名"))).startswith("DP_")
    assert one(spark, ids.node_uri(F.lit("C_名"))).startswith("C_")
    assert one(spark, ids.xxh64_hex(F.lit("abc"))) == "44bc2cf5ad770999"
    a = F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2"))
    b = F.create_map(F.lit("a"), F.lit("2"), F.lit("b"), F.lit("1"))
    assert one(spark, ids.content_hash(F.lit("t"), a)) == one(spark, ids.content_hash(F.lit("t"), b))


@pytest.mark.parametrize(
    ("make", "given", "want"),
    [
        (text.plain_term, "负责的人", "负责"),
        (text.plain_term, "负责人员", "负责"),
        (text.plain_term, "好的", "好"),
        (text.snake_case, "OrderLineItem", "order_line_item"),
        (text.relation_type, "a b:c-d", "A_B_C_D"),
        (text.relation_type, "none", "RELATED_TO"),
        (text.relation_type, "", "RELATED_TO"),
        (text.version_stem, "平台 V2", "平台"),
        (text.version_stem, "平台 1.0", "平台"),
        (text.local_name, "http://x/y#z", "z"),
        (text.local_name, "http://x/y", "y"),
        (text.masked, "abcdefghijkl", "abcd****ijkl"),
        (text.masked, "short", "******"),
        (text.domain_code, " 机器学习 ", "TOPIC_ML"),
        (text.domain_code, "AI", "AI"),
        (text.domain_code, "machine_learning", "MACHINE_LEARNING"),
        (text.domain_code, "财务", "DEPT_FINANCE"),
        (text.domain_code, "北京", "REGION_BEIJING"),
        (text.domain_code, "智能大学", "TOPIC_ZNDX"),
        (text.domain_code, " ", None),
        (text.type_name, "owl:Class", "类"),
        (text.without_upload_prefix, "uuid_a_b.txt", "a_b.txt"),
        (text.html_to_text, "<p>a&amp;b<script>x</script>\n <!-- c -->d</p>", "a&b d"),
    ],
)
def test_text_functions(spark, make, given, want):
    assert one(spark, make(F.lit(given))) == want


def test_more_text(spark):
    assert one(spark, text.product_codes(F.lit("AF253322G 与 Z10172"))) == ["AF253322G", "Z10172"]
    assert one(spark, text.citations(F.lit("x[1]y[3][1]"), F.lit(2))) == [1, 1]
    assert one(spark, text.quoted(F.lit('a "b c" d'))) == ["b c"]
    assert one(spark, text.fixed_chunks(F.lit("0123456789"), 4, 1)) == ["0123", "3456", "6789", "9"]
    assert one(spark, text.shanghai_time(F.lit("2025-03-10 06:35:22").cast("timestamp_ntz"))) == "2025-03-10T14:35:22+08:00"
    assert one(spark, text.entity_description(F.lit("A"), F.lit("owl:Class"), F.create_map(F.lit("k"), F.lit("v"), F.lit("description"), F.lit("no")))) == "A是一个类，属性包括k: v"
    assert one(spark, text.embedding_text(F.lit("T"), F.lit("L"), F.lit("a long quote"), F.create_map(F.lit("k"), F.lit("v")), F.create_map(F.lit("r"), F.array(F.lit("x"))))) == "【T：L】的原文记载：a long quote"
    assert one(spark, text.needs_confirmation(F.lit("TOPIC_DATA_LAKE_X")))


def test_recursive_split():
    assert text.split_recursively("aa\n\nbb\n\ncc", 6, 0) == ["aa\n\nbb", "cc"]
    assert text.split_recursively("aa\n\nbb\n\ncc", 6, 2) == ["aa\n\nbb", "bb\n\ncc"]
    assert text.split_recursively("0123456789", 4, 1) == ["0123", "3456", "6789", "9"]
    assert text.split_recursively("short", 100, 10) == ["short"]
    long = "One sentence. " * 40 + "\n\n" + "x" * 500
    assert all(len(c) <= 110 for c in text.split_recursively(long, 100, 10))


def test_merging_nodes_and_edges(spark):
    n = spark.createDataFrame([("Class", "a", 1, "A", {"x": "1", "y": "1"}, 1), ("Class", "a", 1, "A2", {"x": "2"}, 2), ("Class", "b", 1, "B", {}, 3)], "kind string, id string, tenant int, label string, properties map<string,string>, pos int")
    got = {r.id: r for r in graph.merge_nodes(n).collect()}
    assert got["a"].label == "A2" and got["a"].properties == {"x": "2", "y": "1"} and got["b"].properties is None
    e = spark.createDataFrame([("a", "b", "r s", 1), ("a", "b", "R:S", 2), ("a", "gone", "r", 3)], "src string, dst string, relation string, pos int")
    assert [(r.src, r.dst, r.type, r.pos) for r in graph.merge_edges(e, n).collect()] == [("a", "b", "R_S", 2)]


def test_closure_and_inheritance(spark):
    pairs = spark.createDataFrame([("A", "B"), ("B", "C")], "child string, parent string")
    up = graph.closure(pairs)
    props = spark.createDataFrame([("A", "x"), ("B", "y"), ("C", "z")], "class string, property string")
    got = {(r["class"], r.property): r.source for r in graph.inherited_properties(up, props).collect()}
    assert (got["A", "x"], got["A", "y"], got["A", "z"]) == ("direct", "B", None)
    ring = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A")], "child string, parent string")
    assert graph.closure(ring).count() == 9
    assert graph.closure(pairs.limit(0)).count() == 0


def test_merge_report_and_conflicts(spark):
    rows = [("f1", "a", "type", "I", "iri"), ("f1", "a", "p", "1", "literal"), ("f1", "a", "q", "2", "literal"), ("f2", "a", "type", "I", "iri"), ("f2", "a", "p", "1", "literal"), ("f2", "a", "q", "3", "literal")]
    t = spark.createDataFrame([(*r, None, None) for r in rows], "source string, s string, p string, o string, o_kind string, lang string, datatype string")
    assert tuple(rdf.merge_report(t).first()) == (6, 4, 2, 2)
    assert [(r.s, r.p) for r in rdf.conflicts(t).collect()] == [("a", "q")]


TURTLE = """@prefix : <http://www.example.org/auto_ontology#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
@prefix owl: <http://www.w3.org/2002/07/owl#> .  # a comment
:C_1 a owl:Class ; rdfs:label "理财"@zh , "fund"@en ; rdfs:subClassOf :C_0 .
:I_1 a :C_1 ; :n 5 ; :w 1.5 ; :ok true ; :text "a \\"b\\"\\n" .
"""


def test_turtle(spark):
    got = files.parse_turtle(TURTLE)
    assert len(got) == 9 and got[1][2:5] == ("理财", "literal", "zh") and got[-1][2] == 'a "b"\n'
    t = files.read_turtle(spark.createDataFrame([("f", TURTLE), ("g", None)], "source string, text string"))
    assert {r.s.split("#")[1] for r in rdf.classes(t).collect()} == {"C_0", "C_1"}
    assert [r.label for r in rdf.labels(t).collect()] == ["理财"]
    lines = [r.value for r in rdf.turtle_lines(t).collect()]
    assert sorted(files.parse_turtle("\n".join(lines))) == sorted(r[:4] + (r[4], r[5]) for r in got)
    with pytest.raises(ValueError):
        files.parse_turtle("[] a <x> .")


def test_extraction(spark):
    types = spark.createDataFrame([("C_1", "Fund", "基金产品", 1), ("C_2", "Bank", "银行", 2)], "id string, name string, label string, pos int")
    refs = spark.createDataFrame([("C_1",), ("Fund",), ("银行",), ("BANK",), ("基金",), ("none",), ("",)], "ref string")
    got = {r.ref: (r.type_id, r["rank"]) for r in extraction.resolve_references(refs, types).collect()}
    assert got == {"C_1": ("C_1", 1), "Fund": ("C_1", 2), "银行": ("C_2", 3), "BANK": ("C_2", 4), "基金": ("C_1", 5)}
    inst = spark.createDataFrame([("1", "平台 1.0", "T", {"a": "1", "b": "1"}, 1), ("2", "平台 V2", "T", {"a": "2", "c": "2", "d": "2"}, 2)], "id string, label string, type_id string, props map<string,string>, pos int")
    r = extraction.collapsed_versions(inst).first()
    assert (r.label, r.props) == ("平台 V2", {"a": "2", "b": "1", "c": "2", "d": "2"})
    moved = extraction.moved_properties(spark.createDataFrame([({"rel": ["x"], "size": ["1", "2"]}, {"k": "v"})], "object_props map<string,array<string>>, data_props map<string,string>"), F.array(F.lit("size"))).first()
    assert moved.object_props == {"rel": ["x"]} and moved.data_props == {"k": "v", "size": "1, 2"}
    good, bad = extraction.typed_instances(spark.createDataFrame([("Bank",), ("?",)], "type string"), types)
    assert good.count() == 1 and bad.count() == 1
    payloads = ['{"classes": [{"id": "A", "label": "a"}], "object_properties": []}', '{"object_types": [{"name": "B"}]}', "broken"]
    out = extraction.schema_payload(spark.createDataFrame([(p,) for p in payloads], "payload string")).collect()
    assert [o.object_types and o.object_types[0].name for o in out] == ["A", "B", None]
    actions = spark.createDataFrame([("Fund",), ("open Bank now",), ("x",)], "action string")
    assert {a.action: a.type_name for a in extraction.action_types(actions, types).collect()} == {"Fund": "Fund", "open Bank now": "Bank"}
    nodes, edges = extraction.schema_graph(types.withColumn("properties", F.lit(None)), spark.createDataFrame([("owns", "", "Bank", "fund"), ("lost", "", "Bank", "?")], "name string, label string, source_object_type string, target_object_type string"))
    assert nodes.count() == 2 and [(e.src, e.dst) for e in edges.collect()] == [("C_2", "C_1")]


def test_references(spark):
    g = spark.createDataFrame([(1, 1, "q1"), (1, 2, "q1"), (1, 3, "q2")], "question int, pos int, quote string")
    v = spark.createDataFrame([(1, 1, "q2"), (1, 2, "q3")], "question int, pos int, quote string")
    got = [(r.ref, r.quote) for r in retrieval.fused_references(g, v).orderBy("ref").collect()]
    assert got == [(1, "q1"), (2, "q2"), (3, "q3")]
    used = retrieval.used_references(spark.createDataFrame([(1, "see [1][3][1][9]")], "question int, answer string"), retrieval.fused_references(g, v))
    assert sorted(r.ref for r in used.collect()) == [1, 1, 3]


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0]), (5, None)], "vec_id int, embedding array<float>")
    q = spark.createDataFrame([(9, [2.0, 0.0])], "query_id int, embedding array<float>")
    assert [(r.vec_id, r.similarity) for r in vector.top_k(v, q).orderBy("rank").collect()] == [(1, 1.0), (2, 0.707107)]
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "content_hash string, pos int")
    assert [r.pos for r in vector.insert_absent(rows.where("content_hash = 'b'"), rows).collect()] == [1]


def test_payload_repair(spark):
    assert files.repair('```json\n{"a": [1, 2]}\n```') == '{"a": [1, 2]}'
    assert '"instances": [{"a": 1}]' in files.repair('{"instances": [{"a": 1}, {"b": ')
    assert '"x": 1' in files.repair('noise {"x": 1} more')
    assert files.repair("sorry") == files.repair(None) and '"links": []' in files.repair("")
    assert files.repair('{"a": 1,}') != files.repair("")


def test_file_readers(spark, tmp_path):
    def archive(name, parts):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for k, v in parts.items():
                z.writestr(k, v)
        (tmp_path / name).write_bytes(data.getvalue())

    w = 'xmlns:w="http://w"'
    archive("a.docx", {"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>Hi</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"})
    cell = lambda x: f"<a:tc><a:p><a:t>{x}</a:t></a:p></a:tc>"
    table = f"<a:graphicFrame><a:tbl><a:tr>{cell('p')}{cell(' q ')}</a:tr><a:tr>{cell('')}{cell('')}</a:tr></a:tbl></a:graphicFrame>"
    archive("b.pptx", {"ppt/slides/slide1.xml": '<a:s xmlns:a="http://a"><a:p><a:t>One</a:t></a:p></a:s>', "ppt/slides/slide2.xml": '<a:s xmlns:a="http://a"/>', "ppt/slides/slide3.xml": f'<a:s xmlns:a="http://a"><a:sp><a:p><a:t>T</a:t></a:p></a:sp>{table}</a:s>'})
    gaps = '<m:w xmlns:m="http://m"><m:row><m:c r="A1"><m:v>1</m:v></m:c><m:c r="D1"><m:v>4</m:v></m:c></m:row></m:w>'
    archive("g.xlsx", {"xl/workbook.xml": '<m:w xmlns:m="http://m" xmlns:r="http://r"><m:sheet name="G" r:id="x7"/></m:w>', "xl/_rels/workbook.xml.rels": '<r:R xmlns:r="http://r"><r:Relationship Id="x7" Target="worksheets/other.xml"/></r:R>', "xl/worksheets/other.xml": gaps})
    (tmp_path / "h.doc").write_bytes(b"plain text of\nseveral lines")
    archive("c.xlsx", {"xl/workbook.xml": '<m:w xmlns:m="http://m"><m:sheet name="S"/></m:w>', "xl/sharedStrings.xml": '<m:s xmlns:m="http://m"><m:si><m:t>k</m:t></m:si></m:s>', "xl/worksheets/sheet1.xml": '<m:w xmlns:m="http://m"><m:row><m:c t="s"><m:v>0</m:v></m:c><m:c><m:v>5</m:v></m:c></m:row></m:w>'})
    (tmp_path / "d.html").write_text("<html><style>x</style><p>A &amp; B</p></html>")
    (tmp_path / "e.txt").write_bytes(b"plain \xff text")
    (tmp_path / "f.docx").write_bytes(b"PK\x03\x04 broken")
    got = {r.name: r.text for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": "Hi\nx | y", "b.pptx": "[Page 1]:\nOne\n[Page 3]:\nT\n\n[表格内容]:\np | q\n", "g.xlsx": "-- Sheet: G --\n1\t\t\t4", "h.doc": "plain text of\nseveral lines", "c.xlsx": "-- Sheet: S --\nk\t5", "d.html": "A & B", "e.txt": "plain  text", "f.docx": None}


def test_marked_files(spark):
    rows = spark.createDataFrame([("a", "x\ny"), ("b", " "), ("c", "z")], "name string, text string")
    blob = files.marked(rows).agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("t"))
    assert sorted(tuple(r) for r in files.unmarked(blob, "t").collect()) == [("a", "x\ny"), ("c", "z")]


def test_exchange_keeps_the_graph(spark):
    n = spark.createDataFrame([("1", "A", "T", {"k": "v", "_source_file": "f"}), ("2", "B", "T", {})], "id string, label string, class_label string, properties map<string,string>")
    e = spark.createDataFrame([("1", "2", "r")], "src string, dst string, relation string")
    entities, links = export.interchange(n, e)
    assert {r.name: r.properties for r in entities.collect()}["A"] == {"k": "v"}
    nodes, edges = export.imported(entities.withColumn("pos", F.monotonically_increasing_id()), links)
    assert nodes.count() == 2 and edges.count() == 1


def test_rows_are_numbered_without_one_task(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(7)
    got = {r.k: r["index"] for r in graph.number_rows(rows, "k").collect()}
    assert got == {i: i for i in range(1000)}
    assert graph.number_rows(rows.limit(0), "k").count() == 0


def test_small_helpers(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(2, "old"), (3, "y")], "k int, v string")
    assert sorted((r.k, r.v) for r in aggregates.unchanged_schema(a, b, "k", "v").collect()) == [(1, "x"), (2, "old")]
    assert sorted((r.k, r.v, r.created) for r in aggregates.upserted(b, a, "k", "v").collect()) == [(1, "x", True), (2, None, False), (3, "y", False)]
    assert sorted((r.k, r.value) for r in aggregates.folded(a.unionAll(a.withColumn("v", F.lit("z"))), ["k"], "v").collect()) == [(1, "[x,z]"), (2, "z")]


def test_attribute_and_action_names(spark):
    known = spark.createDataFrame([("投资周期", 1), ("业绩比较基准", 2), ("起点金额", 3), ("风险等级", 4), ("募集币种说明", 5)], "name string, pos int")
    asked = spark.createDataFrame([(a,) for a in ("投资周期", "比较基准", "起点比例", "存续期", "币种", "险等的级", "xyz", "")], "asked string")
    got = {r.asked: (r.name, r["rank"]) for r in matching.attributes(asked, known).collect()}
    assert got == {"投资周期": ("投资周期", 1), "比较基准": ("业绩比较基准", 2), "起点比例": ("起点金额", 3), "存续期": ("投资周期", 4), "币种": ("募集币种说明", 2), "险等的级": ("风险等级", 6)}
    types = spark.createDataFrame([("拒绝申请", "", 1), ("分红", "发红利", 2)], "name string, label string, pos int")
    done = spark.createDataFrame([(a,) for a in ("分红", "发红利", "年度分红", "拒绝赎回", "别的")], "action string")
    assert {r.action: (r.type_name, r["rank"]) for r in matching.actions(done, types).collect()} == {"分红": ("分红", 1), "发红利": ("分红", 1), "年度分红": ("分红", 2), "拒绝赎回": ("拒绝申请", 3)}


def test_ends_by_relation(spark):
    rel = spark.createDataFrame([("a", "a", "type"), ("a", "b", "owns"), ("b", "a", "action"), ("c", "a", "x")], "source_name string, target_name string, relation string")
    types = spark.createDataFrame([("a", "T1")], "name string, id string")
    inst = spark.createDataFrame([("a", "I1"), ("b", "I2")], "name string, id string")
    got = sorted(tuple(r) for r in matching.ends_by_relation(rel, types, inst).collect())
    assert got == [("I1", "T1", "type"), ("I2", "T1", "action"), ("T1", "I2", "owns")]


def test_control_tables(spark, tmp_path):
    p = spark.createDataFrame([(1, 5, False), (2, None, False), (3, 5, True)], "id int, domain int, published boolean")
    new, refused = control.published(p, [1, 2])
    assert {r.id: r.published for r in new.collect()} == {1: True, 2: False, 3: True} and [r.id for r in refused.collect()] == [2]
    assert {r.id: r.domain for r in control.moved(p, 5, 6).collect()} == {1: 6, 2: None, 3: 5}
    domains = spark.createDataFrame([(5,), (6,)], "id int")
    assert [r.id for r in control.deletable(domains, p).collect()] == [6]
    assert control.complete(p, [1, 3, 3]) and not control.complete(p, [1, 9])
    assert [r.id for r in control.page(p, 2, "id", size=2).collect()] == [3]
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "project int, v string")
    assert control.without_project(1, rows)[0].count() == 1
    control.save_partition(rows, f"{tmp_path}/t")
    control.save_partition(rows.where("project = 2").withColumn("v", F.lit("c")), f"{tmp_path}/t")
    assert {r.project: r.v for r in spark.read.parquet(f"{tmp_path}/t").collect()} == {1: "a", 2: "c"}
    assert [round(r.progress, 2) for r in control.progress(spark.range(2), "id").orderBy("id").collect()] == [0.45, 0.9]
    tip = control.tooltip(F.create_map(F.lit("_h"), F.lit("x"), F.lit("k"), F.lit("v" * 30)), F.lit("doc"))
    assert one(spark, tip) == "doc\nk: " + "v" * 20


def test_schema_as_triples_and_back(spark):
    types = spark.createDataFrame([("C_1", "基金", [("size", "number"), ("名", "string")]), ("C_2", "Bank", [])], "id string, label string, properties array<struct<name:string,data_type:string>>")
    links = spark.createDataFrame([("C_2", "C_1", "sells", "")], "src string, dst string, relation string, label string")
    t = rdf.schema_triples(types, links)
    short = lambda x: x and x.split("#")[1]
    assert {(short(r["class"]), r.label) for r in rdf.class_table(t).collect()} == {("C_1", "基金"), ("C_2", "Bank")}
    assert {(short(r["class"]), r.data_type) for r in rdf.data_properties(t).collect()} == {("C_1", "number"), ("C_1", "string")}
    assert [(short(r.property), short(r.domain), short(r.range)) for r in rdf.schema_links(t).collect()] == [("sells", "C_2", "C_1")]


def test_model_seams(spark):
    rows = spark.createDataFrame([("one two three",), ("",), (None,)], "t string")
    v = [r.embedding for r in models.embedded(rows, "t", models.hashed_embedder(64)).collect()]
    assert abs(sum(x * x for x in v[0]) - 1) < 1e-5 and v[1] == v[2] == [0.0] * 64

    def broken(texts):
        raise ValueError

    assert {str(r.embedding) for r in models.embedded(rows, "t", broken).collect()} == {"None"}
    waits, tried = [], []

    def busy(prompt):
        tried.append(prompt)
        if len(tried) < 3:
            raise models.Busy
        return "{}"

    assert models.called(busy, "p", waits.append) == "{}" and waits == [10, 20]
    assert models.called(broken, "p", waits.append) is None
    got = models.extracted(rows.where("t like 'one%'"), "t", lambda p: p.upper()).first()
    assert got.payload == "ONE TWO THREE"


@pytest.mark.parametrize("group", [None, "owner"])
def test_sums_before_and_eviction(spark, group):
    rows = [(i, i * 7 % 50, [None, "a", "a", "a", "b"][i % 5], None if i % 11 == 0 else i % 4) for i in range(200)]
    files = spark.createDataFrame(rows, "id int, mtime int, owner string, size long").repartition(6)
    want, freed = {}, {}
    for i, _, owner, size in sorted(rows, key=lambda r: (r[1], r[0])):
        key = owner if group else 0
        want[i] = freed.get(key, 0)
        freed[key] = want[i] + (size or 0)
    assert {r.id: r.before for r in aggregates.sums_before(files, "size", ["mtime", "id"], group).collect()} == want
    found = aggregates.eviction(files, "size", ["mtime", "id"], 30, group)
    assert found.columns == [*files.columns, "freed_before"]
    assert {r.id for r in found.collect()} == {i for i, before in want.items() if before < 30}
    assert aggregates.sums_before(files.limit(0), "size", ["mtime", "id"], group).count() == 0


def test_ids_of_two_tenants_do_not_meet(spark):
    n = spark.createDataFrame([(1, "a", "A1", "T", {"k": "v"}), (1, "b", "B1", "T", {}), (2, "a", "A2", "T", {}), (2, "b", "B2", "T", {}), (2, "c", "C2", "T", {})], "tenant int, id string, label string, class_label string, properties map<string,string>")
    e = spark.createDataFrame([(1, "a", "b", "r", 1), (2, "b", "a", "r", 2), (1, "a", "c", "r", 3)], "tenant int, src string, dst string, relation string, pos int")
    assert sorted((r.source_label, r.target_label) for r in graph.with_ends(e, n).collect()) == [("A1", "B1"), ("B2", "A2")]
    assert sorted(r.pos for r in graph.merge_edges(e, n).collect()) == [1, 2]
    assert sorted((r.tenant, r.id) for r in graph.isolated(n, e).collect()) == [(2, "c")]
    assert {r.tenant for r in graph.keyword_match(n, e, "B1").collect()} == {1}
    assert graph.of_tenant(n, "2").count() == graph.of_tenant(n, 2).count() == 3


def test_the_exact_similarity_ranks(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0005]), (2, [1.0, 0.0])], "vec_id int, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id int, embedding array<double>")
    assert [(r.vec_id, r.similarity) for r in vector.top_k(v, q, 1).collect()] == [(2, 1.0)]


def test_turtle_that_cannot_be_read_is_an_error_row(spark):
    texts = spark.createDataFrame([("good", "<a> <b> <c> ."), ("blank", "_:x <b> [ <c> <d> ] ."), ("cut", "<a> <b>"), ("none", None)], "source string, text string")
    assert [r.source for r in files.read_turtle(texts).collect()] == ["good"]
    assert sorted(r.source for r in files.turtle_errors(texts).collect()) == ["blank", "cut"]


def test_overlap_must_be_smaller_than_a_chunk(spark):
    with pytest.raises(ValueError):
        text.split_recursively("x" * 50, 10, 10)
    with pytest.raises(ValueError):
        text.fixed_chunks(F.lit("x"), 10, 12)


def test_lists_of_pages(spark):
    nodes = spark.createDataFrame([("AT_1", "Pay", "Class"), ("AT_2", "Sell", "Class"), ("AT_3", "Buy", "Class"), ("AT_4", None, "Class"), ("AT_5", "Run", "NamedIndividual"), ("t", "Bill", "Class")], "id string, label string, kind string")
    edges = spark.createDataFrame([("AT_1", "x", "action", 2), ("AT_1", "t", "action", 1), ("AT_4", "y", "action", 3)], "src string, dst string, relation string, pos int")
    names = spark.createDataFrame([("Sell",), ("AT_3",), (None,)], "name string")
    assert sorted(tuple(r) for r in listings.missing_actions(nodes, edges, names).collect()) == [("AT_1", "Pay", "Bill"), ("AT_4", None, "y")]
    assert sorted(tuple(r) for r in listings.relation_targets(edges, nodes).collect()) == [("action", "Bill"), ("action", "x"), ("action", "y")]
    rows = spark.createDataFrame([("a",), ("a",), ("unknown",), ("",), (None,)], "source string")
    assert [r.source for r in listings.referenced_documents(rows).collect()] == ["a"]
    kept = spark.range(1).select(listings.only_keys(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), ["b", "c"]).alias("m"))
    assert kept.first().m == {"b": "2"}
