from pyspark.sql import functions as F

from tessera.operators import ontology, rdf
from tessera.sources import files

PROP = "array<struct<name:string,label:string,description:string,data_type:string>>"


def made(spark):
    types = spark.createDataFrame(
        [("C_1", "Fund", "基金", "all funds", "C_2", [("size", "规模", "how large", "number"), ("期限", None, None, "date"), ("odd", "", "", None)]), ("C_2", "Product", "产品", None, None, None), ("", "Plain", None, "", "", [])],
        f"id string, name string, label string, description string, sub_class_of string, properties {PROP}",
    )
    links = spark.createDataFrame([("OP_1", "管理", "who runs it", "C_2", "C_1")], "id string, label string, description string, source string, target string")
    actions = spark.createDataFrame([("AT_1", "申购", None, "C_1")], "id string, label string, description string, target string")
    instances = spark.createDataFrame(
        [("I_1", "A fund", "C_1", {"OP_1": ["I_2", "I_2"]}, {"size": "5", "期限": "1\"年", "odd": None}, "f.pdf", 3), ("I_2", "B", "C_2", None, None, None, None)],
        "id string, label string, type string, object_props map<string,array<string>>, data_props map<string,string>, _source_file string, _source_chunk_index int",
    )
    return types, links, actions, instances


def test_everything_is_said(spark):
    got = ontology.ontology_triples(*made(spark))
    short = lambda x: x.split("#")[-1]
    said = {(short(r.s), short(r.p), short(r.o), r.lang or (short(r.datatype) if r.datatype else "")) for r in got.collect()}
    term = next(s for s, p, o, _ in said if o == "期限")
    want = {
        ("C_1", "type", "Class", ""), ("C_1", "label", "基金", "zh"), ("C_1", "comment", "all funds", "zh"), ("C_1", "subClassOf", "C_2", ""), ("C_2", "type", "Class", ""), ("C_2", "label", "产品", "zh"), ("Plain", "type", "Class", ""),
        ("size", "type", "DatatypeProperty", ""), ("size", "label", "规模", "zh"), ("size", "label", "size", "zh"), ("size", "domain", "C_1", ""), ("size", "comment", "how large", "zh"), ("size", "range", "decimal", ""),
        (term, "type", "DatatypeProperty", ""), (term, "label", "期限", "zh"), (term, "domain", "C_1", ""), (term, "range", "date", ""), ("odd", "type", "DatatypeProperty", ""), ("odd", "domain", "C_1", ""), ("odd", "label", "odd", "zh"),
        ("OP_1", "type", "ObjectProperty", ""), ("OP_1", "label", "管理", "zh"), ("OP_1", "comment", "who runs it", "zh"), ("OP_1", "domain", "C_2", ""), ("OP_1", "range", "C_1", ""),
        ("AT_1", "type", "ObjectProperty", ""), ("AT_1", "label", "申购", "zh"), ("AT_1", "domain", "C_1", ""),
        ("I_1", "type", "NamedIndividual", ""), ("I_1", "label", "A fund", "zh"), ("I_1", "type", "C_1", ""), ("I_1", "OP_1", "I_2", ""), ("I_1", "size", "5", "zh"), ("I_1", term, '1"年', "zh"),
        ("I_2", "type", "NamedIndividual", ""), ("I_2", "label", "B", "zh"), ("I_2", "type", "C_2", ""),
        ("_source_file", "type", "DatatypeProperty", ""), ("_source_file", "label", "源文件", "zh"), ("I_1", "_source_file", "f.pdf", "zh"),
        ("_source_chunk_index", "type", "DatatypeProperty", ""), ("_source_chunk_index", "label", "切片索引", "zh"), ("I_1", "_source_chunk_index", "3", "integer"),
    }
    assert said == want and got.count() == len(want)
    lines = "\n".join(r.value for r in rdf.turtle_lines(got).collect())
    assert len(files.parse_turtle(lines)) == len(want)


def test_edges_between_classes(spark):
    got = ontology.class_edges(ontology.ontology_triples(*made(spark)))
    assert {tuple(r) for r in got.collect()} == {("C_1", "C_2", "subClassOf", "schema"), ("C_2", "C_1", "OP_1", "schema"), ("I_1", "C_1", "type", "schema"), ("I_2", "C_2", "type", "schema"), ("C_1", "C_2", "OP_1", "instances")}
    none = ontology.ontology_triples(*[d.limit(0) for d in made(spark)])
    assert none.count() == 0 and ontology.class_edges(none).count() == 0


def test_what_is_said_twice_counts_once(spark):
    types, links, actions, instances = made(spark)
    twice = ontology.statements(types.union(types), links.union(links), actions, instances)
    once = ontology.ontology_triples(*made(spark))
    for read in (rdf.data_properties, rdf.schema_links):  # which gave a row for each time that something was said
        assert sorted(map(str, read(twice).collect())) == sorted(map(str, read(once).collect())), read.__name__


def test_frequent_types_are_sent_to_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(ontology, "HOT", 1)
    typed = spark.createDataFrame([(f"I_{i}", "Often") for i in range(9)] + [("I_1", "Seldom"), ("I_2", "Nothing"), ("I_3", None)], "src string, dst string")
    known = lambda *names: spark.createDataFrame([(n,) for n in names], "class string")
    count = lambda rows: {r.dst: r["count"] for r in rows.groupBy("dst").count().collect()}
    assert count(ontology._of_classes(typed, known("Often", "Seldom"))) == {"Often": 9, "Seldom": 1}
    assert count(ontology._of_classes(typed, known("Seldom"))) == {"Seldom": 1}
