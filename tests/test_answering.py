import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import answering, questions, retrieval

NODE = "id string, kind string, label string, class_label string, properties map<string,string>"
LINK = "src string, dst string, relation string"


@pytest.fixture(scope="module")
def graph(spark):
    pick = random.Random(7)
    nodes = [(f"n{i}", "NamedIndividual" if i % 5 else "Class", f"{pick.choice(['alpha', 'beta', 'gamma'])} {i % 40}" if i % 17 else None, pick.choice("AB"), {"size": str(i % 7), "note": pick.choice(["x", "beta", None])} if i % 3 else None) for i in range(150)]
    edges = [(f"n{pick.randrange(150)}", f"n{pick.randrange(150)}", pick.choice(["OWNS", "IN", "beta-of"])) for _ in range(400)] + [("n1", "gone", "OWNS")]
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges + edges[:5], LINK)


def one(plan, nodes, edges):
    t = plan["template"]
    if t == "relations":
        found = retrieval.relations(edges, nodes, plan["entity"], (plan["relation"],) if plan["relation"] else ())
    elif t == "keyword":
        found = retrieval.keyword_facts(edges, nodes, plan["keyword"])
    elif t == "exists":
        found = questions.existing(edges, nodes, plan["relation"], 10**6).select(F.lit("edge"), "subject", "predicate", "object")
    else:
        found = retrieval.answer_facts(plan, nodes, edges, 10**6)
    rows = [[None if v is None else str(v) for v in r] for r in found.collect()]
    return sorted(rows, key=lambda r: [(v is not None, v or "") for v in r])


def test_every_template_equals_one_by_one(spark, graph):
    nodes, edges = graph
    none = dict.fromkeys(answering.PLAN)
    kinds = [{"template": "attribute", "entity": e, "name": a} for e in ("alpha 3", "n7", "beta", "nobody") for a in ("size", "note", "none")]
    kinds += [{"template": "relations", "entity": e, "relation": r} for e in ("beta 1", "n8", "nobody") for r in (None, "OWNS", "zzz")]
    kinds += [{"template": t, "relation": r} for t in ("either_way", "exists") for r in ("OWNS", "beta-of", "zzz")] + [{"template": "with_attribute", "name": a} for a in ("size", "note", "zzz")]
    kinds += [{"template": "keyword", "keyword": k} for k in ("beta", "gamma 1", "OWN", "zzz")] + [{"template": "all"}, {"template": "attribute"}]
    kinds = [none | k for k in kinds]
    asked = [(i, *kinds[i % len(kinds)].values()) for i in range(1000)]
    schema = "question int, " + ", ".join(f"{c} string" for c in none)
    plans = spark.createDataFrame([(i, *[kinds[i % len(kinds)][c] for c in none]) for i, *_ in asked], schema)
    got = {}
    for r in answering.answered(plans, nodes, edges, 15).collect():
        got.setdefault(r.question, []).append((r["rank"], list(r.cells)))
    want = [one(k, nodes, edges)[:15] if k["template"] != "attribute" or k["entity"] else [] for k in kinds]
    assert sum(map(bool, want)) > 20
    for i in range(1000):
        assert [c for _, c in sorted(got.get(i, []))] == want[i % len(kinds)], kinds[i % len(kinds)]


def test_entity_with_keyword(spark):
    nodes = spark.createDataFrame([("a", "NamedIndividual", "fund a", "F", {"fee note": "1", "x": "a fee", "y": "z"}), ("b", "NamedIndividual", "fee table", "T", None), ("c", "NamedIndividual", "other", "T", {})], NODE)
    edges = spark.createDataFrame([("a", "b", "HAS"), ("c", "a", "OF"), ("b", "c", "IN")], LINK)
    plans = spark.createDataFrame([(1, "entity_keyword", "fund a", None, None, "fee"), (2, "entity_keyword", "other", None, None, "fee"), (3, "entity_keyword", "zzz", None, None, "fee")], "question int, template string, entity string, name string, relation string, keyword string")
    got = sorted((r.question, tuple(r.cells)) for r in answering.answered(plans, nodes, edges).collect())
    assert got == [(1, ("fund a", "HAS", "fee table")), (1, ("fund a", "fee note", "1")), (1, ("fund a", "x", "a fee")), (2, ("other", "IN", "fee table"))]


def test_plans_equal_those_of_one_question(spark):
    entities, attributes, relations = ["红基金", "gold", "g"], ["规模", "fee", "fe"], ["OWNS", "IN"]
    texts = ["gold fee", "fe of gold", "AF000123的规模", 'what about "x" and gold', "who OWNS it", "IN OWNS gold", "规模", "hello", "", None, "红基金 规模 fee IN"]
    known = lambda names: spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, pos int")
    got = {r.question: r for r in answering.planned(spark.createDataFrame(list(enumerate(texts)), "question int, text string"), known(entities), known(attributes), known(relations)).collect()}
    for i, text in enumerate(texts):
        want = retrieval.intent(text or "", entities, attributes, relations)
        types = want.get("types") or ()
        assert (got[i].template, got[i].entity, got[i].name, got[i].relation) == (want["template"], want.get("entity"), want.get("name"), want.get("relation") or (types[0] if types else None)), text
