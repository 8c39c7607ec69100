import random
import re

import pytest

from tessera.operators import extraction, graph, schema_merge


def by_hand(rows):
    """One after the other: to the first staying row that shares a key."""
    stay, out = [], {}
    for pos, keys in sorted(rows):
        out[pos] = next((p for p, k in stay if set(k) & set(keys)), pos)
        if out[pos] == pos:
            stay.append((pos, keys))
    return out


def check(spark, rows, block):
    got = schema_merge.greedy(spark.createDataFrame(rows, "pos long, keys array<string>").repartition(3), block)
    assert {r.pos: r.keep for r in got.collect()} == by_hand(rows) and got.count() == len(rows)


@pytest.mark.parametrize("seed", range(4))
def test_greedy_equals_one_by_one(spark, seed):
    pick = random.Random(seed)
    rows = [(pos, [f"k{pick.randint(0, 150)}" for _ in range(pick.randint(0, 3))]) for pos in pick.sample(range(10_000), 400)]
    for block in (1000, 40):
        check(spark, rows, block)


def test_star_and_chain_of_a_thousand(spark):
    check(spark, [(0, ["hub"])] + [(i, ["hub", f"own{i}"]) for i in range(1, 1000)], 10)
    check(spark, [(i, [f"hub{i}" for i in range(1, 1000)] if i == 1000 else [f"hub{i}"]) for i in range(1, 1001)], 10)
    chain = [(i, [f"c{i}", f"c{i + 1}"]) for i in range(1000)]
    check(spark, chain, 200)
    check(spark, chain, 50_000)


def key(name):
    parted = re.sub("([a-z0-9])([A-Z])", r"\1_\2", re.sub("(.)([A-Z][a-z]+)", r"\1_\2", name))
    return parted.lower().replace("_", "")


def alike(a, b):
    return bool(a and b and a.strip() and b.strip()) and (key(a) == key(b) or a.strip() == b.strip())


def test_types_by_either_key(spark):
    """The third goes to the first, not to the second, which is itself gone."""
    rows = [("x", "1", 0), ("x", "2", 1), ("y", "2", 2), (None, "1", 3), (None, None, 4), ("", "", 5), ("FooBar", "q", 6), ("foo_bar", None, 7), ("z", "FOO bar", 8), (" z ", "r", 9), (None, "Q", 10)]
    got = {r.pos: r.keep for r in schema_merge.same_types(spark.createDataFrame(rows, "name string, label string, pos int")).collect()}
    stay, want = [], {}
    for name, label, pos in rows:
        want[pos] = next((p for n, x, p in stay if alike(label, x) or alike(name, n)), pos)
        if want[pos] == pos:
            stay.append((name, label, pos))
    assert got == want and (got[1], got[2], got[3], got[9]) == (0, 2, 0, 8)


def test_schemas_become_one(spark):
    prop = "array<struct<name:string,data_type:string>>"
    types = spark.createDataFrame(
        [
            ("Fund", "基金", None, [("size", "int"), ("code", "string")], 0), ("Bank", "银行", "Fund", None, 1), ("fund", "产品", None, [("code", "int"), ("risk", "string")], 2), ("Fund", "other", "nothing", [("size", "string"), ("day", "date")], 3),
            ("Trust", "基金", "Bank", [("term", "int")], 4), ("Self", "自己", "Self", [], 5), ("", "x", None, None, 6), (None, "y", None, None, 7), ("Sub", "子", "fund", None, 8),
        ],
        f"name string, label string, sub_class_of string, properties {prop}, pos int",
    )
    links = spark.createDataFrame([("owns", "", "Bank", "fund", 0), ("owns", "", "Bank", "Self", 1), ("lost", "", "Bank", "?", 2), ("runs", "", "银行", "Trust", 3), ("half", "", "Bank", None, 4), (None, "", "Bank", "Fund", 5)], "name string, label string, source string, target string, pos int")
    actions = spark.createDataFrame([("buy", "b", "Trust", [("n", "int")], 0), ("buy", "c", "Bank", [("n", "x"), ("m", "int")], 1), ("no", "", "??", None, 2)], f"name string, label string, target string, parameters {prop}, pos int")
    t, k, a = schema_merge.merged_schema(types, links, actions)
    plain = lambda ps: [tuple(p) for p in ps or []]
    got = {r.name: (r.label, r.sub_class_of, plain(r.properties)) for r in t.collect()}
    assert got == {
        "Fund": ("基金", None, [("size", "int"), ("code", "string"), ("day", "date"), ("risk", "string"), ("term", "int")]),
        "Bank": ("银行", "Fund", []), "Self": ("自己", None, []), "Sub": ("子", "Fund", []),
    }
    assert sorted((r.name, r.source, r.target) for r in k.collect()) == [("owns", "Bank", "Fund"), ("runs", "Bank", "Fund")]
    assert [(r.name, r.label, r.target, plain(r.parameters)) for r in a.collect()] == [("buy", "b", "Fund", [("n", "int"), ("m", "int")])]
    none = [d.limit(0) for d in (types, links, actions)]
    assert [d.count() for d in schema_merge.merged_schema(*none)] == [0, 0, 0]


def test_merges_keep_what_has_null_keys(spark):
    kind = "id string, label string, type_id string, source string, object_props map<string,array<string>>, data_props map<string,string>, pos int"
    rows = [(None, "a", "T", "s", {"r": ["x"]}, {"p": "1"}, 0), (None, "b", "T", "t", {"r": ["y", "x"]}, {"p": "2", "q": None}, 1), ("i", None, None, None, None, None, 2)]
    got = {r.id: r for r in extraction.merged_instances(spark.createDataFrame(rows, kind)).collect()}
    assert (got[None].label, got[None].n, got[None].object_props, got[None].data_props) == ("a", 2, {"r": ["x", "y"]}, {"p": "2", "q": None})
    assert (got["i"].label, got["i"].n, got["i"].object_props, got["i"].data_props) == (None, 1, None, None)
    kind = "id string, label string, type_id string, props map<string,string>, pos int"
    rows = [("1", None, "T", {"a": "1"}, 0), ("2", None, "T", {}, 1), ("3", "x 1.0", None, {"a": "1"}, 2), ("4", "x 2.0", None, {"b": "2", "c": "3"}, 3), ("5", "", "T", None, 4)]
    got = {r.id: r for r in extraction.collapsed_versions(spark.createDataFrame(rows, kind)).collect()}
    assert set(got) == {"1", "2", "4", "5"} and got["1"].props == {"a": "1"} and got["2"].props is None
    assert (got["4"].stem, got["4"].n, got["4"].props) == ("x", 2, {"a": "1", "b": "2", "c": "3"})
    kind = "kind string, id string, tenant long, label string, properties map<string,string>, pos int"
    rows = [("N", None, 1, "a", {"p": "1", "q": "2"}, 0), ("N", None, 1, "b", {"p": "3"}, 1), (None, "x", None, "c", None, 2), ("N", "x", 1, "d", {}, 3)]
    got = {(r.kind, r.id, r.tenant): (r.label, r.pos, r.properties) for r in graph.merge_nodes(spark.createDataFrame(rows, kind)).collect()}
    assert got == {("N", None, 1): ("b", 1, {"p": "3", "q": "2"}), (None, "x", None): ("c", 2, None), ("N", "x", 1): ("d", 3, None)}
