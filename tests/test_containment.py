import random

import pytest

from tessera.operators import containment, extraction, matching


@pytest.mark.parametrize("block_chars", [None, 60])
def test_both_ways_of_dealing_against_brute_force(spark, block_chars):
    pick = random.Random(4)
    say = lambda n: "".join(pick.choice("abcé产 ") for _ in range(n))
    terms = [say(pick.randint(1, 5)) for _ in range(120)] + ["", None, "ab", "ab"]
    texts = [(i % 150, say(pick.randint(0, 40))) for i in range(200)] + [(500, None), (501, ""), (None, "ab"), (502, "ab" * 50_000)]
    frame = spark.createDataFrame([(*t, 1) for t in texts], "id int, text string, term int").repartition(3)
    got = containment.holders(frame, spark.createDataFrame([(t,) for t in terms], "term string"), block_chars)
    assert sorted(((r.id, r.term) for r in got.collect()), key=repr) == sorted({(i, m) for i, t in texts for m in terms if t and m and m in t}, key=repr)


@pytest.mark.parametrize("block_chars", [None, 100_000])
def test_fifty_thousand_terms(spark, block_chars):
    """Terms are numbers: what a text of numbers holds can be told without trying all terms."""
    pick = random.Random(1)
    terms = {str(pick.randint(0, 10**6)) for _ in range(60_000)}
    terms = sorted(terms)[:50_000]
    texts = [(i, "".join(pick.choice("0123456789") for _ in range(n))) for i, n in enumerate([0, 3, 50, 400, 30_000] * 4)]
    known, want = set(terms), set()
    for i, t in texts:
        want |= {(i, t[a : a + n]) for a in range(len(t)) for n in range(1, 8) if t[a : a + n] in known}
    got = containment.holders(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(t,) for t in terms], "term string"), block_chars)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 10_000


def test_references_and_actions_of_any_number(spark):
    """More types than an error allowed before, against the definition."""
    pick = random.Random(2)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(pick.randint(2, 7)))
    types = [(f"t{i}", f"name{i}", pick.choice([word(), "", None, f"label {i}"]), i) for i in range(6000)]
    refs = sorted({word() + word() for _ in range(40)} | {"t7", "name8", "NAME9", "label 77", "x label 5 y", "zzz"})
    got = {r.ref: (r.type_id, r["rank"]) for r in extraction.resolve_references(spark.createDataFrame([(r,) for r in refs], "ref string"), spark.createDataFrame(types, "id string, name string, label string, pos int")).collect()}
    want = {}
    for ref in refs:
        found = [(1, p, i) for i, n, x, p in types if i == ref] + [(2, p, i) for i, n, x, p in types if n == ref] + [(3, p, i) for i, n, x, p in types if x == ref]
        found += [(4, p, i) for i, n, x, p in types if n.lower() == ref.lower()]
        found = found or [(5, p, i) for i, n, x, p in types if x and (x in ref or ref in x)]
        if found:
            want[ref] = (min(found)[2], min(found)[0])
    assert got == want and len(want) > 30
    asked = sorted({word() + word() for _ in range(40)} | {"name3", "xname30", "label 7", "分红"})
    got = {r.action: (r.type_name, r["rank"]) for r in matching.actions(spark.createDataFrame([(a,) for a in asked], "action string"), spark.createDataFrame([t[1:] for t in types], "name string, label string, pos int")).collect()}
    want = {}
    for a in asked:
        found = [(1 if a in (n, x) else 2, p, n) for _, n, x, p in types if a in (n, x) or a in n or n in a or (x and (x in a or a in x))]
        if found:
            want[a] = (min(found)[2], min(found)[0])
    assert got == want and len(want) > 20


def brute_attributes(asked, known):
    out = {}
    for a in asked:
        best = []
        for name, pos in known:
            ends = [(i, a[: -len(e)]) for i, e in enumerate(matching.ENDINGS) if a.endswith(e)]
            fits = [i for i, stem in ends if stem in name]
            means, telling = matching.ATTRIBUTE_NAMES.get(a), [c for c in a if c not in matching.STOP]
            share = sum(c in name for c in telling) / len(telling) if telling else 0
            if name == a:
                best.append((1, 0, pos, name))
            elif a in name:
                best.append((2, 0, pos, name))
            elif fits:
                best.append((3, fits[0], pos, name))
            elif means and name == means:
                best.append((4, 0, pos, name))
            elif means and means in name:
                best.append((5, 0, pos, name))
            elif telling and share >= 0.5:
                best.append((6, -share, pos, name))
        if best:
            out[a] = (min(best)[3], min(best)[0])
    return out


def test_attributes_against_brute_force(spark):
    pick = random.Random(3)
    heads = sorted({*matching.ATTRIBUTE_NAMES.values(), "产品", "说明", "Brand", "基金费"})
    known = [(pick.choice(heads) + pick.choice(["", "说明", "比例", "x"]), i) for i in range(300)]
    asked = sorted({*matching.ATTRIBUTE_NAMES, *matching.ENDINGS, *[pick.choice(heads) + pick.choice(matching.ENDINGS) for _ in range(60)], "的的", "明说", "qqq", "费x的费"})
    got = matching.attributes(spark.createDataFrame([(a,) for a in asked], "asked string"), spark.createDataFrame(known, "name string, pos int"))
    want = brute_attributes(asked, known)
    assert {r.asked: (r.name, r["rank"]) for r in got.collect()} == want and {r for _, r in want.values()} >= {1, 2, 3, 6}
