import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import content_sort, setsketch, suffix_decontam
from tessera.llm.components import components


def test_content_sort(spark):
    texts = ["a  b", "a b", "a\t\n b", None, "", " ", "a b", "x" * 30_000, "é b", *["hot text"] * 400, *["hot  text"] * 100]
    rows = [(i, t, "k", 1) for i, t in enumerate(texts)] + [(1, "a b", "k", 1), (None, "z", "k", 2), (None, "a b", "k", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _norm string, keep_id int").repartition(5)
    want = {}
    for doc_id, t, *_ in rows:
        want.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), []).append(doc_id)
    got = content_sort.label(docs).collect()
    assert len(got) == len(rows)
    by_sha = {}
    for r in got:
        by_sha.setdefault(r.text_sha256, []).append(r)
    assert len(by_sha) == len(want)
    for text, ids in want.items():
        mine = by_sha[hashlib.sha256(text.encode()).hexdigest()]
        least = min((i for i in ids if i is not None), default=None)
        assert len(mine) == len(ids) and {r.group_size for r in mine} == {len(ids)} and {r.keep_id for r in mine} == {least}
        assert [r.doc_id for r in mine if r.kept] == [least]
    assert content_sort.hot_keys(docs, "text", len(rows))
    kept = content_sort.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(want)
    assert content_sort.label(docs.limit(0)).count() == 0


def brute_windows(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_report(docs, items, window=13):
    windows = {}
    for i, t in items:
        w = brute_windows(t)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    out = []
    for d, t in docs:
        w = brute_windows(t)
        hit, found = [False] * len(w), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    found |= windows[tuple(w[k : k + size])]
                    hit[k : k + size] = [True] * size
        out.append((d, len(w), sum(hit), len(found), suffix_decontam.digest(list(found)), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return out


def decontamination_case(seed):
    pick = random.Random(seed)
    vocabulary = ["the", "of", "Ed", "ing", "é", "x1", "on"]
    say = lambda n: " ".join(pick.choice(vocabulary) + pick.choice(["", "", ",", ".\n"]) for _ in range(n))
    items = [(i, say(pick.choice([1, 3, 12, 13, 14, 30]) + 4 * (i > 2))) for i in range(10)] + [(20, None), (21, ""), (22, "..."), (23, "the of"), (1, say(20))]
    docs = []
    for d in range(40):
        parts = [say(pick.randint(0, 40)) for _ in range(2)]
        if d % 2:
            parts.insert(1, pick.choice(items)[1] or "")
        docs.append((d, " ".join(parts)))
    return docs + [(100, None), (101, ""), (102, " ".join(t or "" for _, t in items)), (102, say(50))], items


def test_suffix_decontamination(spark):
    docs, items = decontamination_case(3)
    frame = spark.createDataFrame([(*d, "z", [1]) for d in docs], "doc_id long, text string, items string, ranges array<int>").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    fields = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = sorted(brute_report(docs, items))
    assert sorted(tuple(r[f] for f in fields) for r in suffix_decontam.report(frame, bench).collect()) == want
    old, suffix_decontam.item_blocks.__defaults__ = suffix_decontam.item_blocks.__defaults__, (120,)
    try:  # several blocks of items give the same
        assert sorted(tuple(r[f] for f in fields) for r in suffix_decontam.report(frame, bench).collect()) == want
    finally:
        suffix_decontam.item_blocks.__defaults__ = old
    assert suffix_decontam.report(frame.limit(0), bench).count() == 0
    assert not suffix_decontam.report(frame, bench.limit(0)).where("contaminated or n_hit > 0").count()


def test_components(spark):
    pick = random.Random(2)
    edges = [(pick.randint(0, 300), pick.randint(0, 300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1200)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for u, v in edges for x in (u, v) if u != v}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_near(docs, size, alike):
    sets = {}
    for d, t in docs:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= alike * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted((d, len(sets[d]), root(d), root(d) == d) for d in sets)


def near_case(seed, n=250):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdeé") for _ in range(pick.randint(2, 6)))
    bases = [[word() for _ in range(pick.randint(5, 150))] for _ in range(12)]
    docs = []
    for d in range(n):
        w = list(pick.choice(bases[: 2 if d % 3 else 12]))
        for _ in range(int(len(w) * pick.choice([0, 0, 0.01, 0.02, 0.03, 0.05, 0.2]))):
            w[pick.randrange(len(w))] = word()
        docs.append((d, " \n".join(w).upper() if d % 7 == 0 else " ".join(w)))
    return docs + [(n + 1, None), (n + 2, ""), (n + 3, " \t"), (n + 4, "one"), (n + 5, "One"), (n + 6, "one two three four"), (n + 7, "w " * 3000)]


def test_setsketch_near_duplicates(spark):
    docs = near_case(4)
    frame = spark.createDataFrame([(*d, 5, "f") for d in docs], "doc_id long, text string, rep int, family string").repartition(4)
    for size in (4, 5):
        got = sorted(tuple(r) for r in setsketch.near_duplicates(frame, size).collect())
        assert got == brute_near(docs, size, 80)
    old = setsketch.BLOCK_CLASSES
    setsketch.BLOCK_CLASSES = 20
    try:  # families of many blocks
        assert sorted(tuple(r) for r in setsketch.near_duplicates(frame, 4).collect()) == brute_near(docs, 4, 80)
    finally:
        setsketch.BLOCK_CLASSES = old
    assert setsketch.near_duplicates(frame.limit(0)).count() == 0
    assert setsketch.near_duplicates(frame.unionAll(frame.limit(3))).count() == len(docs) + 3


def test_an_identifier_with_two_texts_makes_no_false_link(spark):
    first, second = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    docs = [(1, first), (2, first + " x"), (1, second), (3, second + " y"), (4, "another text of some words")]
    got = setsketch.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 4)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == [(1, 37, 1), (1, 37, 1), (2, 38, 1), (3, 38, 1), (4, 2, 4)]
    apart = setsketch.near_duplicates(spark.createDataFrame([(5, first), (5, "w"), (6, "w v"), (7, first + " x")], "doc_id long, text string"), 4)
    assert sorted((r.doc_id, r.component_id) for r in apart.collect()) == [(5, 5), (5, 5), (6, 6), (7, 5)]


def test_registers_are_mergeable_and_estimate():
    pick = np.random.default_rng(0)
    errors = []
    for share in (0.3, 0.8, 0.95):
        for _ in range(20):
            both, n = pick.integers(0, 1 << 63, 4000, dtype=np.uint64), int(4000 * share)
            other = np.concatenate([both[:n], pick.integers(0, 1 << 63, 4000 - n, dtype=np.uint64)])
            a, b = setsketch.sketches(np.concatenate([both, other]), np.array([4000, 4000])).astype(int)
            equal, above = np.array([(a == b).sum()]), np.array([(a > b).sum()])
            true = n / (8000 - n)
            got = setsketch.estimate(above, equal, setsketch.REGISTERS - equal - above, np.array([4000]), np.array([4000]))[0]
            errors.append(got - true)
            assert setsketch.reaches(got - 0.01, above, equal, setsketch.REGISTERS - equal - above, np.array([4000]), np.array([4000]))[0]
            union = np.unique(np.concatenate([both, other]))
            assert (setsketch.sketches(union, np.array([len(union)]))[0] == np.maximum(a, b)).all()
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.17


def header_case(n, words=60, own=70, seed=3):
    """Texts that share a long header, similarity about 0.46 and no link, but for a few copies with a changed word."""
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdefghij") for _ in range(6))
    header = " ".join(word() for _ in range(words))
    docs = [(i, header + " " + " ".join(word() for _ in range(own))) for i in range(n)]
    for i in range(0, n // 10):
        changed = docs[i][1].split()
        changed[words + pick.randrange(own)] = word()
        docs.append((n + i, " ".join(changed)))
    return docs


def test_a_family_with_a_common_header_costs_work_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "BLOCK_CLASSES", 40)
    dealt, plain = [], setsketch.confirmed_links

    def counted(members, *rest):
        dealt[-1] += members.count()
        return plain(members, *rest)

    monkeypatch.setattr(setsketch, "confirmed_links", counted)
    docs = header_case(500)
    dealt.append(0)
    got = sorted(tuple(r) for r in setsketch.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), 4).collect())
    assert got == brute_near(docs, 4, 80)
    assert dealt[-1] <= 2 * len(docs)  # each text once or twice as a star, and the few pairs; all pairs of blocks would be 13 times as many


def test_rows_of_one_identifier_with_two_texts_are_told_apart(spark):
    first, second = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = spark.createDataFrame([(1, first), (5, first + " x"), (5, second), (9, second + " y"), (None, first), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.text or "") for r in setsketch.deduplicated(docs).collect()) == sorted([(1, first), (5, second), (-1, "")])
    with np.testing.assert_raises(TypeError):
        setsketch.near_duplicates(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"))
