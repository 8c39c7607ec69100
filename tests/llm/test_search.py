import math
import random
import re

import numpy as np

from tessera.llm import block_max

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, best=10):
    bags = [(i, terms(t)) for i, t in docs]
    some = [b for b in bags if b[1]]
    n, total = len(some), sum(len(b) for _, b in some)
    df = {}
    for _, b in some:
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for i, b in some:
            m = 25 + 75 * len(b) * n // total
            score = 0
            for t in terms(text):
                if tf := b.count(t):
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(scored)[:best])]
    return out


def corpus(seed, n):
    pick = random.Random(seed)
    words = ["w" + "abcdefghij"[k % 10] * (k // 10 + 1) + str(k) for k in range(150)] + ["É", "été", "naïve", "日本"]
    say = lambda k: " ".join(words[min(int(pick.paretovariate(0.6)), len(words)) - 1] for _ in range(k))
    docs = [(i, say(pick.randint(0, 60))) for i in range(n)]
    docs += [(n + i, docs[pick.randrange(n)][1].upper()) for i in range(40)]  # equal scores
    docs += [(3, "W1 again, again; AGAIN"), (3, "W1 again, again; AGAIN"), (None, docs[5][1]), (None, "again"), (n + 90, None), (n + 91, ""), (n + 92, "... !"), (n + 93, say(20_000))]
    items = [(i, say(pick.randint(1, 25))) for i in range(25)] + [(77, None), (78, "?"), (79, "again again again"), (79, "again again again"), (None, "naïve été É"), (80, "nowhere"), (81, say(3000))]
    return docs, items


def test_search_against_brute_force(spark):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    for seed, n, size in ((1, 400, 2000), (2, 60, 10**6), (3, 300, 200)):
        docs, items = corpus(seed, n)
        frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, score string").repartition(4)
        index = block_max.build(frame, size)
        assert size > 10**5 or index.count() > 20
        got = block_max.search(index, spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, rank int"))
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(key, got.collect())) == sorted(map(key, brute(docs, items)))


def test_items_in_several_groups(spark, monkeypatch):
    monkeypatch.setattr(block_max, "ITEM_BYTES", 700)
    docs, items = corpus(4, 120)
    got = block_max.search(block_max.build(spark.createDataFrame(docs, "doc_id long, text string"), 1000), spark.createDataFrame(items, "item_id long, text string"), 3)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(key, got.collect())) == sorted(map(key, brute(docs, items, 3)))


def test_blocks_are_skipped():
    """With a threshold at hand, a block that can't reach it isn't scored; one that can is."""
    items = block_max.pack_items([0], ["rare common"])
    items.weight = np.array([5, 5])
    search = block_max.Search(items, 10, 100, np.array([1000]), 1)
    bound = block_max._bounds(np.array([3, 4]), items)
    assert bound.tolist() == [35] and bound[0] < search.floor[0]


def test_long_products_are_exact():
    count = np.array([1, 10**9, 3 * 10**12])
    n, total = 10**12, 10**15 + 7
    assert block_max.lengths(count, n, total).tolist() == [25 + 75 * c * n // total for c in count.tolist()]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id string, text string"), spark.createDataFrame([(1, "a")], "item_id int, text string")
    assert block_max.search(block_max.build(docs), items).count() == 0
    docs = spark.createDataFrame([("x", "a b")], "doc_id string, text string")
    assert block_max.search(block_max.build(docs), items.limit(0)).count() == 0
    assert [tuple(r) for r in block_max.search(block_max.build(docs), items).collect()] == brute([("x", "a b")], [(1, "a")])
