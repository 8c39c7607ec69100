import random
import re

import numpy as np
import pytest

from tessera.llm import mixing


def brute_targets(sizes, most=3):
    """Share by weight again and again until nobody has too much."""
    weights = [[5, 2, 1][i % 3] for i in range(len(sizes))]
    left, fixed = float(sum(sizes)), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        got = {i: (left - sum(fixed.values())) * weights[i] / sum(weights[j] for j in free) for i in free}
        above = [i for i in free if got[i] > most * sizes[i]]
        if not above:
            return [fixed.get(i, got.get(i, 0.0)) for i in range(len(sizes))]
        fixed |= {i: most * sizes[i] for i in above}


@pytest.mark.parametrize("seed", range(30))
def test_targets_against_brute_force(seed):
    pick = random.Random(seed)
    sizes = [pick.choice([0, pick.randint(1, 50), pick.randint(100, 10_000)]) for _ in range(pick.randint(1, 9))]
    got = mixing.targets(sizes, [[5, 2, 1][i % 3] for i in range(len(sizes))])
    assert np.allclose(got, brute_targets(sizes)) and abs(got.sum() - sum(sizes)) < 1e-6


def test_permutations_are_permutations_and_turn_back():
    for n in [1, 2, 3, 4, 5, 16, 17, 100, 1000, 4097]:
        i, size, key = np.arange(n), np.full(n, n), np.full(n, 77 + n)
        p = mixing.permuted(i, size, key)
        assert sorted(p.tolist()) == list(range(n))
        assert (mixing.permuted(p, size, key, back=True) == i).all()


def corpus(seed=3, n=300):
    pick = random.Random(seed)
    docs = []
    for i in range(n):
        source = pick.choices(["b", "a", "", None, "é", "tiny", "c", "z"], [30, 3, 2, 2, 5, 1, 2, 1])[0]
        docs.append((i, pick.choice([None, "", " \n", *["w " * pick.randint(1, 90)] * 5]), source))
    docs += [(7, "x y z", "b"), (7, "x y z", "b"), (None, "n u l l", None), (None, "n u l l", None), (8, "w " * 20_000, "b")]
    return docs


def sized(docs):
    return [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in docs]


def test_mix_against_its_definition(spark):
    docs = corpus()
    frame = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, source string, row int").repartition(5)
    mixed = mixing.mix(frame, block=16, shard_slots=64)
    rows = mixed.documents.collect()
    names = sorted({d[2] for d in docs if d[2] is not None}) + [None]
    size = dict.fromkeys(names, 0)
    for d, s in zip(docs, sized(docs), strict=True):
        size[d[2]] += s
    want = dict(zip(names, brute_targets([size[x] for x in names]), strict=True))
    assert sorted((r.doc_id or -1, r.size, r.source_size) for r in rows) == sorted((d[0] or -1, s, size[d[2]]) for d, s in zip(docs, sized(docs), strict=True))
    assert all(r.taken <= 3 * r.size for r in rows)
    by_size = {}
    for r in rows:  # no two sources have the same size here
        by_size.setdefault(r.source_size, []).append(r)
    for name in names:
        mine = by_size[size[name]]
        assert np.allclose([r.target for r in mine], want[name])
        assert sum(r.taken for r in mine) == round(want[name])
    spans = mixed.spans.collect()
    of = mixed.sources
    total = int(of.slots.sum())
    full = {}
    for s in spans:
        full.setdefault((s.shard, s.slot), []).append((s.offset, s.length))
    assert len(full) == total and {k // 64 for k in range(total)} == {s for s, _ in full}
    for (shard, slot), parts in full.items():  # gapless from 0, within the block
        assert 0 <= slot < min(64, total - 64 * shard)
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0 and parts[-1][0] + parts[-1][1] <= 16
    shards = -(-total // 64)
    assert shards > 5
    again = mixing.mix(frame.repartition(2), block=16, shard_slots=64)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(key, again.documents.collect())) == sorted(map(key, rows))
    assert sorted(map(key, again.spans.collect())) == sorted(map(key, spans))
    texts = mixing.slot_texts(mixed, frame).collect()
    assert len(texts) == total and sum(len(r.text.split()) for r in texts) == sum(r.taken for r in rows)


def test_shards_draw_by_quota(spark):
    """A shard's counts scatter as a multinomial's do: all shards alike would be a stratified draw."""
    docs = spark.createDataFrame([(i, "w " * 40, "ab"[i % 2]) for i in range(2000)], "doc_id long, text string, source string")
    mixed = mixing.mix(docs, block=4, shard_slots=500)
    count = {}
    source = {r.doc_id: "ab"[r.doc_id % 2] for r in docs.select("doc_id").collect()}
    for r in mixed.spans.where("offset = 0").collect():
        count.setdefault(r.shard, []).append(source[r.doc_id])
    share = [sum(x == "a" for x in c) / len(c) for c in count.values() if len(c) == 500]
    assert abs(np.mean(share) - 5 / 7) < 0.01 and 0.01 < np.std(share) < 0.04


def test_empty_and_wordless_tables(spark):
    kind = "doc_id long, text string, source string"
    assert mixing.taken(spark.createDataFrame([], kind)).count() == 0
    got = mixing.taken(spark.createDataFrame([(1, None, None), (2, " ", "a")], kind)).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    one = mixing.taken(spark.createDataFrame([(1, "a b c", None)], kind)).collect()
    assert [tuple(r) for r in one] == [(1, 3, 3, 3.0, 3)]
