import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import collocations as co


def brute(docs, least=10, first=2000):
    f, total = {}, Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        rows = []
        for p, a in count.items():
            if len(p) < 2 or a < least:
                continue
            longer = [b for q, b in count.items() if len(q) > len(p) and b >= least and p in [q[i : i + len(p)] for i in range(len(q) - len(p) + 1)]] if len(p) == 2 else []
            if any(100 * b >= 50 * a for b in longer):
                continue
            score, _, l, r = min((10**6 * a * a // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:first])]
    return sorted(out)


def corpus(seed, n=150):
    pick = random.Random(seed)
    words = [f"w{chr(97 + k % 26)}{k // 26}" for k in range(40)] + ["É", "été", "New", "york", "city", "日本", "a-b", "_"]
    docs = []
    for i in range(n):
        said = []
        for _ in range(pick.randint(0, 60)):
            said.append(pick.choice([pick.choice(words), pick.choice(words[:5]), "new york", "NEW  York\tCity", "of the", "w.", "x,y"]))
        docs.append((i, " ".join(said), pick.choice(["en", "en", "en", "de", "", None])))
    return docs + [(1, docs[1][1], "en"), (n, None, "en"), (n + 1, "", None), (n + 2, ". , !", "zz"), (n + 3, "lone " * 30_000, "xx"), (None, "new york", "en")]


@pytest.mark.parametrize(("seed", "shard_bytes", "flush"), [(1, 24 << 20, 2_000_000), (2, 20_000, 300)])
def test_phrases_against_brute_force(spark, monkeypatch, seed, shard_bytes, flush):
    monkeypatch.setattr(co, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(co, "FLUSH", flush)
    docs = corpus(seed)
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, lang string, rank int, word string").repartition(4)
    got = co.mine(frame)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(docs)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100
    assert sorted(map(tuple, co.mine(frame, first=7).collect())) == brute(docs, first=7)
    assert sorted(map(tuple, co.mine(frame, least=3, first=None).collect())) == brute(docs, 3, 10**9)


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    """A bitmap that lets everything pass is still safe."""
    monkeypatch.setattr(co, "FILTER_BITS", 3)
    docs = corpus(5, 60)
    assert sorted(map(tuple, co.mine(spark.createDataFrame(docs, "doc_id long, text string, lang string"), least=4).collect())) == brute(docs, 4)


def test_perfect_hash_is_minimal_and_survives_packing():
    pick = np.random.default_rng(0)
    for n in (0, 1, 2, 1000, 40_000):
        keys = [pick.integers(0, 2**63, n).astype(np.uint64), pick.integers(0, 3, n).astype(np.uint64)]
        found = co.PerfectHash.unpacked(co.PerfectHash.build(keys).packed())
        assert sorted(found.slots(keys).tolist()) == list(range(n))
    other = found.slots([keys[0] + np.uint64(1), keys[1]])
    assert ((other >= -1) & (other < n)).all()


def test_strangers_are_not_counted():
    """A row that the hash sends to a slot counts only if the stored key is its own."""
    a = np.arange(1, 2001, dtype=np.uint64)
    found, stored, count = co.counted([(a.tobytes(), np.full(2000, 10, "<i8").tobytes()), (np.arange(5001, 9001, dtype="<u8").tobytes(), np.ones(4000, "<i8").tobytes())], 1, 10)
    at = found.slots([a])
    assert (stored[0][at] == a).all() and (count[at] == 10).all()


def test_tables_without_phrases(spark):
    kind = "doc_id long, text string, lang string"
    assert co.mine(spark.createDataFrame([], kind)).count() == 0
    assert co.mine(spark.createDataFrame([(1, None, None), (2, "a b c", "en")], kind)).count() == 0


def test_scores_pass_64_bits(spark):
    rows = spark.createDataFrame([(10**12, 10**13 + 7, 10**14 + 9)], "a long, l long, r long")
    assert rows.selectExpr(co.SCORE.format("l", "r")).first()[0] == 10**6 * 10**24 // ((10**13 + 7) * (10**14 + 9))


def test_steps_do_not_grow_with_shards_times_tasks(monkeypatch):
    """Many packed rows of a shard are counted in as many steps as one, and many shards' packed rows go out together."""
    pick = np.random.default_rng(1)
    keys = [pick.integers(0, 3000, 40_000).astype(np.uint64), pick.integers(0, 3, 40_000).astype(np.uint64)]
    batches = list(co._packed(keys, np.ones(40_000, np.int64), 1000))
    assert len(batches) == 1 and batches[0].num_rows > 990
    rows = list(zip(*(batches[0].column(c).to_pylist() for c in ("keys", "counts")), strict=True))
    calls = []
    monkeypatch.setattr(co.np, "bincount", lambda *a, f=np.bincount, **k: calls.append(0) or f(*a, **k))
    found, stored, count = co.counted(rows, 2, 3)
    assert len(calls) < 30
    want = Counter(zip(*(k.tolist() for k in keys), strict=True))
    got = dict(zip(zip(*(s.tolist() for s in stored), strict=True), count.tolist(), strict=True))
    assert all(want[k] == n for k, n in got.items()) and {k for k, n in want.items() if n >= 3} <= set(got)


def test_a_shard_asks_for_each_part_once(spark):
    keys = [np.repeat(np.arange(1, 3, dtype=np.uint64), 500), np.arange(1000, 2000, dtype=np.uint64)]
    rows = pa.Table.from_batches([co._model_row(2, 4, co.PerfectHash.build(keys), keys, np.full(1000, 10))])
    asked = co._requests(spark.createDataFrame(rows.to_pandas().drop(columns=["langs", "words"]), "level int, shard int, hash binary, keys binary, counts binary"), 50, 10).collect()
    assert len(asked) == 1002 == len({r.k1 for r in asked}) and {(r.level, r.of_level, r.of_shard) for r in asked} == {(1, 2, 4)}
