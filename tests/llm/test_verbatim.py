import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import suffix_decontam
from tests.llm.test_duplicates import brute_report, brute_windows, decontamination_case


def brute_longest(docs, items):
    items = [(str(i), brute_windows(t)) for i, t in items]
    out = []
    for _, t in docs:
        w, best = brute_windows(t), (0, -1, None)
        for name, v in items:
            for a in range(len(w)):
                for b in range(len(v)):
                    n = 0
                    while a + n < len(w) and b + n < len(v) and w[a + n] == v[b + n]:
                        n += 1
                    if n and (-n, a, name) < (-best[0], best[1], best[2] or ""):
                        best = (n, a, name)
        out.append(best)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_longest_verbatim_match(seed):
    docs, items = decontamination_case(seed)
    size, at, names = suffix_decontam.Shard(pa.array([t for _, t in docs], pa.string())).longest(suffix_decontam.Items(items))
    assert list(zip(size.tolist(), at.tolist(), names, strict=True)) == brute_longest(docs, items)


def test_longest_verbatim_goes_past_windows_and_blocks(spark, monkeypatch):
    words = [f"w{i}" for i in range(300)]
    items = [(1, " ".join(words[:200])), (2, " ".join(words[200:])), (3, None)]
    docs = [(1, "x " + " ".join(words[5:150])), (2, " ".join(words[20:32]) + " y"), (3, " ".join(words[190:210])), (4, None), (4, "none")]
    want = [(1, 145, 1, "1"), (2, 12, 0, "1"), (3, 10, 0, "1"), (4, 0, None, None), (4, 0, None, None)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, suffix_decontam.longest_verbatim(frame, bench).collect())) == want
    monkeypatch.setattr(suffix_decontam.item_blocks, "__defaults__", (120,))
    assert sorted(map(tuple, suffix_decontam.longest_verbatim(frame, bench).collect())) == want
    assert [r.verbatim_words for r in suffix_decontam.longest_verbatim(frame, bench.limit(0)).collect()] == [0] * 5


@pytest.mark.parametrize("window", [2, 13, 20, 40])
def test_windows_of_any_length_against_brute_force(spark, monkeypatch, window):
    docs, items = decontamination_case(5)
    long = " ".join(f"w{i % 37}" for i in range(90))
    items, docs = items + [(50, long)], docs + [(200, "x " + long + " y"), (201, " ".join(long.split()[5:50]))]
    fields = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = sorted(brute_report(docs, items, window))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    for limit in (1 << 20, 150):  # the second makes several blocks
        monkeypatch.setattr(suffix_decontam.item_blocks, "__defaults__", (limit,))
        # documents that come out of a shuffle may come in another order at every run
        got = suffix_decontam.report(frame.repartition(5, "text"), bench, window).collect()
        assert sorted(tuple(r[f] for f in fields) for r in got) == want
        assert sorted((r.doc_id, r.longest_match, r.longest_at if r.longest_match else -1, r.longest_item) for r in got) == sorted((d, *x) for (d, _), x in zip(docs, brute_longest(docs, items), strict=True))
        left = suffix_decontam.clean(frame.repartition(5, "text").withColumn("_row", F.lit(1)), bench, window)
        assert left.columns == ["doc_id", "text", "_row"] and sorted(r.doc_id for r in left.collect()) == sorted(w[0] for w in want if not w[5])


def test_two_passages_side_by_side_are_not_one_match():
    items = suffix_decontam.Items([(1, " ".join(f"a{i}" for i in range(15))), (2, " ".join(f"b{i}" for i in range(15)))])
    size, at, names = suffix_decontam.Shard(pa.array([" ".join(f"a{i}" for i in range(15)) + " " + " ".join(f"b{i}" for i in range(15))])).longest(items)
    assert (size.tolist(), at.tolist(), names) == ([15], [0], ["1"])
