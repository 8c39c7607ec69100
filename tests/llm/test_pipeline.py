import random
import re

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import content_sort, cotrain, setsketch, suffix_decontam

from .test_duplicates import brute_near, brute_report


def corpus(seed=9, n=260):
    """Documents of good and poor quality, copies, near copies and benchmark passages."""
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("aeinorst") for _ in range(pick.randint(2, 7)))
    say = lambda k: " ".join(word() for _ in range(k)) + "."
    items = [(i, say(25)) for i in range(4)]
    docs, labels = [], []
    for i in range(n):
        good = pick.random() < 0.75
        kind = pick.random()
        text = say(pick.randint(20, 80)) if good else " ".join(w + pick.choice(["%%%", "***", "$$$"]) for w in say(40).split())
        if good and docs and kind < 0.15:
            text = pick.choice([d for d in docs if d[5]])[1].replace(" ", "  ")
        elif good and docs and kind < 0.3:
            text = pick.choice([d for d in docs if d[5]])[1] + " " + word()
        elif good and kind < 0.4:
            text += " " + pick.choice(items)[1]
        docs.append((i, text, pick.choice(["en", "de", None]), pick.choice(["a", "b"]), len(text), good))
        if i % 2:
            labels.append((i, int(good), 0))
    return docs, labels, items


def test_stages_against_brute_force(spark, tmp_path):
    docs, labels, items = corpus()
    good = {d[0]: d[5] for d in docs}
    spark.createDataFrame([d[:5] for d in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {d[0]: d[1] for d in docs}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        got = {r.doc_id: r.text for r in out.collect()}
        if name == "quality":
            want = {i: t for i, t in left.items() if good[i]}
            assert len(set(want) ^ set(got)) <= 2
            want = {i: left[i] for i in got}
        elif name == "exact_dedup":
            first = {}
            for i in sorted(left):
                first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", left[i]), i)
            want = {i: left[i] for i in first.values()}
        elif name == "near_dedup":
            want = {d: left[d] for d, _, _, kept in brute_near(list(left.items()), 5, 80) if kept}
        else:
            want = {r[0]: left[r[0]] for r in brute_report(list(left.items()), items) if not r[5]}
        assert got == want and len(got) < len(left)
        left = got
        out.write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in left.items()}
    for pieces in (corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path)).collect(), corpus_pipeline.run(spark, str(tmp_path)).collect()):
        found = {}
        for p in pieces:
            found[p.doc_id] = found.get(p.doc_id, 0) + p.length
        assert found == tokens
    empty = frame.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_columns_with_clashing_names_pass_through(spark):
    names = ["_kept", "_row", "row", "kept", "_id", "_kept_id", "_salt", "component_id", "score", "ranges"]
    kind = "doc_id long, text string, " + ", ".join(f"{n} int" for n in names)
    docs = spark.createDataFrame([(i, t, *range(len(names))) for i, t in enumerate(["a b c d e f", "a  b c d e f", None, "", "x " * 30, "A B C D E F"])], kind)
    bench = spark.createDataFrame([(1, "x " * 13)], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out, ids in ((content_sort.deduplicated(docs), [0, 2, 4, 5]), (setsketch.deduplicated(docs), [0, 2, 3, 4]), (suffix_decontam.clean(docs, bench), [0, 1, 2, 3, 5]), (cotrain.accepted(docs, labels), [0, 1, 2, 3, 4, 5])):
        assert out.columns == docs.columns
        assert sorted((r.doc_id, *r[2:]) for r in out.collect()) == [(i, *range(len(names))) for i in ids]
