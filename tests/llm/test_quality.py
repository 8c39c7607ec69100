import math

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import cotrain

from .test_pipeline import corpus

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def separable(n, good):
    """Documents whose kind shows both in the text and, less surely, in the source."""
    rows = []
    for i in range(n):
        words = [f"{'ab'[k % 2]}{(i * 7 + k * 3) % 50}x" for k in range(30)]
        text = " ".join(words) + "." if good(i) else " ".join(w + "%%%" for w in words)
        rows.append((i, text, "en", "ab"[good(i) if i % 5 else i % 2], len(text)))
    return rows


@pytest.mark.parametrize(
    ("good", "labelled"),
    [(lambda i: i % 2 == 0, 40), (lambda i: i % 2 == 0, 200), (lambda i: i < 200, 400), (lambda i: i % 4 != 3, 60), (lambda i: i % 2 == 0, 2), (lambda i: i % 2 == 0, 7), (lambda i: i % 2 == 0, 8), (lambda i: i % 2 == 0, 12)],
)
def test_labels_in_any_order_and_number(spark, good, labelled):
    docs = spark.createDataFrame(separable(400, good), KIND)
    labels = spark.createDataFrame([(i, int(good(i))) for i in range(labelled)], "doc_id long, quality int")
    got = {r.doc_id: r.accepted for r in cotrain.quality(docs, labels).collect()}
    assert np.mean([got[i] == good(i) for i in range(400)]) > (0.97 if labelled >= 40 else 0.9)


def brute(rows, labels, key_of):
    """Co-training by the docstring, document by document: every sum is a loop over rows, and nothing is packed, binned in histograms or expanded by tasks."""
    by_id = {r[0]: r for r in rows}
    known = sorted(((key_of[i], float(q), i) for i, q in labels), key=lambda x: x[0])
    features = {r[0]: cotrain.content_features(pa.array([r[1]], pa.string()))[0] for r in rows}
    pages = {
        r[0]: cotrain.page_features(pa.RecordBatch.from_arrays([pa.array([r[3]], pa.string()), pa.array([r[2]], pa.string()), pa.array([r[4]], pa.int64())], ["source", "lang", "n_chars"]))[0] for r in rows
    }
    edges = [[float(np.quantile([features[i][k] for _, _, i in known], q / cotrain.BINS)) for q in range(1, cotrain.BINS)] for k in range(cotrain.CONTENT)]

    def vector(view, i):
        if view == 0:
            places = [k * cotrain.BINS + sum(e <= features[i][k] for e in edges[k]) for k in range(cotrain.CONTENT)]
            x = [0.0] * (cotrain.CONTENT * cotrain.BINS + 1)
        else:
            widths = [cotrain.SOURCES, cotrain.LANGS, cotrain.SIZES, cotrain.PAIRS]
            places = [sum(widths[:k]) + int(pages[i][k]) for k in range(4)]
            x = [0.0] * (sum(widths) + 1)
        for p in places:
            x[p] = 1.0
        x[-1] = 1.0
        return np.array(x)

    held = set()
    for label in (0.0, 1.0):
        mine = [i for _, q, i in known if q == label]
        held |= set(mine[: max(1, len(mine) // 4)] if len(mine) > 1 else [])
    taught = [(i, q) for _, q, i in known if i not in held]
    tested = [(i, q) for _, q, i in known if i in held]
    pool = [i for i in by_id if i not in {i for i, _ in labels}]
    chance = lambda z: 1 / (1 + math.exp(-max(-35, min(35, z))))

    def newton(data, start, prior, ridge, extra=None):
        b = np.array(start, float)
        for _ in range(12):
            g, h = -ridge * (b - prior), np.diag(ridge)
            for x, goal in data:
                p = chance(x @ b)
                g, h = g + x * (goal - p), h + max(p * (1 - p), 1e-6) * np.outer(x, x)
            if extra:
                g, h = g - extra[1] - extra[2] @ (b - extra[0]), h + extra[2]
            step = np.linalg.solve(h, g)
            b = b + step
            if abs(step).max() < 1e-6:
                break
        return b

    def learn(view, extra=None):
        width = len(vector(view, taught[0][0]))
        ridge = np.array([1.0] * (width - 1) + [1e-6])
        return newton([(vector(view, i), q) for i, q in taught], np.zeros(width), np.zeros(width), ridge, extra)

    fitted = [learn(0), learn(1)]
    def surely(view):
        score = {i: vector(view, i) @ fitted[view] for i, _ in tested}
        pairs = [(score[i] > score[j]) + 0.5 * (score[i] == score[j]) for i, p in tested for j, q in tested if p == 1 and q == 0]
        ones = sum(q == 1 for _, q in tested)
        return max(0.0, 2 * (sum(pairs) / len(pairs) - 2 * math.sqrt((len(tested) + 1) / (12 * ones * (len(tested) - ones)))) - 1)

    share = sum(q for _, q in taught) / len(taught)
    for turn in range(cotrain.ROUNDS):
        said, skill = [], [surely(0), surely(1)]
        for view in (0, 1):
            bin_of = {i: min(cotrain.STEPS - 1, max(0, int((vector(view, i) @ fitted[view] + 35) * (cotrain.STEPS / 70)))) for i in pool}
            part = (turn + 1) * cotrain.SHARE
            low = sorted(bin_of.values())[max(1, int(part * len(pool) * (1 - share))) - 1]
            high = sorted(bin_of.values(), reverse=True)[max(1, int(part * len(pool) * share)) - 1]
            said.append({i: float(b >= high) for i, b in bin_of.items() if low < high and (b <= low or b >= high)})
        new = []
        for view in (0, 1):
            told = said[1 - view]
            w = cotrain.PSEUDO_WEIGHT * skill[1 - view] * min(1, len(taught) / max(len(told), 1))
            g, h = 0, 0
            for i, q in told.items():
                x = vector(view, i)
                p = chance(x @ fitted[view])
                g, h = g + w * x * (p - q), h + w * max(p * (1 - p), 1e-6) * np.outer(x, x)
            new.append(learn(view, (fitted[view], g, h)))
        fitted = new
    yes, no = sum(q == 1 for _, q in tested), sum(q == 0 for _, q in tested)
    goal = {1.0: (yes + 1) / (yes + 2), 0.0: 1 / (no + 2)}
    logit = lambda view, i: vector(view, i) @ fitted[view]
    tuned = [newton([(np.array([logit(v, i), 1]), goal[q]) for i, q in tested], [1, 0], np.array([1, 0]), np.array([1.0, 0.1])) for v in (0, 1)]
    both = lambda i: np.array([*(tuned[v][0] * logit(v, i) + tuned[v][1] for v in (0, 1)), 1])
    skill = [surely(0), surely(1)]
    near = [s / sum(skill) for s in skill] + [0] if sum(skill) else [0.5, 0.5, 0]
    joint = newton([(both(i), goal[q]) for i, q in tested], near, np.array(near), np.array([1.0, 1.0, 0.1]))
    return {i: (chance(both(i)[0]), chance(both(i)[1]), chance(both(i) @ joint)) for i in by_id}


def test_against_co_training_by_loops(spark):
    docs, labels, _ = corpus(21, 220)
    rows = [tuple(d[:5]) for d in docs]
    labels = [(i, q) for i, q, _ in labels if i < 140]
    frame, known = spark.createDataFrame(rows, KIND).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int")
    key_of = {r.doc_id: r.key for r in cotrain._picked(known, "quality").collect()}
    want = brute(rows, labels, key_of)
    got = {r.doc_id: (r.content_score, r.page_score, r.score) for r in cotrain.quality(frame, known).collect()}
    assert got.keys() == want.keys()
    assert max(abs(a - b) for i in want for a, b in zip(got[i], want[i], strict=True)) < 1e-5


def test_cotraining_on_held_out_labels(spark):
    docs, labels, _ = corpus(11, 600)
    extra = docs + [(9001, None, None, None, None, True), (9002, "", "xx", "", 0, True), (9003, "a " * 20_000, "en", "a", -5, True), docs[0]]
    frame = spark.createDataFrame([(*d[:5], 1.0) for d in extra], "doc_id long, text string, lang string, source string, n_chars long, score double").repartition(3)
    known = spark.createDataFrame(labels + [(None, 1, 0), (77_777, 0, 0), (3, None, 1), (4, 7, 0)], "doc_id long, quality int, toxic int")
    got = cotrain.quality(frame, known).collect()
    assert len(got) == len(extra) and all(0 <= r.score <= 1 for r in got)
    taught = {i for i, _, _ in labels}
    held = [(r.accepted, d[5]) for d in docs for r in got if r.doc_id == d[0] and d[0] not in taught]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert {r.score for r in cotrain.quality(frame, known.limit(0)).collect()} == {1.0}
    assert {r.score for r in cotrain.quality(frame, known.where("quality = 1")).collect()} == {1.0}
    assert cotrain.accepted(frame, known).columns == frame.columns
    bare = frame.select("doc_id", "text")
    assert cotrain.quality(bare, known).count() == len(extra)
    assert cotrain.quality(frame.limit(0), known).count() == 0
    assert cotrain.quality(frame.join(known.select("doc_id"), "doc_id"), known).count() > 0  # no document without a label


def test_regression_recovers_weights():
    pick = np.random.default_rng(1)
    x = pick.normal(size=(20_000, 3))
    b = np.array([1.0, -2.0, 0.5])
    y = (pick.random(20_000) < 1 / (1 + np.exp(-(x @ b + 0.3)))).astype(float)
    assert np.allclose(cotrain.regression(x, y, np.ones(len(y)), 1e-6), [*b, 0.3], atol=0.1)


def test_content_features_of_odd_texts():
    x = cotrain.content_features(pa.array(["", None, "a a A", "\n\n", "é %%% 1", "x" * 100_000]))
    assert np.isfinite(x).all() and x.shape == (6, cotrain.CONTENT)


def test_both_classes_are_on_both_sides():
    for y in ([0, 1] * 20, [1] * 20 + [0] * 20, [1] * 30 + [0, 0], [0, 1], [1, 1, 0], [0] + [1] * 9):
        y = np.array(y, float)
        held = cotrain.held_out(y, np.random.default_rng(1).integers(0, 5, len(y)))
        for label in (0, 1):
            n = (y == label).sum()
            assert (held & (y == label)).sum() == (max(1, n // 4) if n > 1 else 0)


def test_views_teach_each_other(spark):
    """Both views label the pool in every round, and with few labels each does better for it, or no worse, than alone."""
    docs, labels, _ = corpus(11, 900)
    frame = spark.createDataFrame([d[:5] for d in docs], KIND)
    picked = cotrain._picked(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "quality")
    content, page, y, keys = cotrain.samples(frame, picked)
    edges = cotrain._edges(content)
    others = [d for d in docs if d[0] % 2 == 0]
    pool = cotrain.Rows(cotrain.binned(cotrain.content_features(pa.array([d[1] for d in others])), edges), cotrain.page_features(pa.RecordBatch.from_pylist([{"source": d[3], "lang": d[2], "n_chars": d[4]} for d in others])))
    assert page.shape[1] == cotrain.NAMED
    pick, right = np.random.default_rng(0), {True: [], False: []}
    for _ in range(6):
        order = pick.permutation(len(y))
        few, rest = order[:48], order[48:]
        for exchange in right:
            model = cotrain.fit(content[few], page[few], y[few], keys[few], edges, pool, exchange)
            assert len(model.given) == (cotrain.ROUNDS if exchange else 0) and all(a > 1 and b > 1 for a, b in model.given)
            right[exchange].append([np.mean((s >= 0.5) == y[rest]) for s in model.scores(content[rest], page[rest])])
    alone, together = np.mean(right[False], axis=0), np.mean(right[True], axis=0)
    assert (together >= alone - 0.01).all() and together[2] > 0.9


def test_samples_repeat_and_a_repeated_identifier_is_one_row(spark):
    docs = spark.createDataFrame([(7, f"text {i}", "en", "a", 9) for i in range(500)] + [(i, "w " * i, "en", "b", 2 * i) for i in range(8, 60)], KIND).repartition(5)
    picked = cotrain._picked(spark.createDataFrame([(i, i % 2) for i in range(7, 40)], "doc_id long, quality int"), "quality")
    first, again = cotrain.samples(docs, picked), cotrain.samples(docs.repartition(3), picked)
    assert len(first[2]) == 33 and all(np.array_equal(a, b) for a, b in zip(first, again, strict=True))
