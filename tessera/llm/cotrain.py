"""Document quality by co-training two views.

One classifier sees the text's content: its characters, words and lines.  The other sees the page's metadata alone: source, language, source
by language, and length.  Both are logistic regressions on binned features, fitted on the labelled rows of which a quarter of either class, by the
hash of the doc_id, is held out.  In each of ``ROUNDS`` rounds either labels those documents without labels of which it is most
confident, a share of all such documents for either class that grows from round to round (``SHARE``), and the other learns from those
labels too.  They weigh together at most ``PSEUDO_WEIGHT`` of what the labels do, and less the nearer the giving view's order of the held-out rows
may be to chance; a view that doesn't surely beat chance there teaches nothing.  At the end each view is calibrated on the held-out rows, and a last regression on both calibrated views gives the score of every document.

The exchange covers all documents.  Their binned features are written once; a round is two passes over them: histograms of both views' scores,
whose tails are the confident documents (a bin of the histogram is taken whole, so ties are), and the sums of first and second derivatives of
what those documents' labels cost, by which they enter the regression as its second-order expansion.  Tasks sum both before anything is sent; the driver sees sums of
fixed size.  Only labelled rows are sampled: at most ``TRAIN_ROWS``, those with the smallest hashes, and the edges of bins come from them.

Defined results: a null or empty text has the features of an empty text; null metadata is a value of its own; labels other than 0 and 1, or
of documents that don't exist, are left out, and a document labelled twice counts twice; of a labelled doc_id that several documents have, one
of them counts; without labels of both kinds every document is accepted with score 1; with a single label of one kind none of that kind is held
out, and the views are combined uncalibrated; repeated rows are scored each; an empty table gives none; other columns pass through unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import arrays
from tessera.storage import written

TRAIN_ROWS = 8_000
ROUNDS = 4
SHARE = 0.05
PSEUDO_WEIGHT = 0.3
BINS = 10
ACCEPT = 0.5
SOURCES, LANGS, SIZES, PAIRS = 64, 16, 24, 256
#: Numbers of a text's features and of a page's.
CONTENT, NAMED = 25, 4
#: Histogram bins of a view's logits between -35 and 35.
STEPS = 7000

_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_PLAIN = np.array([chr(b) in ".,;:'\"()-?" for b in range(256)])
_SYMBOL = ~(_LETTER | _DIGIT | _PLAIN | ~arrays.SOLID) & np.array([33 <= b < 127 for b in range(256)])
_STOP = np.array([chr(b) in ".?!" for b in range(256)])
_LINE = np.array([b not in (10, 13) for b in range(256)])


def word_features(column: pa.Array) -> np.ndarray:
    """A row of numbers for each text, out of its characters and words."""
    data, offsets = arrays.buffer(column)
    n = len(offsets) - 1
    size = np.diff(offsets)

    def each(flag: np.ndarray) -> np.ndarray:
        done = np.concatenate([[0], np.cumsum(flag)])
        return done[offsets[1:]] - done[offsets[:-1]]

    letters, upper, digits, plain, symbols, stops = (each(t[data]) for t in (_LETTER, _UPPER, _DIGIT, _PLAIN, _SYMBOL, _STOP))
    wide = each(data >= 128)
    starts, ends = arrays.runs(arrays.SOLID[data], offsets)
    keys = arrays.hashes(arrays.lower(data), starts, ends)
    text = np.searchsorted(offsets, starts, "right") - 1
    words = np.bincount(text, minlength=n)
    tally = lambda flag, of=text: np.bincount(of, flag, n)
    same = np.zeros(len(keys), bool)
    same[1:] = (keys[1:] == keys[:-1]) & (text[1:] == text[:-1])
    marked = _SYMBOL[data[ends - 1]] if len(ends) else np.zeros(0, bool)
    shout = (_UPPER[data[starts]] & _UPPER[data[np.minimum(starts + 1, ends - 1)]] & (ends - starts > 1)) if len(ends) else marked
    lone = ~(_LETTER | _DIGIT)[data[starts]] & (ends - starts == 1) if len(ends) else marked
    _, first = np.unique(arrays.mix(keys + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    different = np.bincount(text[first], minlength=n)
    some = lambda x: np.maximum(x, 1)
    return np.column_stack(
        [
            np.log1p(words), size / some(words), letters / some(size), upper / some(letters), digits / some(size), plain / some(size), symbols / some(size), wide / some(size),
            stops / some(words), tally(same) / some(words), tally(marked) / some(words), tally(shout) / some(words), tally(lone) / some(words), different / some(words),
            different / np.sqrt(some(words)), tally(ends - starts > 20) / some(words), tally((ends - starts) <= 2) / some(words),
        ]
    )


def layout_features(column: pa.Array) -> np.ndarray:
    """A row of numbers for each text, out of its lines alone: how many, how long, how often the same."""
    data, offsets = arrays.buffer(column)
    n = len(offsets) - 1
    start, end = arrays.runs(_LINE[data], offsets)
    row, size = np.searchsorted(offsets, start, "right") - 1, end - start
    lines = np.bincount(row, minlength=n)
    keys = arrays.hashes(data, start, end)
    _, first = np.unique(arrays.mix(keys + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    unlike = np.bincount(row[first], minlength=n)
    longest, total = np.zeros(n, np.int64), np.bincount(row, size, n)
    np.maximum.at(longest, row, size)
    ended = np.isin(data[end - 1], [33, 46, 63]) if len(end) else np.zeros(0, bool)
    some = np.maximum(lines, 1)
    tally = lambda flag: np.bincount(row, flag, n) / some
    spread = np.sqrt(np.maximum(np.bincount(row, size.astype(float) ** 2, n) / some - (total / some) ** 2, 0))
    return np.column_stack([np.log1p(lines), np.log1p(total / some), np.log1p(longest), unlike / some, tally(ended), tally(size < 30), spread / np.maximum(total / some, 1), lines / np.sqrt(np.maximum(total, 1))])


def page_features(batch: pa.RecordBatch) -> np.ndarray:
    """Four small numbers for each row: source, language, length class, and source by language."""
    out, keys_of = [], []
    for name, width in (("source", SOURCES), ("lang", LANGS)):
        column = batch.column(name)
        data, offsets = arrays.buffer(column)
        keys = np.zeros(len(column), np.uint64)
        full = np.flatnonzero(np.diff(offsets))
        keys[full] = arrays.hashes(data, offsets[full], offsets[full + 1])
        out.append((keys % np.uint64(width - 1)).astype(np.int64) + 1)
        out[-1][column.is_null().to_numpy(zero_copy_only=False)] = 0
        keys_of.append(keys)
    size = batch.column("n_chars").cast(pa.float64()).fill_null(-1).to_numpy(zero_copy_only=False)
    out.append(np.clip(np.where(size < 0, 0, 1 + np.log2(np.maximum(size, 1)).astype(int)), 0, SIZES - 1))
    out.append((arrays.mix(keys_of[0] + arrays.mix(keys_of[1])) % np.uint64(PAIRS)).astype(np.int64))
    return np.column_stack(out)


def _expit(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float | np.ndarray = 1.0, steps: int = 12, near: np.ndarray | None = None, beside: tuple | None = None) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the last coefficient is the constant.

    The ridge pulls towards ``near``.  ``beside`` is a further cost by its expansion (where, gradient, second derivatives).
    """
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1]) if near is None else near.astype(float).copy()
    near = b.copy()
    penalty = np.broadcast_to(np.asarray(ridge, float), b.shape).copy()
    if np.ndim(ridge) == 0:
        penalty[-1] = 1e-6
    for _ in range(steps):
        p = _expit(x @ b)
        h = (x.T * (weight * np.maximum(p * (1 - p), 1e-6))) @ x + np.diag(penalty)
        g = x.T @ (weight * (y - p)) - penalty * (b - near)
        if beside is not None:
            h, g = h + beside[2], g - beside[1] - beside[2] @ (b - beside[0])
        step = np.linalg.solve(h, g)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    return b


@dataclass
class Model:
    """Bin edges, the weights of both views, their calibration and the weights that combine them; and how many labels each view gave in each round."""

    edges: np.ndarray
    content: np.ndarray
    page: np.ndarray
    calibration: tuple[np.ndarray, np.ndarray]
    joint: np.ndarray
    given: list[tuple[int, int]]

    def scores(self, content: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated chances of good quality: by content, by page, and by both."""
        views = [hot(binned(content, self.edges), BINS_OF[0]) @ self.content[:-1] + self.content[-1], hot(page, BINS_OF[1]) @ self.page[:-1] + self.page[-1]]
        logits = [c[0] * v + c[1] for c, v in zip(self.calibration, views, strict=True)]
        return _expit(logits[0]), _expit(logits[1]), _expit(np.column_stack(logits) @ self.joint[:-1] + self.joint[-1])


#: By view the number of values of each feature.
BINS_OF = ((BINS,) * CONTENT, (SOURCES, LANGS, SIZES, PAIRS))


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.column_stack([np.searchsorted(edges[k], x[:, k], "right") for k in range(x.shape[1])])


def hot(x: np.ndarray, widths: tuple[int, ...]) -> np.ndarray:
    """1 for each feature at its value."""
    out = np.zeros((len(x), sum(widths)), np.float32)
    for k, base in enumerate(np.cumsum(widths) - widths):
        out[np.arange(len(x)), base + x[:, k].astype(np.int64)] = 1
    return out


def _logits(x: np.ndarray, widths: tuple[int, ...], b: np.ndarray) -> np.ndarray:
    return b[:-1][x.astype(np.int64) + (np.cumsum(widths) - widths)].sum(axis=1) + b[-1]


def _step(logits: np.ndarray) -> np.ndarray:
    """The histogram bin of each logit."""
    return np.clip((logits + 35) * (STEPS / 70), 0, STEPS - 1).astype(np.int64)


def histograms(views: tuple[np.ndarray, np.ndarray], fitted: list[np.ndarray]) -> np.ndarray:
    """How often each bin of either view's logits comes."""
    return np.stack([np.bincount(_step(_logits(x, w, b)), minlength=STEPS) for x, w, b in zip(views, BINS_OF, fitted, strict=True)])


def tails(histogram: np.ndarray, positive: float, share: float) -> tuple[int, int]:
    """The bins up to which (downwards and upwards) a view is confident: shares of all documents in the proportion of the labels, at least one document each."""
    total = histogram.sum()
    low = int(np.searchsorted(np.cumsum(histogram), max(1, int(share * total * (1 - positive))), "left"))
    high = STEPS - 1 - int(np.searchsorted(np.cumsum(histogram[::-1]), max(1, int(share * total * positive)), "left"))
    return (low, high) if low < high else (-1, STEPS)


def moments(views: tuple[np.ndarray, np.ndarray], fitted: list[np.ndarray], bounds: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """By view: gradient and second derivatives, at its weights, of what the other view's confident labels cost, and how many there are."""
    out = []
    for me, other in ((0, 1), (1, 0)):
        step = _step(_logits(views[other], BINS_OF[other], fitted[other]))
        low, high = bounds[other]
        rows = np.flatnonzero((step <= low) | (step >= high))
        x = np.column_stack([hot(views[me][rows], BINS_OF[me]), np.ones(len(rows))]).astype(float)
        p = _expit(x @ fitted[me])
        out.append((x.T @ (p - (step[rows] >= high)), (x.T * np.maximum(p * (1 - p), 1e-6)) @ x, len(rows)))
    return out


class Rows:
    """Documents without labels, in memory: the sums that a round of the exchange needs."""

    def __init__(self, content: np.ndarray, page: np.ndarray):
        self.views = (content, page)

    def histograms(self, fitted: list[np.ndarray]) -> np.ndarray:
        return histograms(self.views, fitted)

    def moments(self, fitted: list[np.ndarray], bounds: list[tuple[int, int]]) -> list[tuple]:
        return moments(self.views, fitted, bounds)


class Table:
    """The same of a table of packed rows (content, page: small numbers of many documents)."""

    def __init__(self, packed: DataFrame):
        self.packed = packed

    def _summed(self, function, size: int) -> np.ndarray:
        """The sum of a function's flat array over all packed rows: by task, then by parts of the array."""
        part = 1 << 14

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                for content, page in zip(batch.column("content").to_pylist(), batch.column("page").to_pylist(), strict=True):
                    total += function((np.frombuffer(content, np.uint8).reshape(-1, CONTENT), np.frombuffer(page, "<u2").reshape(-1, NAMED)))
            task = TaskContext.get().partitionId() % 16
            for k in range(0, size, part):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([task]), pa.array([total[k : k + part].tobytes()], pa.binary())], ["k", "task", "sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, x in zip(batch.column("k").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                    sums[k] = sums.get(k, 0) + np.frombuffer(x)
            for k, x in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([x.tobytes()], pa.binary())], ["k", "sums"])

        kind, out = "k long, sums binary", np.zeros(size)
        mapped = self.packed.mapInArrow(run, "k long, task long, sums binary")
        once = mapped.repartition("k", "task").mapInArrow(add, kind)  # a part's arrays are added by up to 16 tasks, then by one
        for r in once.repartition("k").mapInArrow(add, kind).collect():
            x = np.frombuffer(r["sums"])
            out[r["k"] : r["k"] + len(x)] = x
        return out

    def histograms(self, fitted: list[np.ndarray]) -> np.ndarray:
        return self._summed(lambda views: histograms(views, fitted).astype(float).ravel(), 2 * STEPS).reshape(2, STEPS)

    def moments(self, fitted: list[np.ndarray], bounds: list[tuple[int, int]]) -> list[tuple]:
        flat = lambda views: np.concatenate([y for g, h, n in moments(views, fitted, bounds) for y in (g, h.ravel(), [float(n)])])
        width = [sum(w) + 1 for w in BINS_OF]
        got, out, at = self._summed(flat, sum(w + w * w + 1 for w in width)), [], 0
        for w in width:
            out.append((got[at : at + w], got[at + w : at + w + w * w].reshape(w, w), int(round(got[at + w + w * w]))))
            at += w + w * w + 1
        return out


def held_out(y: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of either class the quarter with the smallest keys, one row at least, but never the only one."""
    held = np.zeros(len(y), bool)
    for label in (0, 1):
        rows = np.flatnonzero(y == label)
        n = max(1, len(rows) // 4) if len(rows) > 1 else 0
        held[rows[np.lexsort((rows, order[rows]))[:n]]] = True
    return held


def _skill(score: np.ndarray, y: np.ndarray) -> float:
    """How far the order of scores surely beats chance, from 0 to 1: twice the area under the curve less two standard errors of chance, less 1."""
    no, yes = (y == 0).sum(), (y == 1).sum()
    rank = np.searchsorted(np.sort(score[y == 0]), score[y == 1], "left") + np.searchsorted(np.sort(score[y == 0]), score[y == 1], "right")
    area, error = rank.mean() / (2 * no), np.sqrt((no + yes + 1) / (12 * no * yes))
    return float(max(0.0, 2 * (area - 2 * error) - 1))


def _edges(x: np.ndarray) -> np.ndarray:
    return np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T


def fit(content: np.ndarray, page: np.ndarray, y: np.ndarray, order: np.ndarray, edges: np.ndarray, pool: Rows | Table, exchange: bool = True) -> Model:
    """Co-train on labelled rows, of both kinds, and a pool without labels; without ``exchange`` each view learns alone."""
    views = [hot(binned(content, edges), BINS_OF[0]), hot(page, BINS_OF[1])]
    held = held_out(y, order)
    both = len(np.unique(y[held])) == 2
    taught, ones = int((~held).sum()), np.ones(int((~held).sum()))
    fitted = [regression(x[~held], y[~held], ones) for x in views]
    given: list[tuple[int, int]] = []
    for turn in range(ROUNDS if exchange else 0):
        bounds = [tails(h, y[~held].mean(), (turn + 1) * SHARE) for h in pool.histograms(fitted)]
        skill = [_skill(x[held] @ b[:-1], y[held]) if both else 1.0 for x, b in zip(views, fitted, strict=True)]
        got = pool.moments(fitted, bounds)
        given.append((got[1][2], got[0][2]))
        new = []
        for me, (g, h, n) in enumerate(got):
            weight = PSEUDO_WEIGHT * skill[1 - me] * min(1.0, taught / max(n, 1))
            new.append(regression(views[me][~held], y[~held], ones, beside=(fitted[me], weight * g, weight * h)))
        fitted = new
    logits = [x @ b[:-1] + b[-1] for x, b in zip(views, fitted, strict=True)]
    if not both:
        return Model(edges, *fitted, (np.array([1.0, 0.0]),) * 2, np.array([0.5, 0.5, 0.0]), given)
    # few rows are held out where labels are few: towards unchanged views, combined by how surely each beats chance, and to chances short of 0 and 1
    skill = np.array([_skill(v[held], y[held]) for v in logits])
    near = np.array([*(skill / skill.sum() if skill.sum() else (0.5, 0.5)), 0.0])
    yes, no = (y[held] == 1).sum(), (y[held] == 0).sum()
    goal, ones = np.where(y[held] == 1, (yes + 1) / (yes + 2), 1 / (no + 2)), np.ones(int(held.sum()))
    calibration = tuple(regression(v[held, None], goal, ones, np.array([1.0, 0.1]), near=np.array([1.0, 0.0])) for v in logits)
    joined = np.column_stack([c[0] * v + c[1] for c, v in zip(calibration, logits, strict=True)])
    return Model(edges, *fitted, calibration, regression(joined[held], goal, ones, np.array([1.0, 1.0, 0.1]), near=near), given)


def _inputs(docs: DataFrame) -> list[Column]:
    """The columns that the views read, null where the table lacks them."""
    have = lambda c, kind: (F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c)
    return [have("text", "string"), have("source", "string"), have("lang", "string"), have("n_chars", "double")]


def content_features(column: pa.Array) -> np.ndarray:
    """A row of numbers for each text: characters, words and lines."""
    return np.column_stack([word_features(column), layout_features(column)])


def _at(*key: str | Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(1 << 30))


def _share(rows: int, limit: int) -> int:
    """Below which of 2^30 hashes about one and a half times ``limit`` of so many rows lie, so that seldom fewer do."""
    return min(1 << 30, int((1 << 30) * 1.5 * limit / max(rows, 1)) + 1)


def _picked(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label, key): the labelled sample."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("double").alias("label"), _at("doc_id").alias("_at"))
    picked = known.where(F.col("_at") < _share(known.count(), TRAIN_ROWS)).orderBy("_at", "doc_id", "label").limit(TRAIN_ROWS)
    return written(picked.select("doc_id", "label", _at("doc_id", F.lit("held")).alias("key")), "labels")  # TRAIN_ROWS numbers: small enough to broadcast


def samples(docs: DataFrame, picked: DataFrame) -> tuple[np.ndarray, ...]:
    """Content features, page features, labels and keys of the labelled sample.

    Where a doc_id has several rows, which of them is labelled can't be told, so the one with the smallest text hash is.  A sample is the same at every run.
    """
    texts = docs.select("doc_id", *_inputs(docs))
    found = texts.join(F.broadcast(picked.select("doc_id").distinct()), "doc_id", "left_semi")
    one = found.groupBy("doc_id").agg(F.min_by(F.struct(*[c for c in found.columns if c != "doc_id"]), F.xxhash64("text")).alias("_d")).select("doc_id", "_d.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.slices(batches):
            both = np.column_stack([content_features(batch.column("text")), page_features(batch)])
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array(both.tolist(), pa.list_(pa.float64()))], ["key", "label", "x"])

    rows = one.join(F.broadcast(picked), "doc_id").mapInArrow(run, "key long, label double, x array<double>").collect()
    rows.sort(key=lambda r: (r.key, r.label, r.x))
    x = np.array([r.x for r in rows] or np.zeros((0, CONTENT + NAMED)))
    return x[:, :CONTENT], x[:, CONTENT:], np.array([r.label for r in rows], float), np.array([r.key for r in rows], np.int64)


def _pool(docs: DataFrame, picked: DataFrame, edges: np.ndarray) -> Table:
    """The binned features of all documents without a label that counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.slices(batches):
            content, page = binned(content_features(batch.column("text")), edges), page_features(batch)
            yield pa.RecordBatch.from_arrays([pa.array([content.astype(np.uint8).tobytes()], pa.binary()), pa.array([page.astype("<u2").tobytes()], pa.binary())], ["content", "page"])

    others = docs.select("doc_id", *_inputs(docs)).join(F.broadcast(picked.select("doc_id").distinct()), "doc_id", "left_anti").drop("doc_id")
    return Table(written(others.mapInArrow(run, "content binary, page binary"), "views"))


def trained(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model | None:
    """A model of all documents and a bounded sample of labels, or None where the labels are not of both kinds."""
    picked = _picked(labels, label)
    content, page, y, keys = samples(docs, picked)
    if len(np.unique(y)) < 2:
        return None
    edges = _edges(content)
    return fit(content, page, y, keys, edges, _pool(docs, picked, edges))


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """_row (all input columns), content_score, page_score, score of every document."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    if model is None:
        return docs.select(whole, *[F.lit(1.0).alias(c) for c in ("content_score", "page_score", "score")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.slices(batches, "_row.text", arrays.SLICE_BYTES // 2) if plain else arrays.slices(batches):
            text = batch.column("_row").field("text") if plain else batch.column("text")
            found = model.scores(content_features(text), page_features(batch))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *map(pa.array, found)], ["_row", "content_score", "page_score", "score"])

    plain = docs.schema["text"].dataType == T.StringType()  # then the text isn't sent twice
    frame = docs.select(whole, *_inputs(docs)[plain:])
    schema = T.StructType([frame.schema["_row"], *[T.StructField(c, T.DoubleType()) for c in ("content_score", "page_score", "score")]])
    return frame.mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, content_score, page_score, score, accepted."""
    found = scored(docs, trained(docs, labels))
    return found.select("_row.doc_id", "content_score", "page_score", "score", (F.col("score") >= ACCEPT).alias("accepted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents of good quality, with the input's columns."""
    return scored(docs, trained(docs, labels)).where(F.col("score") >= ACCEPT).select("_row.*")
