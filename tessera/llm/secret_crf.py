"""Secrets in texts: fixed patterns, and a linear-chain conditional random field that adds to them.

The field tags tokens as O (outside), B (a secret begins) or I (inside).  A token is a run of
letters, digits, ``+/_.-`` and characters outside ASCII, or one other character.  Its features are
its shape, its own, neighbouring and leading characters' words by hash, and those of its file: source,
language, length and share of digits.  It is trained here, by gradient ascent on the conditional
likelihood, on windows of ``WINDOW_BYTES`` from at most ``TRAIN_DOCUMENTS`` documents with pattern matches
and as many without; texts of any length give windows.  The matched values are the labels.  In half of the
windows the key word and the value are masked by other characters, so that shape, signs and context have to
carry the decision; so the field also finds secrets that no pattern names.

The windows come from one pass: of the rows with the smallest hashes, each task keeps ``TRAIN_DOCUMENTS`` of
either kind (of those without a match only rows of a small share by hash), and the smallest of all tasks' go on, first of each share of hashes.  A share of all rows by hash is looked at, large enough where one in
a thousand rows has a match; only if that finds too few, all rows are, in a second pass.

The field's spans mark the secrets themselves, without the key word.  One that is not exactly a pattern's span is
added, with the kind ``crf``, whether or not it overlaps a pattern's; pattern spans stay.

Decoding is Viterbi over whole texts.  All transition scores are finite, so a token whose score
for O exceeds its others by more than any two transitions can make good is O on the best path; the
best path is then sought between such tokens only, for all gaps of a slice side by side.  This is
exact.

Defined results: null counts as an empty text; a text without matches has no spans and the digest of the
empty string; repeated rows are scanned each; an empty table, or one without any match to train on,
gives pattern matches alone; source and lang may be null or missing; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import arrays

#: What stands in for masked values: the characters of usual kinds of keys.
ALPHABETS = [np.frombuffer(x, np.uint8) for x in (b"0123456789abcdef", b"0123456789ABCDEF", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", b"abcdefghijklmnopqrstuvwxyz0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")]
#: The patterns, in the order in which kinds are listed, and their least lengths.
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}

TRAIN_DOCUMENTS = 600
WINDOW_BYTES = 640
CHUNK = 64
TABLE = 1 << 12
TEMPLATES = 11
O, B, I = 0, 1, 2  # noqa: E741

_HEX = np.array([48 <= b <= 57 or 97 <= b <= 102 for b in range(256)])
_WORD = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 or b in b"+/_.-" for b in range(256)])
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_KIND = np.array([1 if 48 <= b <= 57 else 2 if 65 <= b <= 90 else 3 if 97 <= b <= 122 else 4 if b >= 128 else 5 for b in range(256)], np.uint8)


def base_spans(data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int, int]]]:
    """By text: (start, kind, end, start of the value) of the pattern matches, in bytes from the text's start, sorted."""
    found: list[list[tuple[int, int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    start, end = arrays.runs(_HEX[data], offsets)
    long = end - start >= LEAST["hex"]
    start, end = start[long], end[long]
    for a, b, t in zip(start.tolist(), end.tolist(), (np.searchsorted(offsets, start, "right") - 1).tolist(), strict=True):
        a, b = a - int(offsets[t]), b - int(offsets[t])
        found[t].append((a, 2, b, a))
    whole, at = data.tobytes(), offsets.tolist()
    lowered = whole.lower()
    for t in range(len(at) - 1):
        low = lowered[at[t] : at[t + 1]]
        if b":" in low or b"=" in low:
            for m in ASSIGN.finditer(low):
                if m.end(1) - m.start(1) >= LEAST["assign"]:
                    found[t].append((m.start(), 0, m.end(), m.start(1)))
        if b"akia" in low:
            for m in ACCESS.finditer(whole[at[t] : at[t + 1]]):
                if m.end() - m.start() >= LEAST["access"]:
                    found[t].append((m.start(), 1, m.end(), m.start()))
        found[t].sort()
    return found


class Tokens:
    """The tokens of a slice's texts and their features."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, files: np.ndarray):
        begin, end = arrays.runs(_WORD[data], offsets)
        single = np.flatnonzero(~_WORD[data] & ~_SPACE[data])
        order = np.argsort(np.concatenate([begin, single]), kind="stable")
        self.start = np.concatenate([begin, single])[order]
        self.end = np.concatenate([end, single + 1])[order]
        self.first = np.searchsorted(self.start, offsets)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        n = len(self.start)
        if not n:
            self.features = np.zeros((0, TEMPLATES), np.int32)
            return
        size = self.end - self.start
        word = arrays.hashes(arrays.lower(data), self.start, self.end)
        kind = _KIND[data]
        total = lambda flag: np.concatenate([[0], np.cumsum(flag)])
        count = [total(kind == k) for k in (1, 2, 3)]
        digits, upper, lower = (c[self.end] - c[self.start] for c in count)
        change = np.zeros(len(data) + 1, np.int64)
        change[1:-1] = kind[1:] != kind[:-1]
        turns = np.cumsum(change)
        turns = turns[self.end - 1] - turns[self.start]
        hexes = total(_HEX[data])
        hex_only = hexes[self.end] - hexes[self.start] == size
        length = np.searchsorted([2, 3, 5, 7, 9, 12, 16, 20, 28, 32, 48], size, "right")
        other = size - digits - upper - lower
        coarse = np.searchsorted([8, 16], size, "right")  # what is learnt from keys of one length holds for others
        shape = ((coarse * 2 + (digits > 0)) * 2 + (upper > 0)) * 4 + (lower > 0) * 2 + (other > 0)
        lead = np.minimum(self.start + 4, self.end)
        lead = arrays.hashes(data, self.start, lead)
        near = lambda k: self._near(word, k, offsets)
        is_sign = (size == 1) & ((data[self.start] == 58) | (data[self.start] == 61) | (data[self.start] == 34) | (data[self.start] == 39))
        signs = self._near(is_sign.astype(np.uint64), 1, offsets).astype(np.int64)
        slot = lambda x: (x % np.uint64(TABLE)).astype(np.int32)
        self.features = np.column_stack(
            [
                np.zeros(n, np.int32), shape % TABLE, length * 16 + np.minimum(turns, 15), (coarse * 6 + np.minimum(5 * digits // size, 5)) * 2 + hex_only,
                slot(word), slot(near(1)), slot(near(2)), slot(near(-1)), signs * 128 + coarse * 8 + np.minimum(turns, 7), slot(lead),
                (files[self.text] % 64) * 3 + coarse,
            ]
        ).astype(np.int32) + np.arange(TEMPLATES, dtype=np.int32) * TABLE

    def _near(self, values: np.ndarray, k: int, offsets: np.ndarray) -> np.ndarray:
        """The value k tokens before (after, if negative) in the same text; 0 where there is none."""
        out = np.zeros_like(values)
        if k > 0:
            out[k:] = np.where(self.text[k:] == self.text[:-k], values[:-k], 0)
        else:
            out[:k] = np.where(self.text[:k] == self.text[-k:], values[-k:], 0)
        return out


def file_features(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A small number for each text out of source, language, length and share of digits."""
    digits = np.concatenate([[0], np.cumsum(_KIND[data] == 1)])
    size = np.maximum(np.diff(offsets), 1)
    share = np.searchsorted([0.002, 0.01, 0.05, 0.2], (digits[offsets[1:]] - digits[offsets[:-1]]) / size)
    length = np.searchsorted([300, 3000, 30_000], size)
    names = np.zeros(len(size), np.int64)
    for column in ("source", "lang"):
        if column in batch.schema.names:
            value, at = arrays.buffer(batch.column(column).cast(pa.string()))
            keys = np.array([hash_bytes(value[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)], np.int64)
            names = names * 7 + keys % 8
    return (names + share * 3 + length * 5) % 64


def hash_bytes(value: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(value, digest_size=4).digest(), "little")


class Field:
    """The weights of a trained field."""

    def __init__(self, emit: np.ndarray, move: np.ndarray, begin: np.ndarray, end: np.ndarray):
        self.emit, self.move, self.begin, self.end = emit, move, begin, end

    def scores(self, tokens: Tokens) -> np.ndarray:
        out = np.zeros((len(tokens.features), 3))
        for k in range(TEMPLATES):
            out += self.emit[tokens.features[:, k]]
        return out

    def tags(self, tokens: Tokens) -> np.ndarray:
        """The best tags of all texts."""
        n = len(tokens.features)
        tags = np.zeros(n, np.int8)
        if not n:
            return tags
        score = self.scores(tokens)
        every = np.concatenate([self.move.ravel(), self.begin, self.end])
        sure = score[:, O] - np.maximum(score[:, B], score[:, I]) > 2 * (every.max() - every.min())
        begin, end = arrays.runs(~sure, tokens.first)
        if not len(begin):
            return tags
        size = end - begin
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        at_start = np.isin(begin, tokens.first[:-1])
        at_end = np.isin(begin + size, tokens.first[1:])
        best = np.where(at_start[:, None], self.begin, self.move[O]) + score[begin]
        back = np.zeros((int(size[0]), len(begin), 3), np.int8) if size[0] * len(begin) < 4e6 else None
        steps = [None] * int(size[0])
        for k in range(1, int(size[0])):
            live = int(np.searchsorted(-size, -k, "left"))  # gaps longer than k come first
            options = best[:live, :, None] + self.move
            pick = options.argmax(1).astype(np.int8)
            if back is not None:
                back[k, :live] = pick
            else:
                steps[k] = pick
            best[:live] = np.take_along_axis(options, pick[:, None, :].astype(np.int64), 1)[:, 0] + score[begin[:live] + k]
        last = (best + np.where(at_end[:, None], self.end, self.move[:, O])).argmax(1)
        for k in range(int(size[0]) - 1, -1, -1):
            live = int(np.searchsorted(-size, -k, "left"))
            tags[begin[:live] + k] = last[:live]
            if k:
                from_ = back[k, :live] if back is not None else steps[k]
                last[:live] = np.take_along_axis(from_, last[:live, None].astype(np.int64), 1)[:, 0]
        return tags


def _likelihood_gradient(score: np.ndarray, gold: np.ndarray, real: np.ndarray, field: Field):
    """Gradient of the conditional log-likelihood for rows of tokens, by forward-backward."""
    rows, width, _ = score.shape
    each = real.sum(1) - 1
    log_sum = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
    ahead, behind = np.zeros_like(score), np.zeros_like(score)
    ahead[:, 0] = field.begin + score[:, 0]
    for k in range(1, width):
        new = log_sum(ahead[:, k - 1, :, None] + field.move, 1) + score[:, k]
        ahead[:, k] = np.where(real[:, k, None], new, ahead[:, k - 1])
    behind[:, -1] = field.end
    for k in range(width - 2, -1, -1):
        new = log_sum(field.move + (score[:, k + 1] + behind[:, k + 1])[:, None, :], 2)
        behind[:, k] = np.where(real[:, k + 1, None], new, field.end)
    total = log_sum(ahead[np.arange(rows), each] + field.end, 1)
    single = np.exp(ahead + behind - total[:, None, None]) * real[:, :, None]
    hot = np.eye(3)[gold] * real[:, :, None]
    emit = hot - single
    pairs = real[:, 1:]
    joint = np.exp(ahead[:, :-1, :, None] + field.move + (score[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]) * pairs[:, :, None, None]
    move = np.einsum("rka,rkb->ab", hot[:, :-1] * pairs[:, :, None], hot[:, 1:]) - joint.sum((0, 1))
    begin = emit[:, 0].sum(0)
    end = emit[np.arange(rows), each].sum(0)
    return emit, move, begin, end


def train(features: np.ndarray, gold: np.ndarray, chunks: np.ndarray, rounds: int = 20, rate: float = 0.15, ridge: float = 1e-5) -> Field:
    """Gradient ascent with moving averages (Adam); ``chunks`` bounds token sequences of up to CHUNK tokens."""
    size = np.diff(chunks)
    real = np.arange(CHUNK) < size[:, None]
    at = np.where(real, chunks[:-1, None] + np.arange(CHUNK), 0)
    names, flat = np.unique(features, return_inverse=True)
    flat = flat.reshape(features.shape)
    table = np.zeros((len(names), 3))
    field = Field(table, np.zeros((3, 3)), np.zeros(3), np.zeros(3))
    parts = ("emit", "move", "begin", "end")
    mean = {p: np.zeros_like(getattr(field, p)) for p in parts}
    square = {p: np.zeros_like(getattr(field, p)) for p in parts}
    for step in range(1, rounds + 1):
        score = np.zeros((len(gold), 3))
        for k in range(TEMPLATES):
            score += field.emit[flat[:, k]]
        emit, *rest = _likelihood_gradient(score[at], gold[at], real, field)
        by_token = np.zeros((len(gold), 3))
        by_token[at[real]] = emit[real]
        table = np.zeros_like(field.emit)
        for k in range(TEMPLATES):
            table += np.column_stack([np.bincount(flat[:, k], by_token[:, c], len(names)) for c in range(3)])
        for p, g in zip(parts, (table, *rest), strict=True):
            g = g / len(size) - ridge * getattr(field, p)
            mean[p] = 0.9 * mean[p] + 0.1 * g
            square[p] = 0.99 * square[p] + 0.01 * g * g
            move = mean[p] / (1 - 0.9**step) / (np.sqrt(square[p] / (1 - 0.99**step)) + 1e-9)
            setattr(field, p, getattr(field, p) + rate * move)
    whole = np.zeros((TABLE * TEMPLATES, 3))
    whole[names] = field.emit
    field.emit = whole
    return field


def gold_tags(tokens: Tokens, spans: list[list[tuple[int, int, int, int]]], offsets: np.ndarray) -> np.ndarray:
    """Tags that say which tokens lie in matched values."""
    tags = np.zeros(len(tokens.start), np.int64)
    for t, found in enumerate(spans):
        for _, _, end, value in found:
            a, b = np.searchsorted(tokens.start, [offsets[t] + value, offsets[t] + end])
            tags[a:b] = I
            tags[a : min(a + 1, b)] = B
    return tags


def window_of(text: bytes, spans: list[tuple[int, int, int, int]], key: int) -> bytes:
    """About WINDOW_BYTES of a text around one of its matches, or anywhere; cut at white space."""
    if len(text) <= WINDOW_BYTES:
        return text
    if spans:
        start, _, end, _ = spans[key % len(spans)]
        low = max(0, min(start - WINDOW_BYTES // 3, end + WINDOW_BYTES // 3 - WINDOW_BYTES))
    else:
        low = key % (len(text) - WINDOW_BYTES + 1)
    piece = text[low : low + WINDOW_BYTES]
    first = re.search(rb"\s", piece) if low else None
    last = piece.rfind(b" ") if low + WINDOW_BYTES < len(text) else -1
    return piece[first.end() if first and first.end() < len(piece) // 4 else 0 : last if last > 3 * len(piece) // 4 else None].decode("utf-8", "ignore").encode()


def windows(docs: DataFrame, limit: int) -> list:
    """(cued, at, file, window): training windows of up to ``limit`` rows of either kind, those with the smallest hashes ``at``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    grain, rows = 1 << 30, docs.count()
    share = lambda often: min(grain, int(grain * often * limit / max(rows, 1)))
    plain = share(64)  # of rows without a match so many are more than enough
    names = [c for c in ("source", "lang") if c in docs.columns]
    keyed = docs.select(text.alias("text"), *[F.col(c).cast("string").alias(c) for c in names], F.pmod(F.xxhash64("doc_id", text), F.lit(grain)).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bool, list] = {True: [], False: []}
        for batch in arrays.slices(batches):
            data, offsets = arrays.buffer(batch.column("text"))
            found, files = base_spans(data, offsets), file_features(batch, data, offsets)
            for t, at in enumerate(batch.column("at").to_pylist()):
                if not found[t] and at >= plain:
                    continue  # beyond the smallest, whatever the other tasks have
                mine = kept[bool(found[t])]
                if len(mine) < 2 * limit or at < mine[limit - 1][0]:
                    mine.append((at, int(files[t]), window_of(data[offsets[t] : offsets[t + 1]].tobytes(), found[t], at)))
                if len(mine) >= 4 * limit:
                    mine.sort()
                    del mine[limit:]
        for cued, mine in kept.items():
            mine.sort()
            if mine[:limit]:
                at, files, pieces = zip(*mine[:limit], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([cued] * len(at)), pa.array(at, pa.int64()), pa.array(files, pa.int64()), pa.array(pieces, pa.binary())], ["cued", "at", "file", "window"])

    def taken(often_cued: float) -> DataFrame:
        found = keyed.where(F.col("at") < max(share(often_cued), share(64))).mapInArrow(run, "cued boolean, at long, file long, window binary")
        # the smallest of each of many shares of the hashes first, so that no task sorts what all tasks have kept
        for keys in (["cued", F.pmod(F.xxhash64("at"), F.lit(256))], ["cued"]):
            place = F.row_number().over(Window.partitionBy(*keys).orderBy("at", "window"))
            found = found.withColumn("_n", place).where(F.col("_n") <= limit).drop("_n")
        return found

    some = taken(1000).collect()
    if share(1000) < grain and sum(r.cued for r in some) < limit // 4:  # matches are rarer: look at every row
        some = taken(float(rows)).collect()
    return sorted(some)


def masked(data: np.ndarray, spans: list[tuple[int, int, int, int]], pick: np.random.Generator) -> None:
    """Other characters for key words, signs and values, in place: letters for letters, a usual kind of key for a value."""
    for start, _, end, value in spans:
        for signs in (b":=", b"\"'"):
            at = np.flatnonzero(np.isin(data[start:value], list(signs))) + start
            data[at] = pick.choice(list(signs), len(at))
        word = np.flatnonzero(np.isin(_KIND[data[start:value]], (2, 3))) + start
        data[word] = pick.integers(97, 123, len(word))
        data[value:end] = pick.choice(ALPHABETS[pick.integers(len(ALPHABETS))], end - value)


def trained(docs: DataFrame, limit: int = TRAIN_DOCUMENTS) -> Field | None:
    """A field fitted on a bounded sample of windows; None if no pattern matches in it."""
    rows = windows(docs, limit)
    data, offsets = arrays.buffer(pa.array([r.window for r in rows], pa.binary()))
    data, spans = data.copy(), base_spans(data, offsets)
    if not any(spans):
        return None
    pick = np.random.default_rng(len(rows))
    for t in range(0, len(rows), 2):
        masked(data[offsets[t] : offsets[t + 1]], spans[t], pick)
    tokens = Tokens(data, offsets, np.array([r.file for r in rows]))
    tags = gold_tags(tokens, spans, offsets)
    cuts = np.concatenate([np.arange(a, b, CHUNK) for a, b in zip(tokens.first[:-1], tokens.first[1:], strict=True)] + [[len(tags)]])
    return train(tokens.features, tags, cuts)


def spans_of(tokens: Tokens, tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, start, end) of the tagged stretches, in bytes of the slice."""
    inside = tags > 0
    begin, end = arrays.runs(inside, tokens.first)
    out = []
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        starts = [a, *(np.flatnonzero(tags[a + 1 : b] == B) + a + 1).tolist(), b]
        out += [(int(tokens.text[x]), int(tokens.start[x]), int(tokens.end[y - 1])) for x, y in zip(starts, starts[1:], strict=False)]
    return out


def scan(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf (added spans), n_field (all spans of the field); places are code points."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(field)  # a table of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.slices(batches):
            data, offsets = arrays.buffer(batch.column("text"))
            found = base_spans(data, offsets)
            added: list[list[tuple[int, int]]] = [[] for _ in found]
            if sent.value is not None:
                tokens = Tokens(data, offsets, file_features(batch, data, offsets))
                for t, a, b in spans_of(tokens, sent.value.tags(tokens)):
                    added[t].append((a - int(offsets[t]), b - int(offsets[t])))
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf", "n_field")}
            for t, base in enumerate(found):
                origin = int(offsets[t])
                place = lambda x, origin=origin: int(points[origin + x] - points[origin])
                known = {(s, e) for s, _, e, _ in base}
                extra = [(a, 3, b) for a, b in added[t] if (a, b) not in known]
                every = [f"{KINDS[k]}:{place(a)}:{place(b)}" for a, k, b in sorted([(s, k, e) for s, k, e, _ in base] + extra)]
                first = ",".join(x for x in every if not x.startswith("crf"))
                for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                    out[name].append(sum(x[1] == k for x in base))
                out["n_crf"].append(len(extra))
                out["n_field"].append(len(added[t]))
                out["base_sha256"].append(hashlib.sha256(first.encode()).hexdigest())
                out["spans"].append(",".join(every))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(v, pa.string() if isinstance(v[0], str) else pa.int64()) for v in out.values()]], ["doc_id", *out])

    columns = ["doc_id", F.col("text").cast("string").alias("text"), *[F.col(c).cast("string").alias(c) for c in ("source", "lang") if c in docs.columns]]
    return docs.select(*columns).mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long, n_field long")


def find_secrets(docs: DataFrame, limit: int = TRAIN_DOCUMENTS) -> DataFrame:
    """Train on a bounded sample and scan every whole text."""
    return scan(docs, trained(docs, limit))
