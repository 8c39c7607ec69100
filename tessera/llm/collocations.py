"""Collocations: phrases of two or three words that come together more often than their parts would.

Everything is counted by language.  A word is the 64-bit key of its language and bytes; that no frequent key stands for two words is
checked against the whole vocabulary, and another seed is taken if one does.  A phrase is the tuple of its words' keys, so it is never mistaken.

1. Words are counted by one aggregate.
2. Level by level, each task over texts maps its occurrences to candidates that are Apriori-safe: a pair only where a bitmap of ``FILTER_BITS``
   says that both words may reach ``LEAST``, a triple only where one says so of both its pairs.  A bitmap may let too much pass, never too little.
   What passes is summed within the task, ``FLUSH`` occurrences at a time, and dealt to shards by the phrase's hash, one packed row for each shard;
   packed rows go to Spark ``BATCH`` keys at a time.
3. A shard drops phrases whose hash bucket holds fewer than ``LEAST`` occurrences, and builds a minimal perfect hash over the rest (levels of
   bits: the keys that are alone at their place are numbered by the bits before it, the others go to the next level).  Its packed rows, made one, are mapped
   ``PIECE`` entries at a time to an array over the slots by one bincount, the stored key of the slot deciding whether it is the phrase, and the arrays are summed by a tree.
4. A shard of candidates asks the shards of their parts for their counts, each different part once, as plain rows.  They are read at the slot that the part's hash
   gives, the stored key again deciding, and go back to the shard that asked; a pair that a triple covers is told to its own shard on the way.  A candidate's
   score is the least over its cuts, in whole numbers of 38 digits.

A shard has about ``SHARD_BYTES`` of packed rows, however large the corpus, and since a task sums first, the most common phrase adds one entry for each
``FLUSH`` occurrences.  The two bitmaps are all that is broadcast.  The driver sees the bitmaps, the number of words, and no phrase.

Defined results: a null text is empty, a null language is ``und``; a language without candidates has no rows; repeated documents count each; equal
scores and counts go by phrase, in byte order; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import arrays
from tessera.storage import written

LEAST = 10
LONGEST = 3
FIRST = 2000
COVERED = 50
FILTER_BITS = 26
FLUSH = 2_000_000
BATCH = 1 << 17
PIECE = 1 << 18
SHARD_BYTES = 24 << 20
SEEDS = 8
MOST_TASKS = 20_000
#: Shards that a task goes through one by one where only candidates or words are left of them.
SMALL = 4
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BREAKS = np.array([chr(b) in ".,;:!?" or 10 <= b <= 13 for b in range(256)])
_WORD = ~_BREAKS & np.array([b not in (9, 32) for b in range(256)])


def tuple_hash(columns: list[np.ndarray], seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each row of some columns of keys."""
    x = arrays.mix(columns[0] + np.array(seed * 2 + 1, np.uint64) * _STEP)
    for c in columns[1:]:
        x = arrays.mix(x * np.uint64(3) + c)
    return x


class PerfectHash:
    """A minimal perfect hash of distinct rows of keys: 0..n-1, without gaps; rows that it wasn't built of get any slot or -1."""

    def __init__(self, levels: list[np.ndarray], size: int):
        self.levels, self.size = levels, size
        self.before = [np.concatenate([[0], np.cumsum(x)]) for x in levels]
        done = np.cumsum([0, *[int(b[-1]) for b in self.before]])
        self.base = done[:-1]

    @staticmethod
    def build(columns: list[np.ndarray]) -> PerfectHash:
        levels, left, n = [], columns, len(columns[0])
        while len(left[0]):
            m = max(64, 2 * len(left[0]))
            place = (tuple_hash(left, len(levels) + 1) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(place, minlength=m) == 1
            levels.append(alone)
            left = [c[~alone[place]] for c in left]
        return PerfectHash(levels, n)

    def slots(self, columns: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(columns[0]), -1)
        todo = np.arange(len(out))
        for k, bits in enumerate(self.levels):
            if not len(todo):
                break
            place = (tuple_hash([c[todo] for c in columns], k + 1) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[place]
            out[todo[hit]] = self.base[k] + self.before[k][place[hit]]
            todo = todo[~hit]
        return out

    def packed(self) -> bytes:
        head = np.array([self.size, len(self.levels), *map(len, self.levels)], "<i8").tobytes()
        return head + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @staticmethod
    def unpacked(data: bytes) -> PerfectHash:
        size, n = np.frombuffer(data, "<i8", 2).tolist()
        widths, at, levels = np.frombuffer(data, "<i8", n, 16).tolist(), 16 + 8 * n, []
        for w in widths:
            k = -(-w // 8)
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, k, at), count=w).astype(bool))
            at += k
        return PerfectHash(levels, size)


def _columns(data: bytes, level: int) -> list[np.ndarray]:
    rows = np.frombuffer(data, "<u8").reshape(-1, level)
    return [np.ascontiguousarray(rows[:, k]) for k in range(level)]


def _rows(columns: list[np.ndarray]) -> np.ndarray:
    """The keys of one row after the other, as ``_columns`` reads them."""
    return np.stack(columns, axis=1).astype("<u8", copy=False)


def _same(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    return np.logical_and.reduce([x == y for x, y in zip(a, b, strict=True)])


def _distinct(columns: list[np.ndarray]) -> list[np.ndarray]:
    order = np.argsort(tuple_hash(columns), kind="stable")
    got = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = ~_same([c[1:] for c in got], [c[:-1] for c in got])
    got = [c[new] for c in got]
    h = tuple_hash(got)
    if (h[1:] == h[:-1]).any():  # two rows of one hash may have come in turns
        return list(np.unique(np.stack(got), axis=1))
    return got


def _tree_sum(parts: list[np.ndarray]) -> np.ndarray:
    while len(parts) > 1:
        parts = [parts[i] + parts[i + 1] if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def counted(rows: list[tuple[bytes, bytes]], level: int, least: int) -> tuple[PerfectHash, list[np.ndarray], np.ndarray] | None:
    """Of packed rows (keys, counts) of one shard: the hash over what may reach ``least``, the stored keys and the exact counts by slot."""
    # as many steps as a shard has entries, however many rows they came in
    keys, count = _columns(b"".join(k for k, _ in rows), level), np.frombuffer(b"".join(c for _, c in rows), "<i8")
    m = 1 << max(10, (4 * len(count)).bit_length())
    at = (tuple_hash(keys, 99) % np.uint64(m)).astype(np.int64)
    may = np.bincount(at, count, m)[at] >= least
    if not may.any():
        return None
    keys, count = [k[may] for k in keys], count[may]
    distinct = _distinct(keys)
    found = PerfectHash.build(distinct)
    slot = found.slots(distinct)
    stored = [np.empty_like(k) for k in distinct]
    for s, k in zip(stored, distinct, strict=True):
        s[slot] = k

    def occurrences(k: list[np.ndarray], c: np.ndarray) -> np.ndarray:
        at = found.slots(k)
        good = _same([s[at] for s in stored], k)
        return np.bincount(at[good], c[good], found.size).astype(np.int64)

    return found, stored, _tree_sum([occurrences([k[i : i + PIECE] for k in keys], count[i : i + PIECE]) for i in range(0, len(count), PIECE)])


def _tokens(batch: pa.RecordBatch, seed: int) -> tuple[np.ndarray, ...]:
    """Bytes, starts and ends of words, their documents, their keys, and whether the next word follows within the piece."""
    data, offsets = arrays.buffer(batch.column("text"))
    data = arrays.lower(data)
    starts, ends = arrays.runs(_WORD[data], offsets)
    doc = np.searchsorted(offsets, starts, "right") - 1
    names, at = arrays.buffer(batch.column("lang"))
    full = np.flatnonzero(np.diff(at))
    lang = np.zeros(len(at) - 1, np.uint64)
    lang[full] = arrays.hashes(names, at[full], at[full + 1])
    keys = arrays.mix(arrays.hashes(data, starts, ends) + arrays.mix(lang + np.array(seed, np.uint64) * _STEP)[doc])
    breaks = np.flatnonzero(_BREAKS[data])
    joined = np.zeros(len(starts), bool)
    joined[:-1] = (doc[1:] == doc[:-1]) & (np.searchsorted(breaks, starts[1:]) == np.searchsorted(breaks, ends[:-1]))
    return data, starts, ends, doc, keys, joined


def _words(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, word, h, n) of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.slices(batches, limit=2 * arrays.SLICE_BYTES):
            data, starts, ends, doc, keys, _ = _tokens(batch, seed)
            some, first, n = np.unique(keys, return_index=True, return_counts=True)
            size = (ends - starts)[first]
            at = np.concatenate([[0], np.cumsum(size)])
            flat = data[np.arange(at[-1]) + np.repeat(starts[first] - at[:-1], size)]
            words = pa.LargeStringArray.from_buffers(len(some), pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(flat.tobytes())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(doc[first])), words, pa.array(some.view(np.int64)), pa.array(n)], ["lang", "word", "h", "n"])

    return docs.mapInArrow(run, "lang string, word string, h long, n long").groupBy("lang", "word", "h").agg(F.sum("n").alias("n"))


def _bitmap(places: DataFrame) -> np.ndarray:
    """The set of ``place`` (below 2 ** FILTER_BITS) as packed bits; summed up by Spark, a bounded number of bytes for the driver."""
    at = F.col("place") + 1
    parts = places.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(max(1, (1 << FILTER_BITS) // 8), np.uint8)
    for r in parts:
        bits = np.frombuffer(r["bits"], np.uint8)
        low = (r["b"] - 1) * len(bits)
        out[low : low + len(bits)] = bits[: len(out) - low]
    return out


def _may(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes >> np.uint64(65 - (8 * len(bits)).bit_length())).astype(np.int64)
    return (bits[at >> 3] >> (at & 7)) & 1 == 1


def _packed(columns: list[np.ndarray], count: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """Rows of keys summed and cut into one packed row for each shard that has some, ``BATCH`` keys or one longer row at a time."""
    h = tuple_hash(columns)
    order = np.argsort(h)
    h, columns, count = h[order], [c[order] for c in columns], count[order]
    new = np.ones(len(h), bool)
    new[1:] = ~_same([c[1:] for c in columns], [c[:-1] for c in columns])
    first = np.flatnonzero(new)
    count, h = np.add.reduceat(count, first) if len(first) else count, h[first]
    keys, count = _rows([c[first] for c in columns]), count.astype("<i8", copy=False)
    shard = ((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    cuts = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
    some = np.flatnonzero(np.diff(cuts))
    ends, low = cuts[some + 1], 0
    while low < len(some):
        start = cuts[some[low]]
        high = max(low + 1, int(np.searchsorted(ends, start + BATCH, "right")))
        at = np.concatenate([[start], ends[low:high]])
        packed = [pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(((at - start) * x[:1].nbytes).astype(np.int32)), pa.py_buffer(x[start : at[-1]])]) for x in (keys, count)]
        yield pa.RecordBatch.from_arrays([pa.array(some[low:high].astype(np.int32)), *packed], ["shard", "keys", "counts"])
        low = high


def shard_of(columns: list[np.ndarray], shards: int) -> np.ndarray:
    return (((tuple_hash(columns) >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _phrases(docs: DataFrame, level: int, seed: int, shards: int, words: np.ndarray, pairs: np.ndarray | None) -> DataFrame:
    """(shard, keys, counts): packed occurrences of the Apriori-safe candidates of ``level`` words."""
    most = FLUSH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            yield from _packed(columns, np.ones(len(columns[0]), np.int64), shards)

        for batch in arrays.slices(batches):
            *_, keys, joined = _tokens(batch, seed)
            if len(keys) < level:
                continue
            may = _may(words, keys)
            pair = joined[:-1] & may[:-1] & may[1:]
            if level == 2:
                at = np.flatnonzero(pair)
            else:
                first = np.flatnonzero(pair)
                pair[first] = _may(pairs, tuple_hash([keys[first], keys[first + 1]]))
                at = np.flatnonzero(pair[:-1] & pair[1:])
            if len(at):
                held.append([keys[at + k] for k in range(level)])
            if sum(len(x[0]) for x in held) >= most:
                yield from flush()
        if held:
            yield from flush()

    return docs.mapInArrow(run, "shard int, keys binary, counts binary")


_MODEL = "level int, shard int, hash binary, keys binary, counts binary, langs array<string>, words array<string>"
_NAMES = ["level", "shard", "hash", "keys", "counts", "langs", "words"]


def _model_row(level: int, shard: int, found: PerfectHash, stored: list[np.ndarray], count: np.ndarray, langs=None, words=None) -> pa.RecordBatch:
    texts = [pa.array([x], pa.list_(pa.string())) for x in (langs, words)]
    return pa.RecordBatch.from_arrays([pa.array([level], pa.int32()), pa.array([shard], pa.int32()), *[pa.array([x], pa.binary()) for x in (found.packed(), _rows(stored).tobytes(), count.astype("<i8").tobytes())], *texts], _NAMES)


def _grouped(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of one shard after another; they come sorted by shard."""
    now, held = None, []
    for batch in batches:
        for shard, *rest in zip(*(batch.column(c).to_pylist() for c in ["shard", *names]), strict=True):
            if shard != now and held:
                yield now, held
                held = []
            now = shard
            held.append(tuple(rest))
    if held:
        yield now, held


def _models(chunks: DataFrame, level: int, shards: int, least: int) -> DataFrame:
    """A row for each shard: its hash, stored keys and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _grouped(batches, ["keys", "counts"]):
            if got := counted(rows, level, least):
                yield _model_row(level, shard, *got)
        arrays.release()

    return written(chunks.repartition(min(shards, MOST_TASKS), "shard").sortWithinPartitions("shard").mapInArrow(run, _MODEL), f"phrases-{level}")


def _word_models(words: DataFrame, shards: int) -> DataFrame:
    """As ``_models`` for words, with the words themselves."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard_of([h], shards).astype(np.int32))], [*batch.schema.names, "shard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _grouped(batches, ["h", "n", "lang", "word"]):
            h, n = np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([r[1] for r in rows], np.int64)
            found = PerfectHash.build([h])
            order = np.argsort(found.slots([h]))
            yield _model_row(1, shard, found, [h[order]], n[order], [rows[i][2] for i in order], [rows[i][3] for i in order])

    dealt = words.select("h", "n", "lang", "word").mapInArrow(place, "h long, n long, lang string, word string, shard int")
    return written(dealt.repartition(min(-(-shards // SMALL), MOST_TASKS), "shard").sortWithinPartitions("shard").mapInArrow(run, _MODEL), "phrases-1")


def _pair_places(models: DataFrame, least: int) -> DataFrame:
    """Where the frequent pairs stand in their bitmap."""
    shift = np.uint64(64 - FILTER_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                good = np.frombuffer(counts, "<i8") >= least
                h = tuple_hash([k[good] for k in _columns(keys, 2)])
                yield pa.RecordBatch.from_arrays([pa.array((h >> shift).astype(np.int64))], ["place"])

    return models.select("keys", "counts").mapInArrow(run, "place long")


def _requests(models: DataFrame, shards: int, least: int) -> DataFrame:
    """What the candidates of each shard (of_level, of_shard) ask of their parts, each different part once: its level, shard and keys, and of pairs the most that one of the triples has."""
    names = ["level", "shard", "k1", "k2", "most", "of_level", "of_shard"]

    def asked(part: list[np.ndarray], most: np.ndarray, level: int, shard: int) -> Iterator[pa.RecordBatch]:
        order = np.argsort(tuple_hash(part))
        part, most = [c[order] for c in part], most[order]
        new = np.ones(len(order), bool)
        new[1:] = ~_same([c[1:] for c in part], [c[:-1] for c in part])
        first = np.flatnonzero(new)
        part, most = [c[first] for c in part], np.maximum.reduceat(most, first)
        n, of = len(first), shard_of(part, shards).astype(np.int32)
        same = lambda x: np.full(n, x, np.int32)
        k1, k2 = part[0], part[1] if len(part) > 1 else np.zeros(n, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (same(len(part)), of, k1.view(np.int64), k2.view(np.int64), most, same(level), same(shard))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for level, shard, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("level", "shard", "keys", "counts")), strict=True):
                a = np.frombuffer(counts, "<i8")
                good = a >= least
                if not good.any():
                    continue
                a, columns = a[good], [k[good] for k in _columns(keys, level)]
                yield from asked([np.concatenate(columns)], np.zeros(level * len(a), np.int64), level, shard)
                if level == 3:
                    yield from asked([np.concatenate(columns[:2]), np.concatenate(columns[1:])], np.tile(a, 2), level, shard)

    return models.where("level > 1").select("level", "shard", "keys", "counts").mapInArrow(run, "level int, shard int, k1 long, k2 long, most long, of_level int, of_shard int")


def _behind(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict | None, pa.RecordBatch | None]]:
    """A model row, then the rows behind it in one or more batches, of partitions in which each shard's model comes first."""
    for batch in batches:
        at = np.flatnonzero(batch.column("hash").is_valid().to_numpy(zero_copy_only=False))
        for low, high in zip([0, *(at + 1).tolist()], [*at.tolist(), batch.num_rows], strict=True):
            if low:
                yield batch.slice(low - 1, 1).to_pylist()[0], None
            if low < high:
                yield None, batch.slice(low, high - low)


def _keys(batch: pa.RecordBatch | pa.Table, *names: str) -> list[np.ndarray]:
    return [np.ascontiguousarray(batch.column(c).to_numpy()).view(np.uint64) for c in names]


def _dealt(models: DataFrame, rows: DataFrame, shards: int) -> DataFrame:
    """Rows behind the model of their level and shard."""
    both = models.unionByName(rows, allowMissingColumns=True)
    return both.repartition(min(-(-shards // SMALL), MOST_TASKS), "level", "shard").sortWithinPartitions("level", "shard", F.col("hash").isNull())


def _answers(models: DataFrame, requests: DataFrame, shards: int) -> DataFrame:
    """(level, shard, k1, k2, part, f, lang, word) for the shard that asked: the count f of a part of so many words, read at its slot.  Part 0 tells a pair's shard that a triple covers it."""
    names = ["level", "shard", "k1", "k2", "part", "f", "lang", "word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for model, batch in _behind(batches):
            if model is not None:
                level, shard = model["level"], model["shard"]
                found, stored, count = PerfectHash.unpacked(model["hash"]), _columns(model["keys"], level), np.frombuffer(model["counts"], "<i8")
                texts = [pa.array(model[c], pa.string()) if model[c] is not None else None for c in ("langs", "words")]
                continue
            keys = _keys(batch, "k1", "k2")[:level]
            at = found.slots(keys)
            if not _same([s[at] for s in stored], keys).all():  # Apriori: a candidate's parts are frequent, so they are stored
                raise RuntimeError("a part of a frequent phrase isn't among the frequent ones")
            where, same = pa.array(at), lambda x, n: pa.array(np.full(n, x, np.int32))
            said = [t.take(where) if t is not None else pa.nulls(len(at), pa.string()) for t in texts]
            k1, k2 = batch.column("k1"), batch.column("k2")
            yield pa.RecordBatch.from_arrays([batch.column("of_level"), batch.column("of_shard"), k1, k2, same(level, len(at)), pa.array(count[at]), *said], names)
            if level == 2:
                most = batch.column("most").to_numpy()
                over = np.flatnonzero(most * 100 >= count[at] * COVERED)
                n, which = len(over), pa.array(over)
                yield pa.RecordBatch.from_arrays([same(2, n), same(shard, n), k1.take(which), k2.take(which), same(0, n), pa.array(most[over]), *[pa.nulls(n, pa.string())] * 2], names)

    dealt = _dealt(models.where("level < 3"), requests, shards)
    return dealt.mapInArrow(run, "level int, shard int, k1 long, k2 long, part int, f long, lang string, word string")


def _places(keys: list[np.ndarray], asked: list[np.ndarray]) -> np.ndarray:
    """Where each row of keys that is asked for stands; each is there."""
    h = tuple_hash(keys)
    order = np.argsort(h)
    at = np.searchsorted(h[order], tuple_hash(asked))
    while True:  # rows of one hash are gone through
        if (at >= len(order)).any():
            raise RuntimeError("a count that was asked for is missing")
        other = ~_same([k[order[at]] for k in keys], asked)
        if not other.any():
            return order[at]
        at = at + other


def _candidates(models: DataFrame, answers: DataFrame, shards: int, least: int) -> DataFrame:
    """(lang, phrase, words, a, w1, w2, w3, p12, p23): the candidates that no triple covers, with their parts' counts; what has no third word has no count of it nor of pairs."""
    names = ["lang", "phrase", "words", "a", "w1", "w2", "w3", "p12", "p23"]

    def made(model: dict, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, a = model["level"], np.frombuffer(model["counts"], "<i8")
        good = a >= least
        if not good.any():
            return
        a, columns = a[good], [k[good] for k in _columns(model["keys"], level)]
        rows = pa.Table.from_batches(held)
        kinds = rows.column("part").to_numpy()
        of = lambda kind: rows.take(pa.array(np.flatnonzero(kinds == kind))).combine_chunks()
        covered = of(0)
        if covered.num_rows:
            kept = np.ones(len(a), bool)
            kept[_places(columns, _keys(covered, "k1", "k2"))] = False
            a, columns = a[kept], [c[kept] for c in columns]
            if not len(a):
                return
        words = of(1)
        keys = _keys(words, "k1")
        at = [_places(keys, [c]) for c in columns]
        f = words.column("f").to_numpy()
        counts = [f[x] for x in at]
        if level == 3:
            pairs = of(2)
            keys, f = _keys(pairs, "k1", "k2"), pairs.column("f").to_numpy()
            counts += [f[_places(keys, columns[k : k + 2])] for k in (0, 1)]
        lang, word = (words.column(c).combine_chunks() for c in ("lang", "word"))
        lang, phrase = lang.take(pa.array(at[0])), pc.binary_join_element_wise(*[word.take(pa.array(x)) for x in at], " ")
        nothing = [pa.nulls(len(a), pa.int64())] * (5 - len(counts))
        yield pa.RecordBatch.from_arrays([lang, phrase, pa.array(np.full(len(a), level, np.int32)), pa.array(a), *[pa.array(c) for c in counts], *nothing], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for model, batch in _behind(batches):
            if batch is not None:
                held.append(batch.select(["part", "k1", "k2", "f", "lang", "word"]))
                continue
            if held:
                yield from made(now, held)
            now, held = model, []
        if held:
            yield from made(now, held)
        arrays.release()

    dealt = _dealt(models.where("level > 1").drop("langs", "words"), answers, shards)
    return dealt.mapInArrow(run, "lang string, phrase string, words int, a long, w1 long, w2 long, w3 long, p12 long, p23 long")


#: The score of one cut, in whole numbers of 38 digits.
SCORE = "cast((cast(a as decimal(15, 0)) * cast(a as decimal(15, 0)) * 1000000) div (cast({0} as decimal(19, 0)) * cast({1} as decimal(19, 0))) as long)"


def mine(docs: DataFrame, least: int = LEAST, first: int | None = FIRST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the ``first`` phrases by score, count and phrase; all of them for None."""
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    for seed in range(SEEDS):
        words = written(_words(texts, seed), "words")
        twice = words.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).where((F.col("k") > 1) & (F.col("n") >= least))
        if twice.isEmpty():
            break
    else:
        raise RuntimeError("frequent words share their keys under every seed")
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    shards = max(1, -(-int(words.agg(F.sum("n")).first()[0] or 0) * 8 * LONGEST // SHARD_BYTES))
    frequent = words.where(F.col("n") >= least)
    may = _bitmap(frequent.select(F.shiftrightunsigned("h", 64 - FILTER_BITS).alias("place")))
    one = _word_models(frequent, shards)
    two = _models(_phrases(texts, 2, seed, shards, may, None), 2, shards, least)
    three = _models(_phrases(texts, 3, seed, shards, may, _bitmap(_pair_places(two, least))), 3, shards, least)
    models = one.unionByName(two).unionByName(three)
    answers = _answers(models, _requests(models, shards, least), shards)
    row = written(_candidates(models, answers, shards, least), "candidates")
    cut = lambda l, r, k: F.struct(F.expr(SCORE.format(l, r)).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r"))  # noqa: E731, E741
    best = F.when(F.col("words") == 2, cut("w1", "w2", 1)).otherwise(F.least(cut("w1", "p23", 1), cut("p12", "w3", 2)))
    phrases = row.select("lang", "phrase", "a", best.alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    if first is not None:  # in two steps, so that no task ranks a whole language
        salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
        phrases = phrases.withColumn("_r", F.row_number().over(salted)).where(F.col("_r") <= first).drop("_r")
    ranked = phrases.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if first is not None:
        ranked = ranked.where(F.col("rank") <= first)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
