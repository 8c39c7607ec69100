"""Benchmark decontamination with suffix arrays of the training texts.

A shard is a slice of a task's texts as one row of word keys.  Its suffix array is made by prefix
doubling down to ``DEPTH`` words or a window, if that is longer.  Every suffix of every benchmark item is looked up in it by
binary search, all side by side.  That gives

* for suffixes that begin with a whole window, the places of all occurrences: one interval of the array.  The words that these
  cover are hit;
* for every suffix its neighbours in the shard, and so for every place of the shard the two item suffixes next to it, one of which has
  the longest match that begins there.  Matches as long as the array is deep go on to their true end, found in the items' own
  suffix array, which is sorted all the way.  Of each document the longest is kept, with its place and item.

A document lies in one shard, so nothing is shuffled.

A window is ``WINDOW`` consecutive words of an item; an item of fewer, but not none, is one.
Words are compared by 64-bit keys over their bytes.

The items are a stated query set: they go to the tasks in blocks of ``BLOCK_BYTES`` of text at most, and the driver holds one
block and one partition's rows at a time.  A worker keeps the arrays of the last block it saw.  Where there is more than one block, the documents are written once
with a row number, every block is a pass over that table, and only row numbers and findings are shuffled to unite the passes.

Defined results: a null or empty text has no words, isn't contaminated and has a longest match of 0 and no place or item; items without words
and null texts have no window; repeated documents and items each count for themselves; an empty
benchmark contaminates nothing; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import arrays
from tessera.storage import written

WINDOW = 13
DEPTH = 16
BLOCK_BYTES = 2 << 20


def suffix_array(keys: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Places of the suffixes of some word keys in the order of their first ``depth`` words."""
    n = len(keys)
    order = np.argsort(keys)
    rank = _ranks(keys[order], order, n)
    step = 1
    while step < depth:
        pair = rank[:n].astype(np.uint64) << np.uint64(32)
        pair[: max(n - step, 0)] |= rank[step:n].astype(np.uint64)
        order = np.argsort(pair)
        rank = _ranks(pair[order], order, n)
        step *= 2
    return order


def _ranks(ordered: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(n, np.uint32)
    rank[order] = np.cumsum(new, dtype=np.uint32)
    return rank


def _keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word keys of a text column with a 0 after each text, where each text starts, and how many words it has."""
    data, offsets = arrays.buffer(column)
    _, words, count = arrays.words(arrays.lower(data), offsets, arrays.ALNUM)
    keys = np.zeros(len(words) + len(count), np.uint64)
    keys[np.arange(len(words)) + np.repeat(np.arange(len(count)), count)] = np.maximum(words, 1)
    return keys, np.cumsum(count + 1) - (count + 1), count


def _common(a: np.ndarray, at: np.ndarray, b: np.ndarray, to: np.ndarray, most: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Words that a from ``at`` and b from ``to`` share, ``most`` at most, and whether b is below (-1), the same as far as that (0) or above (1).

    A 0 ends a text: two ends are no common word, and an end is below every word.
    """
    size, state = np.zeros(len(at), np.int64), np.zeros(len(at), np.int8)
    most = np.broadcast_to(np.asarray(most, np.int64), len(at))
    going = np.flatnonzero(most > 0)
    while len(going):
        x, y = a[at[going] + size[going]], b[to[going] + size[going]]
        state[going] = np.where(y < x, -1, (y > x).astype(np.int8))
        going = going[(x == y) & (x != 0)]
        size[going] += 1
        going = going[size[going] < most[going]]
    return size, state


def _bound(array: np.ndarray, keys: np.ndarray, wanted: np.ndarray, at: np.ndarray, depth: np.ndarray, upper: bool) -> np.ndarray:
    """The first place of a suffix array of ``keys`` that isn't below (is above) the first ``depth`` words of wanted[at:]."""
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(array))
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        _, state = _common(wanted, at[open_], keys, array[middle], depth[open_])
        right = state <= 0 if upper else state < 0
        low[open_[right]] = middle[right] + 1
        high[open_[~right]] = middle[~right]
        open_ = open_[low[open_] < high[open_]]
    return low


class Items:
    """The suffix array of a block of benchmark items, and their windows."""

    def __init__(self, rows: list[tuple[object, str | None]], window: int = WINDOW):
        rows = sorted((str(i), t) for i, t in rows if t)
        keys, starts, count = _keys(pa.array([t for _, t in rows], pa.string()))
        self.window, self.depth = window, max(DEPTH, window)
        self.names = [i for i, _ in rows]
        self.keys = np.concatenate([keys, np.zeros(self.depth + 1, np.uint64)])
        self.array = suffix_array(keys, int(count.max(initial=0)) + 1)
        self.array = self.array[keys[self.array] != 0]
        item = np.repeat(np.arange(len(rows)), count + 1)
        self.item = item[self.array]
        place = self.array - starts[self.item]
        left = count[self.item] - place
        # suffixes with the same first words are looked up once
        depth = np.minimum(left, self.depth)
        self.probes = self._different(np.arange(len(self.array)), depth)[0]
        self.probe_depth = depth[self.probes]
        # windows in the order of the array: equal ones stand side by side
        size = count[self.item]
        begins = np.flatnonzero((left >= window) | ((place == 0) & (size < window)))
        depth = np.minimum(size[begins], window)
        first, which = self._different(begins, depth)
        self.windows, self.window_depth = self.array[first], np.minimum(size[first], window)
        held = np.unique(np.column_stack([which, self.item[begins]]), axis=0) if len(begins) else np.zeros((0, 2), np.int64)
        self.held, self.holds = held[:, 1], np.searchsorted(held[:, 0], np.arange(len(first) + 1))
        # least[k][i]: the least item of 2^k places of the array from i
        self.least = [self.item.astype(np.int32)]
        while 2 << (len(self.least) - 1) <= len(self.item):
            last, step = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(last[:-step], last[step:]))

    def _different(self, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of places of the array those whose first ``depth`` words differ from the one's before; and for each place which of them it equals."""
        new = np.ones(len(at), bool)
        if len(at) > 1:
            shared, _ = _common(self.keys, self.array[at[1:]], self.keys, self.array[at[:-1]], depth[1:])
            new[1:] = (depth[1:] != depth[:-1]) | (shared < depth[1:])
        return at[new], np.cumsum(new) - 1

    def least_item(self, keys: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The first item, in the order of their ids, that holds the ``size`` words at each place of some keys; one does."""
        low, high = (_bound(self.array, self.keys, keys, at, size, upper) for upper in (False, True))
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.zeros(len(at), np.int64)
        for k in np.unique(level).tolist():
            mine = np.flatnonzero(level == k)
            out[mine] = np.minimum(self.least[k][low[mine]], self.least[k][high[mine] - (1 << k)])
        return out


class Shard:
    """The suffix array of the texts of one slice."""

    def __init__(self, column: pa.Array, depth: int = DEPTH):
        keys, self.starts, self.count = _keys(column)
        self.size = len(keys)
        self.array = suffix_array(keys, depth)
        self.keys = np.concatenate([keys, np.zeros(depth + 1, np.uint64)])

    def hits(self, items: Items) -> tuple[np.ndarray, list[list[int]]]:
        """A mark for each word (and text end) that a window covers, and by text the items whose windows occur."""
        first, last = (_bound(self.array, self.keys, items.keys, items.windows, items.window_depth, upper) for upper in (False, True))
        n = last - first
        window = np.repeat(np.arange(len(n)), n)
        at = self.array[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
        cover = np.zeros(self.size + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + items.window_depth[window], -1)
        text = np.searchsorted(self.starts, at, "right") - 1
        found: list[list[int]] = [[] for _ in self.count]
        if len(text):
            for t, w in np.unique(np.column_stack([text, window]), axis=0).tolist():
                found[t].extend(items.held[items.holds[w] : items.holds[w + 1]].tolist())
        return np.cumsum(cover[:-1]) > 0, found

    def longest(self, items: Items) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
        """By text: words of the longest match with an item, the first word where one begins, and the item (of several the smallest id)."""
        n = len(self.count)
        if not len(items.array):
            return np.zeros(n, np.int64), np.full(n, -1), [None] * n
        first = _bound(self.array, self.keys, items.keys, items.array[items.probes], items.probe_depth, False)
        real = np.flatnonzero(self.keys[self.array] != 0)
        below = np.cumsum(np.bincount(first, minlength=self.size + 1))[real] - 1  # the last item suffix that isn't above each place
        at = self.array[real]
        size = np.zeros(len(at), np.int64)
        for near in (below, below + 1):
            ok = np.flatnonzero((near >= 0) & (near < len(items.probes)))
            shared, _ = _common(self.keys, at[ok], items.keys, items.array[items.probes[near[ok]]], items.depth)
            size[ok] = np.maximum(size[ok], shared)
        deep = np.flatnonzero(size >= items.depth)
        if len(deep):  # to the true end, among item suffixes sorted all the way
            above = _bound(items.array, items.keys, self.keys, at[deep], np.full(len(deep), self.size), False)
            for near in (above - 1, above):
                ok = np.flatnonzero((near >= 0) & (near < len(items.array)))
                shared, _ = _common(self.keys, at[deep[ok]], items.keys, items.array[near[ok]], self.size)
                size[deep[ok]] = np.maximum(size[deep[ok]], shared)
        text = np.searchsorted(self.starts, at, "right") - 1
        best = np.zeros(n, np.int64)
        np.maximum.at(best, text, size)
        won = np.flatnonzero((size == best[text]) & (size > 0))
        where = np.full(n, self.size)
        np.minimum.at(where, text[won], at[won])
        found = np.flatnonzero(best)
        names: list[str | None] = [None] * n
        for t, i in zip(found.tolist(), items.least_item(self.keys, where[found], best[found]).tolist(), strict=True):
            names[t] = items.names[i]
        return best, np.where(best > 0, where - self.starts, -1), names


_made: dict[str, Items] = {}


def _items(name: str, rows: list[tuple[object, str | None]], window: int) -> Items:
    """The worker's arrays of a block; those of the block before it go."""
    if name not in _made:
        _made.clear()
        _made[name] = Items(rows, window)
    return _made[name]


FOUND = [
    T.StructField("n_words", T.LongType()), T.StructField("ranges", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("longest_match", T.LongType()), T.StructField("longest_at", T.LongType()), T.StructField("longest_item", T.StringType()),
]


def _pass(frame: DataFrame, text: str, block: list[tuple[object, str | None]], window: int) -> DataFrame:
    """_doc and the findings of one block for every row of a frame with _doc, whose text is the column or field ``text``."""
    sent, name = frame.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _items(name, sent.value, window)
        for batch in arrays.slices(batches, text):
            shard = Shard(batch.column("_doc").field("text") if "." in text else batch.column(text), items.depth)
            hit, by_text = shard.hits(items)
            size, at, names = shard.longest(items)
            begin, end = arrays.runs(hit, np.append(shard.starts, shard.size))
            of = np.searchsorted(shard.starts, begin, "right") - 1
            places = np.column_stack([begin - shard.starts[of], end - shard.starts[of]]).astype(np.int32).ravel()
            cuts = 2 * np.searchsorted(of, np.arange(len(shard.count) + 1))
            held = pa.array([sorted({items.names[i] for i in x}) for x in by_text], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_doc"), pa.array(shard.count.astype(np.int64)), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(places)), held,
                    pa.array(size), pa.array(at, mask=at < 0), pa.array(names, pa.string()),
                ],
                ["_doc", *(f.name for f in FOUND)],
            )

    return frame.mapInArrow(run, T.StructType([frame.schema["_doc"], *FOUND]))


def _united_passes(frame: DataFrame, text: str, blocks: Iterable[list[tuple[object, str | None]]], window: int) -> DataFrame:
    """The findings of several blocks by row; _doc has a field _row that tells rows apart.  No text is shuffled."""
    found = None
    for block in blocks:
        part = _pass(frame, text, block, window)
        found = part if found is None else found.unionAll(part)
    best = F.min_by(F.struct("longest_match", "longest_at", "longest_item"), F.struct(-F.col("longest_match"), "longest_at", "longest_item"))
    ranges, items = (F.flatten(F.collect_list(c)) for c in ("ranges", "items"))  # one of each for every block
    whole = found.groupBy("_doc._row").agg(F.first("_doc").alias("_doc"), F.max("n_words").alias("n_words"), ranges.alias("ranges"), F.array_sort(F.array_distinct(items)).alias("items"), best.alias("_b"))
    return whole.select("_doc", "n_words", _united("ranges").alias("ranges"), "items", "_b.*")


def item_blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[object, str | None]]]:
    """The items, brought to the driver a partition at a time, in blocks of ``limit`` bytes of text or one item."""
    block, size = [], 0
    for item_id, text in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        if block and size + len(text or "") > limit:
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += len(text or "")
    if block:
        yield block


def _blocks(benchmark: DataFrame) -> tuple[list, Iterable[list] | None]:
    """The first block; and all blocks where there is more than one, each read when its turn comes."""
    blocks = item_blocks(benchmark)
    first, second = next(blocks, []), next(blocks, None)
    return first, None if second is None else itertools.chain([first, second], blocks)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _united(ranges):
    """Overlapping ranges of a row joined."""
    import pandas as pd

    def one(flat):
        pairs, out = sorted(zip(flat[::2], flat[1::2], strict=True)), []
        for a, b in pairs:
            if out and a <= out[-1]:
                out[-1] = max(out[-1], b)
            else:
                out += [a, b]
        return out

    return pd.Series([one(list(map(int, x))) for x in ranges])


def n_hit(ranges: str):
    """Hit words of joined ranges: ends less starts."""
    return F.aggregate(F.transform(ranges, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)


def contaminated():
    """Whether a document counts as contaminated: a twentieth of its words are hit."""
    hit = n_hit("ranges")
    return (hit > 0) & (20 * hit >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; longest_match, longest_at, longest_item; ranges and items themselves.

    longest_match: the words of the longest passage that stands verbatim in one item, whole to its true end and of whatever length, below a
    window too; longest_at: the first word (from 0) where such a passage begins; longest_item: the item, of several the one whose id as a
    string is the smallest.  Without a common word 0 and nulls.
    """
    first, several = _blocks(benchmark)
    text = F.col("text").cast("string").alias("text")
    if several is None:
        found = _pass(docs.select(F.struct("doc_id").alias("_doc"), text), "text", first, window)
    else:
        rows = written(docs.select("doc_id", text, F.monotonically_increasing_id().alias("_row")), "texts")
        found = _united_passes(rows.select(F.struct("_row", "doc_id").alias("_doc"), "text"), "text", several, window)
    return found.select(
        "_doc.doc_id", "n_words", n_hit("ranges").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"), "longest_match", "longest_at", "longest_item", "ranges", "items",
    )


def longest_verbatim(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a document: doc_id, verbatim_words, verbatim_at, verbatim_item: the longest match of ``report``."""
    return report(docs, benchmark).select("doc_id", *(F.col(f"longest_{a}").alias(f"verbatim_{b}") for a, b in (("match", "words"), ("at", "at"), ("item", "item"))))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that aren't contaminated, with the input's columns; with several blocks by an anti join with the row numbers of the others."""
    first, several = _blocks(benchmark)
    plain = docs.schema["text"].dataType == T.StringType()  # then the text isn't sent twice
    whole, text = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("text").cast("string").alias("text")
    if several is None:
        return _pass(docs.select(whole, *([] if plain else [text])), "_doc.text" if plain else "text", first, window).where(~contaminated()).select("_doc.*")
    rows = written(docs.select(whole, text, F.monotonically_increasing_id().alias("_row")), "texts")
    found = _united_passes(rows.select(F.struct("_row").alias("_doc"), "text"), "text", several, window)
    return rows.join(found.where(contaminated()).select("_doc._row"), "_row", "left_anti").select("_doc.*")


def digest(items: list[str]) -> str:
    """What items_sha256 holds for some item ids."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
