"""Ranked lexical search with block-max pruning.

``build`` turns the documents into an index, once: a block is a range of neighbouring documents (about ``BLOCK_BYTES`` of text,
or one longer document) and holds their forward index: by document its terms, as places in the block's dictionary, and how often each occurs.

``search`` answers any number of items, a stated query set, against all documents:

1. one pass over the blocks finds, for the items' terms, the documents that hold them and each term's largest impact in the block;
   the sums give the weights, and weight times largest impact, summed over an item's terms, bounds what any document of the block can score;
2. of each item the ``FIRST`` blocks with the highest bounds are scored; its 10th best score is a threshold;
3. the other blocks are sorted by an item's bound, ``RUN_BLOCKS`` at a time within a task, and scored until the bound drops below the threshold,
   which the task raises as it finds better documents.

A score is the sum over an item's terms, with repeats, of w * ((1000000000*tf) div (1000*tf + 8*m)); see ``weights`` and ``lengths``.  All scores
are exact whole numbers; a block is skipped only if its bound is below a score that ten documents reach, so results are those of a full search.

Items are taken ``ITEM_BYTES`` of text at a time, which is what a task holds of them; more items are more passes over the index.
Of the documents the driver sees two sums, of the items in hand their terms' counts and thresholds.

Defined results: a null text, or one without terms, has no terms and isn't found or counted; an item without terms finds nothing; repeated documents
are ranked each, a repeated item is answered as often as it comes; equal scores go by doc_id, null last; fewer than 10 rows where fewer documents score
above 0; empty tables give no rows; other columns aren't read.  Very long texts are one block each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import arrays
from tessera.storage import written

BLOCK_BYTES = 128 << 10
ITEM_BYTES = 16 << 20
RUN_BLOCKS = 64
FIRST = 2
BEST = 10


def _dictionary(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of words data[start:end]: the word's place in a dictionary sorted by key; the dictionary's keys, bytes and offsets."""
    keys, first, place = np.unique(arrays.hashes(data, starts, ends), return_index=True, return_inverse=True)
    size = (ends - starts)[first]
    at = np.concatenate([[0], np.cumsum(size)])
    return place, keys, data[np.arange(at[-1]) + np.repeat(starts[first] - at[:-1], size)], at


def build(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The index, a row a block: block, ids, counts (terms of each document), n_docs, n_terms, words and word_ends (the dictionary), doc_ends, terms, tf.

    A row's documents are sorted by doc_id.  Numbers are little-endian, four bytes each (counts and doc_ends eight).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in arrays.slices(batches, limit=block_bytes):
            batch = batch.take(pc.sort_indices(batch.column("doc_id")))
            data, offsets = arrays.buffer(batch.column("text"))
            data = arrays.lower(data)
            starts, ends = arrays.runs(arrays.ALNUM[data], offsets)
            count = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
            place, _, words, at = _dictionary(data, starts, ends)
            doc = np.repeat(np.arange(len(count)), count)
            pair, tf = np.unique(doc * max(len(at) - 1, 1) + place, return_counts=True)
            doc, term = np.divmod(pair, max(len(at) - 1, 1))
            doc_ends = np.cumsum(np.bincount(doc, minlength=len(count)))
            ids = pa.ListArray.from_arrays(pa.array([0, len(count)], pa.int32()), batch.column("doc_id"))
            raw = [x.astype(kind).tobytes() for x, kind in ((words, "u1"), (at[1:], "<i4"), (doc_ends, "<i8"), (term, "<i4"), (tf, "<i4"), (count, "<i8"))]
            yield pa.RecordBatch.from_arrays([pa.array([block]), ids, pa.array([int((count > 0).sum())]), pa.array([int(count.sum())]), *[pa.array([x], pa.binary()) for x in raw]], _INDEX)
            block += 1

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block long, ids array<{kind}>, n_docs long, n_terms long, words binary, word_ends binary, doc_ends binary, terms binary, tf binary, counts binary"
    return written(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema), "lexical-index")


_INDEX = ["block", "ids", "n_docs", "n_terms", "words", "word_ends", "doc_ends", "terms", "tf", "counts"]


@dataclass
class Items:
    """Items' terms as places in their common vocabulary, which is sorted by key; ``weight`` by term."""

    ids: list
    ends: np.ndarray
    terms: np.ndarray
    keys: np.ndarray
    words: np.ndarray
    word_ends: np.ndarray
    weight: np.ndarray | None = None


def pack_items(ids: list, texts: list[str | None]) -> Items:
    data, offsets = arrays.buffer(pa.array(texts, pa.large_string()))
    data = arrays.lower(data)
    starts, ends = arrays.runs(arrays.ALNUM[data], offsets)
    place, keys, words, at = _dictionary(data, starts, ends)
    return Items(ids, np.searchsorted(starts, offsets[1:]), place, keys, words, at[1:])


def weights(df: np.ndarray, n: int) -> np.ndarray:
    """floor(1000 * ln((2N+2) / (2df+1)))"""
    return np.floor(1000 * np.log((2 * n + 2) / (2 * df.astype(float) + 1))).astype(np.int64)


def lengths(count: np.ndarray, n: int, total: int) -> np.ndarray:
    """100-75 + ((75*n*N) div L) for documents of ``count`` terms; exact where products pass 64 bits."""
    if len(count) and 75 * int(count.max()) * n >= 1 << 63:
        return np.array([25 + 75 * c * n // total for c in count.tolist()], np.int64)
    return 25 + 75 * count * n // max(total, 1)


class Block:
    """A block's postings of the items' terms."""

    def __init__(self, row: dict, items: Items):
        read = lambda c, kind: np.frombuffer(row[c], kind).astype(np.int64)
        words, stop = np.frombuffer(row["words"], np.uint8), read("word_ends", "<i4")
        start = np.concatenate([[0], stop[:-1]])[: len(stop)]
        mine = arrays.hashes(words, start, stop)
        at = np.minimum(np.searchsorted(items.keys, mine), max(len(items.keys) - 1, 0))
        hit = np.flatnonzero(items.keys[at] == mine) if len(items.keys) else np.zeros(0, np.int64)
        self.known, self.local = at[hit], hit
        if len(hit):  # the bytes decide, not the key
            size = stop[hit] - start[hit]
            theirs = np.concatenate([[0], items.word_ends[:-1]])[self.known]
            same = size == items.word_ends[self.known] - theirs
            self.known, hit, size, theirs = self.known[same], hit[same], size[same], theirs[same]
            run = np.cumsum(size) - size
            step = np.arange(size.sum()) - np.repeat(run, size)
            equal = words[np.repeat(start[hit], size) + step] == items.words[np.repeat(theirs, size) + step]
            right = np.logical_and.reduceat(equal, run) if len(run) else np.zeros(0, bool)
            self.known, self.local = self.known[right], hit[right]
        self.ids, count = row["ids"], read("counts", "<i8")
        self.count = count
        terms, tf, doc_ends = read("terms", "<i4"), read("tf", "<i4"), read("doc_ends", "<i8")
        slot = np.full(len(stop), -1)
        slot[self.local] = np.arange(len(self.local))
        slot = slot[terms]
        kept = slot >= 0
        doc = np.repeat(np.arange(len(doc_ends)), np.diff(np.concatenate([[0], doc_ends])))
        self.slot, self.tf, self.doc = slot[kept].astype(np.int32), tf[kept], doc[kept].astype(np.int32)

    def impacts(self, n: int, total: int) -> Block:
        m = lengths(self.count, n, total)[self.doc]
        self.impact = (1_000_000_000 * self.tf // (1000 * self.tf + 8 * m)).astype(np.int32)  # below 10 ** 6
        del self.tf
        return self

    def peaks(self, vocabulary: int) -> np.ndarray:
        """By term of the vocabulary the largest impact in the block."""
        out = np.zeros(vocabulary, np.int64)
        most = np.zeros(len(self.known), np.int64)
        np.maximum.at(most, self.slot, self.impact)
        out[self.known] = most
        return out

    def scores(self, need: np.ndarray) -> np.ndarray:
        """By document the score; ``need`` has by term of the vocabulary its weight times its occurrences in the item."""
        by_doc = np.zeros(len(self.count) + 1, np.int64)
        np.cumsum(np.bincount(self.doc, minlength=len(self.count)), out=by_doc[1:])
        done = np.concatenate([[0], np.cumsum(need[self.known][self.slot] * self.impact)])
        return done[by_doc[1:]] - done[by_doc[:-1]]


class Search:
    """Scores items over blocks, keeping each item's threshold: a score that ``best`` documents are known to reach."""

    def __init__(self, items: Items, n: int, total: int, floor: np.ndarray, best: int):
        self.items, self.n, self.total, self.best = items, n, total, best
        self.floor = floor.copy()
        self.found: dict[int, list] = {}
        self.need = np.zeros(len(items.keys), np.int64)

    def score(self, block: Block, item: int) -> None:
        lo, hi = (self.items.ends[item - 1] if item else 0), self.items.ends[item]
        terms = self.items.terms[lo:hi]
        np.add.at(self.need, terms, self.items.weight[terms])
        score = block.scores(self.need)
        self.need[terms] = 0
        good = np.flatnonzero(score >= max(int(self.floor[item]), 1))
        good = good[np.argsort(-score[good], kind="stable")][: self.best]  # a block's documents are sorted by doc_id
        if not len(good):
            return
        kept = self.found.setdefault(item, [])
        kept += [(-int(score[i]), block.ids[i] is None, block.ids[i]) for i in good.tolist()]
        kept.sort(key=lambda x: (x[0], x[1], 0 if x[1] else x[2]))
        del kept[self.best :]
        if len(kept) == self.best:
            self.floor[item] = max(self.floor[item], -kept[-1][0])

    def rows(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        flat = [(item, doc, -score) for item, kept in self.found.items() for score, _, doc in kept]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], kind), pa.array([x[2] for x in flat], pa.int64())], ["item", "doc_id", "score"])


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}
    arrays.release()


def _bounds(peaks: np.ndarray, items: Items) -> np.ndarray:
    """By item the bound of a block with these largest impacts."""
    done = np.concatenate([[0], np.cumsum((peaks * items.weight)[items.terms])])[items.ends]
    return np.diff(np.concatenate([[0], done]))


def _answer(index: DataFrame, items: Items, n: int, total: int, best: int) -> DataFrame:
    """(item, doc_id, score): a superset of each item's ``best``, by the item's place."""
    spark, width, kind = index.sparkSession, len(items.keys), index.schema["ids"].dataType.elementType
    read = ["block", "ids", "words", "word_ends", "doc_ends", "terms", "tf", "counts"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(width, np.int64)
        for row in _each(batches):
            block = Block(row, items).impacts(n, total)
            df[block.known] += np.bincount(block.slot, minlength=len(block.known))
            peaks = block.peaks(width)[block.known].astype("<i4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([block.known.astype("<i4").tobytes()], pa.binary()), pa.array([peaks], pa.binary()), pa.array([None], pa.binary())], ["block", "terms", "peaks", "df"])
        # what the task has counted goes along in one last row
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([b""], pa.binary()), pa.array([b""], pa.binary()), pa.array([df.astype("<i8").tobytes()], pa.binary())], ["block", "terms", "peaks", "df"])

    measured = written(index.select(*read).mapInArrow(measure, "block long, terms binary, peaks binary, df binary"), "block-maxima")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(width, np.int64)
        for batch in batches:
            for x in batch.column("df").to_pylist():
                df += np.frombuffer(x, "<i8")
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], ["term", "df"])

    df = np.zeros(width, np.int64)
    for r in measured.where("block < 0").select("df").mapInArrow(counted, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]  # one number for each term of the items in hand
    items.weight = weights(df, n)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros((len(items.ids), FIRST), np.int64)
        where = np.full((len(items.ids), FIRST), -1)
        for row in _each(batches):
            peaks = np.zeros(width, np.int64)
            peaks[np.frombuffer(row["terms"], "<i4")] = np.frombuffer(row["peaks"], "<i4")
            bound = _bounds(peaks, items)
            least = top.argmin(axis=1)
            better = np.flatnonzero(bound > top[np.arange(len(bound)), least])
            top[better, least[better]], where[better, least[better]] = bound[better], row["block"]
        item, k = np.nonzero(where >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(where[item, k]), pa.array(top[item, k])], ["item", "block", "bound"])

    ranked = measured.where("block >= 0").select("block", "terms", "peaks").mapInArrow(first, "item int, block long, bound long")
    ahead = ranked.withColumn("_r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "block"))).where(F.col("_r") <= FIRST)
    ahead = written(ahead.groupBy("block").agg(F.collect_list("item").alias("items")), "first-blocks")  # FIRST rows an item at most

    def score_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(items, n, total, np.zeros(len(items.ids), np.int64), best)
        for row in _each(batches):
            block = Block(row, items).impacts(n, total)
            for item in row["items"]:
                search.score(block, item)
        yield from search.rows(pa_kind)

    pa_kind = _arrow(kind)
    schema = f"item int, doc_id {kind.simpleString()}, score long"
    begun = written(index.select(*read).join(F.broadcast(ahead), "block").mapInArrow(score_first, schema), "first-scores")
    floor = np.zeros(len(items.ids), np.int64)
    tenth = begun.withColumn("_r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))).where(F.col("_r") == best)
    for r in tenth.collect():
        floor[r["item"]] = r["score"]

    def score_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, held = Search(items, n, total, floor, best), []

        def clear() -> None:
            bounds = np.array([b for _, b, _ in held])
            for item in np.flatnonzero((bounds >= np.maximum(search.floor, 1)).any(axis=0)).tolist():
                for k in np.argsort(-bounds[:, item], kind="stable").tolist():
                    if bounds[k, item] < max(int(search.floor[item]), 1):
                        break
                    if item not in held[k][2]:
                        search.score(held[k][0], item)
            held.clear()

        for row in _each(batches):
            block = Block(row, items).impacts(n, total)
            held.append((block, _bounds(block.peaks(width), items), set(row["items"] or ())))
            if len(held) == RUN_BLOCKS:
                clear()
        if held:
            clear()
        yield from search.rows(pa_kind)

    rest = index.select(*read).join(F.broadcast(ahead), "block", "left").mapInArrow(score_rest, schema)
    return begun.unionByName(rest)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def search(index: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``best`` documents with a score above 0."""
    spark = index.sparkSession
    sums = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n, total = int(sums[0] or 0), int(sums[1] or 0)
    asked = written(items.select("item_id", F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("at")), "items")
    groups = max(1, -(-int(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES))
    kind, doc_kind = items.schema["item_id"].dataType, index.schema["ids"].dataType.elementType
    out = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id {doc_kind.simpleString()}, score long")
    for group in range(groups):
        rows = asked.where(F.pmod(F.xxhash64("at"), F.lit(groups)) == group).orderBy("at").collect() if total else []
        packed = pack_items([r["item_id"] for r in rows], [r["text"] for r in rows])
        if not len(packed.terms):
            continue
        found = _answer(index, packed, n, total, best)
        names = spark.createDataFrame(list(enumerate(packed.ids)), f"item int, item_id {kind.simpleString()}")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).join(F.broadcast(names), "item")
        out = out.unionByName(written(ranked.select("item_id", "rank", "doc_id", "score"), "found"))
    return out
