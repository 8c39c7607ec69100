"""Mixing sources to target weights with fixed-length blocks of words.

The words of each source form one stream, in an order that the documents' identifiers decide, cut into blocks of ``BLOCK``
words.  The mix is a row of slots, ``SHARD_SLOTS`` to an output shard, one block each.  Each shard draws its source counts from
a multinomial whose chances are the sources' quotas, with a generator that the shard's number seeds.  Draws beyond a quota,
spread evenly over the shards, go to the sources that were drawn too seldom, so that every quota is met.  The k-th slot of a
source with n blocks takes the block that a pseudorandom permutation of 0..n-1 has at k mod n; each pass over the
source has a permutation of its own, so no block comes more than once in a pass.  Slots and blocks meet in an equi-join by source and index.
The last slot of a source is cut where the target is reached, so a source gives its target to the word.

Targets: sources, in code point order with null last, get ``WEIGHTS`` in turn; what a source gets beyond ``MOST`` times its
size is shared again by weight among the others until none is above.

Only (identifier, source, size, hash) of a document is shuffled, never its text.  The driver sees one row a source, at most
``MOST_SOURCES`` (more raise ValueError), and nothing of the documents.  Offsets come from prefix sums over the totals of tasks.

Defined results: a null or empty text has size 0 and isn't taken; null is a source of its own, after all others, the empty
string another; repeated rows are documents each and are taken each; an empty table gives no rows; other columns aren't read;
the same documents give the same mix at every run, however they are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import arrays
from tessera.llm.concat_cut import cut
from tessera.llm.prefix import part_bases
from tessera.storage import written

BLOCK = 2048
SHARD_SLOTS = 8192
WEIGHTS = (5, 2, 1)
MOST = 3
MOST_SOURCES = 1 << 20
SEED = 20_240_501
WORD = r"[^\x20\x09-\x0D]+"
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: What a round of the network adds to its key.
_ROUNDS = np.arange(4, dtype=np.uint64) * _STEP


def targets(sizes: list[int], weights: list[float], share: float = 1.0, most: int = MOST) -> np.ndarray:
    """Words that each source should give: ``share`` of all sizes by weight, none above ``most`` times its size."""
    capped, w = np.zeros(len(sizes), bool), np.array(weights, float)
    limit = np.array([float(most * s) for s in sizes])
    while True:
        left = share * sum(sizes) - sum(most * s for s, c in zip(sizes, capped, strict=True) if c)
        got = np.where(capped, limit, w * left / max(w[~capped].sum(), 1e-300))
        over = ~capped & (got > limit)
        if not over.any():
            return got
        capped |= over


def permuted(i: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """A keyed permutation of 0..n-1 at i (all three by row): a Feistel network, repeated until it falls below n; ``back``: its inverse."""
    n, key, out = np.asarray(n, np.uint64), np.asarray(key, np.uint64), np.array(i, np.uint64)
    half = (np.searchsorted(np.uint64(1) << np.arange(63, dtype=np.uint64), n, "left").astype(np.uint64) + np.uint64(1)) // np.uint64(2)
    half = np.maximum(half, np.uint64(1))
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(out))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in (3, 2, 1, 0) if back else (0, 1, 2, 3):
            if back:
                left, right = right ^ (arrays.mix(left + k + _ROUNDS[r]) & m), left
            else:
                left, right = right, left ^ (arrays.mix(right + k + _ROUNDS[r]) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def _keys(source: np.ndarray, turn: np.ndarray, seed: int) -> np.ndarray:
    """A key for each pass over each source."""
    return arrays.mix(arrays.mix(np.asarray(source, np.uint64) + np.uint64(seed)) + np.asarray(turn, np.uint64) * _STEP)


@dataclass
class Sources:
    """By source, in order: name, size and target in words, blocks, slots, and words that the last slot takes."""

    names: list[str | None]
    sizes: list[int]
    targets: np.ndarray
    blocks: np.ndarray
    slots: np.ndarray
    last: np.ndarray


def quotas(sizes: list[int], goal: np.ndarray, block: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of each source, slots that its target needs, and how many words the last of them takes."""
    size, goal = np.array(sizes, np.int64), np.rint(goal).astype(np.int64)
    blocks = -(-size // block)
    some = np.maximum(size, 1)
    turns, rest = goal // some, goal % some
    short = size - np.maximum(blocks - 1, 0) * block  # words of the last block
    # where, in the pass that isn't whole, the last block comes
    at = permuted(np.maximum(blocks - 1, 0), np.maximum(blocks, 1), _keys(np.arange(len(size)), turns, seed), back=True) if len(size) else size
    before = rest <= at * block
    within = ~before & (rest <= at * block + short)
    after = rest - at * block - short
    count = np.where(before, -(-rest // block), np.where(within, at + 1, at + 1 + -(-np.maximum(after, 0) // block)))
    last = np.where(before, rest - (count - 1) * block, np.where(within, rest - at * block, after - (count - at - 2) * block))
    slots = turns * blocks + np.where(rest > 0, count, 0)
    return blocks, slots, np.where(rest > 0, last, block)


def _rows(docs: DataFrame, seed: int) -> DataFrame:
    """(row, doc_id, source, size, at, text_hash) of every document; the one pass over the texts."""
    text = F.col("text").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    at = F.xxhash64(F.col("doc_id"), F.lit(seed))
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), at.alias("at"), F.xxhash64(text).alias("text_hash"))


def _sources(rows: DataFrame, weights: tuple, share: float, block: int, seed: int) -> Sources:
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [int(r["size"]) for r in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share)
    return Sources([r.source for r in found], sizes, goal, *quotas(sizes, goal, block, seed))


def _pieces(rows: DataFrame, named: DataFrame, block: int) -> DataFrame:
    """(rank, block, offset, row, doc_id, text_hash, start, length): where each document's words lie in its source's blocks."""
    order = [F.col("source").asc_nulls_last(), "at", "doc_id", "size", "text_hash", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = batch.column("size").to_numpy(zero_copy_only=False)
            done = before + np.cumsum(size)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(size), part, np.int32)), pa.array(done - size)], [*batch.schema.names, "part", "before"])
            before = int(done[-1]) if len(done) else before

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("first", "size"))
            for low in range(0, len(first), 1024):
                f, s = first[low : low + 1024], size[low : low + 1024]
                row, start, length = cut(f, s, block)
                of = pa.array(row + low)
                at = f[row] + start
                kept = [batch.column(c).take(of) for c in ("rank", "row", "doc_id", "text_hash")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(at // block), pa.array(at % block), pa.array(start), pa.array(length)], ["rank", "row", "doc_id", "text_hash", "block", "offset", "start", "length"])

    # sorted by source first, so what all sources before have is where a source begins
    dealt = rows.where("size > 0").repartitionByRange(*order).sortWithinPartitions(*order).select("row", "doc_id", "source", "size", "text_hash")
    kind = rows.schema["doc_id"].dataType.simpleString()
    stream = written(dealt.mapInArrow(run, f"row long, doc_id {kind}, source string, size long, text_hash long, part int, before long"), "mix-stream")
    bases = part_bases(stream.select("part", (F.col("before") + F.col("size")).alias("end")), "part", "end")
    placed = stream.join(F.broadcast(bases), "part").withColumnRenamed("source", "_source")
    placed = placed.join(named, F.col("_source").eqNullSafe(F.col("source")))
    placed = placed.select("rank", "row", "doc_id", "text_hash", "size", (F.col("before") + F.col("_base") - F.col("base")).alias("first"))
    return placed.mapInArrow(place, f"rank int, row long, doc_id {kind}, text_hash long, block long, offset long, start long, length long")


def _drawn(spark, shards: int, total: int, chance: np.ndarray, shard_slots: int, seed: int) -> DataFrame:
    """(shard, rank, drawn): source counts of each shard, a multinomial each."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                n = min(shard_slots, total - shard * shard_slots)
                count = np.random.default_rng([seed, shard]).multinomial(n, chance)
                rank = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rank), shard)), pa.array(rank.astype(np.int32)), pa.array(count[rank].astype(np.int64))], ["shard", "rank", "drawn"])

    return spark.range(shards).mapInArrow(draw, "shard long, rank int, drawn long")


def _slots(spark, of: Sources, block: int, shard_slots: int, seed: int) -> DataFrame:
    """(shard, slot, rank, block, words): which block each slot of each shard takes, and how many of its words."""
    quota, blocks, last = of.slots, of.blocks, of.last
    total = int(quota.sum())
    shards = -(-total // shard_slots)
    schema = "shard long, rank int, first long, n long"
    if not total:
        return spark.createDataFrame([], "shard long, slot long, rank int, block long, words long")
    drawn = written(_drawn(spark, shards, total, quota / total, shard_slots, seed), "mix-draws")
    all_drawn = np.zeros(len(quota), np.int64)
    for r in drawn.groupBy("rank").agg(F.sum("drawn").alias("n")).collect():  # one row a source
        all_drawn[r["rank"]] = r["n"]
    known = F.broadcast(spark.createDataFrame([(i, min(int(q), int(d)), int(d)) for i, (q, d) in enumerate(zip(quota, all_drawn, strict=True)) if d], "rank int, kept long, all long"))
    so_far = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = drawn.withColumn("upto", F.sum("drawn").over(so_far)).join(known, "rank")
    # of a source's draws as many stay as its quota has, evenly over the shards
    stays = "cast(cast({} as decimal(19, 0)) * kept div all as long)"
    counted = counted.withColumn("first", F.expr(stays.format("upto - drawn"))).withColumn("n", F.expr(stays.format("upto")) - F.col("first"))
    # the others go, in pseudorandom order, to what the sources lack that were drawn too seldom
    lacks = np.maximum(quota - all_drawn, 0)
    ends = np.cumsum(lacks)

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, begin, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "begin", "n")), strict=True):
                at = np.sort(permuted(np.arange(begin, begin + n), np.full(n, ends[-1]), np.full(n, seed)))
                rank = np.searchsorted(ends, at, "right")
                first = all_drawn[rank] + at - (ends[rank] - lacks[rank])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(rank.astype(np.int32)), pa.array(first), pa.array(np.ones(n, np.int64))], ["shard", "rank", "first", "n"])

    spare = counted.groupBy("shard").agg(F.sum(F.col("drawn") - F.col("n")).alias("n")).where("n > 0")
    spare = spare.withColumn("begin", F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    given = counted.where("n > 0").select("shard", "rank", "first", "n").unionByName(spare.mapInArrow(give, schema))
    within = Window.partitionBy("shard").orderBy("rank", "first").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    given = given.withColumn("place", F.sum("n").over(within) - F.col("n"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, rank, first, n, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "rank", "first", "n", "place"))
            step = max(1, (1 << 18) // shard_slots)  # a row has shard_slots slots at most
            for low in range(0, len(n), step):
                many = n[low : low + step]
                row = np.repeat(np.arange(low, low + len(many)), many)
                nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                k, r = first[row] + nth, rank[row]
                turn = k // blocks[r]
                index = permuted(k % blocks[r], blocks[r], _keys(r, turn, seed))
                size = np.minimum(shard_slots, total - shard[row] * shard_slots)
                slot = permuted(place[row] + nth, size, _keys(shard[row], np.full(len(row), 1 << 32), seed))
                words = np.where(k == quota[r] - 1, last[r], block)
                yield pa.RecordBatch.from_arrays([pa.array(shard[row]), pa.array(slot), pa.array(r), pa.array(index), pa.array(words)], ["shard", "slot", "rank", "block", "words"])

    return given.mapInArrow(spread, "shard long, slot long, rank int, block long, words long")


@dataclass
class Mix:
    """``documents``: doc_id, size, source_size, target, taken.  ``spans``: shard, slot, offset, doc_id, text_hash, start, length, where start and
    length count a document's words and offset those before in the slot.  ``sources``: what each source has and gives."""

    documents: DataFrame
    spans: DataFrame
    sources: Sources


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.0, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> Mix:
    """Mix all documents; ``share`` of all their words is taken."""
    spark = docs.sparkSession
    rows = written(_rows(docs, seed), "mix-rows")
    of = _sources(rows, weights, share, block, seed)
    begins = np.concatenate([[0], np.cumsum(np.array(of.sizes, np.int64))[:-1]]) if of.sizes else []
    named = [(i, name, int(b), size, float(t)) for i, (name, b, size, t) in enumerate(zip(of.names, begins, of.sizes, of.targets, strict=True))]
    named = spark.createDataFrame(named, "rank int, source string, base long, source_size long, target double")
    slots = _slots(spark, of, block, shard_slots, seed)
    pieces = _pieces(rows, named.select("rank", "source", "base"), block)
    spans = slots.join(pieces, ["rank", "block"]).where("offset < words")
    spans = spans.withColumn("length", F.least("length", F.col("words") - F.col("offset")))
    spans = written(spans.select("shard", "slot", "offset", "row", "doc_id", "text_hash", "start", "length"), "mix-spans")
    taken = spans.groupBy("row").agg(F.sum("length").alias("taken"))
    whole = rows.withColumnRenamed("source", "_source").join(named, F.col("_source").eqNullSafe(F.col("source"))).join(taken, "row", "left")
    whole = whole.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return Mix(whole, spans.drop("row"), of)


def slot_texts(mixed: Mix, docs: DataFrame) -> DataFrame:
    """(shard, slot, text): the words of each slot, as they stand in the documents, documents apart by an empty line."""
    texts = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text")).dropDuplicates(["doc_id", "text_hash"])
    spans = mixed.spans.withColumnsRenamed({"doc_id": "_doc", "text_hash": "_hash"})
    both = spans.join(texts, F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash"))).select("shard", "slot", "offset", "start", "length", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.slices(batches):
            data, offsets = arrays.buffer(batch.column("text"))
            begin, end = arrays.runs(arrays.SOLID[data], offsets)
            first = np.searchsorted(begin, offsets[:-1]) + batch.column("start").to_numpy()
            last = first + batch.column("length").to_numpy() - 1
            cuts = [data[a:b].tobytes().decode() for a, b in zip(begin[first], end[last], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("slot"), batch.column("offset"), pa.array(cuts, pa.string())], ["shard", "slot", "offset", "text"])

    parts = both.mapInArrow(run, "shard long, slot long, offset long, text string")
    listed = F.array_sort(F.collect_list(F.struct("offset", "text")))  # BLOCK words at most
    return parts.groupBy("shard", "slot").agg(F.concat_ws("\n\n", F.transform(listed, lambda x: x["text"])).alias("text"))


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of all documents."""
    return mix(docs).documents
