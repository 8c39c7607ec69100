"""Simple-8b files of token ids.

A 64-bit word has a selector in its four high bits and up to 60 ids of one width below.  The
widest selector takes one id of up to 60 bits and is the escape for ids that no other fits.
Ids are coded in blocks of ``BLOCK`` ids (the last of a chunk is shorter), and a chunk keeps the
word at which each block begins, so that all blocks are coded and decoded side by side.

The file is a Parquet table in the shared folder, one row a chunk of whole documents, in ascending
doc_id order over its parts: part, chunk, doc_ids, sizes, payload (the words, little-endian) and
block_offsets.

Defined results: a null or empty text has the end id alone; repeated rows are all written, equal
doc_ids in the order of their texts; null doc_ids come first; an empty table gives an empty file;
other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import arrays, bpe
from tessera.llm.prefix import part_bases
from tessera.storage import written

BLOCK = 1024
#: Fixed values of the format: ids in a word and bits of each, by selector from 1 on.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)


def pack_words(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The words of some ids, and the word at which each block begins (with the end)."""
    n = len(ids)
    blocks = -(-n // block)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    wide = np.zeros(blocks * block, np.uint64)
    wide[:n] = ids
    bits = np.searchsorted(np.array([1 << w for w in WIDTHS[:-1]], np.uint64), wide, "right")
    most = np.full((blocks, block + 60), 60, np.uint8)
    most[:, :block] = np.array(COUNTS, np.uint8)[bits].reshape(blocks, block)
    # best: how many ids a word that begins here takes, all of them narrow enough
    best = np.ones((blocks, block), np.uint8)
    least = most[:, :block].copy()
    for count in range(2, 61):
        np.minimum(least, most[:, count - 1 : count - 1 + block], out=least)
        fits = least >= count
        if not fits.any():
            break
        if count in COUNTS:
            best[fits] = count
    # all blocks step from word to word together
    left = np.full(blocks, block)
    left[-1] = n - (blocks - 1) * block
    at, live, found = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(live):
        step = best[live, at]
        found.append((live, at, step))
        at = at + step
        go = at < left[live]
        live, at = live[go], at[go]
    owner, place, taken = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(owner * block + place, kind="stable")
    owner, place, taken = owner[order], place[order], taken[order]
    padded = np.zeros((blocks, block + 60), np.uint64)
    padded[:, :block] = wide.reshape(blocks, block)
    padded = padded.ravel()
    begin = owner * (block + 60) + place
    out = np.zeros(len(begin), np.uint64)
    for selector, (count, width) in enumerate(zip(COUNTS, WIDTHS, strict=True), 1):
        these = np.flatnonzero(taken == count)
        if len(these):
            word = np.full(len(these), selector << 60, np.uint64)
            for k in range(count):
                word |= padded[begin[these] + k] << np.uint64(k * width)
            out[these] = word
    return out, np.searchsorted(owner, np.arange(blocks + 1))


def unpack_words(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The n ids of some words; offsets as pack_words gives them."""
    if not n:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64) - 1
    if selector.min() < 0:
        raise ValueError("not a Simple-8b word")
    count, width = np.array(COUNTS)[selector], np.array(WIDTHS, np.uint64)[selector]
    done = np.cumsum(count)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    before = (done - count)[offsets[:-1]]
    place = (done - count) - before[owner]  # the place of a word's first id in its block
    size = np.minimum(np.where(owner == len(offsets) - 2, n - owner * block, block) - place, count)
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    word, w = np.repeat(words, size), np.repeat(width, size)
    return (word >> (within.astype(np.uint64) * w)) & ((np.uint64(1) << w) - np.uint64(1))


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Tokenize every whole text and write the ids in ascending doc_id order; returns the file's table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, chunk, before = bpe.pieces(tokenizer), TaskContext.get().partitionId(), 0, 0
        for batch in arrays.slices(batches):
            flat, count = encoder.encode(batch.column("text"), end_id)
            words, offsets = pack_words(flat)
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()), "chunk": pa.array([chunk], pa.int32()), "before": pa.array([before], pa.int64()),
                    "doc_ids": pa.array([batch.column("doc_id").to_pylist()], pa.list_(batch.schema.field("doc_id").type)), "sizes": pa.array([count.tolist()], pa.list_(pa.int64())),
                    "payload": pa.array([words.astype("<u8").tobytes()], pa.binary()), "block_offsets": pa.array([offsets.tolist()], pa.list_(pa.int64())),
                }
            )
            chunk, before = chunk + 1, before + int(count.sum())

    kind = docs.schema["doc_id"].dataType.simpleString()
    ordered = docs.select("doc_id", F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    coded = ordered.mapInArrow(run, f"part int, chunk int, before long, doc_ids array<{kind}>, sizes array<long>, payload binary, block_offsets array<long>")
    return written(coded, "simple8b")


def read_ids(file: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row a document of a written file: doc_id, start, n_tokens, ids_crc32, and the ids if asked for."""
    end = F.col("before") + F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    bases = part_bases(file.select("part", end.alias("end")), "part", "end")
    kind = file.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name, row=row: batch.column(batch.schema.get_field_index(name))[row]
                doc_ids, sizes = get("doc_ids").values, get("sizes").values.to_numpy()
                done = np.cumsum(sizes)
                n = int(done[-1])
                ids = unpack_words(np.frombuffer(get("payload").as_buffer(), "<u8"), get("block_offsets").values.to_numpy(), n)
                start = done - sizes
                out = [doc_ids, pa.array(get("first").as_py() + start), pa.array(sizes), pa.array(arrays.crc32s(ids, start, done))]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(start, n).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    placed = file.join(F.broadcast(bases), "part").select("doc_ids", "sizes", "payload", "block_offsets", (F.col("before") + F.col("_base")).alias("first"))
    return placed.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
