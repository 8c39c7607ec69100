"""Concatenate-and-cut packing of token ids into fixed windows.

Two passes.  The first tokenizes every text once and writes, for each document, its ids and how
many ids its write task had put out before it.  The totals of the tasks give each task's global
offset (a prefix sum over one number a task).  The second pass reads the ids back, places each
document at its global offset and cuts it wherever a window ends; a record tells for every piece
its window and the place there.  Nothing is shuffled but the totals.

Defined results: a null or empty text has the end id alone; repeated rows are packed as often as
they come; a null doc_id is kept; an empty table gives no pieces; other columns aren't read.
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

WINDOW = 2048
END_ID = 1


def encoded(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """(part, doc_id, before, n_tokens, ids): little-endian unsigned 32-bit ids of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = bpe.pieces(tokenizer), TaskContext.get().partitionId(), 0
        for batch in arrays.slices(batches):
            flat, count = encoder.encode(batch.column("text"), end_id)
            done = before + np.cumsum(count)
            begins = np.concatenate([[0], np.cumsum(count)])
            data = pa.py_buffer(flat.astype("<u4").tobytes())
            ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer((4 * begins).astype(np.int64).tobytes()), data])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(count), part, np.int32)), batch.column("doc_id"), pa.array(done - count), pa.array(count.astype(np.int64)), ids.cast(pa.binary())],
                ["part", "doc_id", "before", "n_tokens", "ids"],
            )
            before = int(done[-1])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"part int, doc_id {kind}, before long, n_tokens long, ids binary")


def cut(first: np.ndarray, size: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of ``size`` ids from the global places ``first`` on: each piece's row, start in it and length."""
    low, high = first // window, (first + np.maximum(size, 1) - 1) // window
    n = np.where(size > 0, high - low + 1, 0)
    row = np.repeat(np.arange(len(first)), n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = np.maximum(first[row], (low[row] + nth) * window)
    end = np.minimum(first[row] + size[row], (low[row] + nth + 1) * window)
    return row, begin - first[row], end - begin


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document in a window; all windows but the last are full.

    Columns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with
    ``with_ids`` the piece's ids as array<int>.
    """
    rows = written(encoded(docs, tokenizer, end_id), "packed-ids")
    bases = part_bases(rows.select("part", (F.col("before") + F.col("n_tokens")).alias("end")), "part", "end")
    placed = rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("before") + F.col("_base")).alias("first"), "n_tokens", "ids")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.slices(batches, "ids", 4 * arrays.SLICE_BYTES):
            first = batch.column("first").to_numpy(zero_copy_only=False)
            size = batch.column("n_tokens").to_numpy(zero_copy_only=False)
            raw, at = arrays.buffer(batch.column("ids"))
            ids = np.frombuffer(raw.tobytes(), "<u4")
            row, start, length = cut(first, size, window)
            begin = at[row] // 4 + start
            out = [
                batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length), pa.array(arrays.crc32s(ids, begin, begin + length)),
                pa.array(size[row]), pa.array((first[row] + start) // window), pa.array((first[row] + start) % window),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    return placed.mapInArrow(run, schema)
