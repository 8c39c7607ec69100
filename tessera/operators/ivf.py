"""Inverted-file index over vectors: approximate cosine search that compares a query with the nearest cells only.

``build`` fits ``nlist`` centroids on a bounded sample (``SAMPLE`` vectors a centroid, those with the smallest hashes) and stores
every vector, in packs, under its centroid; a cell of more than ``CELL_ROWS`` vectors is split into shares.  ``search`` sends each
query to its ``nprobe`` nearest cells, as an equi-join on cell and share, where packs are compared as matrices and the exact similarity
ranks.  ``probes`` says how many cells a wanted recall takes on these vectors: it searches a bounded sample of them exactly.

Only centroids, counts of cells and samples reach the driver.  With ``nprobe`` = ``nlist`` the result is that of ``vector.top_k``.

Defined results: null vectors, vectors without length, with missing or infinite numbers or of another length than the index are not found and find
nothing; repeated ids are vectors each; equal similarities go to the smaller vec_id; an empty table gives an index that finds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import vector
from tessera.storage import written

NLIST, NPROBE = 128, 10
#: Vectors of the sample for each centroid, vectors of a share of a cell, and vectors that ``probes`` searches for.
SAMPLE, CELL_ROWS, TRIED = 256, 100_000, 256
ROUNDS = 15


@dataclass
class Index:
    """Centroids (unit rows), shares of each cell, and the packs: cell, share, ids, payload, data (64-bit floats)."""

    centroids: np.ndarray
    shares: np.ndarray
    packs: DataFrame


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a column that are whole and of this size, and their places."""
    good = np.flatnonzero(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == size)
    flat = column.take(pa.array(good)).flatten()
    if flat.null_count:
        flat = flat.fill_null(np.nan)
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(good), size)
    with np.errstate(all="ignore"):
        length = np.sqrt((x * x).sum(axis=1))
    whole = np.isfinite(length) & (length > 0)
    return x[whole], good[whole]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def centroids(sample: np.ndarray, nlist: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means, from evenly spaced rows of the sample; an empty cell takes the vector farthest from its centroid."""
    x = _unit(sample)
    nlist = min(nlist, len(x))
    found = x[np.linspace(0, len(x) - 1, nlist).astype(int)] if nlist else x
    for _ in range(rounds if nlist else 0):
        near = x @ found.T
        cell, best = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, cell, x)
        for empty in np.flatnonzero(np.bincount(cell, minlength=nlist) == 0):
            far = int(best.argmin())
            sums[empty], best[far] = x[far], np.inf
        found = _unit(sums)
    return found


def _sampled(vectors: DataFrame, rows: int, salt: str) -> list:
    """(vec_id, embedding) of the rows with the smallest hashes, at most so many."""
    at = F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(1 << 30))
    share = min(1 << 30, int((1 << 30) * 1.5 * rows / max(vectors.count(), 1)) + 1)  # so that tasks sort few
    return vectors.withColumn("_at", at).where(F.col("_at") < share).orderBy("_at", "vec_id").limit(rows).select("vec_id", "embedding").collect()


def _vectors(rows: DataFrame, key: str = "vec_id", payload: tuple[str, ...] = ()) -> DataFrame:
    kept = F.struct(*[F.col(c) for c in payload]) if payload else F.lit(None).cast("boolean")
    return rows.where("embedding is not null").select(F.col(key).alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), kept.alias("payload"))


def build(vectors: DataFrame, nlist: int = NLIST, size: int | None = None, payload: tuple[str, ...] = ()) -> Index:
    """An index of vectors (vec_id, embedding) of one ``size``, by default that of the sample's first vector; ``payload``: columns to filter by."""
    rows = _vectors(vectors, payload=payload)
    sample = [r.embedding for r in _sampled(rows, nlist * SAMPLE, "centroids") if r.embedding]
    size = size or (len(sample[0]) if sample else 0)
    known, _ = _matrix(pa.array(sample, pa.list_(pa.float64())), size)
    middle = centroids(known, nlist)
    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("vec_id", vectors.schema["vec_id"].dataType), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("payload", rows.schema["payload"].dataType)])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = _matrix(batch.column("embedding"), size)
            cell = (_unit(x) @ middle.T).argmax(axis=1) if len(middle) else np.zeros(0)
            at = pa.array(at[: len(cell)])
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *[batch.column(c).take(at) for c in ("vec_id", "embedding", "payload")]], schema.names)

    placed = rows.mapInArrow(assign, schema)
    shares = np.zeros(len(middle), np.int64)
    for r in placed.groupBy("cell").count().collect():  # nlist rows
        shares[r["cell"]] = -(-r["count"] // CELL_ROWS)
    split = F.array(*[F.lit(int(s)) for s in np.maximum(shares, 1)]) if len(shares) else F.array(F.lit(1))
    dealt = placed.withColumn("share", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.get(split, F.col("cell"))).cast("int"))
    packed = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("share", T.IntegerType()), T.StructField("ids", T.ArrayType(schema["vec_id"].dataType)), T.StructField("payload", T.ArrayType(schema["payload"].dataType)), T.StructField("data", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, share = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "share"))
            edge = np.flatnonzero((cell[1:] != cell[:-1]) | (share[1:] != share[:-1])) + 1
            for low, high in zip([0, *edge], [*edge, len(cell)], strict=True):
                for a in range(low, high, vector.PACK):
                    few = batch.slice(a, min(vector.PACK, high - a))
                    ids, kept = (pa.ListArray.from_arrays(pa.array([0, few.num_rows], pa.int32()), few.column(c)) for c in ("vec_id", "payload"))
                    data = few.column("embedding").flatten().to_numpy(zero_copy_only=False).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([cell[a]]), pa.array([share[a]]), ids, kept, pa.array([data], pa.binary())], packed.names)

    packs = dealt.repartition("cell", "share").sortWithinPartitions("cell", "share").mapInArrow(pack, packed)
    return Index(middle, shares, written(packs, "cells"))


def search(index: Index, queries: DataFrame, k: int = 5, nprobe: int = NPROBE, where: Callable[[Column], Column] | None = None) -> DataFrame:
    """(query_id, vec_id, similarity, rank): of each query (query_id, embedding) the k most similar vectors of its ``nprobe`` nearest cells.

    ``where`` says of a payload whether its vector counts.
    """
    middle, size = index.centroids, index.centroids.shape[1] if index.centroids.size else 0
    spark, kind = queries.sparkSession, queries.schema["query_id"].dataType
    asked = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("pack", T.LongType()), T.StructField("query_ids", T.ArrayType(kind)), T.StructField("query_data", T.BinaryType())])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 32
        for batch in batches:
            x, at = _matrix(batch.column("embedding"), size)
            if not len(x) or not len(middle):
                continue
            near = np.argsort(-(_unit(x) @ middle.T), axis=1, kind="stable")[:, :nprobe]
            for cell in np.unique(near).tolist():
                mine = np.flatnonzero((near == cell).any(axis=1))
                for low in range(0, len(mine), vector.PACK):
                    few = mine[low : low + vector.PACK]
                    ids = pa.ListArray.from_arrays(pa.array([0, len(few)], pa.int32()), batch.column("vec_id").take(pa.array(at[few])))
                    yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([n]), ids, pa.array([x[few].tobytes()], pa.binary())], asked.names)
                    n += 1

    schema = T.StructType([T.StructField("query_id", kind), T.StructField("vec_id", index.packs.schema["ids"].dataType.elementType), T.StructField("similarity", T.DoubleType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, counts, data, query_ids, query_data = (batch.column(c)[i] for c in ("ids", "counts", "data", "query_ids", "query_data"))
                matrix = lambda x: np.frombuffer(x.as_buffer(), np.float64).reshape(-1, size)
                some = np.flatnonzero(counts.values.fill_null(False).to_numpy(zero_copy_only=False)) if counts.is_valid else np.arange(len(ids.values))
                if not len(some):
                    continue
                query, vec, exact = vector._near(matrix(data)[some], matrix(query_data), k)
                yield pa.RecordBatch.from_arrays([query_ids.values.take(pa.array(query)), ids.values.take(pa.array(some[vec])), pa.array(exact)], schema.names)

    split = spark.createDataFrame([(c, s) for c, n in enumerate(index.shares.tolist()) for s in range(n)], "cell int, share int")
    probes = _vectors(queries, "query_id").mapInArrow(probe, asked).join(split, "cell")
    counts = (F.transform("payload", where) if where is not None else F.lit(None)).cast("array<boolean>").alias("counts")
    # never broadcast: a query goes to many cells, which Spark doesn't reckon
    found = index.packs.select("cell", "share", "ids", counts, "data").hint("merge").join(probes, ["cell", "share"]).select("ids", "counts", "data", "query_ids", "query_data").mapInArrow(compare, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return found.select(*schema.names).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).withColumn("similarity", F.round("similarity", 6))


def probes(index: Index, vectors: DataFrame, k: int = 5, recall: float = 0.9) -> int:
    """How many cells must be probed for this recall at k, as measured: ``TRIED`` of the vectors are searched for exactly, and for each of
    their nearest the place of its cell among the cells, by nearness to the vector searched for, is taken down."""
    tried = _sampled(_vectors(vectors), TRIED, "tried")
    if not tried or not index.centroids.size:
        return 1
    spark = vectors.sparkSession
    # each by its place in the sample: an id may come twice
    asked = spark.createDataFrame([(i, r.embedding) for i, r in enumerate(tried)], "query_id long, embedding array<double>")
    exact = vector.top_k(_vectors(vectors), asked, k).select("query_id", "vec_id")
    wanted = _vectors(vectors).join(exact, "vec_id").select("query_id", "embedding").collect()  # k * TRIED vectors
    middle, size = index.centroids, index.centroids.shape[1]
    places = []
    for r in wanted:
        x, _ = _matrix(pa.array([r.embedding, tried[r.query_id].embedding], pa.list_(pa.float64())), size)
        if len(x) == 2:
            near = _unit(x) @ middle.T
            places.append(int(np.flatnonzero(np.argsort(-near[1], kind="stable") == near[0].argmax())[0]))
    return 1 + int(np.quantile(places, min(1.0, recall), method="higher")) if places else 1


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, found, wanted): how many of the exact results an approximate search has."""
    both = exact.select("query_id", "vec_id").join(approximate.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found"), F.count(F.lit(1)).alias("wanted"))
