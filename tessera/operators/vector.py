"""Vector collections: exact cosine search, filters, insertion of what is absent, deletion."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.storage import written

#: Up to so many queries are broadcast to all tasks; more are dealt out like the vectors.
MOST_QUERIES = 4096
#: Vectors in a pack, the unit that is compared as a matrix.
PACK = 512
#: How far below the k-th best a similarity by matrix product may be and still count after exact sums and rounding.
NEAR = 2e-6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, where: Column | None = None) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k most similar vectors of each query, whatever the number of queries.

    ``vectors`` and ``queries`` have id and embedding columns vec_id/query_id, embedding.  Both are put in packs, and every
    pack of queries meets every pack of vectors: up to MOST_QUERIES queries are broadcast, more are joined as blocks.
    A task's best k of each query are found before anything is shuffled.
    The exact similarity ranks, and is rounded to six digits afterwards; ties go to the smaller vec_id.  Vectors of another length than the query's don't count.
    """
    pool = vectors if where is None else vectors.where(where)
    asked, packs = _packs(queries, "query_id", "_q"), _packs(pool, "vec_id", "_v")
    if queries.limit(MOST_QUERIES + 1).count() <= MOST_QUERIES:
        blocks = packs.join(F.broadcast(asked), F.col("_v_size") == F.col("_q_size"))
    else:  # dealt by length and share: the vectors' packs are spread over the shares, each of which gets all queries
        shares = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        spread = packs.withColumn("_share", F.pmod(F.xxhash64("_v_pack"), F.lit(shares)).cast("int"))
        every = written(asked, "queries").withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        # never broadcast: exploded queries are many more bytes than Spark reckons
        blocks = spread.hint("merge").join(every, (F.col("_v_size") == F.col("_q_size")) & (F.col("_share") == F.col("_to")))
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("vec_id", vectors.schema["vec_id"].dataType), T.StructField("similarity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, tuple] = {}  # by pack of queries, what the task's vectors have given so far
        for batch in batches:
            for i in range(batch.num_rows):
                ids, data, query_ids, query_data = (batch.column(c)[i] for c in ("_v_ids", "_v_data", "_q_ids", "_q_data"))
                size, pack = batch.column("_v_size")[i].as_py(), batch.column("_q_pack")[i].as_py()
                matrix = lambda x: np.frombuffer(x.as_buffer(), np.float64).reshape(-1, size)  # noqa: B023, E731
                query, vector, exact = _near(matrix(data), matrix(query_data), k)
                found = ids.values.take(pa.array(vector))
                if pack in best:
                    _, query_0, found_0, exact_0 = best[pack]
                    query, found, exact = np.concatenate([query_0, query]), pa.concat_arrays([found_0, found]), np.concatenate([exact_0, exact])
                stay = _kept(query, found, exact, k)
                best[pack] = query_ids.values, query[stay], found.take(pa.array(stay)), exact[stay]
        for query_ids, query, found, exact in best.values():
            yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(query)), found, pa.array(exact)], schema.names)

    pairs = blocks.select("_v_ids", "_v_data", "_v_size", "_q_pack", "_q_ids", "_q_data").mapInArrow(run, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).withColumn("similarity", F.round("similarity", 6))


def _packs(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(_size, _pack, _ids, _data, each behind ``name``): at most PACK ids and their vectors of one length as 64-bit floats, in a row."""
    kind = rows.schema[key].dataType
    schema = T.StructType([T.StructField(f"{name}_size", T.IntegerType()), T.StructField(f"{name}_pack", T.StringType()), T.StructField(f"{name}_ids", T.ArrayType(kind)), T.StructField(f"{name}_data", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            size = column.value_lengths().to_numpy(zero_copy_only=False)
            for n in np.unique(size).tolist():
                at = np.flatnonzero(size == n)
                for low in range(0, len(at), PACK):
                    few = pa.array(at[low : low + PACK])
                    data = column.take(few).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    held = ids.take(few)
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([uuid.uuid4().hex]), pa.ListArray.from_arrays(pa.array([0, len(few)], pa.int32()), held), pa.array([data.tobytes()], pa.binary())], schema.names)

    whole = rows.where(F.size("embedding") > 0).where(~F.exists("embedding", lambda x: x.isNull()))
    return whole.select(key, F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, schema)


def _summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``dot`` of each row of a with that of b, added up in the same order."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def _near(vectors: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of query and vector and their cosine, for all that can be among a query's k best once rounded.

    A matrix product finds those near the k-th best; their cosines are then summed as ``cosine`` does.
    """
    with np.errstate(all="ignore"):
        norm, length = np.sqrt(_summed(queries, queries)), np.sqrt(_summed(vectors, vectors))
        scale = norm[:, None] * length
        rough = queries @ vectors.T / scale
        odd = ~np.isfinite(rough)  # to be looked at one by one: no length, or numbers beyond all bounds
        rough[odd] = -np.inf
        least = np.partition(rough, len(vectors) - k, axis=1)[:, len(vectors) - k] - NEAR if len(vectors) > k else np.full(len(queries), -np.inf)
        query, vector = np.nonzero((~odd & (rough >= least[:, None])) | (odd & ((scale > 0) | np.isnan(scale))))
        exact = _summed(vectors[vector], queries[query]) / (length[vector] * norm[query])
    return query, vector, exact


def _kept(query: np.ndarray, ids: pa.Array, exact: np.ndarray, k: int) -> np.ndarray:
    """Places of the pairs that can be among a query's k best once rounded; of equal cosines the k smallest ids."""
    if not len(query):
        return np.zeros(0, np.int64)
    high = np.where(np.isnan(exact), np.inf, exact)  # NaN is Spark's largest number
    order = pa.compute.rank(ids, sort_keys="ascending", tiebreaker="first", null_placement="at_start").to_numpy()
    by = np.lexsort((order, -high, query))
    query, high, at = query[by], high[by], np.arange(len(by))
    new = np.append(True, query[1:] != query[:-1])
    start = np.maximum.accumulate(np.where(new, at, 0))
    last = np.append(start[1:] != start[:-1], True)
    end = at[last][np.cumsum(new) - 1]
    enough = high >= high[np.minimum(start + k - 1, end)] - NEAR
    run = np.maximum.accumulate(np.where(new | np.append(True, high[1:] != high[:-1]), at, 0))
    return by[enough & (at - run < k)]


def insert_absent(existing: DataFrame, rows: DataFrame, key: str = "content_hash", order: str = "pos") -> DataFrame:
    """The rows to add: those whose key isn't there yet, one for each key, the first."""
    rest = [c for c in rows.columns if c != key]
    once = rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row")).select(key, "_row.*").select(*rows.columns)
    return once.join(existing.select(key), key, "left_anti")


def delete_where(rows: DataFrame, condition: Column) -> DataFrame:
    """What stays after deleting the rows for which a condition is true."""
    return rows.where(~F.coalesce(condition, F.lit(False)))


def aligned(vectors: DataFrame, queries: DataFrame, most_distance: float = 0.8) -> DataFrame:
    """The nearest vector of each query unless it is too far away."""
    return top_k(vectors, queries, 1).where(1 - F.col("similarity") <= most_distance)
