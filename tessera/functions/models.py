"""Seams for models: embedders and extractors are callables that the caller passes in.

The callables run inside tasks, on Arrow batches.  ``hashed_embedder`` needs no model and gives the same vectors everywhere.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tries of a call, and seconds to wait after a busy answer (times the try) or any other failure.
TRIES, BUSY_SECONDS, FAILED_SECONDS = 3, 10, 2


class Busy(Exception):
    """What a callable raises if the service asks to come back later."""


def hashed_embedder(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """Words hashed to places with a sign, scaled to length 1; texts without words give zeros."""

    def embed(texts: list[str]) -> list[list[float]]:
        import numpy as np
        import xxhash

        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = xxhash.xxh64_intdigest(w.encode())
                out[i, h % dim] += 1.0 if h >> 63 else -1.0
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(size > 0, size, 1)).tolist()

    return embed


def embedded(rows: DataFrame, text: str, embed: Callable[[list[str]], list[list[float]]], zeros: int | None = None) -> DataFrame:
    """Rows with an ``embedding``; where embedding fails, zeros of that length, or null."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(batch):
        import pandas as pd

        try:
            return pd.Series(embed(batch.tolist()))
        except Exception:  # one failed call doesn't lose the others
            return pd.Series([None if zeros is None else [0.0] * zeros] * len(batch))

    return rows.withColumn("embedding", vectors(text))


def called(call: Callable[[str], str], prompt: str, pause: Callable[[float], None] = time.sleep) -> str | None:
    """A call with its tries; null if all fail."""
    for n in range(1, TRIES + 1):
        try:
            return call(prompt)
        except Busy:
            wait = BUSY_SECONDS * n
        except Exception:
            wait = FAILED_SECONDS
        if n < TRIES:
            pause(wait)
    return None


def extracted(chunks: DataFrame, prompt: str, call: Callable[[str], str], pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """Chunks with the model's ``payload`` for their prompt, null where it failed."""
    schema = T.StructType([*chunks.schema.fields, T.StructField("payload", T.StringType())])

    def run(frames: Iterator) -> Iterator:
        for rows in frames:
            rows["payload"] = [called(call, p, pause) for p in rows[prompt]]
            yield rows

    return chunks.mapInPandas(run, schema)
