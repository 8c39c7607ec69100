"""Written intermediate tables.

Lineage is cut with Parquet tables in the folder that the cluster names in
``spark.checkpoint.dir``: every executor can read it, so losing one executor never loses
a finished stage.  Only where that setting is missing (tests, laptops) is a folder of our
own used.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Rows that a task gets of a table too large for Spark's own number of partitions.
TASK_ROWS = 1 << 20
#: By application, the tables that it has written.
_written: dict[str, list[str]] = {}
#: Where the tables that ``written`` has returned lie.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Spark's setting by which a query's shuffle files go as soon as it has ended; else they stay until the driver collects its garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables, visible to the driver and all executors."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back; what was shuffled for it is deleted."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANED, "false")
    spark.conf.set(CLEANED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANED, before)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def unneeded(*tables: DataFrame) -> None:
    """Delete tables that ``written`` has returned and that nothing reads any more."""
    for t in tables:
        path = _paths.pop(t)
        _written[t.sparkSession.sparkContext.applicationId].remove(path)
        _delete(t.sparkSession, path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written within are deleted at the end, but for those that the function given here is called with."""
    mine = _written.setdefault(spark.sparkContext.applicationId, [])
    before, kept = set(mine), set()

    def keep(t: DataFrame) -> DataFrame:
        kept.add(_paths[t])
        return t

    yield keep
    for path in [p for p in mine if p not in before and p not in kept]:
        mine.remove(path)
        _delete(spark, path)


def forget(spark: SparkSession) -> int:
    """Delete the tables that ``written`` has made in this application so far, and say how many.

    For when results that read them have been stored: DataFrames over them can't be computed any more.
    """
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """``rows``, of which there are ``n``, dealt by keys among so many tasks that each gets ``TASK_ROWS`` on average; few rows are left to Spark.

    Spark's own number of partitions is fixed, and a task's share would grow with the input.
    """
    tasks = -(-n // TASK_ROWS)
    return rows.repartition(tasks, *keys) if tasks > rows.sparkSession.sparkContext.defaultParallelism else rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables of a scale-factor folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
