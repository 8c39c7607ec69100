"""Counts over projects, domains and lists, and other small relational helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import written


def distinct_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the last."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row")).select(key, "_row.*").select(*rows.columns)


def counts_with_zero(dimension: DataFrame, facts: DataFrame, key: str, fact_key: str) -> DataFrame:
    """Rows of a dimension with the number of facts of each, 0 included.  Facts are counted before the join."""
    counted = facts.groupBy(F.col(fact_key).alias(key)).agg(F.count(F.lit(1)).alias("n"))
    return dimension.join(counted, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def ordered_list(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, values): the values of each key in the given order."""
    pairs = F.array_sort(F.collect_list(F.struct(order, value)))
    return rows.groupBy(key).agg(F.transform(pairs, lambda p: p[value]).alias("values"))


def folded(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """One value as itself, several as a sorted list in brackets."""
    values = rows.groupBy(*key).agg(F.array_sort(F.collect_set(value)).alias("vs"))
    return values.select(*key, F.when(F.size("vs") == 1, F.col("vs")[0]).otherwise(F.concat(F.lit("["), F.array_join("vs", ","), F.lit("]"))).alias("value"))


def sums_before(rows: DataFrame, value: str, order: list[str], group: str | None = None) -> DataFrame:
    """Rows with ``before``: the sum of a value over the rows before each in a total order, of all rows or of each group.

    Rows are dealt by range of group and order, so a large group is spread over tasks.  A window sums within a task's share,
    and the shares' totals, one row for each task and group, give the rest.
    """
    keys = [group] if group else []
    dealt = rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    dealt = written(dealt, "dealt")
    until = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum(value).over(until(Window.partitionBy("_part", *keys).orderBy(*order))), F.lit(0))
    totals = dealt.groupBy(F.col("_part").alias("_share"), *[F.col(k).alias("_group") for k in keys]).agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy("_group").orderBy("_share") if keys else Window.orderBy("_share")
    bases = totals.withColumn("_base", F.coalesce(F.sum("_total").over(until(earlier)), F.lit(0))).drop("_total")
    same = F.col("_part") == F.col("_share")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("_group"))
    found = dealt.withColumn("_within", within).join(bases, same)
    return found.select(*rows.columns, (F.col("_within") + F.col("_base")).alias("before"))


def eviction(files: DataFrame, size: str, order: list[str], need: float, group: str | None = None) -> DataFrame:
    """The oldest files to delete until ``need`` is freed, in all or in each group: those before which less has been freed."""
    return sums_before(files, size, order, group).withColumnRenamed("before", "freed_before").where(F.col("freed_before") < need)


def unchanged_schema(new: DataFrame, old: DataFrame, key: str, column: str) -> DataFrame:
    """New rows that take an old row's value of a column where they have none."""
    kept = old.select(key, F.col(column).alias("_old"))
    return new.join(kept, key, "left").withColumn(column, F.coalesce(column, "_old")).drop("_old")


def upserted(existing: DataFrame, rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, created): existing values replaced by new ones, new keys marked."""
    a, b = existing.select(key, F.col(value).alias("_old"), F.lit(True).alias("_had")), rows.select(key, F.col(value).alias("_new"), F.lit(True).alias("_has"))
    return a.join(b, key, "full").select(key, F.when(F.col("_has"), F.col("_new")).otherwise(F.col("_old")).alias(value), F.col("_had").isNull().alias("created"))


def searched(rows: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows of which some column holds a text, in any case."""
    hit: Column = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
    return rows.where(hit)


def visible(rows: DataFrame, user: int) -> DataFrame:
    """Rows that are published or the user's own."""
    return rows.where(F.col("published") | (F.col("owner") == user))
