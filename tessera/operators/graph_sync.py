"""A stored graph brought up to date, reading only what differs.

A store is a Parquet folder of rows (tenant, key columns, content), partitioned into ``SHARDS`` by a hash of the tenant and of one of ``SLOTS`` slots that the key falls
into, and a table of digests: for each tenant and slot the count of rows, the sum and the exclusive or of two hashes of them, and above these, for each
tenant, the same over its slots.  New rows are digested in the same way; tenants are compared first, of those that differ the slots, and only the
shards of slots that differ are read (partition pruning).  The rest of the store isn't opened.

Defined results: rows are a set by (tenant, key): of repeats the last by content stays; a null in tenant, key or content is a value like any other;
a tenant that the new rows don't name stays as it is, unless it is among ``tenants``, the ones to be replaced whole, and then all its rows go.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.storage import written

SHARDS, SLOTS = 64, 16


def _text(c: str, kind: str) -> Column:
    """A column as text that tells null from empty; maps with their entries in order."""
    value = F.to_json(F.struct(F.array_sort(F.map_entries(c)).alias("m"))) if kind.startswith("map") else F.to_json(F.struct(F.col(c).alias("v")))
    return F.when(F.col(c).isNull(), "null").otherwise(value)


def _placed(rows: DataFrame, key: list[str]) -> DataFrame:
    """Each (tenant, key) once, with slot, shard and two hashes of the whole row."""
    kinds = dict(rows.dtypes)
    content = [c for c in rows.columns if c not in {"tenant", *key}]
    said = rows.withColumn("_said", F.concat_ws("\x01", *[_text(c, kinds[c]) for c in content]) if content else F.lit(""))
    once = said.groupBy("tenant", *key).agg(F.max_by(F.struct(*content, "_said"), "_said").alias("_r")).select("tenant", *key, "_r.*") if content else said.distinct()
    slot = F.pmod(F.xxhash64(*key), F.lit(SLOTS)).cast("int")
    whole = [F.concat_ws("\x01", *[_text(c, kinds[c]) for c in ["tenant", *key]]), F.col("_said")]
    placed = once.withColumns({"slot": slot, "_a": F.xxhash64(*whole), "_b": F.xxhash64(F.lit("b"), *whole)})
    return placed.withColumn("shard", F.pmod(F.xxhash64("tenant", "slot"), F.lit(SHARDS)).cast("int")).drop("_said")


def digests(placed: DataFrame) -> DataFrame:
    """(tenant, slot, shard, n, total, mixed): the leaves."""
    return placed.groupBy("tenant", "slot", "shard").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_a").cast("decimal(20,0)")).alias("total"), F.bit_xor("_b").alias("mixed"))


def _roots(leaves: DataFrame) -> DataFrame:
    return leaves.groupBy("tenant").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.bit_xor("mixed").alias("mixed"))


def _unlike(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """The keys, on either side, whose digests differ or that one side lacks."""
    sums = ["n", "total", "mixed"]
    a, b = (rows.select(*[F.col(k).alias(f"{side}_{k}") for k in key], F.struct(*sums).alias(f"{side}_d")) for rows, side in ((new, "a"), (old, "b")))
    both = a.join(b, reduce(lambda x, y: x & y, [F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in key]), "full_outer")
    return both.where(~F.col("a_d").eqNullSafe(F.col("b_d"))).select(*[F.when(F.col("a_d").isNotNull(), F.col(f"a_{k}")).otherwise(F.col(f"b_{k}")).alias(k) for k in key])


def _null_safe(left: DataFrame, right: DataFrame, key: list[str], how: str) -> DataFrame:
    """A join on keys in which null equals null; the left side's columns stay, and those of the right that it lacks."""
    renamed = right.withColumnsRenamed({k: f"_k_{k}" for k in key})
    return left.join(renamed, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key]), how).drop(*[f"_k_{k}" for k in key])


@dataclass
class Store:
    """A folder with ``rows`` and ``digests``, and the columns that make a row's key besides the tenant."""

    spark: SparkSession
    path: str
    key: list[str]

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def leaves(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/digests")

    def create(self, rows: DataFrame) -> Store:
        placed = written(_placed(rows, self.key), "placed")
        placed.drop("_a", "_b").repartition("shard").write.partitionBy("shard").mode("overwrite").parquet(f"{self.path}/rows")
        digests(placed).write.mode("overwrite").parquet(f"{self.path}/digests")
        return self

    def _differing(self, new: DataFrame, tenants: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """(tenant, slot, shard) of the leaves that differ, and the new leaves."""
        leaves, old = written(digests(new), "new-digests"), self.leaves()
        named = leaves.select("tenant").distinct()
        meant = (named if tenants is None else named.unionByName(tenants.select("tenant"))).distinct()
        old = _null_safe(old, meant, ["tenant"], "left_semi")
        unlike = _unlike(_roots(leaves), _roots(old), ["tenant"])
        mine = [_null_safe(side, unlike, ["tenant"], "left_semi") for side in (leaves, old)]
        return written(_unlike(mine[0], mine[1], ["tenant", "slot", "shard"]), "unlike"), leaves

    def _stored(self, unlike: DataFrame) -> DataFrame:
        """The stored rows of the shards that hold leaves which differ; other partitions aren't read."""
        shards = [r["shard"] for r in unlike.select("shard").distinct().collect()]  # SHARDS at most
        return self.rows().where(F.col("shard").isin(shards))

    def changes(self, rows: DataFrame, tenants: DataFrame | None = None) -> DataFrame:
        """(change, tenant, key…): what is added, changed and removed for the store to hold these rows."""
        return self._changes(written(_placed(rows, self.key), "placed"), tenants)[0]

    def _changes(self, new: DataFrame, tenants: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        unlike, leaves = self._differing(new, tenants)
        leaf = ["tenant", "slot", "shard"]
        ours = _null_safe(new, unlike, leaf, "left_semi").select("tenant", *self.key, F.col("_a").alias("_new"))
        theirs = _placed(_null_safe(self._stored(unlike), unlike, leaf, "left_semi").drop("slot", "shard"), self.key).select("tenant", *self.key, F.col("_a").alias("_old"))
        both = _outer(ours, theirs, ["tenant", *self.key])
        change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
        found = both.where(~F.col("_old").eqNullSafe(F.col("_new"))).select(change.alias("change"), "tenant", *self.key)
        return found, unlike, leaves

    def update(self, rows: DataFrame, tenants: DataFrame | None = None) -> DataFrame:
        """Make the store hold these rows, and say what changed.  Only shards with a leaf that differs are written anew, by replacing their partitions."""
        new = written(_placed(rows, self.key), "placed")
        found, unlike, leaves = self._changes(new, tenants)
        found, leaf = written(found, "changes"), ["tenant", "slot", "shard"]
        stays = _null_safe(self._stored(unlike), unlike, leaf, "left_anti")
        comes = _null_safe(new, unlike, leaf, "left_semi").drop("_a", "_b")
        old = _null_safe(self.leaves(), unlike, leaf, "left_anti")
        whole = written(stays.select(*comes.columns).unionByName(comes), "renewed")
        table = written(old.unionByName(_null_safe(leaves, unlike, leaf, "left_semi")), "digests")
        # a shard that is left without rows has no partition to replace: it gets one without rows
        empty = self.spark.createDataFrame([], whole.schema)
        gone = [r["shard"] for r in unlike.select("shard").distinct().join(whole.select("shard").distinct(), "shard", "left_anti").collect()]  # SHARDS at most
        whole.repartition("shard").write.option("partitionOverwriteMode", "dynamic").partitionBy("shard").mode("overwrite").parquet(f"{self.path}/rows")
        for shard in gone:
            empty.drop("shard").write.mode("overwrite").parquet(f"{self.path}/rows/shard={shard}")
        table.write.mode("overwrite").parquet(f"{self.path}/digests")
        return found


def _outer(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    right = b.withColumnsRenamed({k: f"_k_{k}" for k in key})
    both = a.join(right, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key]), "full_outer")
    return both.select(*[F.when(F.col("_new").isNotNull(), F.col(k)).otherwise(F.col(f"_k_{k}")).alias(k) for k in key], "_old", "_new")
