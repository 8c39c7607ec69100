"""The property graph as tables, and how the relational input tables become one.

Nodes: tenant, id, kind ('NamedIndividual' or 'Class'), label, class_label, properties (string map), pos.
Edges: tenant, src, dst, relation, label, pos.  ``pos`` is the place in the input, for everything that depends on order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.storage import table


def key(name: str, column: str) -> Column:
    """A node id: the table's name and the row's key."""
    return F.concat(F.lit(f"{name}:"), F.col(column).cast("string"))


#: table, key, label, tenant, properties
ENTITIES = [
    ("region", "r_regionkey", "r_name", "r_regionkey", []),
    ("nation", "n_nationkey", "n_name", "n_regionkey", []),
    ("customer", "c_custkey", "c_name", "c_nationkey", ["c_mktsegment"]),
    ("supplier", "s_suppkey", "s_name", "s_nationkey", []),
    ("part", "p_partkey", "p_name", "p_size", ["p_brand", "p_type"]),
]
#: table, source table and key, relation, target table and key
RELATIONS = [
    ("nation", ("nation", "n_nationkey"), "IN_REGION", ("region", "n_regionkey")),
    ("customer", ("customer", "c_custkey"), "LIVES_IN", ("nation", "c_nationkey")),
    ("supplier", ("supplier", "s_suppkey"), "LOCATED_IN", ("nation", "s_nationkey")),
    ("orders", ("order", "o_orderkey"), "PLACED_BY", ("customer", "o_custkey")),
    ("lineitem", ("order", "l_orderkey"), "CONTAINS", ("part", "l_partkey")),
    ("lineitem", ("part", "l_partkey"), "SUPPLIED_BY", ("supplier", "l_suppkey")),
]


def nodes(spark: SparkSession, sf: str, only: tuple[str, ...] | None = None) -> DataFrame:
    """The entity tables as graph nodes."""
    parts = []
    for name, k, label, tenant, props in ENTITIES:
        if only is None or name in only:
            pairs = [x for p in props for x in (F.lit(p), F.col(p))]
            parts.append(
                table(spark, sf, name).select(
                    F.col(tenant).cast("long").alias("tenant"), key(name, k).alias("id"), F.lit("NamedIndividual").alias("kind"), F.col(label).alias("label"),
                    F.lit(name).alias("class_label"), (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("properties"), F.col(k).cast("long").alias("pos"),
                )
            )
    return reduce(DataFrame.unionByName, parts)


def edges(spark: SparkSession, sf: str, only: tuple[str, ...] | None = None) -> DataFrame:
    """The foreign keys as graph edges."""
    parts = []
    for name, (s, sk), relation, (d, dk) in RELATIONS:
        if only is None or relation in only:
            parts.append(table(spark, sf, name).select(key(s, sk).alias("src"), key(d, dk).alias("dst"), F.lit(relation).alias("relation")))
    return reduce(DataFrame.unionByName, parts)
