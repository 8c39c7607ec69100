"""Control tables as table functions: projects, domains and documents, with the rules for changing them.

Projects: id, owner, domain, published, created, name.  Every change returns the new table and nothing is written in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What makes an edge one from an instance to its class.
TYPE_RELATIONS = ("type", "instance_of", "rdf:type")


def edge_kind(relation: Column, label: Column, source: Column) -> Column:
    """One of type, subclass, action and property, by relation, label or the source's id."""
    either = lambda *names: F.lower(relation).isin(*names) | F.lower(F.coalesce(label, F.lit(""))).isin(*names)
    return F.when(either(*TYPE_RELATIONS), "type").when(either("subclassof", "rdfs:subclassof"), "subclass").when(either("action") | source.startswith("AT_"), "action").otherwise("property")


def published(projects: DataFrame, ids: list[int]) -> tuple[DataFrame, DataFrame]:
    """Projects with some published, and those refused as they have no domain."""
    wanted = F.col("id").isin(ids)
    return projects.withColumn("published", F.col("published") | (wanted & F.col("domain").isNotNull())), projects.where(wanted & F.col("domain").isNull())


def moved(projects: DataFrame, source: int, target: int) -> DataFrame:
    """Projects with those of one domain in another; published ones keep theirs."""
    return projects.withColumn("domain", F.when((F.col("domain") == source) & ~F.col("published"), target).otherwise(F.col("domain")))


def deletable(domains: DataFrame, projects: DataFrame) -> DataFrame:
    """Domains that no project is in."""
    return domains.join(projects.select(F.col("domain").alias("id")), "id", "left_anti")


def complete(rows: DataFrame, ids: list[int]) -> bool:
    """Whether every one of some different ids is in a table."""
    return rows.where(F.col("id").isin(ids)).select("id").distinct().count() == len(set(ids))


def without_project(project: int, *tables: DataFrame) -> list[DataFrame]:
    """Tables with a project column, without a project's rows."""
    return [t.where(F.col("project") != project) for t in tables]


def page(rows: DataFrame, number: int, *order: str, size: int = 10) -> DataFrame:
    """A page, from 1 on, of a total order."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def progress(rows: DataFrame, order: str, share: float = 0.9) -> DataFrame:
    """Numbered rows (``index`` from 0) with the share of all that is done after each."""
    total = rows.count()
    return rows.withColumn("progress", (F.col(order) + 1) / F.lit(max(total, 1)) * share)


def tooltip(properties: Column, source: Column, most: int = 5, width: int = 20) -> Column:
    """A node's source and first properties, shortened, one a line; those that begin with _ are hidden."""
    shown = F.slice(F.map_entries(F.map_filter(properties, lambda k, v: ~k.startswith("_"))), 1, most)
    lines = F.transform(shown, lambda e: F.concat(e["key"], F.lit(": "), F.substring(e["value"], 1, width)))
    return F.array_join(F.concat(F.filter(F.array(source), lambda s: s.isNotNull()), lines), "\n")


def save_partition(rows: DataFrame, path: str) -> None:
    """Replace only the partitions (by project) that the rows have."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project").parquet(path)
