"""Search documents and interchange JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.ids import import_node_id
from tessera.functions.text import entity_description, relation_description, type_name
from tessera.operators.graph import with_ends

#: Properties that aren't exported.
INTERNAL = ("description", "_domain")


def entity_documents(nodes: DataFrame) -> DataFrame:
    """A search document for each node."""
    owl = F.concat(F.lit("owl:"), F.col("kind"))
    return nodes.select(
        F.lit("entity").alias("knowledge_graph_kwd"), F.col("label").alias("name_kwd"), type_name(owl).alias("type_kwd"), entity_description(F.col("label"), owl, F.col("properties")).alias("content"),
    )


def relation_documents(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A search document for each edge."""
    found = with_ends(edges, nodes)
    return found.select(
        F.lit("relation").alias("knowledge_graph_kwd"), F.col("source_label").alias("from_kwd"), F.col("target_label").alias("to_kwd"),
        relation_description(F.col("source_label"), F.col("relation"), F.col("target_label")).alias("content"),
    )


def graph_documents(nodes: DataFrame, edges: DataFrame, part: int = 1000) -> DataFrame:
    """A tenant's whole structure as search documents of the kind 'graph': names with their types, and pairs of names with the weight 1.

    Each document holds at most about ``part`` nodes or edges, dealt by hash, so that no row grows with the tenant; ``part_no`` tells a tenant's documents apart.
    Edges need a name at both ends; entries are in the order of their text.
    """
    typed = nodes.select("tenant", F.struct(F.col("label").alias("id"), type_name(F.col("class_label")).alias("entity_type")).alias("node"), F.lit(None).alias("edge"))
    found = with_ends(edges, nodes).where("source_label <> '' and target_label <> ''")
    linked = found.select("tenant", F.lit(None).alias("node"), F.struct(F.col("source_label").alias("source"), F.col("target_label").alias("target"), F.lit(1).alias("weight")).alias("edge"))
    rows = typed.unionByName(linked)
    parts = rows.groupBy("tenant").agg(F.ceil(F.count(F.lit(1)) / part).alias("_parts"))
    dealt = rows.join(parts, "tenant").withColumn("part_no", F.pmod(F.xxhash64("node", "edge"), F.col("_parts")))
    whole = dealt.groupBy("tenant", "part_no").agg(F.array_sort(F.collect_list("node")).alias("nodes"), F.array_sort(F.collect_list("edge")).alias("edges"))
    return whole.select(F.lit("graph").alias("knowledge_graph_kwd"), "tenant", "part_no", F.to_json(F.struct("nodes", "edges")).alias("content"))


def type_entities(nodes: DataFrame) -> DataFrame:
    """(class_label, names): the names of each class, sorted."""
    return nodes.groupBy("class_label").agg(F.array_sort(F.collect_list("label")).alias("names"))


def as_json(documents: DataFrame) -> DataFrame:
    return documents.select(F.to_json(F.struct("*")).alias("value"))


def interchange(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relationships as they are exchanged, without internal properties."""
    shown = F.map_filter("properties", lambda k, v: ~k.isin(*INTERNAL) & ~k.startswith("_source_"))
    entities = nodes.select(F.col("label").alias("name"), F.col("class_label").alias("type"), shown.alias("properties"))
    return entities, with_ends(edges, nodes).select(F.col("source_label").alias("source_name"), F.col("target_label").alias("target_name"), "relation")


def imported(entities: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph of exchanged entities and relationships; a name that comes twice is its first entity; loose relationships go."""
    first = entities.groupBy("name").agg(F.min(F.struct("pos", "type")).alias("e"))
    nodes = first.select(import_node_id(F.col("name")).alias("id"), F.col("name").alias("label"), F.col("e.type").alias("class_label"))
    end = lambda column, out: nodes.select(F.col("label").alias(column), F.col("id").alias(out))
    edges = relationships.join(end("source_name", "src"), "source_name").join(end("target_name", "dst"), "target_name").select("src", "dst", "relation").distinct()
    return nodes, edges
