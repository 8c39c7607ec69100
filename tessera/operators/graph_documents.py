"""Whole graphs as stored documents: JSON documents, one a tenant or several of a large one, read as variants.

A document is ``{"nodes": […], "edges": […]}``.  It is parsed once; nodes and edges come out of the variant by ``variant_explode``, counts are the lengths of
its arrays without taking them apart, and the schema that a set of documents has is gathered by an aggregate of variants, which keeps one schema for
each task.

Defined results: a null document is no graph and gives nothing; text that isn't JSON, or JSON that isn't an object, is an error row; a missing or null list
is empty, and so is a value there that isn't a list; entries that aren't objects, or have no id (nodes) or no end (edges), are left out; repeated entries come each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import METADATA_KEYS, with_ends

NODE = {"id": "string", "label": "string", "kind": "string", "class_label": "string", "properties": "map<string,string>"}
EDGE = {"src": "string", "dst": "string", "relation": "string", "label": "string"}
#: Entries in a document at about the most: a variant of 128 MB can't be read.
MOST = 20_000


def stored(nodes: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(tenant, document): each tenant's nodes and edges as JSON text, in order of their ids; columns as in ``NODE`` and ``EDGE``, those that are missing left out.

    A tenant with more than ``most`` entries (``MOST``) has several documents, among which a hash deals them, so that no text, list or task grows with a tenant.
    """
    most = most or MOST
    entry = lambda rows, known: F.to_json(F.struct(*[F.col(c) for c in known if c in rows.columns])).alias("text")
    at = lambda a, b, c: F.struct(a.alias("a"), b.alias("b"), c.alias("c")).alias("at")
    none = F.lit(None).cast("string")
    parts = nodes.select("tenant", F.lit(False).alias("edge"), at(F.col("id"), none, none), entry(nodes, NODE)).unionByName(
        edges.select("tenant", F.lit(True).alias("edge"), at(F.col("src"), F.col("relation"), F.col("dst")), entry(edges, EDGE))
    )
    large = parts.groupBy(F.col("tenant").alias("_t")).count().where(F.col("count") > most).select("_t", F.ceil(F.col("count") / most).alias("_n"))
    share = F.pmod(F.xxhash64("text"), F.coalesce("_n", F.lit(1))).alias("share")
    dealt = parts.join(F.broadcast(large), F.col("tenant").eqNullSafe(F.col("_t")), "left").select("tenant", share, "edge", "at", "text")
    listed = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(kind, F.struct("at", "text")))), lambda x: x["text"]), ",")
    whole = dealt.groupBy("tenant", "share").agg(listed(~F.col("edge")).alias("nodes"), listed(F.col("edge")).alias("edges"))
    return whole.select("tenant", F.concat(F.lit('{"nodes":['), "nodes", F.lit('],"edges":['), "edges", F.lit("]}")).alias("document"))


def parsed(documents: DataFrame) -> DataFrame:
    """(tenant, document, v): the documents as variants; v is null for what isn't a JSON object."""
    v = F.try_parse_json("document")
    return documents.select("tenant", "document", F.when(F.try_variant_get(v, "$", "map<string,variant>").isNotNull(), v).alias("v"))


def errors(documents: DataFrame) -> DataFrame:
    """(tenant, document) of the documents that aren't graphs."""
    return parsed(documents).where("document is not null and v is null").select("tenant", "document")


def _entries(documents: DataFrame, name: str, fields: dict[str, str], needs: tuple[str, ...]) -> DataFrame:
    listed = parsed(documents).where("v is not null").select("tenant", F.try_variant_get("v", f"$.{name}", "variant").alias("list"))
    listed = listed.where(F.try_variant_get("list", "$", "array<variant>").isNotNull())
    tvf = documents.sparkSession.tvf.variant_explode(F.col("list").outer())
    each = listed.lateralJoin(tvf).select("tenant", "value")
    found = each.select("tenant", *[F.try_variant_get("value", f"$.{f}", kind).alias(f) for f, kind in fields.items()])
    for c in needs:
        found = found.where(F.col(c).isNotNull())
    return found


def nodes(documents: DataFrame) -> DataFrame:
    """(tenant, id, label, kind, class_label, properties) of all documents."""
    return _entries(documents, "nodes", NODE, ("id",))


def edges(documents: DataFrame) -> DataFrame:
    """(tenant, src, dst, relation, label) of all documents."""
    return _entries(documents, "edges", EDGE, ("src", "dst"))


def counts(documents: DataFrame) -> DataFrame:
    """(tenant, n_nodes, n_edges): entries of each tenant's graphs, by the lengths of the lists alone."""
    size = lambda name: F.coalesce(F.sum(F.coalesce(F.size(F.try_variant_get("v", f"$.{name}", "array<variant>")), F.lit(0))), F.lit(0)).cast("long")
    return parsed(documents).where("v is not null").groupBy("tenant").agg(size("nodes").alias("n_nodes"), size("edges").alias("n_edges"))


def schema(documents: DataFrame) -> str:
    """The schema that all the documents together have, as one text."""
    return parsed(documents).where("v is not null").agg(F.schema_of_variant_agg("v")).first()[0]


def project_schemas(documents: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tenant, class, properties, cached) and (tenant, relation, domain, range, cached) of every tenant: the schema that its document keeps, else what its graph shows.

    documents: tenant, document (with ``schema``, its ``classes`` and ``object_properties``); nodes: tenant, class_label, id, properties; edges: tenant, src, dst, relation.  A
    kept schema counts if it has a class.  A kept class goes by its label, else its id, else 'Unknown', as do relations and their ends; a class of the graph has the
    property names that its nodes use.
    """
    v = parsed(documents).where("v is not null").select("tenant", F.try_variant_get("v", "$.schema.classes", "array<variant>").alias("c"), F.try_variant_get("v", "$.schema.object_properties", "array<variant>").alias("r"))
    kept = v.where(F.size("c") > 0)
    text = lambda x, *names: F.coalesce(*[F.try_variant_get(x, f"$.{n}", "string") for n in names], F.lit("Unknown"))
    classes = kept.select("tenant", F.explode("c").alias("x")).select("tenant", text("x", "label", "id").alias("class"), F.coalesce(F.try_variant_get("x", "$.data_properties", "array<string>"), F.array().cast("array<string>")).alias("properties"), F.lit(True).alias("cached"))
    relations = kept.select("tenant", F.explode("r").alias("x")).select("tenant", text("x", "label", "id").alias("relation"), text("x", "domain").alias("domain"), text("x", "range").alias("range"), F.lit(True).alias("cached"))
    have = kept.select("tenant").distinct()
    rest, links = nodes.join(have, "tenant", "left_anti"), edges.join(have, "tenant", "left_anti")
    named = rest.select("tenant", F.col("class_label").alias("class"), F.explode_outer(F.map_keys("properties")).alias("k"))
    used = F.array_sort(F.collect_set(F.when(~F.col("k").isin(*METADATA_KEYS), F.col("k"))))
    inferred = named.where("class is not null").groupBy("tenant", "class").agg(used.alias("properties")).withColumn("cached", F.lit(False))
    found = with_ends(links, rest).select("tenant", "relation", F.col("source_class").alias("domain"), F.col("target_class").alias("range")).distinct().withColumn("cached", F.lit(False))
    return classes.unionByName(inferred), relations.unionByName(found)
