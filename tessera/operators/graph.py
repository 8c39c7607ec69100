"""Property-graph operators: merging, matching, closure, inference and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import relation_type
from tessera.storage import written


#: Keys that say where a node comes from; they are no part of a schema.
METADATA_KEYS = ("id", "project_id", "source_file", "source_chunk_index", "source_quote", "chunk_text")


def first_by(rows: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """One row for each key: the first (or last) in the given order.

    A min_by (max_by) aggregate over the row, so copies of a hot key shrink before the shuffle.
    """
    rest = [c for c in rows.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    best = rows.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*rows.columns)


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes merged by (kind, id, tenant): later properties win, earlier ones that they don't name stay.

    A null in the key is a value like any other; a node without properties has null for them.
    """
    key = ["kind", "id", "tenant"]
    none = F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast(nodes.schema["properties"].dataType.valueType).alias("value"))
    parts = nodes.select(*key, "pos", "label", F.explode(F.concat(F.array(none), F.coalesce(F.map_entries("properties"), F.array()))).alias("p"))
    once = parts.groupBy(*key, F.col("p.key").alias("k")).agg(F.max_by("p.value", "pos").alias("v"), F.max_by("label", "pos").alias("label"), F.max("pos").alias("pos"))
    head = lambda c: F.max(F.when(F.col("k").isNull(), F.col(c))).alias(c)
    whole = once.groupBy(*key).agg(head("label"), head("pos"), F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v")))).alias("e"))
    return whole.select(*key, "label", "pos", F.when(F.size("e") > 0, F.map_from_entries("e")).alias("properties"))


def of_tenant(rows: DataFrame, tenant: object) -> DataFrame:
    """The rows of a tenant, which may be given as a number or as text."""
    return rows.where(F.col("tenant").cast("string") == F.lit(str(tenant)))


def tenant_key(*tables: DataFrame) -> list[str]:
    """What ids are joined with besides: the tenant, where all the tables have one.  Ids are unique within a tenant only."""
    return ["tenant"] if all("tenant" in t.columns for t in tables) else []


def merge_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges merged by (tenant, src, dst, type), the last wins; an edge without both ends in its tenant is dropped."""
    tenant = tenant_key(edges, nodes)
    typed = edges.withColumn("type", relation_type(F.col("relation")))
    once = first_by(typed, [*tenant, "src", "dst", "type"], ["pos"], last=True)
    return visible_edges(once, nodes.select(*tenant, "id").distinct())


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge in both directions."""
    return edges.unionByName(edges.withColumns({"src": F.col("dst"), "dst": F.col("src")}))


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with source_label, source_class, target_label and target_class, of nodes of the same tenant where both tables have one."""
    tenant = tenant_key(edges, nodes)
    end = lambda side, key: nodes.select(*tenant, F.col("id").alias(key), F.col("label").alias(f"{side}_label"), F.col("class_label").alias(f"{side}_class"))
    return edges.join(end("source", "src"), [*tenant, "src"]).join(end("target", "dst"), [*tenant, "dst"])


def matched_properties(properties: Column, keyword: str) -> Column:
    """The key-value pairs whose key or value holds a keyword."""
    return F.filter(F.map_entries(properties), lambda e: F.contains(e["key"], F.lit(keyword)) | F.contains(e["value"], F.lit(keyword)))


def keyword_match(nodes: DataFrame, edges: DataFrame, keyword: str) -> DataFrame:
    """Nodes whose properties hold a keyword, or that link to a node whose label does; with those neighbours.

    An optional match: the condition on the neighbour is part of the join.
    """
    tenant = tenant_key(edges, nodes)
    near = undirected(edges.select(*tenant, "src", "dst", "relation"))
    other = nodes.select(*tenant, F.col("id").alias("dst"), F.col("label").alias("neighbour"))
    far = near.join(other.where(F.contains("neighbour", F.lit(keyword))), [*tenant, "dst"])
    mine = nodes.select(*tenant, F.col("id").alias("src"), "label", matched_properties(F.col("properties"), keyword).alias("matched"))
    return mine.join(far, [*tenant, "src"], "left").where((F.size("matched") > 0) | F.col("relation").isNotNull())


def closure(pairs: DataFrame, depth: int | None = None) -> DataFrame:
    """(child, ancestor, depth): all ancestors with their least distance, each node its own at 0; with ``depth``, none further.

    Pairs are (child, parent).  Distances double from round to round, so rounds grow with the logarithm of
    the longest chain, and a round joins only pairs at the distance reached, so the work grows with the result; cycles end because only shorter distances replace longer ones.
    """
    own = pairs.select(F.col("child").alias("n")).union(pairs.select("parent")).distinct()
    known = pairs.where("child is not null and parent is not null").select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).where("child <> ancestor").distinct()
    known, reach = written(known, "closure"), 1
    while depth is None or reach < depth:
        # what lies further than ``reach`` lies beyond a node at exactly that distance
        edge = known.where(F.col("depth") == reach)
        if edge.isEmpty():
            break
        up = known.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("_far"), F.col("depth").alias("_more"))
        steps = edge.join(up, "ancestor").select("child", F.col("_far").alias("ancestor"), (F.col("depth") + F.col("_more")).alias("depth")).where("child <> ancestor")
        known = written(known.unionByName(steps).groupBy("child", "ancestor").agg(F.min("depth").alias("depth")), "closure")
        reach *= 2
    known = known if depth is None else known.where(F.col("depth") <= depth)
    return known.unionByName(own.where("n is not null").select(F.col("n").alias("child"), F.col("n").alias("ancestor"), F.lit(0).alias("depth")))


def inherited_properties(ancestors: DataFrame, properties: DataFrame) -> DataFrame:
    """(class, property, depth, source): own and inherited properties, the nearest definition of each.

    source is 'direct', the parent's name for a direct parent, else null.
    """
    found = ancestors.join(properties.select(F.col("class").alias("ancestor"), "property"), "ancestor")
    best = found.groupBy("child", "property").agg(F.min(F.struct("depth", "ancestor")).alias("b"))
    source = F.when(F.col("b.depth") == 0, "direct").when(F.col("b.depth") == 1, F.col("b.ancestor").cast("string"))
    return best.select(F.col("child").alias("class"), "property", F.col("b.depth").alias("depth"), source.alias("source"))


def nearest_value(ancestors: DataFrame, values: DataFrame) -> DataFrame:
    """(node, value): the first value that isn't empty, going up the chain."""
    found = ancestors.join(values.where("value <> ''").select(F.col("node").alias("ancestor"), "value"), "ancestor")
    return found.groupBy(F.col("child").alias("node")).agg(F.min_by("value", F.struct("depth", "ancestor")).alias("value"))


def ancestor_violations(links: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Links whose end's class has the expected class neither as itself nor as an ancestor: columns class, expected."""
    allowed = ancestors.select(F.col("child").alias("class"), F.col("ancestor").alias("expected"))
    return links.join(allowed, ["class", "expected"], "left_anti")


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an edge in their tenant."""
    tenant = tenant_key(edges, nodes)
    ends = edges.select(*tenant, F.col("src").alias("id")).union(edges.select(*tenant, "dst"))
    return nodes.join(ends, [*tenant, "id"], "left_anti")


def visible_edges(edges: DataFrame, visible: DataFrame) -> DataFrame:
    """Edges both of whose ends are in a set of ids, of their tenant where both tables have one."""
    tenant = tenant_key(edges, visible)
    for end in ("src", "dst"):
        edges = edges.join(visible.select(*tenant, F.col("id").alias(end)), [*tenant, end], "left_semi")
    return edges


def schema_keys(nodes: DataFrame) -> DataFrame:
    """(class_label, keys): the property names that a class's nodes use, sorted."""
    used = nodes.select("class_label", F.explode(F.map_keys("properties")).alias("k")).where(~F.col("k").isin(*METADATA_KEYS))
    return used.groupBy("class_label").agg(F.array_sort(F.collect_set("k")).alias("keys"))


def signatures(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The different (source class, relation, target class)."""
    return with_ends(edges, nodes).select("source_class", "relation", "target_class").distinct()


def pair_counts(edges: DataFrame) -> DataFrame:
    """(a, b, n, both_ways): edges between unordered pairs, and whether there are some in both directions."""
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    return edges.groupBy(a.alias("a"), b.alias("b")).agg(F.count(F.lit(1)).alias("n"), (F.min(F.col("src") < F.col("dst")) != F.max(F.col("src") < F.col("dst"))).alias("both_ways"))


def pair_offsets(edges: DataFrame, order: str) -> DataFrame:
    """Edges with the side on which to draw them: 0 where a pair has one, else +1 for the first and -1 for others."""
    pair = [F.least("src", "dst"), F.greatest("src", "dst")]
    n = F.count(F.lit(1)).over(Window.partitionBy(*pair))
    place = F.row_number().over(Window.partitionBy(*pair).orderBy(order))
    return edges.withColumn("side", F.when(n == 1, 0).when(place == 1, 1).otherwise(-1))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, change): 'added' and 'removed' ids between two states."""
    added = after.select("id").join(before.select("id"), "id", "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(before.select("id").join(after.select("id"), "id", "left_anti").withColumn("change", F.lit("removed")))


def class_tree(edges: DataFrame, nodes: DataFrame, search: str) -> DataFrame:
    """(class, instances): classes with the labels of their instances, where the class or an instance holds a text."""
    found = with_ends(edges, nodes).groupBy(F.col("target_label").alias("class")).agg(F.array_sort(F.collect_list("source_label")).alias("instances"))
    return found.where(F.contains(F.lower("class"), F.lit(search.lower())) | F.exists("instances", lambda i: F.contains(F.lower(i), F.lit(search.lower()))))


def grid_places(nodes: DataFrame, order: str, total: int) -> DataFrame:
    """Nodes with the column and row of a square grid.  The order is dealt by range; only partition totals meet in one task."""
    width = max(1, -(-(total**0.5) // 1))
    numbered = number_rows(nodes, order)
    return numbered.withColumns({"col": (F.col("index") % int(width)).cast("int"), "row": F.floor(F.col("index") / int(width)).cast("int")})


def number_rows(rows: DataFrame, *order: str | Column) -> DataFrame:
    """Rows with ``index``, their place from 0 in a total order.

    The order is dealt by range and sorted in every partition, and the partitions' row counts, one number
    each, give the offsets.  No task sees all rows.
    """
    ordered = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    counts = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("_part", before.alias("_base"))  # one row a partition
    return ordered.withColumn("_part", part).join(F.broadcast(bases), "_part").withColumn("index", F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_base")
