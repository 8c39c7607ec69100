"""From extracted payloads to a resolved, merged graph: schemas, instances, links and actions.

The language model is not part of this: payloads come as rows.  Everything whose result depends on order takes
``pos``, the place of a row in the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import name_key, version_stem
from tessera.operators import containment
from tessera.storage import TASK_ROWS, dealt, written

#: So many of the most frequent references are sent to all tasks.
HOT = 1000
#: So many of a task's rows are looked at to find what most rows are versions of.
SAMPLED = 64

NEW_SCHEMA = "struct<object_types:array<struct<name:string,label:string,sub_class_of:string,properties:array<struct<name:string,data_type:string>>>>,link_types:array<struct<name:string,label:string,source_object_type:string,target_object_type:string>>>"
OLD_SCHEMA = "struct<classes:array<struct<id:string,label:string,sub_class_of:string,data_properties:array<struct<name:string,data_type:string>>>>,object_properties:array<struct<id:string,label:string,domain:string,range:string>>>"


def schema_payload(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Payloads of the old and the new form as object_types and link_types of the new."""
    new, old = F.from_json(payload, NEW_SCHEMA), F.from_json(payload, OLD_SCHEMA)
    types = F.transform(old["classes"], lambda c: F.struct(c["id"].alias("name"), c["label"].alias("label"), c["sub_class_of"].alias("sub_class_of"), c["data_properties"].alias("properties")))
    links = F.transform(old["object_properties"], lambda p: F.struct(p["id"].alias("name"), p["label"].alias("label"), p["domain"].alias("source_object_type"), p["range"].alias("target_object_type")))
    return rows.withColumns({"object_types": F.coalesce(new["object_types"], types), "link_types": F.coalesce(new["link_types"], links)})


def resolve_references(references: DataFrame, types: DataFrame) -> DataFrame:
    """(ref, type_id, rank): the type that a reference names.

    In this order: by id, by name, by label, by name in any case, by containment of labels either way; within
    a rank the first type in the schema.  Unresolved references aren't returned.  references: ref; types: id, name, label, pos.
    """
    refs = references.select("ref").where("ref <> ''").distinct()
    exact = F.array(
        F.struct(F.lit(1).alias("rank"), F.col("id").alias("k")), F.struct(F.lit(2).alias("rank"), F.col("name").alias("k")),
        F.struct(F.lit(3).alias("rank"), F.col("label").alias("k")),
    )
    by_key = types.select("id", "pos", F.inline(exact)).withColumnRenamed("k", "ref")
    found = refs.join(by_key, "ref").select("ref", "rank", "pos", "id")
    in_any_case = types.select("id", "pos", F.lower("name").alias("low"))
    found = found.unionByName(refs.withColumn("low", F.lower("ref")).join(in_any_case, "low").select("ref", F.lit(4).alias("rank"), "pos", "id"))
    left = refs.join(found, "ref", "left_anti")
    labelled = types.where("label <> ''").select("id", "pos", "label")
    pairs = containment.either_way(left.select(F.col("ref").alias("a")), labelled.select(F.col("label").alias("b")))
    contained = pairs.select(F.col("a").alias("ref"), F.col("b").alias("label")).join(labelled, "label").select("ref", F.lit(5).alias("rank"), "pos", "id")
    best = found.unionByName(contained).groupBy("ref").agg(F.min(F.struct("rank", "pos", "id")).alias("b"))
    return best.select("ref", F.col("b.id").alias("type_id"), F.col("b.rank").alias("rank"))


def typed_instances(instances: DataFrame, types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Instances with type_id, and those whose type the schema lacks."""
    keys = types.select(F.col("id").alias("type_id"), "pos", F.explode(F.array("id", "name", "label")).alias("type"))
    first = keys.groupBy("type").agg(F.min_by("type_id", "pos").alias("type_id"))
    return instances.join(first, "type"), instances.join(first, "type", "left_anti")


def moved_properties(instances: DataFrame, data_keys: Column) -> DataFrame:
    """Relations that are really data properties go there, their values joined by commas."""
    wrong = F.map_filter("object_props", lambda k, v: F.array_contains(data_keys, k))
    moved = F.transform_values(wrong, lambda k, v: F.array_join(v, ", "))
    kept = F.map_filter("data_props", lambda k, v: ~F.map_contains_key(moved, k))
    return instances.withColumns({"object_props": F.map_filter("object_props", lambda k, v: ~F.array_contains(data_keys, k)), "data_props": F.map_concat(kept, moved)})


def merged_instances(instances: DataFrame) -> DataFrame:
    """One row for each id: relation targets united in order, later data values win, the first source stays.

    A null id is one id like any other; an instance without data or relations has null for that map.
    """
    none = F.lit(None)
    part = lambda kind, k, v, vs: F.struct(F.lit(kind).alias("part"), k.cast("string").alias("k"), v.cast(value).alias("v"), vs.cast(values).alias("vs"))
    value, values = (instances.schema[c].dataType.valueType for c in ("data_props", "object_props"))
    entries = lambda c, make: F.coalesce(F.transform(F.map_entries(c), make), F.array())
    parts = F.concat(F.array(part("h", none, none, none)), entries("data_props", lambda e: part("d", e["key"], e["value"], none)), entries("object_props", lambda e: part("o", e["key"], none, e["value"])))
    rows = instances.select("id", "pos", F.struct("label", "type_id", "source").alias("h"), F.explode(parts).alias("p")).select("id", "pos", "h", "p.*")
    once = rows.groupBy("id", "part", "k").agg(
        F.max_by("v", "pos").alias("v"), F.min_by("h", "pos").alias("h"), F.count(F.lit(1)).alias("n"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == "o", F.struct("pos", "vs")))), lambda s: s["vs"]))).alias("vs"),
    )
    mapped = lambda kind, c: F.array_sort(F.collect_list(F.when(F.col("part") == kind, F.struct(F.col("k"), F.col(c)))))
    head = lambda c: F.max(F.when(F.col("part") == "h", F.col(c)))
    whole = once.groupBy("id").agg(head("h").alias("h"), head("n").alias("n"), mapped("o", "vs").alias("o"), mapped("d", "v").alias("d"))
    filled = lambda c: F.when(F.size(c) > 0, F.map_from_entries(c))
    return whole.select("id", "h.*", "n", filled("o").alias("object_props"), filled("d").alias("data_props"))


def collapsed_versions(instances: DataFrame) -> DataFrame:
    """Instances that differ by a version at the end of their label, as one for each type.

    The one with most properties stays (of equals the first), its values kept and missing ones filled in from the others.
    An instance without a label is a version of none and stays; a null type is a type like any other.
    instances: id, label, type_id, props (map), pos.  Returns stem, type_id, id, label, props, n.

    Rows are dealt once, by what they are versions of; what has more versions than a task's rows is summed up before it is dealt.
    """
    rows = instances.select("id", "label", "type_id", "props", "pos", version_stem(F.col("label")).alias("stem"))
    rows = rows.withColumn("alone", F.when(F.col("stem").isNull(), F.col("pos")))
    keys = ["stem", "type_id", "alone"]
    n = instances.count()
    if n <= TASK_ROWS:
        return _collapsed(rows.repartition(*keys), keys)
    seen = instances.select("label", F.col("type_id").alias("_type")).sample(SAMPLED / TASK_ROWS, 1).select(version_stem(F.col("label")).alias("_stem"), "_type")
    many = written(seen.where("_stem is not null").groupBy("_stem", "_type").count().where(F.col("count") > SAMPLED // 2).drop("count"), "many")
    if many.isEmpty():
        return _collapsed(_by_group(rows, n, keys), keys)
    same = F.col("stem").eqNullSafe(F.col("_stem")) & F.col("type_id").eqNullSafe(F.col("_type"))
    rest, often = (rows.join(F.broadcast(many), same, how) for how in ("left_anti", "left_semi"))
    return _collapsed(_by_group(rest, n, keys), keys).unionByName(_collapsed(often, keys))


def _by_group(rows: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """The ``n`` rows dealt by keys, also where they are few, so that grouping by these keys and others shuffles nothing more."""
    tasks = -(-n // TASK_ROWS)
    return rows.repartition(tasks, *keys) if tasks > rows.sparkSession.sparkContext.defaultParallelism else rows.repartition(*keys)


def _collapsed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each of the groups of ``collapsed_versions``.

    Of rows with the same properties only the first can give values, so those of each set of names are made one before they are taken apart.
    """
    names = F.coalesce(F.array_sort(F.map_keys("props")), F.array().cast(T.ArrayType(rows.schema["props"].dataType.keyType)))
    listed = rows.withColumn("names", names).withColumn("w", F.struct("pos", "id", "label", F.transform("names", lambda k: F.col("props")[k]).alias("values")))
    first = listed.groupBy(*keys, "names").agg(F.min_by("w", F.struct("pos")).alias("w"), F.count(F.lit(1)).alias("n"))
    none = F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast(rows.schema["props"].dataType.valueType).alias("value"))
    entries = F.transform("names", lambda k, i: F.struct(k.alias("key"), F.get(F.col("w.values"), i).alias("value")))
    order = F.struct((-F.size("names")).alias("rich"), F.col("w.pos").alias("pos"))
    parts = first.select(*keys, "n", order.alias("order"), F.struct("w.id", "w.label").alias("h"), F.explode(F.concat(F.array(none), entries)).alias("p"))
    once = parts.groupBy(*keys, F.col("p.key").alias("k")).agg(F.min_by("p.value", "order").alias("v"), F.min_by("h", "order").alias("h"), F.sum("n").alias("n"))
    head = lambda c: F.max(F.when(F.col("k").isNull(), F.col(c)))
    whole = once.groupBy(*keys).agg(head("h").alias("h"), head("n").alias("n"), F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v")))).alias("e"))
    return whole.select("stem", "type_id", "h.*", "n", F.when(F.size("e") > 0, F.map_from_entries("e")).alias("props"))


def merged_types(types: DataFrame) -> DataFrame:
    """One row for each id with the union of its properties, the first definition of each; types: id, label, properties, pos."""
    props = types.select("id", "pos", F.posexplode("properties").alias("at", "p"))
    once = props.groupBy("id", F.col("p.name").alias("name")).agg(F.min(F.struct("pos", "at", "p")).alias("d"))
    listed = once.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("d")), lambda d: d["p"]).alias("properties"))
    heads = types.groupBy("id").agg(F.min_by("label", "pos").alias("label"))
    return heads.join(listed, "id", "left")


def target_ids(links: DataFrame, instances: DataFrame) -> DataFrame:
    """Links with target_id: the first instance whose label is a spelling of the target."""
    first = instances.groupBy(name_key(F.col("label")).alias("k")).agg(F.min_by("id", "pos").alias("target_id"))
    return links.withColumn("k", name_key(F.col("target"))).join(first, "k", "left").drop("k")


def valid_links(links: DataFrame, ancestors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links whose ends fit domain and range, themselves or by an ancestor, and the others.

    links: src_type, domain, dst_type, range.  A null domain or range allows all.
    """
    fit = lambda c, e, mark: ancestors.select(F.col("child").alias(c), F.col("ancestor").alias(e), F.lit(True).alias(mark)).distinct()
    checked = links.join(fit("src_type", "domain", "_d"), ["src_type", "domain"], "left").join(fit("dst_type", "range", "_r"), ["dst_type", "range"], "left")
    ok = (F.col("domain").isNull() | F.col("_d").isNotNull()) & (F.col("range").isNull() | F.col("_r").isNotNull())
    return checked.where(ok).drop("_d", "_r"), checked.where(~ok).drop("_d", "_r")


def discarded(unknown_types: DataFrame, bad_relations: DataFrame) -> DataFrame:
    """One row, ``n``: an instance of an unknown type counts once, a bad relation once for each of its targets."""
    return unknown_types.select(F.lit(1).alias("w")).unionAll(bad_relations.select(F.size("targets"))).agg(F.coalesce(F.sum("w"), F.lit(0)).alias("n"))


def action_types(actions: DataFrame, types: DataFrame) -> DataFrame:
    """(action, type_name): equal names first, then containment either way, the first type of the schema."""
    pairs = containment.either_way(actions.select(F.col("action").alias("a")), types.select(F.col("name").alias("b")))
    found = pairs.select(F.col("a").alias("action"), F.col("b").alias("name")).join(types.select("name", F.col("pos").alias("_p")), "name")
    return found.groupBy("action").agg(F.min_by("name", F.struct(F.col("action") != F.col("name"), "_p")).alias("type_name"))


def without_class_instances(instances: DataFrame, types: DataFrame) -> DataFrame:
    """Instances but for those without properties that merely bear a class's name."""
    names = types.select(F.col("label").alias("label")).distinct().withColumn("_named", F.lit(True))
    return instances.join(names, "label", "left").where(F.col("_named").isNull() | (F.size("props") > 0)).drop("_named")


def schema_graph(types: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A schema as class nodes and relation edges; links with an end that names no type are dropped."""
    nodes = types.select("id", "label", F.lit("Class").alias("kind"), "properties")
    ends = links.select("name", "label", "source_object_type", "target_object_type")
    refs = written(ends.select(F.explode(F.array("source_object_type", "target_object_type")).alias("ref")).groupBy("ref").agg(F.count(F.lit(1)).alias("n")), "refs")
    n = (refs.agg(F.sum("n")).first()[0] or 0) // 2
    found = written(resolve_references(refs, types), "resolved").select("ref", "type_id")
    often = written(refs.orderBy(F.desc("n"), "ref").limit(HOT).select("ref").join(found, "ref", "left"), "often")
    for end, name in (("source_object_type", "src"), ("target_object_type", "dst")):
        ends = resolved(ends, end, name, found, often, n)
    return nodes, dealt(ends.select("src", "dst", F.col("name").alias("relation"), "label"), n, "src", "dst", "relation", "label").distinct()


def resolved(links: DataFrame, end: str, name: str, found: DataFrame, often: DataFrame, n: int, whole: bool = False) -> DataFrame:
    """The ``n`` links with the id of the type at an end as ``name``; those that name none are gone, or with ``whole`` stay with null.

    References that many links have would go to one task each: ``often`` has them with their types, or null, and goes to all tasks, and their links are spread.
    """
    known = F.broadcast(often.select(F.col("ref").alias(end), F.col("type_id").alias("_known"), F.lit(True).alias("_often")))
    told = links.join(known, end, "left") if whole else links.where(F.col(end).isNotNull()).join(known, end, "left").where("_often is null or _known is not null")
    place = F.when(F.col("_often"), 1 + F.pmod(F.xxhash64(*links.columns), F.lit(HOT))).otherwise(0).cast("int")
    rest = found.select(F.col("ref").alias(end), F.lit(0).alias("_place"), F.col("type_id").alias("_id"))
    joined = dealt(told.withColumn("_place", place), n, end, "_place").join(rest, [end, "_place"], "left").withColumn(name, F.coalesce("_known", "_id"))
    return (joined if whole else joined.where(F.col(name).isNotNull())).drop(end, "_place", "_known", "_often", "_id")
