"""Extracted instances and actions put into a graph, graphs turned back into schemas, and the shapes in which both are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.ids import action_instance_id
from tessera.operators import extraction, graph
from tessera.operators.rdf import BASE, OWL, RDF, RDFS
from tessera.storage import TASK_ROWS, written

#: Relations and labels that aren't relations of a schema.
TYPE_RELATIONS, SUBCLASS = ("rdf:type", "type", "subClassOf", "subclass_of"), ("subClassOf", "subclass_of")
#: What an action says of itself.
ACTION_KEYS = ("动作类型", "目标实例", "目标类型")
#: Hidden properties that a stored node keeps, and the names they get.
PROVENANCE = {"_source_file": "source_file", "_source_chunk_index": "source_chunk_index", "_source_quote": "source_quote", "_chunk_text": "chunk_text", "_domain": "domain"}
#: Labels of nodes and edges that have none.
NO_LABEL, NO_EDGE_LABEL, NO_RELATION = "未知实体", "关联", "related_to"

PROPERTY = "struct<name:string,label:string,description:string,data_type:string>"
OBJECT_TYPES = f"array<struct<id:string,name:string,label:string,description:string,primary_key:string,sub_class_of:string,properties:array<{PROPERTY}>>>"
LINK_TYPES = "array<struct<id:string,name:string,label:string,description:string,source_object_type:string,target_object_type:string,cardinality:string>>"
ACTION_TYPES = f"array<struct<id:string,name:string,label:string,description:string,target_object_type:string,parameters:array<{PROPERTY}>>>"
NEW_FORM = f"struct<object_types:{OBJECT_TYPES},link_types:{LINK_TYPES},action_types:{ACTION_TYPES}>"
OLD_FORM = (
    f"struct<classes:array<struct<id:string,name:string,label:string,description:string,primary_key:string,sub_class_of:string,parent_classes:string,data_properties:array<string>,property_definitions:array<{PROPERTY}>>>,"
    "object_properties:array<struct<id:string,name:string,label:string,description:string,domain:string,range:string,source_object_type:string,target_object_type:string,cardinality:string>>>"
)
INSTANCE = "struct<label:string,type:string,data_props:map<string,string>,object_props:map<string,array<string>>>"


def either_form(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Schema payloads of the new or the old form with object_types, link_types and action_types, all of the new.

    A payload with object_types is of the new form.  An old class's properties may be names or objects, and its definitions
    count where it has none; the first parent class is what it is a subclass of.  Missing texts are empty, missing
    data types 'string'.  A payload that can't be read has null in all three.
    """
    new, old = F.from_json(payload, NEW_FORM), F.from_json(payload, OLD_FORM)
    text = lambda c: F.coalesce(c, F.lit(""))
    filled = lambda *cs: F.coalesce(*[F.when(c != "", c) for c in cs], F.lit(""))

    def prop(p: Column) -> Column:
        return F.struct(text(p["name"]).alias("name"), filled(p["label"], p["name"]).alias("label"), text(p["description"]).alias("description"), F.coalesce(p["data_type"], F.lit("string")).alias("data_type"))

    def stated(p: Column) -> Column:
        named = F.struct(p.alias("name"), p.alias("label"), F.lit("").alias("description"), F.lit("string").alias("data_type"))
        return F.when(p.startswith("{"), prop(F.from_json(p, PROPERTY))).otherwise(named)

    def object_type(c: Column) -> Column:
        own, defined = F.transform(c["data_properties"], stated), F.transform(c["property_definitions"], prop)
        parent = F.coalesce(F.get(F.from_json(c["parent_classes"], "array<string>"), 0), F.when(~c["parent_classes"].startswith("["), c["parent_classes"]))
        return F.struct(
            text(c["id"]).alias("id"), filled(c["name"], c["id"]).alias("name"), text(c["label"]).alias("label"), F.coalesce(c["description"], c["label"], F.lit("")).alias("description"),
            F.when(c["primary_key"] != "", c["primary_key"]).alias("primary_key"), F.coalesce(F.when(parent != "", parent), F.when(c["sub_class_of"] != "", c["sub_class_of"])).alias("sub_class_of"),
            F.when(F.size(own) > 0, own).otherwise(F.coalesce(defined, F.array().cast(f"array<{PROPERTY}>"))).alias("properties"),
        )

    def link_type(p: Column) -> Column:
        return F.struct(
            text(p["id"]).alias("id"), filled(p["name"], p["id"]).alias("name"), text(p["label"]).alias("label"), text(p["description"]).alias("description"),
            F.coalesce(p["domain"], p["source_object_type"], F.lit("")).alias("source_object_type"), F.coalesce(p["range"], p["target_object_type"], F.lit("")).alias("target_object_type"),
            F.when(p["cardinality"] != "", p["cardinality"]).alias("cardinality"),
        )

    is_new, read = new["object_types"].isNotNull(), F.get_json_object(payload, "$").isNotNull()
    empty = lambda form: F.when(read, F.array().cast(form))
    return rows.withColumns({
        "object_types": F.when(is_new, new["object_types"]).otherwise(F.coalesce(F.transform(old["classes"], object_type), empty(OBJECT_TYPES))),
        "link_types": F.coalesce(F.when(is_new, new["link_types"]).otherwise(F.transform(old["object_properties"], link_type)), empty(LINK_TYPES)),
        "action_types": F.coalesce(new["action_types"], empty(ACTION_TYPES)),
    })


def payload_instances(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Payloads with ``instances``: those of an object's field, or the payload itself where it is a list; null where it can't be read."""
    listed = F.from_json(payload, f"array<{INSTANCE}>")
    return rows.withColumn("instances", F.when(F.ltrim(payload).startswith("["), listed).otherwise(F.from_json(payload, f"struct<instances:array<{INSTANCE}>>")["instances"]))


def stored_properties(properties: Column, domain: Column | None = None) -> Column:
    """A node's properties as they are stored: hidden ones go, those that tell where it comes from get plain names.

    A given domain comes before the node's own; a visible property comes before a renamed one; empty hidden values don't count.
    """
    shown = F.map_filter(properties, lambda k, v: ~k.startswith("_"))
    kept = [F.struct(F.lit(name).alias("key"), F.try_element_at(properties, F.lit(hidden)).alias("value")) for hidden, name in PROVENANCE.items()]
    if domain is not None:
        kept[-1] = F.struct(F.lit("domain").alias("key"), F.coalesce(F.when(domain != "", domain), F.try_element_at(properties, F.lit("_domain"))).alias("value"))
    named = F.filter(F.array(*kept), lambda e: e["value"].isNotNull() & (e["value"] != "") & ~F.map_contains_key(shown, e["key"]))
    return F.map_concat(F.map_from_entries(named), shown)


def labelled_keys(properties: Column, definitions: Column) -> Column:
    """Properties under the labels that definitions (name, label) give their names; of two that get one key the later stays.

    Definitions may be null; of two for a name the last counts.
    """
    named = F.filter(definitions, lambda d: (d["name"] != "") & (d["label"] != ""))

    def renamed(e: Column) -> Column:
        label = F.get(F.reverse(F.filter(named, lambda d: d["name"] == e["key"])), 0)["label"]
        return F.struct(F.coalesce(label, e["key"]).alias("key"), e["value"].alias("value"))

    entries = F.transform(F.map_entries(properties), renamed)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def readable_relation(id_: Column) -> Column:
    """What a relation's id calls it: what follows its last '_object_property_', or its last part if that has Chinese characters, else the id."""
    mark = "_object_property_"
    after, last = F.substring_index(id_, mark, -1), F.substring_index(id_, "_", -1)
    return F.when(F.contains(id_, F.lit(mark)) & (after != ""), after).when(F.contains(id_, F.lit("_")) & last.rlike(r"[一-鿿]"), last).otherwise(id_)


def relation_labels(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(prop_id, label): each relation id with the last label that an edge gives it, as prop_id or as its own id, else read from the id.

    ids: prop_id; edges: id, prop_id, label, pos.
    """
    stated = edges.where("label <> ''").select("pos", "label", F.explode(F.array("prop_id", "id")).alias("prop_id")).where("prop_id <> ''")
    known = stated.groupBy("prop_id").agg(F.max_by("label", F.struct("pos", "label")).alias("label"))
    return ids.select("prop_id").distinct().join(known, "prop_id", "left").select("prop_id", F.coalesce("label", readable_relation(F.col("prop_id"))).alias("label"))


def graph_schema(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The schema that a graph states: classes, their properties, relations and actions, each as the function of its name gives it.

    nodes: id, raw_id, label, kind, properties (map), pos; edges: src, dst, relation, label, prop_id, pos.
    Null relations and labels count as empty, a null raw_id as none.
    """
    return schema_classes(nodes, edges), schema_properties(nodes, edges), schema_relations(nodes, edges), schema_actions(nodes, edges)


def _classes(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes, and of these the plain ones and the actions."""
    classes = nodes.where("kind = 'Class'").select("id", F.coalesce("raw_id", F.lit("")).alias("raw_id"), F.coalesce("label", "id").alias("label"), "properties", "pos")
    is_action = F.col("raw_id").startswith("AT_") | F.col("id").startswith("AT_")
    return classes, classes.where(~is_action), classes.where(is_action)


def _links(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"relation": F.coalesce("relation", F.lit("")), "label": F.coalesce("label", F.lit("")), "prop_id": F.coalesce("prop_id", F.lit(""))})


def _parents(edges: DataFrame) -> DataFrame:
    up = (F.col("relation") == "subclass_of") | F.col("label").isin(*SUBCLASS)
    return _links(edges).where(up).select(F.col("src").alias("child"), F.col("dst").alias("parent"), "pos")


def _names(classes: DataFrame) -> DataFrame:
    """(k, name): a label for each id and raw id."""
    return classes.select(F.col("id").alias("k"), "label").unionAll(classes.where("raw_id <> ''").select("raw_id", "label")).groupBy("k").agg(F.max("label").alias("name"))


def schema_classes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label, parents in the edges' order) of a graph's classes."""
    listed = _parents(edges).groupBy(F.col("child").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "parent"))), lambda s: s["parent"]).alias("parents"))
    return _classes(nodes)[1].join(listed, "id", "left").select("id", "label", F.coalesce("parents", F.array().cast("array<string>")).alias("parents"))


def schema_properties(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(class, property, source 'direct' or 'inherited', from: a direct parent's label or null) of a graph's classes."""
    plain, pairs = _classes(nodes)[1], _parents(edges)
    inside = pairs.join(plain.select(F.col("id").alias("child")), "child", "left_semi").join(plain.select(F.col("id").alias("parent")), "parent", "left_semi")
    own = plain.select(F.col("id").alias("class"), F.explode(F.map_keys("properties")).alias("property")).distinct()
    above = graph.closure(inside.select("child", "parent")).where("depth > 0").select(F.col("child").alias("class"), F.col("ancestor").alias("up"))
    inherited = above.join(own.withColumnRenamed("class", "up"), "up").select("class", "property").distinct().join(own, ["class", "property"], "left_anti")
    labels = plain.select(F.col("id").alias("parent"), F.col("label").alias("_from"))
    giving = inside.join(own.withColumnRenamed("class", "parent"), "parent").join(labels, "parent").groupBy(F.col("child").alias("class"), "property").agg(F.min_by("_from", F.struct("pos", "parent")).alias("from"))
    return own.select("class", "property", F.lit("direct").alias("source"), F.lit(None).cast("string").alias("from")).unionByName(
        inherited.join(giving, ["class", "property"], "left").select("class", "property", F.lit("inherited").alias("source"), "from")
    )


def schema_relations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label, domain, range) of a graph's relations; ends by label, else by id.

    Edges are dealt by their ends; those with an end that a task's rows have are spread.
    """
    links = _links(edges)
    key = F.when(F.rtrim(F.col("prop_id"), F.lit("_")) != "", F.col("prop_id")).when(F.col("label") != "", F.col("label")).otherwise(F.col("relation"))
    related = links.where((F.col("relation") != "") & ~F.col("relation").isin("action", *TYPE_RELATIONS) & ~F.col("label").isin(*SUBCLASS))
    related = written(related.select(key.alias("id"), "label", "src", "dst"), "related")
    names = _names(_classes(nodes)[0]).select(F.col("k").alias("ref"), F.col("name").alias("type_id"))
    n = related.count()
    seen = related.sample(min(1.0, extraction.SAMPLED / TASK_ROWS), 1).select(F.explode(F.array("src", "dst")).alias("ref")).where("ref is not null").groupBy("ref").count()
    often = written(seen.where(F.col("count") > extraction.SAMPLED // 2).select("ref").join(names, "ref", "left"), "often")
    for end, name in (("src", "domain"), ("dst", "range")):
        related = extraction.resolved(related.withColumn(f"_{end}", F.col(end)), end, name, names, often, n, True).withColumn(name, F.coalesce(name, f"_{end}")).drop(f"_{end}")
    return related.select("id", "label", "domain", "range")


def schema_actions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label, target) of a graph's actions, by the first action edge of each; the target by label, else by id."""
    classes, _, acting = _classes(nodes)
    first = _links(edges).where("relation = 'action'").groupBy(F.col("src").alias("id")).agg(F.min_by("dst", F.struct("pos", "dst")).alias("dst"))
    ends = _names(classes).select(F.col("k").alias("dst"), F.col("name").alias("_d"))
    return acting.select("id", "label").join(first, "id", "left").join(ends, "dst", "left").select("id", "label", F.coalesce("_d", "dst", F.lit("")).alias("target"))


def instances_in_graph(instances: DataFrame, actions: DataFrame, classes: DataFrame, existing: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What extracted instances and actions add to a graph: nodes (id, label, class_label, properties) and edges (src, dst, label, relation).

    instances: id, label, type, data_props, object_props, pos; actions: label, action_type, target, target_type, parameters, pos;
    classes: id, raw_id, label, definitions (name, label), pos; existing: id of all nodes; labels: prop_id, label.

    Of rows with one id the first makes the node, and none does where the node exists.  Empty values go, keys take the labels of their
    definitions.  An instance that has a class's label and nothing of its own is dropped.  Every instance has a type edge to its class, if
    that exists, and one to each target that is an instance by id, else by label (the last one of that label).  An action's class is the one named by id,
    raw id, label or a definition, else the first that contains the name or is contained in it.
    """
    full = lambda m: F.coalesce(F.map_filter(m, lambda k, v: v.isNotNull() & (v != "")), F.create_map().cast("map<string,string>"))
    by_key = classes.select("id", "pos", F.explode(F.array("id", "raw_id")).alias("type")).where("type <> ''").groupBy("type").agg(F.min_by("id", F.struct("pos", "id")).alias("class_id"))
    about = classes.select(F.col("id").alias("class_id"), F.col("label").alias("class_label"), "definitions")
    placed = instances.join(by_key, "type", "left").join(about, "class_id", "left").withColumn("properties", full(F.col("data_props")))
    names = classes.select("label").distinct().withColumn("_named", F.lit(True))
    old = existing.select("id").distinct().withColumn("_old", F.lit(True))
    own = F.map_filter("properties", lambda k, v: ~k.isin(*ACTION_KEYS))
    bare = F.col("_named").isNotNull() & F.col("_old").isNull() & (F.size(own) == 0) & (F.coalesce(F.size("object_props"), F.lit(0)) <= 0)
    kept = placed.join(names, "label", "left").join(old, "id", "left").where(~bare)
    kept = written(kept.select("id", "label", "pos", "class_id", "class_label", "definitions", "properties", "object_props", "_old"), "kept")  # read by five branches
    keyed = F.when(F.col("definitions").isNull(), F.col("properties")).otherwise(labelled_keys(F.col("properties"), F.col("definitions")))
    fresh = graph.first_by(kept.where("_old is null").select("id", "pos", "label", F.coalesce("class_label", F.lit("")).alias("class_label"), keyed.alias("properties")), ["id"], ["pos"])
    nodes = fresh.select("id", "label", "class_label", "properties")

    types = kept.where("class_id is not null").select(F.col("id").alias("src"), F.col("class_id").alias("dst")).distinct().join(old.select(F.col("id").alias("dst")), "dst", "left_semi")
    types = types.select("src", "dst", F.lit("type").alias("label"), F.lit("type").alias("relation"))
    ids = kept.select("id").distinct()
    last = kept.groupBy(F.col("label").alias("target")).agg(F.max_by("id", F.struct("pos", "id")).alias("_by_label"))
    mine = ids.select(F.col("id").alias("target"), F.lit(True).alias("_is_id"))

    def with_target(rows: DataFrame) -> DataFrame:
        found = rows.join(mine, "target", "left").join(last, "target", "left")
        return found.withColumn("dst", F.when(F.col("_is_id"), F.col("target")).otherwise(F.col("_by_label"))).where("dst is not null")

    stated = kept.select(F.col("id").alias("src"), F.explode("object_props").alias("prop_id", "targets")).select("src", "prop_id", F.explode("targets").alias("target"))
    label = F.coalesce("label", readable_relation(F.col("prop_id")))
    related = with_target(stated).join(labels.select("prop_id", "label"), "prop_id", "left").select("src", "dst", label.alias("label"), F.lit("object_property").alias("relation")).distinct()

    acting = classes.where(F.col("raw_id").startswith("AT_") | F.col("id").startswith("AT_"))
    defined = F.transform(F.coalesce("definitions", F.array().cast("array<struct<name:string,label:string>>")), lambda d: d["name"])
    keys = acting.select("pos", F.col("id").alias("_action"), F.col("label").alias("_label"), F.explode(F.concat(F.array("id", "raw_id", "label"), defined)).alias("name")).where("name <> ''")
    chosen = extraction.action_types(actions.select(F.col("action_type").alias("action")).where("action <> ''"), keys.select("name", "pos"))
    meant = chosen.join(keys.groupBy(F.col("name").alias("type_name")).agg(F.min_by(F.struct("_action", "_label"), F.struct("pos", "_action")).alias("a")), "type_name").select(F.col("action").alias("action_type"), "a.*")
    goal = by_key.join(about.select("class_id", F.col("class_label").alias("_goal")), "class_id").select(F.col("type").alias("target_type"), "_goal")
    done = actions.withColumn("id", action_instance_id(F.col("label"))).join(old, "id", "left_anti")
    done = graph.first_by(done.select("id", "pos", "label", "action_type", "target", "target_type", "parameters"), ["id"], ["pos"])
    done = done.join(meant, "action_type", "left").join(goal, "target_type", "left")
    text = lambda c: F.coalesce(c, F.lit(""))
    extra = F.map_filter(full(F.col("parameters")), lambda k, v: (k != "") & ~k.isin(*ACTION_KEYS))
    said = [text("action_type"), text("target"), F.coalesce("_goal", "target_type", F.lit(""))]
    replaced = [F.coalesce(F.try_element_at(full(F.col("parameters")), F.lit(k)), s) for k, s in zip(ACTION_KEYS, said, strict=True)]
    props = F.map_concat(F.create_map(*[x for k, v in zip(ACTION_KEYS, replaced, strict=True) for x in (F.lit(k), v)]), extra)
    nodes = nodes.unionByName(done.select("id", "label", F.coalesce("_label", "action_type", F.lit("")).alias("class_label"), props.alias("properties")))
    action_types = done.where("_action is not null").select(F.col("id").alias("src"), F.col("_action").alias("dst"), F.lit("type").alias("label"), F.lit("type").alias("relation"))
    action_types = action_types.join(old.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "label", "relation")
    aims = with_target(done.select(F.col("id").alias("src"), "action_type", "target")).select("src", "dst", F.col("action_type").alias("label"), F.lit("action").alias("relation"))
    return nodes, types.unionByName(related).unionByName(action_types).unionByName(aims)


def plain_triples(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A graph as triples under its own names, nothing hashed: every label and value is Chinese text, properties and relations are declared.

    nodes: id, label, kind, properties; edges: src, dst, relation, label.  Null labels and relations get the fixed names; null values become empty.
    Edges without both ends are dropped.  Characters that no IRI takes are percent-encoded.
    """
    none = F.lit(None).cast("string")
    iri = lambda c: F.concat(F.lit(BASE), F.regexp_replace(F.url_encode(c), r"\+", "%20"))
    named = lambda p, o: F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit("iri").alias("o_kind"), none.alias("lang"))
    text = lambda p, o: F.struct(p.alias("p"), o.alias("o"), F.lit("literal").alias("o_kind"), F.lit("zh").alias("lang"))
    kind = F.when(F.col("kind") == "Class", OWL + "Class").otherwise(OWL + "NamedIndividual")
    about = nodes.where("id is not null").select(iri(F.col("id")).alias("s"), F.inline(F.array(named(RDF + "type", kind), text(F.lit(RDFS + "label"), F.coalesce("label", F.lit(NO_LABEL))))))
    values = nodes.where("id is not null").select("id", F.explode("properties").alias("k", "v"))
    stated = values.select(iri(F.col("id")).alias("s"), F.inline(F.array(text(iri(F.col("k")), F.coalesce("v", F.lit(""))))))
    declared = lambda rows, name, label, what: rows.select(iri(name).alias("s"), F.inline(F.array(named(RDF + "type", F.lit(OWL + what)), text(F.lit(RDFS + "label"), label))))
    relation, label = F.coalesce("relation", F.lit(NO_RELATION)), F.coalesce("label", F.lit(NO_EDGE_LABEL))
    both = edges.where("src <> '' and dst <> ''").select("src", "dst", relation.alias("relation"), label.alias("label"))
    links = both.select(iri(F.col("src")).alias("s"), iri(F.col("relation")).alias("p"), iri(F.col("dst")).alias("o"), F.lit("iri").alias("o_kind"), none.alias("lang"))
    keys, relations = values.select("k").distinct(), both.select("relation", "label").distinct()
    parts = [about, stated, declared(keys, F.col("k"), F.col("k"), "DatatypeProperty"), declared(relations, F.col("relation"), F.col("label"), "ObjectProperty"), links]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.distinct().withColumn("datatype", none)


def download(made: DataFrame, stored: DataFrame) -> DataFrame:
    """(project, content, stored): a project's document made anew, or the stored one where that gave none or an empty one."""
    both = made.select("project", F.col("content").alias("_new")).join(stored.select("project", F.col("content").alias("_old")), "project", "full")
    new = F.when(F.col("_new") != "", F.col("_new"))
    return both.select("project", F.coalesce(new, "_old").alias("content"), new.isNull().alias("stored")).where("content is not null")
