"""Many questions at once: a table of plans, answered together by shared scans of the graph.

``planned`` finds, for all questions in one pass, the names that each mentions, and so its template.  ``answered`` takes the different plans, whatever the
number of questions that have each, finds the nodes that all their names mean with one automaton pass, and joins plans with nodes and edges by what they
name; template and names are columns.  Of each plan the first ``limit`` rows are kept, in each task before anything is shuffled, and given to
its questions.

Templates, and the cells of their rows: attribute (id, label, value), relations and keyword and exists (edge, subject, predicate, object), either_way (entity, relation,
other), with_attribute (id, label, value), entity_keyword (label, relation, neighbour; or label, key, value), all (id, label, class_label).

Defined results: rows go by all their cells, null first; a question without text has the plan ``all``; a plan that misses what its template needs has no rows; a
repeated question is answered once; empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import PRODUCT_CODE
from tessera.operators import containment
from tessera.operators.graph import undirected
from tessera.operators.retrieval import FACTS, going_by
from tessera.storage import written

TEMPLATES = ("attribute", "relations", "either_way", "with_attribute", "keyword", "entity_keyword", "exists", "all")
PLAN = ["template", "entity", "name", "relation", "keyword"]


def planned(questions: DataFrame, entities: DataFrame, attributes: DataFrame, relations: DataFrame) -> DataFrame:
    """(question, template, entity, name, relation, keyword) of questions (question, text); the known names are (name, pos) each.

    The entity is the first product code, else the first quotation, else the first known one that the text holds; attribute and relation are the first
    that it holds.  An entity with an attribute asks for it, one without for its relations (of the relation held, or all); without entity, a
    relation asks for all that have it, an attribute for all that have it, and nothing for everything.
    """
    asked = questions.select("question", "text").dropDuplicates(["question"])
    names = entities.select("name", "pos", F.lit("e").alias("kind")).unionByName(attributes.select("name", "pos", F.lit("a").alias("kind"))).unionByName(relations.select("name", "pos", F.lit("r").alias("kind")))
    held = containment.holders(asked.select(F.col("question").alias("id"), "text"), names.select(F.col("name").alias("term"))).withColumnRenamed("term", "name").join(names, "name")
    first = lambda kind: F.min_by(F.when(F.col("kind") == kind, F.col("name")), F.when(F.col("kind") == kind, F.struct("pos", "name")))
    found = held.groupBy(F.col("id").alias("question")).agg(first("e").alias("_e"), first("a").alias("name"), first("r").alias("relation"))
    rows = asked.join(found, "question", "left")
    code = F.get(F.regexp_extract_all("text", F.lit(f"({PRODUCT_CODE})"), 1), 0)
    quoted = F.get(F.regexp_extract_all("text", F.lit('"([^"]+)"'), 1), 0)
    rows = rows.withColumn("entity", F.coalesce(code, quoted, "_e"))
    has = lambda c: F.col(c).isNotNull()
    template = F.when(has("entity") & has("name"), "attribute").when(has("entity"), "relations").when(has("relation"), "either_way").when(has("name"), "with_attribute").otherwise("all")
    rows = rows.withColumn("template", template)
    needs = lambda c, *templates: F.when(F.col("template").isin(*templates), F.col(c)).alias(c)
    return rows.select("question", "template", needs("entity", "attribute", "relations"), needs("name", "attribute", "with_attribute"), needs("relation", "relations", "either_way"), F.lit(None).cast("string").alias("keyword"))


def _cells(*columns: Column | str) -> Column:
    return F.array(*[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]).alias("cells")


def answered(plans: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = FACTS) -> DataFrame:
    """(question, rank, cells): the first ``limit`` rows of each question's plan.

    plans: question and the columns of ``planned``, further templates included; nodes: id, label, kind, class_label, properties; edges: src, dst, relation.
    """
    mine = written(plans.select("question", *PLAN).dropDuplicates(["question"]).withColumn("plan", F.to_json(F.struct(*PLAN), {"ignoreNullFields": "false"})), "plans")
    once = written(mine.select("plan", *PLAN).distinct(), "different-plans")
    of = lambda *templates: once.where(F.col("template").isin(*templates))
    meant = written(going_by(nodes, of("attribute", "relations", "entity_keyword").select(F.col("entity").alias("name"))).withColumnRenamed("name", "entity"), "meant")
    label = nodes.select("id", "label")
    ends = lambda rows: rows.join(label.select(F.col("id").alias("src"), F.col("label").alias("subject")), "src").join(label.select(F.col("id").alias("dst"), F.col("label").alias("object")), "dst")
    fact = _cells(F.lit("edge"), "subject", "relation", "object")

    valued = of("attribute").join(meant, "entity").join(nodes.select("id", "label", "properties"), "id").select("plan", _cells("id", "label", F.try_element_at("properties", F.col("name"))))
    out = of("relations").join(meant, "entity").select("plan", F.col("relation").alias("_only"), F.col("id").alias("src")).join(edges.select("src", "dst", "relation"), "src")
    related = ends(out.where(F.col("_only").isNull() | (F.col("_only") == F.col("relation")))).select("plan", fact)
    both = ends(undirected(edges.select("src", "dst", "relation").join(of("either_way").select("relation").distinct(), "relation", "left_semi")))
    either = of("either_way").select("plan", "relation").join(both, "relation").select("plan", _cells("subject", "relation", "object"))
    props = nodes.select("id", "label", F.explode("properties").alias("name", "value"))
    having = of("with_attribute").select("plan", "name").join(props.where("value is not null"), "name").select("plan", _cells("id", "label", "value"))
    single = nodes.where("kind = 'NamedIndividual'").select("id")
    there = edges.select("src", "dst", "relation").join(of("exists").select("relation").distinct(), "relation", "left_semi")
    there = there.join(single.withColumnRenamed("id", "src"), "src", "left_semi").join(single.withColumnRenamed("id", "dst"), "dst", "left_semi")
    exists = of("exists").select("plan", "relation").join(ends(there), "relation").select("plan", fact)

    words = of("keyword", "entity_keyword").select(F.col("keyword").alias("term"))
    labelled = written(containment.holders(nodes.select("id", F.col("label").alias("text")), words).withColumnRenamed("term", "keyword"), "labelled")
    named = containment.holders(edges.select("relation").distinct().select(F.col("relation").alias("id"), F.col("relation").alias("text")), words).select(F.col("id").alias("relation"), F.col("term").alias("keyword"))
    flat = edges.select("src", "dst", "relation")
    touched = flat.join(labelled.withColumnRenamed("id", "src"), "src").unionByName(flat.join(labelled.withColumnRenamed("id", "dst"), "dst")).unionByName(flat.join(named, "relation"))
    # an edge that holds the keyword twice is one, but repeated edges stay: the sum over repeats is divided by how often each was found
    touched = touched.groupBy("src", "dst", "relation", "keyword").agg(F.lit(1)).select("src", "dst", "relation", "keyword").join(flat, ["src", "dst", "relation"])
    anywhere = of("keyword").select("plan", "keyword").join(ends(touched), "keyword").select("plan", fact)

    starts = of("entity_keyword").select("plan", "entity", "keyword").join(meant, "entity").join(label, "id").select("plan", "keyword", "id", "label")
    near = undirected(flat).select(F.col("src").alias("id"), "relation", F.col("dst").alias("other"))
    beside = starts.join(near, "id").join(labelled.withColumnRenamed("id", "other"), ["other", "keyword"]).join(label.select(F.col("id").alias("other"), F.col("label").alias("neighbour")), "other")
    key = F.struct("id", "name", "value")
    inside = containment.holders(props.select(key.alias("id"), F.explode(F.array("name", "value")).alias("text")), words).select("id.*", F.col("term").alias("keyword"))
    about = beside.select("plan", _cells("label", "relation", "neighbour")).unionByName(starts.join(inside, ["id", "keyword"]).select("plan", _cells("label", "name", "value")))
    everything = F.broadcast(nodes.select(_cells("id", "label", "class_label")).orderBy("cells").limit(limit))  # ``limit`` rows
    whole = of("all").select("plan").join(everything, F.lit(True))

    hits = valued
    for more in (related, either, having, anywhere, about, exists, whole):
        hits = hits.unionByName(more)
    first = hits.withColumn("rank", F.row_number().over(Window.partitionBy("plan").orderBy("cells"))).where(F.col("rank") <= limit)
    return mine.select("question", "plan").join(first, "plan").select("question", "rank", "cells")
