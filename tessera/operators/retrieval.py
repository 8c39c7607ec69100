"""Answering from the graph and from vectors: templates, facts, references and their fusion."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import PRODUCT_CODE
from tessera.operators import containment
from tessera.operators.graph import undirected, with_ends
from tessera.storage import written

#: How many facts, references of a kind and characters a context takes.
FACTS, REFERENCES, QUOTE, SAME_QUOTE = 20, 5, 300, 50
#: Shares to which the nodes that go by a name are dealt.
SHARES = 64


def named(nodes: DataFrame, text: str) -> Column:
    """Whether a node goes by a text: its id, label or a property."""
    props = F.exists(F.map_values("properties"), lambda v: F.contains(v, F.lit(text)))
    return (F.col("id") == text) | F.contains("label", F.lit(text)) | F.coalesce(props, F.lit(False))


def node_facts(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.lit("node").alias("type"), F.col("label").alias("subject"), F.col("class_label").alias("predicate"), F.lit(None).cast("string").alias("object"), "properties")


def edge_facts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    found = with_ends(edges, nodes)
    return found.select(F.lit("edge").alias("type"), F.col("source_label").alias("subject"), F.col("relation").alias("predicate"), F.col("target_label").alias("object"))


def attribute(nodes: DataFrame, entity: str, name: str) -> DataFrame:
    """(id, label, value): a property of the nodes that go by a name."""
    return nodes.where(named(nodes, entity)).select("id", "label", F.try_element_at("properties", F.lit(name)).alias("value"))


def going_by(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(name, id): the nodes that go by each name, whatever the number of either: by id, or by a label or property that holds it; names: name.

    Null and empty names go by nothing; a pair comes once.
    """
    wanted = names.select("name").where("name <> ''").distinct()
    said = nodes.select("id", F.explode(F.concat(F.array("label"), F.coalesce(F.map_values("properties"), F.array().cast("array<string>")))).alias("text"))
    held = containment.holders(said, wanted.select(F.col("name").alias("term"))).select(F.col("term").alias("name"), "id")
    return held.unionByName(nodes.select("id").join(wanted, F.col("id") == F.col("name")).select("name", "id")).distinct()


def attributes(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(question, id, label, value): the property asked for of all nodes that go by the name asked for; asked: question, entity, attribute.

    Where many ask for what many nodes go by, the result is quadratic.  Values are looked up once for a name and attribute, and the nodes of either
    dealt to ``SHARES`` shares, each of which gets the questions, so that what grows as the product is made in many tasks and never shuffled.
    """
    wanted = asked.select("question", F.col("entity").alias("name"), "attribute")
    by = going_by(nodes, wanted.select("name")).join(nodes.select("id", "label", "properties"), "id")
    said = by.join(wanted.select("name", "attribute").distinct(), "name").select("name", "attribute", "id", "label", F.try_element_at("properties", F.col("attribute")).alias("value"))
    key = F.struct("name", "attribute", "_share").alias("_key")  # null attributes are equal in it
    told = written(said.withColumn("_share", F.pmod(F.xxhash64("id"), F.lit(SHARES)).cast("int")).select(key, "id", "label", "value"), "told")
    parts = told.select("_key", F.col("_key.name").alias("_name"), F.col("_key.attribute").alias("_attribute")).distinct()
    questions = wanted.join(parts, (F.col("name") == F.col("_name")) & F.col("attribute").eqNullSafe(F.col("_attribute"))).select("question", "_key")
    # so many tasks as Spark has for shuffles, though what they read is little
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = questions.repartition(tasks, "_key").hint("merge").join(told, "_key")
    return found.select("question", "id", "label", "value")


def with_attribute(nodes: DataFrame, name: str) -> DataFrame:
    """(id, label, value): all nodes that have a property."""
    return nodes.select("id", "label", F.try_element_at("properties", F.lit(name)).alias("value")).where("value is not null")


def relations(edges: DataFrame, nodes: DataFrame, entity: str, types: tuple[str, ...] = ()) -> DataFrame:
    """Facts about the edges, of some types or all, that leave the nodes going by a name."""
    start = nodes.where(named(nodes, entity)).select(F.col("id").alias("src"))
    out = edges if not types else edges.where(F.col("relation").isin(*types))
    return edge_facts(out.join(start, "src", "left_semi"), nodes)


def related_either_way(edges: DataFrame, nodes: DataFrame, relation: str) -> DataFrame:
    """(entity, relation, other): every entity with a relation, in both directions."""
    found = with_ends(undirected(edges.where(F.col("relation") == relation)), nodes)
    return found.select(F.col("source_label").alias("entity"), "relation", F.col("target_label").alias("other"))


def keyword_facts(edges: DataFrame, nodes: DataFrame, keyword: str) -> DataFrame:
    """Edges of which either end's label, or the relation, holds a keyword."""
    hit = lambda c: F.contains(c, F.lit(keyword))
    return edge_facts(edges, nodes).where(hit("subject") | hit("object") | hit("predicate"))


def top(rows: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows of a total order."""
    return rows.orderBy(*order).limit(n)


def intent(question: str, entities: list[str], attributes: list[str], relation_names: list[str]) -> dict[str, object]:
    """Which template answers a question, from the names it mentions; one question, on the driver."""
    codes = re.findall(PRODUCT_CODE, question)
    about = codes + re.findall('"([^"]+)"', question) + [e for e in entities if e in question]
    asked = [a for a in attributes if a in question]
    linked = [r for r in relation_names if r in question]
    subject = about[0] if about else None
    if subject and asked:
        return {"template": "attribute", "entity": subject, "name": asked[0]}
    if subject:
        return {"template": "relations", "entity": subject, "types": tuple(linked)}
    if linked:
        return {"template": "either_way", "relation": linked[0]}
    if asked:
        return {"template": "with_attribute", "name": asked[0]}
    return {"template": "all"}


def answer_facts(plan: dict[str, object], nodes: DataFrame, edges: DataFrame, limit: int = FACTS) -> DataFrame:
    """The rows that a plan of ``intent`` asks for, the first ``limit`` of them in the order of all their columns."""
    kind = plan["template"]
    if kind == "attribute":
        found = attribute(nodes, plan["entity"], plan["name"])
    elif kind == "relations":
        found = relations(edges, nodes, plan["entity"], plan["types"])
    elif kind == "either_way":
        found = related_either_way(edges, nodes, plan["relation"])
    elif kind == "with_attribute":
        found = with_attribute(nodes, plan["name"])
    else:
        found = nodes.select("id", "label", "class_label")
    return top(found, limit, *found.columns)


def fused_references(graph: DataFrame, vector: DataFrame, per_path: int = REFERENCES) -> DataFrame:
    """(question, ref, path, quote): references of both paths, numbered from 1 for each question.

    graph and vector: question, pos, quote.  Quotes that begin alike are one reference, of the graph if both have it; then
    each path keeps its first few.
    """
    both = graph.select("question", F.lit(0).alias("path"), "pos", "quote").unionByName(vector.select("question", F.lit(1).alias("path"), "pos", "quote"))
    once = both.groupBy("question", F.substring("quote", 1, SAME_QUOTE).alias("head")).agg(F.min(F.struct("path", "pos", "quote")).alias("r")).select("question", "r.*")
    place = F.row_number().over(Window.partitionBy("question", "path").orderBy("pos", "quote"))
    kept = once.withColumn("n", place).where(F.col("n") <= per_path)
    number = F.row_number().over(Window.partitionBy("question").orderBy("path", "pos", "quote"))
    return kept.select("question", number.cast("long").alias("ref"), F.when(F.col("path") == 0, "graph").otherwise("vector").alias("path"), F.substring("quote", 1, QUOTE).alias("quote"))


def context(facts: DataFrame, hits: DataFrame) -> DataFrame:
    """(question, context): the lines of facts and passages of each question, under headings.

    facts: question, pos, subject, predicate, object (null for a node); hits: question, pos, text.
    """
    line = F.when(F.col("object").isNull(), F.concat_ws(": ", "subject", "predicate")).otherwise(F.concat_ws(" ", "subject", "predicate", "object"))
    limited = lambda rows, n: rows.withColumn("_n", F.row_number().over(Window.partitionBy("question").orderBy("pos"))).where(F.col("_n") <= n)
    body = lambda rows, column, n, title: limited(rows, n).groupBy("question").agg(F.concat(F.lit(title), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", column))), lambda s: F.concat(F.lit("\n- "), s[column])), "")).alias(title))
    a = body(facts.withColumn("line", line), "line", FACTS, "Facts")
    b = body(hits.withColumn("line", F.substring("text", 1, QUOTE)), "line", REFERENCES, "Passages")
    return a.join(b, "question", "full").select("question", F.concat_ws("\n", "Facts", "Passages").alias("context"))


def used_references(answers: DataFrame, references: DataFrame) -> DataFrame:
    """References that an answer cites as [n]; a reference cited twice comes twice.  answers: question, answer."""
    cited = answers.select("question", F.explode(F.regexp_extract_all("answer", F.lit(r"\[([0-9]+)\]"), 1)).alias("n"))
    return cited.withColumn("ref", F.expr("try_cast(n as bigint)")).drop("n").join(references, ["question", "ref"])
