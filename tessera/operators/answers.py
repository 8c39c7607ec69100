"""What a model is given to answer from, and what is told about it: both search paths, contexts, references, counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.retrieval import FACTS, QUOTE, REFERENCES
from tessera.storage import written

#: The properties that a context shows, and the headings of its parts.
SHOWN = ["产品编号", "产品类型", "投资周期", "募集方式", "风险等级", "业绩比较基准"]
FACTS_HEADING, PASSAGES_HEADING, SCHEMA_HEADING, NO_FILE = "【图谱事实】", "【相关文档】", "【当前图谱结构字典】", "未知文件"


def both_paths(graph: Callable[[], DataFrame], vector: Callable[[], DataFrame], empty_graph: DataFrame, empty_vector: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """What two searches find, and the errors by path: a path that fails gives its empty table and the other's rows stay.

    Each is written before it counts as done, so a failure in its tasks is its own too.
    """
    found, errors = [], {}
    for name, search, empty in (("graph", graph, empty_graph), ("vector", vector, empty_vector)):
        try:
            found.append(written(search(), name))
        except Exception as failure:  # whatever a search raises is its own
            errors[name] = str(failure)
            found.append(empty)
    return found[0], found[1], errors


def shown_properties(properties: Column) -> Column:
    """The properties that a context shows, as ``key: value`` joined by commas; empty without any."""
    kept = F.filter(F.map_entries(properties), lambda e: e["key"].isin(*SHOWN))
    return F.coalesce(F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), ", "), F.lit(""))


def fact_line(kind: Column, subject: Column, predicate: Column, object: Column, properties: Column, matched: Column, data: Column) -> Column:
    """A fact as a line: an edge with arrows, a node with properties and matched pairs, anything else as it is.  Null parts are empty."""
    text = lambda c: F.coalesce(c, F.lit(""))
    pairs = F.filter(matched, lambda e: (e["key"] != "") & (e["value"] != ""))
    more = F.coalesce(F.array_join(F.transform(pairs, lambda e: F.concat(F.lit(", "), e["key"], F.lit(": "), e["value"])), ""), F.lit(""))
    props = shown_properties(properties)
    node = F.concat(text(subject), F.when(props != "", F.concat(F.lit(" ("), props, F.lit(")"))).otherwise(""), more)
    edge = F.concat_ws(" -> ", text(subject), text(predicate), text(object))
    return F.concat(F.lit("- "), F.when(kind == "edge", edge).when(kind == "node", node).otherwise(text(data)))


def full_context(facts: DataFrame, hits: DataFrame) -> DataFrame:
    """(question, context): a question's first facts and passages, a line each, under their headings.

    facts: question, pos, type, subject, predicate, object, properties, matched, data; hits: question, pos, text, properties.
    A question with one of the two has that part only; the part of passages starts with an empty line.
    """
    columns = ["type", "subject", "predicate", "object", "properties", "matched", "data"]
    place = F.row_number().over(Window.partitionBy("question").orderBy("pos"))
    lines = facts.withColumn("_n", place).where(F.col("_n") <= FACTS).select("question", "_n", fact_line(*[F.col(c) for c in columns]).alias("line"))
    props = shown_properties(F.col("properties"))
    passage = F.concat(F.lit("["), F.col("_n"), F.lit("] "), F.substring(F.coalesce("text", F.lit("")), 1, QUOTE), F.when(props != "", F.concat(F.lit(" | 属性："), props)).otherwise(""), F.lit("..."))
    quotes = hits.withColumn("_n", place).where(F.col("_n") <= REFERENCES).select("question", "_n", passage.alias("line"))

    def part(rows: DataFrame, heading: str, name: str) -> DataFrame:
        listed = F.transform(F.array_sort(F.collect_list(F.struct("_n", "line"))), lambda s: s["line"])
        return rows.groupBy("question").agg(F.concat_ws("\n", F.lit(heading), listed).alias(name))

    both = part(lines, FACTS_HEADING, "a").join(part(quotes, "\n" + PASSAGES_HEADING, "b"), "question", "full")
    return both.select("question", F.concat_ws("\n", "a", "b").alias("context"))


def single_path(hits: DataFrame, k: int = REFERENCES) -> tuple[DataFrame, DataFrame]:
    """(question, context) and (question, ref, file, quote) of a search by vectors alone: the first k hits, repeats too.

    hits: question, rank, file, quote; a null file is named as unknown, a null quote is empty.
    """
    place = F.row_number().over(Window.partitionBy("question").orderBy("rank", "file", "quote")).cast("long")
    kept = hits.select("question", place.alias("ref"), F.coalesce("file", F.lit(NO_FILE)).alias("file"), F.coalesce("quote", F.lit("")).alias("quote")).where(F.col("ref") <= k)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ref", "quote"))), lambda s: F.concat(F.lit("["), s["ref"], F.lit("] "), s["quote"]))
    return kept.groupBy("question").agg(F.array_join(listed, "\n\n").alias("context")), kept


def path_counts(**paths: DataFrame) -> DataFrame:
    """A row a question with the number of rows that each path gave, 0 for none; paths: question."""
    named = [rows.select("question", F.lit(name).alias("_path")) for name, rows in paths.items()]
    both = named[0]
    for rows in named[1:]:
        both = both.unionByName(rows)
    return both.groupBy("question").agg(*[F.count_if(F.col("_path") == name).alias(f"n_{name}") for name in paths])


def schema_lines(types: DataFrame, links: DataFrame) -> DataFrame:
    """(part, pos, line): a schema as lines for a model, the heading, types with their properties, then relations.

    types: label, properties (names), pos; links: label, domain, range, pos.  Null names are empty.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    head = types.sparkSession.createDataFrame([(0, 0, SCHEMA_HEADING)], "part int, pos long, line string")
    a = types.select(F.lit(1).alias("part"), F.col("pos").cast("long").alias("pos"), F.concat(F.lit("节点类型："), text("label"), F.lit(" | 包含属性：["), F.concat_ws(", ", "properties"), F.lit("]")).alias("line"))
    b = links.select(F.lit(2).alias("part"), F.col("pos").cast("long").alias("pos"), F.concat(F.lit("关系：("), text("domain"), F.lit(") -["), text("label"), F.lit("]-> ("), text("range"), F.lit(")")).alias("line"))
    return head.unionByName(a).unionByName(b)
