"""One schema out of the schemas that many chunks give: types, links and actions merged in order, ends resolved and sent to what stays.

Types that go by spellings of one name, or of one label, are one.  Likeness isn't transitive, so the order counts: a type goes to the first
earlier type that stays and is like it, and stays if there is none.  That is the lexicographically first maximal independent set of the likeness graph, found in
rounds: what is the first undecided type of all its names stays at once, and what is like it goes.  Where that decides too little (long chains), the
first ``BLOCK`` undecided types are gone through one by one in a single task, so any input ends after as many rounds as it has blocks at most.

Defined results: a null or empty name or label is like nothing; a type with neither stays; ``pos`` tells types apart and orders them; empty tables give
none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import name_key, unicode_trim
from tessera.operators.extraction import resolve_references
from tessera.storage import written

#: Types gone through one by one at a time: (pos, keys) of so many rows are what one task holds.
BLOCK = 50_000


def keys(name: Column, label: Column) -> Column:
    """What a type can be alike in: the spelling key and the trimmed text of its name and of its label."""
    said = lambda kind, text, tag: F.when(unicode_trim(text) != "", F.concat(F.lit(f"{kind}{tag}:"), name_key(text) if tag == "k" else unicode_trim(text)))
    return F.array_compact(F.array(said("n", name, "k"), said("n", name, "t"), said("l", label, "k"), said("l", label, "t")))


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, sorted by pos, that stay: none of their keys is a staying one's."""
    taken: set[str] = set()
    for batch in batches:
        stay = []
        for pos, own in zip(batch.column("pos").to_pylist(), batch.column("keys").to_pylist(), strict=True):
            if taken.isdisjoint(own):
                taken.update(own)
                stay.append(pos)
        yield pa.RecordBatch.from_arrays([pa.array(stay, batch.schema.field("pos").type)], ["pos"])


def greedy(rows: DataFrame, block: int | None = None) -> DataFrame:
    """(pos, keep): for each row (pos, keys) the pos of the first staying row that shares a key, or its own."""
    block = block or BLOCK
    kind = rows.schema["pos"].dataType.simpleString()
    rows = written(rows.select("pos", "keys"), "alike")
    left, stay, before = rows, [], None
    while n := left.count():
        if n <= block or (before is not None and n > 0.8 * before):
            # sorted by range and cut to one block: the single task sees no more than that
            new = written(left.orderBy("pos").limit(block).coalesce(1).sortWithinPartitions("pos").mapInArrow(_one_by_one, f"pos {kind}"), "staying")
        else:
            held = left.select("pos", F.explode_outer("keys").alias("key"))
            first = held.where("key is not null").groupBy("key").agg(F.min("pos").alias("first"))
            late = held.join(first, "key").where("pos > first").select("pos").distinct()
            new = written(left.join(late, "pos", "left_anti").select("pos"), "staying")
        before = n
        theirs = left.join(new, "pos", "left_semi").select(F.explode("keys").alias("key")).distinct()
        gone = left.select("pos", F.explode("keys").alias("key")).join(theirs, "key", "left_semi").select("pos").distinct()
        stay.append(new)
        left = written(left.join(gone, "pos", "left_anti").join(new, "pos", "left_anti"), "undecided")
    if not stay:
        return rows.select("pos", F.col("pos").alias("keep"))
    kept = stay[0]
    for more in stay[1:]:
        kept = kept.unionByName(more)
    owners = rows.join(kept, "pos", "left_semi").select(F.col("pos").alias("keep"), F.explode("keys").alias("key"))
    found = rows.select("pos", F.explode("keys").alias("key")).join(owners, "key").groupBy("pos").agg(F.min("keep").alias("keep"))
    return rows.select("pos").join(found, "pos", "left").select("pos", F.coalesce("keep", "pos").alias("keep"))


def same_types(types: DataFrame) -> DataFrame:
    """(pos, keep): the type that each type goes to, itself if it stays; types: name, label, pos."""
    return greedy(types.select("pos", keys(F.col("name"), F.col("label")).alias("keys")))


def _united(rows: DataFrame, key: list[str], listed: str) -> DataFrame:
    """(key, ``listed``): the named structs of all rows' lists, of each name the first by pos and place, in that order."""
    each = rows.select(*key, "pos", F.posexplode(listed).alias("at", "p"))
    once = each.groupBy(*key, F.col("p.name").alias("_name")).agg(F.min_by("p", F.struct("pos", "at")).alias("p"), F.min(F.struct("pos", "at")).alias("o"))
    return once.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "p"))), lambda d: d["p"]).alias(listed))


def _first_of(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row a name, the first; a row without a name is left out."""
    return rows.where("name <> ''").groupBy("name").agg(F.min_by(F.struct(*columns), "pos").alias("_r"), F.min("pos").alias("pos")).select("name", "pos", "_r.*")


def merged_schema(types: DataFrame, links: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(types, links, actions) of one schema.

    types: name, label, sub_class_of, properties (array of structs with a name), pos; links: name, label, source, target, pos; actions: name, label, target, parameters,
    pos.  Repeats of a name give one type, link or action, the first, with the properties or parameters of all.  A superclass, an end or a target
    is found by ``resolve_references`` among the types; a link or action whose end names none is dropped, and so is a superclass that is the type itself.  Then types
    that are alike are one: the first stays and gets the properties it lacks, and ends, targets and superclasses name what stays.
    """
    heads = _first_of(types.withColumn("name", unicode_trim("name")), ["label"])
    # a later definition's superclass replaces an earlier one
    above = types.where("sub_class_of <> ''").groupBy(unicode_trim("name").alias("name")).agg(F.max_by("sub_class_of", "pos").alias("sub_class_of"))
    props = _united(types.withColumn("name", unicode_trim("name")), ["name"], "properties")
    whole = written(heads.join(above, "name", "left").join(props, "name", "left"), "types")
    links = _first_of(links.where("source <> '' and target <> ''").withColumn("name", unicode_trim("name")), ["label", "source", "target"])
    params = _united(actions.withColumn("name", unicode_trim("name")), ["name"], "parameters")
    actions = _first_of(actions.where("target <> ''").withColumn("name", unicode_trim("name")), ["label", "target"]).join(params, "name", "left")

    refs = whole.select(F.col("sub_class_of").alias("ref")).unionByName(links.select(F.explode(F.array("source", "target")).alias("ref"))).unionByName(actions.select(F.col("target").alias("ref")))
    meant = resolve_references(refs, whole.select(F.col("name").alias("id"), "name", "label", "pos"))
    keep = written(same_types(whole), "keep")
    survivor = keep.join(whole.select(F.col("pos").alias("keep"), F.col("name").alias("stays")), "keep").join(whole.select("pos", "name"), "pos").select("name", "stays")
    # by reference, the name of the type that it means and of the one that stays for it
    to = written(meant.select("ref", F.col("type_id").alias("name")).join(survivor, "name").select("ref", F.col("name").alias("_means"), F.col("stays").alias("_stays")), "meant")

    def sent(rows: DataFrame, column: str, how: str = "inner") -> DataFrame:
        return rows.join(to.select(F.col("ref").alias(column), F.col("_stays").alias("_to")), column, how).withColumn(column, F.col("_to")).drop("_to")

    grouped = whole.join(survivor, "name").withColumn("own", F.col("name") == F.col("stays"))
    merged = _united(grouped, ["stays"], "properties")
    stays = grouped.where("own").drop("properties", "own").join(merged, "stays", "left").drop("stays")
    named = to.withColumnRenamed("ref", "sub_class_of")
    above = F.when((F.col("_means") != F.col("name")) & (F.col("_stays") != F.col("name")), F.col("_stays"))
    final = stays.join(named, "sub_class_of", "left").select("name", "label", above.alias("sub_class_of"), "properties", "pos")
    return final, sent(sent(links, "source"), "target").select("name", "label", "source", "target", "pos"), sent(actions, "target").select("name", "label", "target", "parameters", "pos")
