"""Is one class an ancestor of another, for many pairs at once, without the closure of all pairs; and links checked with it.

``build`` makes interval labels.  Of each class's parents the smallest is its parent in a spanning forest; where those pointers run in a circle, the circle is cut at
its smallest class.  An Euler tour of each tree, whose list is ranked by pointer jumping, gives every class an interval that holds the
intervals of its descendants in the tree.  Each edge outside the forest (second parents, cut circles) is an extra label: whatever lies in the interval of its child
also counts as standing where its parent stands, and so on through further such edges, which are closed among themselves beforehand.

``holds`` answers pairs by equality of the tree and ranges of places.  Pointer jumping takes rounds by the logarithm of the
longest way, over written tables, of which only the last is kept; what has at most ``LOCAL`` rows is jumped in one task instead.

Defined results: a null end makes no edge, a class is its own ancestor, also one that no edge names; classes on a circle are ancestors of each other.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import name_key, unicode_trim
from tessera.storage import passing, unneeded, written

#: Rows that one task jumps by itself, and shares of a class's children among which their order is made.
LOCAL = 200_000
SHARES = 64
#: Links are checked in up to so many slices, each of so many at least, so that only one slice's shuffled rows are on disk at a time.
SLICES = 4
SLICE_ROWS = 1 << 22


@dataclass
class Ancestry:
    """``labels``: node, root, low, high.  ``extra``: what lies in (root, low..high) also stands at (to_root, to_low)."""

    labels: DataFrame
    extra: DataFrame


def _jump_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``jumped`` for a whole table in one task."""
    held = list(batches)
    if not held:
        return
    whole = pa.Table.from_batches(held)
    names = np.array(whole.column("node").to_pylist(), object)
    place = {x: i for i, x in enumerate(names)}
    hop = np.array([place.get(x, -1) if x is not None else -1 for x in whole.column("next").to_pylist()])
    n = len(names)
    steps, end, least = (hop >= 0).astype(np.int64), np.where(hop < 0, np.arange(n), -1), np.argsort(np.argsort(names))
    order = np.sort(names)
    for _ in range(max(1, n.bit_length())):
        go = np.flatnonzero(hop >= 0)
        to = hop[go]
        steps[go] += steps[to]
        least[go] = np.minimum(least[go], least[to])
        end[go], hop[go] = end[to], hop[to]
    open_ = hop >= 0
    end = np.where(open_, hop, end)
    yield pa.RecordBatch.from_arrays([whole.column("node").combine_chunks(), pa.array(names[end].tolist(), pa.string()), pa.array(steps), pa.array(order[least].tolist(), pa.string()), pa.array(open_)], ["node", "end", "steps", "least", "open"])


def jumped(pointers: DataFrame, local: int | None = None) -> DataFrame:
    """(node, end, steps, least, open) of pointers (node, next; texts, each node once): where each way ends and after how many steps, and the least node on it.

    A way that runs into a circle is open; its end is a node of the circle, and the least node of one on the circle is the circle's.
    """
    rows = written(pointers.select("node", "next"), "pointers")
    n = rows.count()
    if n <= (LOCAL if local is None else local):
        out = written(rows.coalesce(1).mapInArrow(_jump_here, "node string, end string, steps long, least string, open boolean"), "jumped")
        unneeded(rows)
        return out
    last, now = rows, rows.select("node", F.col("next").alias("hop"), F.col("next").isNotNull().cast("long").alias("steps"), F.when(F.col("next").isNull(), F.col("node")).alias("end"), F.col("node").alias("least"))
    for _ in range(n.bit_length()):
        now = written(now, "jumps")
        unneeded(last)
        last = now
        if now.where("hop is not null").isEmpty():
            break
        there = now.select(F.col("node").alias("hop"), F.col("hop").alias("_hop"), F.col("steps").alias("_steps"), F.col("end").alias("_end"), F.col("least").alias("_least"))
        on = now.join(there, "hop", "left")
        went = F.col("hop").isNotNull()
        now = on.select(
            "node", F.col("_hop").alias("hop"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.when(went, F.col("_end")).otherwise(F.col("end")).alias("end"),
            F.when(went, F.least("least", "_least")).otherwise(F.col("least")).alias("least"),
        )
    out = written(now.select("node", F.coalesce("hop", "end").alias("end"), "steps", "least", F.col("hop").isNotNull().alias("open")), "jumped")
    unneeded(last)
    return out


def _tour(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, next): the Euler tour of each tree as a list of arcs, d… down to a class and u… up from it."""
    arc = lambda side, c: F.concat(F.lit(side), F.col(c))
    dealt = tree.withColumn("_s", F.pmod(F.xxhash64("child"), F.lit(SHARES)))
    in_share = Window.partitionBy("parent", "_s").orderBy("child")
    chains = dealt.withColumns({"sibling": F.lead("child").over(in_share), "_first": F.row_number().over(in_share) == 1})
    heads = chains.where("_first").select("parent", "_s", F.col("child").alias("_head")).withColumn("_then", F.lead("_head").over(Window.partitionBy("parent").orderBy("_s")))
    siblings = chains.join(heads.select("parent", "_s", "_then"), ["parent", "_s"]).select("child", "parent", F.coalesce("sibling", "_then").alias("sibling"))
    first = heads.groupBy("parent").agg(F.min_by("_head", "_s").alias("first"))
    down = nodes.join(first.withColumnRenamed("parent", "node"), "node", "left").select(arc("d", "node").alias("node"), F.coalesce(arc("d", "first"), arc("u", "node")).alias("next"))
    up = nodes.join(siblings.withColumnRenamed("child", "node"), "node", "left").select(arc("u", "node").alias("node"), F.coalesce(arc("d", "sibling"), arc("u", "parent")).alias("next"))
    return down.unionByName(up)


def _stabbed(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """Points (root, at, and more) with each different interval (_root, _low, _high) of intervals (root, low, high) that holds them.

    An interval is the union of blocks of 2^level places, at most two a level, and a point lies in one block a level: equality of blocks finds
    what a range would have to be compared for.
    """
    spans = intervals.select("root", "low", "high").distinct()
    longest = spans.agg(F.max(F.col("high") - F.col("low") + 1)).first()[0] or 1
    levels = F.explode(F.sequence(F.lit(0), F.lit(int(longest).bit_length() - 1))).alias("level")
    each = spans.select("root", "low", "high", levels).withColumns({"_unit": F.expr("shiftleft(1L, level)"), "_to": F.expr("shiftright(high + 1, level)")})
    each = each.withColumn("_from", F.expr("shiftright(low + _unit - 1, level)")).withColumn("_after", F.col("_from") + F.abs(F.col("_from") % 2))
    ends = F.array(F.when((F.col("_from") % 2 != 0) & (F.col("_from") < F.col("_to")), F.col("_from")), F.when((F.col("_to") % 2 != 0) & (F.col("_after") < F.col("_to")), F.col("_to") - 1))
    blocks = each.select("root", "level", F.explode(F.array_compact(ends)).alias("block"), F.col("root").alias("_root"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    dealt = points.select("*", levels).withColumn("block", F.expr("shiftright(at, level)"))
    return dealt.hint("merge").join(blocks, ["root", "level", "block"]).drop("level", "block")


def build(pairs: DataFrame, local: int | None = None) -> Ancestry:
    """Labels of all classes of pairs (child, parent)."""
    with passing(pairs.sparkSession) as keep:
        found = _built(pairs, local)
        return Ancestry(keep(found.labels), keep(found.extra))


def _built(pairs: DataFrame, local: int | None) -> Ancestry:
    text = lambda c: F.col(c).cast("string").alias(c)
    edges = written(pairs.select(text("child"), text("parent")).where("child <> parent").distinct(), "edges")
    nodes = written(pairs.select(F.explode(F.array(text("child"), text("parent"))).alias("node")).where("node is not null").distinct(), "classes")
    chosen = written(edges.groupBy("child").agg(F.min("parent").alias("parent")), "chosen")
    pointers = lambda tree: nodes.join(tree.select(F.col("child").alias("node"), F.col("parent").alias("next")), "node", "left")
    ways = jumped(pointers(chosen), local)
    circles = ways.where("open").select(F.col("end").alias("node")).distinct().join(ways, "node").where("node = least").select(F.col("node").alias("child"))
    circles, tree = written(circles, "cuts"), chosen
    if not circles.isEmpty():
        tree = written(chosen.join(circles, "child", "left_anti"), "forest")
        ways = jumped(pointers(tree), local)
    ranks = jumped(_tour(tree, nodes), local)
    place = lambda side, name: ranks.where(F.col("node").startswith(side)).select(F.expr("substr(node, 2)").alias("node"), (-F.col("steps")).alias(name))
    labels = written(ways.select("node", F.col("end").alias("root")).join(place("d", "low"), "node").join(place("u", "high"), "node"), "labels")

    beside = edges.join(tree, ["child", "parent"], "left_anti")
    to = labels.select(F.col("node").alias("parent"), F.col("root").alias("to_root"), F.col("low").alias("to_low"))
    extra = written(beside.join(labels.withColumnRenamed("node", "child"), "child").join(to, "parent").select("root", "low", "high", "to_root", "to_low").distinct(), "extra")
    # where what stands at one place also stands: through the edges whose intervals hold the place; closed by doubling, over places alone
    places = extra.select(F.col("to_root").alias("root"), F.col("to_low").alias("at")).distinct()
    ways = _stabbed(places, extra).select(F.col("root").alias("to_root"), F.col("at").alias("to_low"), *[F.col(f"_{c}").alias(c) for c in ("root", "low", "high")])
    edge = extra.select("root", "low", "high", F.col("to_root").alias("_root"), F.col("to_low").alias("_low"))
    ways = written(ways.join(edge, ["root", "low", "high"]).select("to_root", "to_low", "_root", "_low").distinct(), "ways")
    size = ways.count()
    while size:
        on = ways.select(F.col("to_root").alias("_root"), F.col("to_low").alias("_low"), F.col("_root").alias("_next_root"), F.col("_low").alias("_next_low"))
        further = ways.join(on, ["_root", "_low"]).select("to_root", "to_low", F.col("_next_root").alias("_root"), F.col("_next_low").alias("_low"))
        ways = written(ways.unionByName(further).distinct(), "ways")
        before, size = size, ways.count()
        if size == before:
            break
    beyond = extra.join(ways, ["to_root", "to_low"]).select("root", "low", "high", F.col("_root").alias("to_root"), F.col("_low").alias("to_low"))
    extra = written(extra.unionByName(beyond).distinct(), "extra")
    return Ancestry(labels, extra)


def holds(pairs: DataFrame, ancestry: Ancestry) -> DataFrame:
    """The different pairs (child, ancestor), without nulls, of which the second is an ancestor of the first or the same."""
    asked = pairs.select(F.col("child").cast("string").alias("child"), F.col("ancestor").cast("string").alias("ancestor")).where("child is not null and ancestor is not null").distinct()
    labels, extra = ancestry.labels, ancestry.extra
    own = labels.select(F.col("node").alias("child"), F.col("root").alias("_root"), F.col("low").alias("_at"))
    above = labels.select(F.col("node").alias("ancestor"), F.col("root").alias("_to_root"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    placed = written(asked.where("child <> ancestor").join(own, "child").join(above, "ancestor"), "asked")
    inside = placed.where("_root = _to_root and _at between _low and _high").select("child", "ancestor")
    # the places where a child also stands are found once for each, not for each pair
    points = placed.select("child", F.col("_root").alias("root"), F.col("_at").alias("at")).distinct()
    edge = extra.select(F.col("root").alias("_root"), F.col("low").alias("_low"), F.col("high").alias("_high"), F.col("to_root").alias("_to_root"), "to_low")
    stands = written(_stabbed(points, extra).join(edge, ["_root", "_low", "_high"]).select("child", "_to_root", "to_low").distinct(), "stands")
    around = placed.hint("merge").join(stands, ["child", "_to_root"]).where("to_low between _low and _high").select("child", "ancestor")
    return asked.where("child = ancestor").unionByName(inside).unionByName(around).distinct()


def _ends(told: DataFrame, instances: DataFrame) -> DataFrame:
    """What of told (text, and more) names an instance, with its id and type: the first of that label, else the first that is a spelling of it."""
    named = instances.where(unicode_trim(F.col("label")) != "")
    pick = F.min_by(F.struct("id", F.col("type_id").cast("string").alias("type")), "pos")
    exact = named.groupBy(unicode_trim(F.col("label")).alias("_label")).agg(pick.alias("_exact"))
    alike = named.groupBy(name_key(F.col("label")).alias("_key")).agg(pick.alias("_alike"))
    texts = told.select("text", unicode_trim(F.col("text")).alias("_label"), name_key(F.col("text")).alias("_key")).distinct()
    found = texts.join(exact, "_label", "left").join(alike, "_key", "left").select("text", F.coalesce("_exact", "_alike").alias("_found"))
    return told.join(found.where("_found.id is not null"), "text").select(*told.columns, "_found.id", "_found.type")


def validated_links(links: DataFrame, relations: DataFrame, instances: DataFrame, ancestry: Ancestry, columns: list[str] | None = None) -> DataFrame:
    """Extracted links with relation_id, source_id, target_id and ``reasons``: empty where the link is accepted, else all that speaks against it.

    links: relation, source, target, and more columns; relations: id, label, domain, range; instances: id, label, type_id, pos.  A relation goes by its id, else by the first
    label; an instance by its label without white space around, else by the first that is a spelling of it.  Reasons, in this order: relation, source,
    target (names nothing known), domain, range (the end's class isn't the one wanted nor below it).  A relation's null domain or range allows all; an
    instance without a class fits no other; the three columns added are null where nothing was found.  ``columns``: those of links that are returned, else all.

    Links are read several times.
    """
    made = ("relation_id", "source_id", "target_id", "reasons")
    kept = [c for c in (links.columns if columns is None else columns) if c not in made]
    said = relations.where("id is not null").select(F.col("id").cast("string").alias("relation"), F.lit(0).alias("_k"), F.col("id").alias("relation_id"))
    said = said.unionByName(relations.where("label <> '' and id is not null").select(F.col("label").cast("string").alias("relation"), F.lit(1).alias("_k"), F.col("id").alias("relation_id")))
    said = said.groupBy("relation").agg(F.min(F.struct("_k", "relation_id"))["relation_id"].alias("relation_id"))
    wanted = relations.groupBy(F.col("id").alias("relation_id")).agg(F.min(F.struct("domain", "range")).alias("_w"))
    wanted = wanted.select("relation_id", F.col("_w.domain").cast("string").alias("_domain"), F.col("_w.range").cast("string").alias("_range"))
    # links are dealt twice, by either end with the class wanted of it, and only to what is already known of that pair
    known = links.select(*dict.fromkeys([*kept, "relation", "source", "target"])).join(written(said.join(wanted, "relation_id"), "relations"), "relation", "left")
    pair = lambda end, want: F.struct(F.col(end).alias("text"), F.col(want).alias("want"))
    with passing(links.sparkSession) as keep:
        told = known.select(F.explode(F.array(pair("source", "_domain"), pair("target", "_range"))).alias("p")).select("p.*").where("text is not null").distinct()
        told = keep(written(_ends(written(told, "told"), instances), "told"))
    with passing(links.sparkSession) as keep:
        fits = keep(written(holds(told.select(F.col("type").alias("child"), F.col("want").alias("ancestor")), ancestry).select(F.col("child").alias("type"), F.col("ancestor").alias("want"), F.lit(True).alias("fits")), "fits"))
    ends = written(told.join(fits, ["type", "want"], "left").select("text", "want", "id", (F.col("want").isNotNull() & F.col("fits").isNull()).alias("off")), "ends")
    unneeded(told, fits)

    def checked(known: DataFrame) -> DataFrame:
        for end, want, off in (("source", "_domain", "_off_domain"), ("target", "_range", "_off_range")):
            there = ends.select(F.col("text").alias("_text"), F.col("want").alias("_want"), F.col("id").alias(f"{end}_id"), F.col("off").alias(off))
            known = known.join(there, (F.col(end) == F.col("_text")) & F.col(want).eqNullSafe(F.col("_want")), "left").drop("_text", "_want")
        reasons = [
            (F.col("relation_id").isNull(), "relation"), (F.col("source_id").isNull(), "source"), (F.col("target_id").isNull(), "target"),
            (F.col("_off_domain"), "domain"), (F.col("_off_range"), "range"),
        ]
        return known.select(*kept, "relation_id", "source_id", "target_id", F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in reasons])).alias("reasons"))

    n = min(SLICES, -(-links.count() // SLICE_ROWS))
    if n < 2:
        return checked(known)
    slices = [written(checked(known.where(F.pmod(F.xxhash64("source"), F.lit(n)) == k)), "checked") for k in range(n)]
    unneeded(ends)
    return functools.reduce(DataFrame.unionByName, slices)
