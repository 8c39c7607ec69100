"""Extracted rows checked against a table of rules in one pass: each row with all the reasons that speak against it, accepted and refused rows from one scan.

The rules are what extraction demands of types, links and actions of a schema and of instances, links and actions of a document: texts that may not be
blank.  A caller can add rules, as reason and condition.

Defined results: a condition that is null doesn't hold; a blank text is null, empty or white space; repeated rows are judged each; an empty table has counts of 0; a column that
a rule needs and the table lacks counts as blank everywhere.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessera.functions.text import unicode_trim
from tessera.storage import shared_dir

#: The texts that may not be blank, by kind of row.
REQUIRED = {
    "object_type": ("name",), "link_type": ("name", "source_object_type", "target_object_type"), "action_type": ("name", "target_object_type"),
    "instance": ("label", "type"), "link": ("relation", "source", "target"), "action": ("label", "action_type"),
}


def blank(rows: DataFrame, column: str) -> Column:
    if column not in rows.columns:
        return F.lit(True)
    return F.coalesce(unicode_trim(F.col(column).cast("string")) == "", F.lit(True))


def rules_of(rows: DataFrame, kind: str) -> dict[str, Column]:
    """The rules of a kind of row: reason and the condition under which it holds against a row."""
    return {f"{c} is blank": blank(rows, c) for c in REQUIRED[kind]}


def checked(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The rows with ``reasons``: the rules that hold against each, in the order of the rules."""
    said = [F.when(F.coalesce(c, F.lit(False)), F.lit(reason)) for reason, c in rules.items()]
    return rows.withColumn("reasons", F.array_compact(F.array(*said)) if said else F.array().cast("array<string>"))


@dataclass
class Checked:
    """``accepted`` with the input's columns, ``refused`` with reasons besides, and ``counts``: rows, accepted, refused, and how many rows each reason holds against."""

    accepted: DataFrame
    refused: DataFrame
    counts: dict[str, int]


def split(rows: DataFrame, rules: dict[str, Column]) -> Checked:
    """Write accepted and refused rows by one scan, and count them as they pass."""
    spark, seen = rows.sparkSession, Observation(f"checked-{uuid.uuid4().hex}")
    ok = F.size("reasons") == 0
    measures = [F.count(F.lit(1)).alias("rows"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("refused")]
    measures += [F.count_if(F.array_contains("reasons", reason)).alias(f"reason {i}") for i, reason in enumerate(rules)]
    path = f"{shared_dir(spark)}/checked-{uuid.uuid4().hex}"
    passed = checked(rows, rules).observe(seen, *measures).withColumn("_ok", ok)
    passed.write.partitionBy("_ok").parquet(path)
    got = seen.get
    counts = {k: got.get(k, 0) for k in ("rows", "accepted", "refused")} | {reason: got.get(f"reason {i}", 0) for i, reason in enumerate(rules)}
    stored = spark.read.schema(passed.schema).parquet(path)
    return Checked(stored.where("_ok").select(*rows.columns), stored.where("not _ok").select(*rows.columns, "reasons"), counts)
