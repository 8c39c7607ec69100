"""Deterministic identifiers as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import unicode_trim

#: The prefix of each category's ids.
PREFIXES = {"Class": "C", "ObjectType": "C", "Instance": "I", "ObjectProperty": "OP", "LinkType": "OP", "DataProperty": "DP", "ActionType": "AT"}
OTHER_PREFIX = "Node"
EMPTY_LABEL = "_empty_label_"


def short_md5(value: Column, digits: int = 8) -> Column:
    return F.substring(F.md5(value.cast("string").cast("binary")), 1, digits)


def concept_id(label: Column, category: str) -> Column:
    """The same label and category give the same id everywhere."""
    trimmed = unicode_trim(F.coalesce(label, F.lit("")))
    named = F.when(trimmed == "", EMPTY_LABEL).otherwise(trimmed)
    return F.concat(F.lit(PREFIXES.get(category, OTHER_PREFIX) + "_"), short_md5(F.concat(named, F.lit("::" + category.strip()))))


def instance_id(label: Column, code: Column) -> Column:
    """An instance's id within one product."""
    return F.concat_ws("_", concept_id(label, "Instance"), code)


def action_instance_id(label: Column) -> Column:
    return F.concat(F.lit("action_"), concept_id(label, "ActionInstance"))


def property_uri(name: Column, always_hash: bool = False) -> Column:
    """An ASCII name stands for itself, any other by its hash."""
    if always_hash:
        return F.concat(F.lit("prop_"), short_md5(name))
    return F.when(name.rlike("^[a-zA-Z][a-zA-Z0-9_]*$"), name).otherwise(F.concat(F.lit("DP_"), short_md5(name)))


def node_uri(id_: Column, digits: int = 8) -> Column:
    """As property_uri, but the hash keeps the id's category prefix; of eight digits, some 100,000 ids have two with the same."""
    prefix = F.regexp_extract(id_, "^(C|AT|I|OP|DP)_", 1)
    return F.when(id_.rlike("^[a-zA-Z][a-zA-Z0-9_]*$"), id_).otherwise(F.concat(F.when(prefix == "", OTHER_PREFIX).otherwise(prefix), F.lit("_"), short_md5(id_, digits)))


def import_node_id(name: Column) -> Column:
    return F.concat(F.lit("node_"), short_md5(name, 12))


def import_instance_id(name: Column, nth: Column) -> Column:
    return F.concat(F.lit("inst_"), short_md5(name, 12), F.lit("_"), nth.cast("string"))


def content_hash(text: Column, metadata: Column) -> Column:
    """sha256 of a text and the canonical JSON of its metadata (a map; keys sorted)."""
    canonical = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(metadata))))
    return F.sha2(F.concat(text, F.lit("_"), canonical), 256)


@F.pandas_udf(T.StringType())
def xxh64_hex(value):
    """xxHash64 with seed 0 in hex; Spark's own xxhash64 has another seed."""
    import xxhash

    return value.map(lambda v: None if v is None else xxhash.xxh64_hexdigest(v.encode()))
