"""Exact deduplication by sorting contents; DataFrame functions only.

Texts are compared after every run of ASCII white space has become one space.  Sampled
splitters deal the normalised texts out by range, an external sort places equals next to each
other, and the window over them compares neighbours in full and keeps the smallest identifier.
Texts are ordered by their first ``LEAD`` characters, a hash and then the whole text, so that what is
sampled for the splitters has a bounded size.

A text with a large share of all rows would land in one task.  So texts that a sample finds
often (``HOT_SHARE`` of its rows or more; there can be at most 1/HOT_SHARE of them) are dealt
out by text and a salt, and only their groups, one row for each text and salt, are joined
again afterwards.  The number of salts grows with the table, so that a salt has ``SALT_ROWS`` rows
at most however large a text's share is.  Hotness changes how rows are dealt, never the result.

Defined results: null counts as an empty text; of rows that repeat an identifier and a text one
stays; a null identifier stays only where its group has no other; an empty table gives none.
Columns of the input other than the identifier and the text pass through unchanged, if asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_SHARE = 1 / 5000
HOT_SAMPLE = 200_000
LEAST_HOT = 20
SALTS = 64
SALT_ROWS = 100_000
LEAD = 48


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def hot_keys(docs: DataFrame, text: str, rows: int, sample: int = HOT_SAMPLE) -> list[int]:
    """Hashes of texts that make up HOT_SHARE of a sample of the table's rows; at most 1/HOT_SHARE of them reach the driver."""
    share = min(1.0, sample / max(rows, 1))
    keys = docs.sample(share, seed=7).select(F.xxhash64(normalised(F.col(text))).alias("_k"))
    often = keys.groupBy("_k").count().where(F.col("count") >= max(LEAST_HOT, HOT_SHARE * share * rows))
    return [r["_k"] for r in often.orderBy(F.desc("count")).limit(int(1 / HOT_SHARE)).collect()]


def label(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.

    With ``carry`` also ``row``, a struct of all input columns.
    """
    total = docs.count()
    hot, salts = hot_keys(docs, text, total), max(SALTS, total // SALT_ROWS)
    norm = normalised(F.col(text))
    body = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row") if carry else norm.alias("_norm")
    rows = docs.select(F.col(doc_id).alias("_id"), body, F.substring(norm, 1, LEAD).alias("_lead"), F.xxhash64(norm).alias("_hash"))
    place = ["_lead", "_hash"]
    if hot:
        rows = rows.withColumn("_salt", F.when(F.col("_hash").isin(hot), F.pmod(F.xxhash64("_id"), F.lit(salts))).otherwise(F.lit(0)))
        place.append("_salt")
    dealt = rows.repartitionByRange(*place)
    if carry:  # one text a row is shuffled
        dealt = dealt.withColumn("_norm", normalised(F.col(f"_row.`{text}`")))
    else:
        dealt = dealt.withColumn("_row", F.lit(None).cast("int"))
    ordered = Window.partitionBy(*place, "_norm").orderBy(F.col("_id").asc_nulls_last())
    same = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.row_number().over(ordered) == 1
    found = dealt.select("_id", "_row", "_norm", "_hash", F.min("_id").over(same).alias("_least"), F.count(F.lit(1)).over(same).alias("_n"), first.alias("_first"))
    found = found.select("_id", "_row", "_least", "_n", "_first", F.sha2("_norm", 256).alias("_sha"), *([F.col("_hash").isin(hot).alias("_hot")] if hot else []))
    if hot:
        # hot groups: join the salted parts; one row for each hot text, so at most 1/HOT_SHARE and those that share its hash
        whole = found.where("_hot AND _first").groupBy(F.col("_sha").alias("_of")).agg(F.min("_least").alias("_all_least"), F.sum("_n").alias("_all_n"))
        found = found.join(F.broadcast(whole), F.col("_hot") & (F.col("_sha") == F.col("_of")), "left")
        found = found.withColumn("_least", F.coalesce("_all_least", "_least")).withColumn("_n", F.coalesce("_all_n", "_n"))
    kept = F.col("_first") & F.col("_id").eqNullSafe(F.col("_least"))
    named = [F.col("_id").alias("doc_id"), F.col("_least").alias("keep_id"), F.col("_n").cast("long").alias("group_size"), kept.alias("kept"), F.col("_sha").alias("text_sha256")]
    return found.select(*named, *([F.col("_row").alias("row")] if carry else []))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with the input's columns."""
    return label(docs, doc_id, text, carry=True).where("kept").select("row.*")
