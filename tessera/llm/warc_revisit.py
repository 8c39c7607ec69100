"""Not-modified revisits of a web archive, resolved to the response that they stand for.

A revisit record says that a page had not changed.  It is joined, as of its time, to the latest earlier
full response of the same canonical URL; the validators of both are compared; and the header fields that a
not-modified answer may update replace those of the response.

The as-of join is two windows.  Records are dealt by URL and a bucket of time, so one URL with a large share
of all records is spread over its buckets; within a bucket a window carries the last full
response forward.  Across buckets only one row for each URL and bucket, its last full response, is carried.

Records: record_id, url, ts (timestamp), kind ('response' or 'revisit'), status, etag, last_modified,
digest, headers (array of name and value).

Result, one row a revisit: verdict 'resolved', 'unverified' (nothing to compare, taken as it is),
'changed' (validators differ; not joined) or 'no response'; refers_to and refers_ts of the response; status and
merged headers.

Defined results: only responses of status 200 are full; a response at the very time of a revisit isn't
earlier; of full responses at one time the largest record_id is the latest; records with a null url or time
resolve to nothing; repeated records are rows of their own; an empty table gives none; other columns
aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields that a not-modified answer carries for the stored response to take over.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that don't name a page.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
BUCKET_SECONDS = 3600
#: Shares of the rows without URL or time.
LONE_SHARES = 1024


def canonical_url(url: Column) -> Column:
    """Host and path that different spellings of a URL share.

    Scheme, fragment, a leading www., default ports, tracking parameters and the slash at a path's end are dropped,
    the host is lower-cased and parameters are sorted.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), "^www\\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    params = F.filter(F.split(F.regexp_extract(bare, "\\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    return F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.concat_ws("&", F.array_sort(params)))).otherwise(""))


def _same(mine: Column, theirs: Column) -> Column:
    """true or false where both are given, else null."""
    weak = lambda x: F.regexp_replace(x, "^W/", "")
    return F.when(mine.isNotNull() & theirs.isNotNull(), weak(mine) == weak(theirs))


def resolve(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """One row a revisit: record_id, canonical_url, ts, verdict, refers_to, refers_ts, status, headers."""
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("url").isNotNull() & F.col("ts").isNotNull()
    response = F.struct("ts", "record_id", "etag", "last_modified", "digest", "status", "headers")
    rows = records.select(
        "record_id", "ts", "kind", "etag", "last_modified", "digest", "headers", canonical_url(F.col("url")).alias("canonical_url"),
        F.floor(F.unix_timestamp("ts") / bucket_seconds).alias("bucket"), F.when(full, response).alias("response"),
    )
    rows = rows.where((F.col("kind") == "revisit") | F.col("response").isNotNull())
    # what has no URL or time finds nothing: dealt by its identifier, so that such rows don't meet in one task
    lone = F.col("canonical_url").isNull() | F.col("ts").isNull()
    rows = rows.withColumn("deal", F.when(lone, F.pmod(F.xxhash64("record_id"), F.lit(LONE_SHARES))).otherwise(F.lit(-1).cast("long")))
    order = [F.col("ts"), (F.col("kind") == "response").cast("int"), F.col("record_id")]
    within = Window.partitionBy("canonical_url", "bucket", "deal").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.last("response", ignorenulls=True).over(within)).where("kind = 'revisit'")
    # the last full response of each bucket; ties go to the largest record_id as the order of fields in the struct says
    last = rows.groupBy("canonical_url", "bucket", "deal").agg(F.max_by("response", F.when(F.col("response").isNotNull(), F.struct("ts", "record_id"))).alias("last"))
    across = Window.partitionBy("canonical_url", "deal").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("canonical_url", "bucket", "deal", F.last("last", ignorenulls=True).over(across).alias("far"))
    found = near.join(carried, ["canonical_url", "bucket", "deal"], "left").withColumn("r", F.coalesce("near", "far"))

    checks = [_same(F.col(c), F.col(f"r.{c}")) for c in ("etag", "last_modified", "digest")]
    agree = F.coalesce(*checks)  # the strongest validator that both have decides
    verdict = F.when(F.col("r").isNull(), "no response").when(agree.isNull(), "unverified").when(agree, "resolved").otherwise("changed")
    taken = verdict.isin("resolved", "unverified")
    name = lambda h: F.lower(h["name"])
    update = F.filter(F.col("headers"), lambda h: name(h).isin(*PERMITTED))
    update = F.coalesce(update, F.array().cast(records.schema["headers"].dataType))
    replaced = F.transform(update, name)
    merged = F.concat(F.filter(F.coalesce("r.headers", F.array().cast(records.schema["headers"].dataType)), lambda h: ~F.array_contains(replaced, name(h))), update)
    return found.select(
        "record_id", "canonical_url", "ts", verdict.alias("verdict"), F.when(taken, F.col("r.record_id")).alias("refers_to"), F.when(taken, F.col("r.ts")).alias("refers_ts"),
        F.when(taken, F.col("r.status")).alias("status"), F.when(taken, merged).alias("headers"),
    )


def records_of(pages: DataFrame) -> DataFrame:
    """Capture records for a table of pages: each page was fetched once and asked for again a day later.

    A page answers in the minute of its page_id, every eleventh with status 500.  The later answer is
    a revisit; which validators it carries, and whether they still hold, goes by page_id.
    """
    n = F.col("page_id")
    at = F.timestamp_seconds(F.lit(1_704_067_200) + n * 60)
    digest, day = F.md5(F.coalesce(F.col("html").cast("string"), F.lit(""))), F.date_format(at, "yyyy-MM-dd")
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    response = F.struct(
        (n * 2).alias("record_id"), at.alias("ts"), F.lit("response").alias("kind"), F.when(n % 11 == 0, 500).otherwise(200).alias("status"),
        F.when(n % 3 != 0, digest).alias("etag"), F.when(n % 4 != 0, day).alias("last_modified"), digest.alias("digest"),
        F.array(pair("Content-Type", F.lit("text/html")), pair("ETag", digest), pair("Date", day)).alias("headers"),
    )
    revisit = F.struct(
        (n * 2 + 1).alias("record_id"), F.timestamp_seconds(F.lit(1_704_067_200 + 86_400) + n * 60).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        F.when(n % 5 == 0, F.lit("other")).when(n % 3 != 0, F.concat(F.lit("W/"), digest)).alias("etag"), F.when(n % 2 == 0, day).alias("last_modified"), F.when(n % 7 != 0, digest).alias("digest"),
        F.array(pair("Content-Type", F.lit("text/plain")), pair("Expires", n), pair("date", F.lit("later"))).alias("headers"),
    )
    return pages.select("url", F.inline(F.array(response, revisit)))
