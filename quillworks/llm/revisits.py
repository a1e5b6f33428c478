"""Not-modified revisits of web archives, resolved by an as-of join.

Records are full responses and revisits (a 304 answer without a body). A revisit takes the body of the latest earlier full
response of the same canonical URL, if the validators that it carries (entity tag, last-modified) agree with that response's;
headers are merged as for a cached response: those of the revisit win, save the ones that describe the stored body.

The join runs in two steps, so that a URL of any number of records is spread: within blocks of time each revisit looks
back for a response; where its block has none before it, it takes the last response of the earlier blocks, of which
only one row a block is ordered by itself. Responses of one instant are ordered by record_id; a revisit sees only responses of
earlier instants. Null URLs and times resolve to nothing. Repeated rows resolve each by itself. Columns beyond the seven of a record
are not read, whatever their names. Long URLs are compared whole. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Headers of a stored response that a not-modified answer does not replace.
STORED_ONLY = ["content-encoding", "content-length", "content-md5", "content-range", "content-type", "transfer-encoding"]
#: Time units in one block.
BLOCK = 4096


#: Parameters that tell where a visitor came from, not which resource is meant.
TRACKING = ["fbclid", "gclid", "mc_cid", "mc_eid", "msclkid", "ref", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term"]


def canonical_url(url):
    """Host in lower case without scheme and default port; path without closing slash and .html; the query's parameters in
    order, without those of TRACKING; no fragment."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"(?s)#.*$", "")
    place = F.regexp_replace(bare, r"(?s)\?.*$", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(place, r"^[^/]*", 0), r":(80|443)$", ""))
    path = F.regexp_replace(F.regexp_extract(place, r"(?s)^[^/]*(.*)$", 1), r"(\.html?|/)$", "")
    asked = F.filter(F.split(F.regexp_extract(bare, r"(?s)\?(.*)$", 1), "&"), lambda x: (x != "") & ~F.split(x, "=")[0].isin(TRACKING))
    query = F.array_join(F.array_sort(asked), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def merged(stored, fresh):
    """Header map of a revalidated response."""
    taken = F.map_filter(fresh, lambda k, _: ~k.isin(STORED_ONLY))
    kept = F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(taken), k))
    return F.map_concat(kept, taken)


def resolve(records: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each revisit of ``records`` (record_id, url, ts, kind response or revisit, etag, last_modified, headers map) with
    canonical, resolved_id (the response it refers to; null if none earlier or its validators differ), status (resolved,
    mismatch, missing) and merged headers (null unless resolved)."""
    records = records.select("record_id", "url", "ts", "kind", "etag", "last_modified", "headers")
    keyed = records.withColumn("canonical", canonical_url(F.col("url"))).withColumn("block", F.floor(F.col("ts") / block))
    stored = F.when((F.col("kind") == "response") & F.col("ts").isNotNull(), F.struct("ts", "record_id", "etag", "last_modified", "headers"))
    here = Window.partitionBy("canonical", "block").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    keyed = keyed.withColumn("near", F.max(F.when(F.col("kind") == "response", F.struct("ts", "record_id"))).over(here))
    responses = keyed.where(stored.isNotNull() & F.col("canonical").isNotNull())
    last = responses.groupBy("canonical", "block").agg(F.max(F.struct("ts", "record_id")).alias("last"))
    blocks = keyed.where("kind = 'revisit'").select("canonical", "block").distinct().join(last, ["canonical", "block"], "full")
    earlier = F.max("last").over(Window.partitionBy("canonical").orderBy("block").rangeBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("canonical", "block", earlier.alias("far"))
    asked = keyed.where("kind = 'revisit'").join(blocks, ["canonical", "block"], "left").withColumn("of", F.coalesce("near", "far"))
    found = responses.select(F.col("canonical").alias("c"), F.struct("ts", "record_id").alias("k"), F.col("etag").alias("old_etag"), F.col("last_modified").alias("old_modified"), F.col("headers").alias("old_headers")).dropDuplicates(["c", "k"])
    both = asked.join(found, (F.col("canonical") == F.col("c")) & (F.col("of") == F.col("k")), "left")
    agree = (F.col("etag").isNull() | F.col("etag").eqNullSafe(F.col("old_etag"))) & (F.col("last_modified").isNull() | F.col("last_modified").eqNullSafe(F.col("old_modified")))
    agree = agree & (F.col("etag").isNotNull() | F.col("last_modified").isNotNull())
    status = F.when(F.col("k").isNull(), "missing").when(agree, "resolved").otherwise("mismatch")
    none = F.create_map().cast("map<string,string>")
    return both.withColumn("status", status).select(
        "record_id",
        "url",
        "ts",
        "canonical",
        "status",
        F.when(F.col("status") == "resolved", F.col("k.record_id")).alias("resolved_id"),
        F.when(F.col("status") == "resolved", merged(F.coalesce("old_headers", none), F.coalesce("headers", none))).alias("headers"),
    )


#: A page is asked for again so long after its capture.
REVISIT_AFTER = 1000


def captures(pages: DataFrame) -> DataFrame:
    """Archive records of ``pages``: each page's full response at the time page_id, and a revisit ``REVISIT_AFTER`` later that
    carries its entity tag, so that a later capture of the same canonical URL makes it mismatch."""
    etag = F.md5(F.coalesce("html", F.lit("")))
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    response = pages.select(
        (2 * F.col("page_id")).alias("record_id"), "url", F.col("page_id").alias("ts"), F.lit("response").alias("kind"), etag.alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        F.create_map(F.lit("content-length"), size, F.lit("date"), F.col("page_id").cast("string"), F.lit("etag"), etag).alias("headers"),
    )
    later = F.col("page_id") + REVISIT_AFTER
    revisit = pages.select(
        (2 * F.col("page_id") + 1).alias("record_id"), "url", later.alias("ts"), F.lit("revisit").alias("kind"), etag.alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), later.cast("string"), F.lit("age"), F.lit("0")).alias("headers"),
    )
    return response.union(revisit)


def report(pages: DataFrame) -> DataFrame:
    """record_id, canonical, status, resolved_id and headers (name=value, sorted, joined by semicolons) of each revisit."""
    listed = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return resolve(captures(pages)).select("record_id", "canonical", "status", "resolved_id", listed.alias("headers"))
