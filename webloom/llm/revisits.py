"""Not-modified revisit resolution for web archives (operator 2).

Capture records are (record_id, url, ts, kind, headers, payload): ``response``
records are full, ``revisit`` records answered "304 Not Modified".  A revisit
resolves to the latest earlier full response of its canonical URL, if their
validators agree, and its permitted headers are merged into the stored ones.

The as-of join is a distributed scan: records are range partitioned by (URL,
time), so that even one URL with most of the records is many partitions; each
partition finds the last full response before each record by itself, and one
row for each partition's first and last URL carries responses across.

Validators: entity tags decide where both sides have one (weak comparison: a
``W/`` prefix is ignored), else Last-Modified dates; a disagreement is
``validator_mismatch``, no common validator ``no_validator``, no earlier full
response ``no_earlier_response``; otherwise the revisit is ``resolved``.

Merged headers: names are lower-cased, the 304's values replace the stored
ones, but for headers that describe the connection or the stored body
(``KEEP_STORED``).

Defined results: a revisit "at" the time of a response comes after it if its
record_id is larger; records without URL or time (null) and without headers
(null: none) are kept and cannot resolve in the first case; equal records are
separate rows; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as SparkWindow
from pyspark.sql import functions as F

from .tables import materialise

#: Headers of a stored response that a 304 does not change (RFC 9110, RFC 9111).
KEEP_STORED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
               "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")
#: Query parameters that name a visit's origin, not a resource.
TRACKING = "(utm_[a-z]+|gclid|fbclid|ref)"


def canonical_url(url: Column) -> Column:
    """One spelling of a URL: no scheme, ``www.`` or ``m.``, user, default
    port, fragment, tracking parameter or closing slash; host in lower case,
    parameters in order."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":(80|443)$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.filter(F.array_sort(F.split(query, "&")), lambda p: (p != "") & ~p.rlike(f"^{TRACKING}(=|$)"))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _lower_keys(headers: Column) -> Column:
    """Header names in lower case; of names that then coincide the largest value."""
    pairs = F.array_sort(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e.key).alias("key"), e.value.alias("value"))))
    alone = F.filter(pairs, lambda e, i: (i == F.size(pairs) - 1) | (F.get(pairs, i + 1).key != e.key))
    return F.when(headers.isNull(), F.map_from_entries(F.filter(F.array(F.struct(F.lit("").alias("key"), F.lit("").alias("value"))), lambda e: F.lit(False)))).otherwise(
        F.map_from_entries(alone))


def _latest_full(records: DataFrame, partitions: int) -> DataFrame:
    """Each record with the latest full response before it (struct ``full``)."""
    ordered = records.repartitionByRange(partitions, "key", "ts", "record_id").withColumn("pid", F.spark_partition_id())
    rows = materialise(ordered, "captures")
    full = F.when(F.col("kind") == "response", F.struct("record_id", "ts", "headers", "payload"))
    inside = SparkWindow.partitionBy("pid", "key").orderBy("ts", "record_id").rowsBetween(SparkWindow.unboundedPreceding, -1)
    seen = rows.withColumn("before", F.last(full, ignorenulls=True).over(inside))
    # two URLs of a partition at most go on in another one: its first and its last
    edge = rows.groupBy("pid").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    edges = edge.select("pid", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("key"))
    at_edge = rows.join(F.broadcast(edges), ["pid", "key"])
    last = at_edge.where("kind = 'response'").groupBy("pid", "key").agg(F.max_by(
        F.struct("record_id", "ts", "headers", "payload"), F.struct("ts", "record_id")).alias("f"))
    across = SparkWindow.partitionBy("key").orderBy("pid").rowsBetween(SparkWindow.unboundedPreceding, -1)
    carried = (edges.join(last, ["pid", "key"], "left")
               .select("pid", "key", F.last("f", ignorenulls=True).over(across).alias("carried")).where("carried IS NOT NULL"))
    # two rows for each range partition at most
    return (seen.join(F.broadcast(carried), ["pid", "key"], "left")
            .withColumn("full", F.coalesce("before", "carried")).drop("before", "carried", "pid"))


def resolve(records: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row for each revisit: record_id, url_key, ts, status, response_id,
    headers (merged where resolved), payload of the response."""
    n = partitions or int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = records.select("record_id", canonical_url(F.col("url")).alias("key"), "ts", "kind",
                          _lower_keys(F.col("headers")).alias("headers"), "payload")
    known = F.col("key").isNotNull() & F.col("ts").isNotNull()
    lost = base.where(~known & (F.col("kind") == "revisit")).withColumn("full", F.lit(None).cast(
        "struct<record_id:bigint,ts:timestamp,headers:map<string,string>,payload:string>"))
    found = _latest_full(base.where(known), n).where("kind = 'revisit'").unionByName(lost)
    etag = lambda h: F.regexp_replace(F.element_at(h, "etag"), "^W/", "")
    date = lambda h: F.element_at(h, "last-modified")
    new, old = F.col("headers"), F.col("full.headers")
    status = (F.when(F.col("full").isNull(), "no_earlier_response")
              .when(etag(new) == etag(old), "resolved").when(etag(new) != etag(old), "validator_mismatch")
              .when(date(new) == date(old), "resolved").when(date(new) != date(old), "validator_mismatch")
              .otherwise("no_validator"))
    permitted = F.map_filter(new, lambda k, v: ~k.isin(*KEEP_STORED))
    stored = F.map_filter(old, lambda k, v: ~F.map_contains_key(permitted, k))
    ok = F.col("status") == "resolved"
    return found.withColumn("status", status).select(
        "record_id", F.col("key").alias("url_key"), "ts", "status",
        F.when(ok, F.col("full.record_id")).alias("response_id"),
        F.when(ok, F.map_concat(stored, permitted)).alias("headers"),
        F.when(ok, F.col("full.payload")).alias("payload"))


def captures(pages: DataFrame) -> DataFrame:
    """Capture records made of the pages table: page p is fetched at minute p
    and again 100,000 and 200,000 minutes later under other spellings of its
    URL, and each fetch visits the host's front page too."""
    at = lambda m: F.timestamp_seconds(F.lit(1_600_000_000) + 60 * m)
    p = F.col("page_id")
    tag = F.md5(F.coalesce("html", F.lit("")))
    front = F.concat(F.regexp_extract("url", "^([A-Za-z]+://[^/?#]*)", 1), F.lit("/"))
    day = F.concat(F.lit("day "), F.floor(p / 500).cast("string"))
    first = pages.select(
        (p * 6).alias("record_id"), "url", at(p).alias("ts"), F.lit("response").alias("kind"),
        F.create_map(F.lit("ETag"), tag, F.lit("Content-Length"), F.octet_length("html").cast("string"),
                     F.lit("Date"), p.cast("string"), F.lit("Server"), F.lit("a")).alias("headers"), F.sha1("html").alias("payload"))
    again = pages.select(
        (p * 6 + 1).alias("record_id"), F.concat(F.regexp_replace("url", "[#?].*$", ""), F.lit("#again")).alias("url"),
        at(p + 100_000).alias("ts"), F.lit("revisit").alias("kind"),
        F.create_map(F.lit("etag"), F.concat(F.lit("W/"), F.when(p % 7 == 0, F.lit("changed")).otherwise(tag)),
                     F.lit("content-length"), F.lit("0"), F.lit("DATE"), (p + 100_000).cast("string")).alias("headers"),
        F.lit(None).cast("string").alias("payload"))
    third = pages.select(
        (p * 6 + 2).alias("record_id"), F.concat("url", F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("utm_id=1")).alias("url"),
        at(p + 200_000).alias("ts"), F.lit("revisit").alias("kind"),
        F.create_map(F.lit("Expires"), F.lit("never")).alias("headers"), F.lit(None).cast("string").alias("payload"))
    fronts = pages.select(
        (p * 6 + 3).alias("record_id"), front.alias("url"), at(p).alias("ts"),
        F.when(p % 10 == 0, "response").otherwise("revisit").alias("kind"),
        F.create_map(F.lit("Last-Modified"), day, F.lit("Date"), p.cast("string"), F.lit("Content-Type"),
                     F.when(p % 10 == 0, "text/html").otherwise("none")).alias("headers"),
        F.when(p % 10 == 0, F.sha1(front)).alias("payload"))
    return first.union(again).union(third).union(fronts)


def header_lines(headers: Column) -> Column:
    """A map of headers as sorted ``name: value`` lines."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e.key, F.lit(": "), F.coalesce(e.value, F.lit(""))))), "\n")
