"""The crawl as one job over a store of fetched pages.

Batches of seeds crawl side by side, each with its own set of visited URLs:
seeds (depth 0) -> their pages' links -> links the batch may follow -> pages not
visited before -> ... -> page records under the host of the seed that led to
them -> chunk files.

* Pages are parsed once.  Their links, resolved and without repeats, are written
  once as edges, in folders by a hash bucket of the page they stand on.
* Visited URLs are written round by round in folders of the same buckets.  A round
  reads the edges of its frontier's buckets only, and takes out what has been
  visited by reading the buckets its candidates fall into only; the other
  folders are pruned.  The driver holds bucket numbers and one count a round.
* Iteration is semi-naive: a round joins the last round's new URLs, not all.  It ends
  at ``max_depth``, or where a round adds nothing.

Rounds are written tables in the shared scratch folder, so a lost executor costs
the tasks it ran.  A page that many batches reach is many records: these are kept
by the page's key, and its content joins them slice by slice where chunk files are
written, once for each piece of a host's chunks that holds the page.  A URL's key is the URL without its fragment; where the store has a
key more than once, the lowest page id stands.  A URL reached from two seeds in the
same round goes to the smaller seed host.  Null URLs lead nowhere, pages that do not
parse have no links and no record, a link without a page in the store is visited
and has no record.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import json_string_length
from ..functions.urls import drop_query_param_col, hostname, netloc, resolve_link, root_domain, strip_fragment
from ..session import cut_lineage, release, scratch_path
from ..sinks.chunkfiles import write_chunk_files
from . import chunks as CH
from . import pages as P

#: From rows with a ``link`` to the same rows with a ``target``: the URL that answers (redirects).
Follow = Callable[[DataFrame], DataFrame]
#: JSON characters of a host's chunks that one task writes, and of a slice, whose exchanges are on disk
#: together; slices of a crawl at most.
PIECE_CHARS, SLICE_CHARS, SLICES = 64_000_000, 512_000_000, 16
_VISITED = "batch_id long, url string, seed_host string, depth int, bucket int"


def _bucket(url: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")


def _write(df: DataFrame, path: str) -> DataFrame:
    """Write in folders by bucket and read back."""
    schema = df.schema
    df.repartition("bucket").write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def _touched(rows: DataFrame) -> dict[int, int]:
    """Rows in each bucket that has any (one row a bucket reaches the driver)."""
    return {r.bucket: r["count"] for r in rows.groupBy("bucket").count().collect()}


@dataclass
class Crawl:
    """A finished crawl: ``visited`` is ``(batch_id, url, seed_host, depth)``, ``pages`` the parsed store,
    ``deltas`` the number of URLs that each round added."""
    visited: DataFrame
    pages: DataFrame
    deltas: list[int] = field(default_factory=list)


def parsed_site(pages: DataFrame, buckets: int, method: str = "parser", with_feed: bool = True) -> DataFrame:
    """One parsed page for each URL key with its JSON characters (measured once, not at every visit),
    written in folders by bucket; title and paragraphs where a feed is to be made.  ``row`` tells
    pages apart that come under one id."""
    key = strip_fragment(F.col("url"))
    first = pages.where(F.col("url").isNotNull()).groupBy(key.alias("key")).agg(F.min("page_id").alias("page_id"))
    only = pages.join(first.select("page_id"), "page_id", "left_semi")
    parsed = P._content(P.parse_pages(only, method)).where(F.col("error").isNull())
    feed = [F.element_at("titles", 1).alias("title"), F.array_join("paras", " ").alias("paragraphs")] if with_feed else []
    return _write(parsed.select(key.alias("key"), F.monotonically_increasing_id().alias("row"), "page_id", "url", "content", *feed,
                                "hrefs", (json_string_length(F.col("url")) + json_string_length(F.col("content"))).alias("json_chars"),
                                _bucket(key, buckets).alias("bucket")), scratch_path(pages.sparkSession, "crawl-pages"))


def site_edges(site: DataFrame, rule: str, follow: Follow | None) -> DataFrame:
    """``(bucket, key, place, target)``: the links of each page with what the rule compares
    (the link's authority or root domain) and the key of the page that answers."""
    links = (site.select("bucket", "key", "url", F.explode("hrefs").alias("href"))
             .withColumn("link", resolve_link(F.col("url"), F.col("href"))).drop("href"))
    if rule == "root_domain":
        links = links.withColumn("link", drop_query_param_col(F.col("link")))
        links = links.withColumn("place", root_domain(hostname(F.col("link"))))
    else:
        links = links.where(F.col("link").startswith("http")).withColumn("place", netloc(F.col("link")))
    links = follow(links) if follow else links.withColumn("target", F.col("link"))
    return _write(links.select("bucket", "key", "place", strip_fragment(F.col("target")).alias("target"))
                  .where(F.col("target").isNotNull()).distinct(), scratch_path(site.sparkSession, "crawl-edges"))


def allowed_places(seeds: DataFrame, rule: str) -> DataFrame:
    """``(batch_id, place)`` that a batch may follow: its seeds' authorities, or its first seed's root domain."""
    if rule == "root_domain":
        return (seeds.groupBy("batch_id").agg(F.min_by("url", "seq").alias("url"))
                .select("batch_id", root_domain(hostname(F.col("url"))).alias("place")))
    return seeds.select("batch_id", netloc(F.col("url")).alias("place")).distinct()


def crawl(pages: DataFrame, seeds: DataFrame, *, max_depth: int | None = C.CRAWL_DEPTH, rule: str = "authority",
          follow: Follow | None = None, buckets: int = 16, method: str = "parser", with_feed: bool = True) -> Crawl:
    """Crawl all batches of ``seeds`` ``(batch_id, seq, url)`` over ``pages`` ``(page_id, url, html)``.

    ``rule="authority"`` follows http(s) links whose authority is one of the batch's seeds';
    ``"root_domain"`` those whose root domain is the first seed's.  ``max_depth=None`` goes on to
    the fixpoint.  ``buckets`` is the number of folders of edges and visited URLs.  Without
    ``with_feed`` the parsed pages hold no title and paragraphs (see :func:`feed`)."""
    if rule not in ("authority", "root_domain"):
        raise ValueError(f"unknown rule {rule!r}")
    spark = pages.sparkSession
    seeds = seeds.where(F.col("url").isNotNull()).select(F.col("batch_id").cast("long"), "seq", "url")
    site = parsed_site(pages, buckets, method, with_feed)
    release(spark)      # of the exchanges of whole pages
    edges, allowed = site_edges(site, rule, follow), allowed_places(seeds, rule)
    path = scratch_path(spark, "crawl-visited")

    def visited() -> DataFrame:
        return spark.read.schema(_VISITED).parquet(path)

    def add(rows: DataFrame, depth: int) -> tuple[DataFrame, dict[int, int]]:
        """Write a round's new URLs; what was written, and its rows by bucket."""
        folder = f"{path}/depth={depth}"
        _write(rows.select("batch_id", "url", "seed_host", _bucket(F.col("url"), buckets).alias("bucket")), folder)
        new = spark.read.schema(_VISITED).option("basePath", path).parquet(folder)
        return new, _touched(new)

    frontier, held = add(seeds.groupBy("batch_id", strip_fragment(F.col("url")).alias("url"))
                         .agg(F.min(netloc(F.col("url"))).alias("seed_host")), 0)
    deltas, depth = [sum(held.values())], 0
    while held and (max_depth is None or depth < max_depth):
        depth += 1
        out = edges.where(F.col("bucket").isin(list(held)))
        arrivals = (frontier.select("bucket", F.col("url").alias("key"), "batch_id", "seed_host")
                    .join(out, ["bucket", "key"]).join(allowed, ["batch_id", "place"], "left_semi")
                    .groupBy("batch_id", F.col("target").alias("url")).agg(F.min("seed_host").alias("seed_host")))
        found = cut_lineage(arrivals.withColumn("bucket", _bucket(F.col("url"), buckets)))
        seen = visited().where(F.col("bucket").isin(list(_touched(found)))).select("bucket", "batch_id", "url")
        frontier, held = add(found.join(seen, ["bucket", "batch_id", "url"], "left_anti"), depth)
        deltas.append(sum(held.values()))
    return Crawl(visited().drop("bucket"), site, deltas)


def crawl_records(done: Crawl, run_ts: float, content: bool = True) -> DataFrame:
    """Page records of a crawl in buffer order, written once:
    ``(batch_id, host, depth, url, content, timestamp, record_size, ord)``.

    ``host`` is the seed's.  A buffer is one batch's records of one host, by depth, then URL;
    ``ord`` rises along it (range partitions, numbered inside).  What is written has the page's ``key`` and ``row``;
    the contents join it as they are read, or with ``content=False`` where ``write_crawl`` writes them."""
    fixed = 41 + len(repr(float(run_ts)))
    spark = done.pages.sparkSession
    pages = done.pages.where(F.length("content") > 0).select(
        "key", "row", F.col("url").alias("page_url"), (F.lit(fixed) + F.col("json_chars")).cast("bigint").alias("record_size"))
    rows = (done.visited.join(pages, done.visited["url"] == F.col("key"))
            .select("batch_id", F.col("seed_host").alias("host"), "depth", F.col("page_url").alias("url"), "key", "row",
                    F.lit(float(run_ts)).alias("timestamp"), "record_size"))
    order = ["batch_id", "host", "depth", "url"]
    path = scratch_path(spark, "crawl-records")
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("ord", F.monotonically_increasing_id())
    schema = ordered.schema
    ordered.write.option("compression", "zstd").parquet(path)
    records = spark.read.schema(schema).parquet(path)
    if not content:
        return records
    return (records.join(done.pages.select("key", "row", "content"), ["key", "row"])
            .select("batch_id", "host", "depth", "url", "content", "timestamp", "record_size", "ord"))


def _pieces(records: DataFrame, numbered: DataFrame) -> DataFrame:
    """``numbered`` with the ``piece`` of a host's chunks that each chunk lies in and its ``slice``,
    written in folders by slice; pieces have about PIECE_CHARS, slices are as many as SLICE_CHARS asks for."""
    spark, path = records.sparkSession, scratch_path(records.sparkSession, "crawl-numbered")
    hosts = cut_lineage(records.groupBy(F.col("host").alias("_h")).agg(F.sum("record_size").alias("_chars")))
    slices = min(SLICES, 1 + (hosts.agg(F.sum("_chars")).first()[0] or 0) // SLICE_CHARS)
    of_host = F.ceil(F.greatest(F.col("_chars"), F.lit(1)) / F.lit(PIECE_CHARS)).cast("bigint")
    rows = (numbered.join(hosts, F.col("host").eqNullSafe(F.col("_h")))
            .withColumn("piece", F.pmod(F.xxhash64("batch_id", "chunk_no"), of_host)).drop("_h", "_chars")
            .withColumn("slice", F.pmod(F.xxhash64("host", "piece"), F.lit(slices)).cast("int")))
    schema = rows.schema
    rows.write.partitionBy("slice").option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def write_crawl(records: DataFrame, path: str, limit: int = C.FLUSH_CHARS,
                layout: tuple[str, ...] = ("host", "batch_id", "chunk_no"), pages: DataFrame | None = None,
                form: str = "text") -> None:
    """Chunk files of a crawl: each batch and host's buffer, flushed by the record that brings it to ``limit``.

    Numbers that ``layout`` leaves out of the path are fields of the records, so that a crawl of many
    batches writes files by host, with a chunk a line, instead of a file a chunk.

    With ``pages``, the crawl's parsed pages, records come without their contents.  Chunks are then written
    slice by slice, and the exchanges of one slice are dropped before the next: a page goes once to each piece
    of a host's chunks that holds it, and becomes the records of that piece there."""
    buffer = F.concat_ws(" ", F.col("batch_id").cast("string"), F.col("host"))
    numbered = CH.assign_chunks(records.withColumn("buffer", buffer), limit, host="buffer", ord_col="ord")
    rows = records.join(numbered.select("ord", "chunk_no"), "ord")
    how = dict(batch="batch_id", order="ord", layout=layout, form=form,
               carry=tuple(k for k in ("batch_id", "chunk_no") if k not in layout))
    if pages is None:
        return write_chunk_files(rows, path, **how)
    rows = _pieces(records, rows)
    release(rows.sparkSession)
    refs = F.collect_list(F.struct("batch_id", "chunk_no", "ord", "url", "timestamp"))
    for k, i in enumerate(sorted(r[0] for r in rows.select("slice").distinct().collect()) or [0]):
        held = rows.where(F.col("slice") == i).groupBy("host", "piece", "key", "row").agg(refs.alias("refs"))
        whole = (held.join(pages.select("key", "row", "content"), ["key", "row"]).repartition("host", "piece")
                 .select("host", "piece", "content", F.inline("refs")))
        write_chunk_files(whole, path, mode="append" if k else "overwrite", dealt="piece", **how)
        del held, whole
        release(rows.sparkSession)


def feed(done: Crawl) -> DataFrame:
    """``(batch_id, url, title, content)`` of the pages a crawl reached (see ``sinks.feed``)."""
    pages = done.pages.select("key", F.col("url").alias("page_url"), "title", F.col("paragraphs").alias("content"))
    return (done.visited.join(pages, done.visited["url"] == F.col("key"))
            .select("batch_id", F.col("page_url").alias("url"), "title", "content"))


def seed_list(spark: SparkSession, urls: list[str], batch_size: int = C.URL_BATCH_SIZE) -> DataFrame:
    """``(batch_id, seq, url)`` of a list in a job definition."""
    return spark.createDataFrame([(i // batch_size, i, u) for i, u in enumerate(urls)], "batch_id long, seq long, url string")
