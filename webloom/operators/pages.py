"""Operators over fetched pages ``(page_id, url, html)``.

Parsing is one ``mapInArrow`` job producing the direct text nodes of the
selected tags and the hrefs; everything after it (stripping, joining, link
resolution, host membership) is JVM-side.  A native regex form handles flat
markup without Python and is checked against the parser on the test data.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import html as H
from ..functions.metrics import observed
from ..functions.text import json_string_length, py_strip
from ..functions.urls import (drop_query_param_col, hostname, netloc, resolve_link,
                              root_domain, strip_fragment)

PARSED_SCHEMA = ("page_id bigint, url string, titles array<string>, paras array<string>, "
                 "heads array<string>, hrefs array<string>, error string")


#: Pages whose markup and nodes a Python worker holds as objects at a time.
PARSE_ROWS = 256
_NODES = ("titles", "paras", "heads", "hrefs")
_PARSED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), *[(c, pa.list_(pa.string())) for c in _NODES],
                     ("error", pa.string())])


def _parse_batches(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, PARSE_ROWS):
            part = batch.slice(at, PARSE_ROWS)
            cols, errors = {c: [] for c in _NODES}, []
            for html in part.column("html").to_pylist():
                try:
                    if html is None:
                        raise ValueError("no html")
                    nodes, links = H.parse_html(html)
                    got = (nodes["title"], nodes["p"], [t for h in H.SELECTED[2:] for t in nodes[h]], links)
                    error = None
                except Exception as e:  # noqa: BLE001 - a bad page is a reject row
                    got, error = (None,) * len(_NODES), f"{type(e).__name__}: {e}"
                for c, v in zip(_NODES, got):
                    cols[c].append(v)
                errors.append(error)
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), *[pa.array(cols[c], pa.list_(pa.string())) for c in _NODES],
                 pa.array(errors, pa.string())], schema=_PARSED)


def parse_pages(pages: DataFrame, method: str = "parser") -> DataFrame:
    """``(page_id, url, titles, paras, heads, hrefs, error)`` per page.

    ``method="parser"`` is the general form; ``"native"`` is the regex form
    for flat markup (no Python worker).
    """
    src = pages.select(F.col("page_id").cast("bigint"), "url", "html")
    if method == "parser":
        return src.mapInArrow(_parse_batches, PARSED_SCHEMA)
    clean = H.strip_raw_blocks(F.col("html"))
    heads = F.concat(*[H.native_nodes(clean, f"h{i}") for i in range(1, 7)])
    nonempty = lambda a: F.filter(a, lambda t: F.length(t) > 0)
    return src.select(
        "page_id", "url",
        nonempty(H.native_nodes(clean, "title")).alias("titles"),
        nonempty(H.native_nodes(clean, "p")).alias("paras"),
        nonempty(heads).alias("heads"),
        F.transform(H.native_hrefs(clean), H.decode_entities).alias("hrefs"),
        F.when(F.col("html").isNull(), F.lit("ValueError: no html")).alias("error"))


def _content(parsed: DataFrame) -> DataFrame:
    nodes = F.concat("titles", "paras", "heads")
    text = F.array_join(F.filter(F.transform(nodes, py_strip), lambda t: t != ""), " ")
    return parsed.withColumn("content", text)


def page_text(pages: DataFrame, method: str = "parser") -> DataFrame:
    """``(page_id, url, host, content, n_chars)`` for pages with non-empty text."""
    return (_content(parse_pages(pages, method))
            .where(F.col("error").isNull() & (F.length("content") > 0))
            .select("page_id", "url", netloc(F.col("url")).alias("host"), "content",
                    F.length("content").cast("bigint").alias("n_chars")))


def extract_rejects(pages: DataFrame, method: str = "parser") -> DataFrame:
    """Dead letters of extraction: parse errors and pages without text."""
    parsed = _content(parse_pages(pages, method))
    return (parsed.where(F.col("error").isNotNull() | (F.coalesce(F.length("content"), F.lit(0)) == 0))
            .select("page_id", "url",
                    F.coalesce("error", F.lit("no text")).alias("reason")))


def page_title_content(pages: DataFrame, method: str = "parser") -> DataFrame:
    """Feed variant: first title node (as is) and paragraph nodes joined by a space."""
    parsed = parse_pages(pages, method).where(F.col("error").isNull())
    return parsed.select("page_id", "url", F.element_at("titles", 1).alias("title"),
                         F.array_join("paras", " ").alias("content"))


def page_links(pages: DataFrame, method: str = "parser", observation=None) -> DataFrame:
    """One row per ``a[href]`` (duplicates kept) with the href resolved.
    An ``Observation`` collects the number of links found (``{"links": n}``)."""
    parsed = parse_pages(pages, method).where(F.col("error").isNull())
    links = (parsed.select("page_id", "url", F.explode("hrefs").alias("href"))
             .withColumn("link", resolve_link(F.col("url"), F.col("href"))))
    return observed(links, observation, "links")


def page_hosts(pages: DataFrame) -> DataFrame:
    """Pages per authority (``netloc``: userinfo, port and case kept)."""
    return (pages.select(netloc(F.col("url")).alias("host"))
            .groupBy("host").agg(F.count(F.lit(1)).alias("n_pages")))


def seed_batches(seeds: DataFrame, batch_size: int = C.URL_BATCH_SIZE,
                 seq_col: str = "page_id") -> DataFrame:
    """Batch number by list position: ``seq div batch_size`` (no global window)."""
    return seeds.withColumn("batch_id", F.floor(F.col(seq_col) / F.lit(batch_size)).cast("bigint"))


def internal_links(pages: DataFrame, batch_size: int = C.URL_BATCH_SIZE,
                   method: str = "parser") -> DataFrame:
    """Links a crawl batch follows: http(s) links whose authority is one of the
    batch's seed authorities.  The page keeps its seed's host."""
    seeds = seed_batches(pages.select("page_id", "url"), batch_size)
    allowed = seeds.select("batch_id", netloc(F.col("url")).alias("link_host")).distinct()
    links = (page_links(pages, method)
             .join(seeds.select("page_id", "batch_id"), "page_id")
             .where(F.col("link").startswith("http"))
             .withColumn("link_host", netloc(F.col("link"))))
    return (links.join(allowed, ["batch_id", "link_host"], "left_semi")
            .select("page_id", "batch_id", netloc(F.col("url")).alias("host"),
                    "link", "link_host"))


def root_domain_links(pages: DataFrame, batch_size: int = C.URL_BATCH_SIZE,
                      method: str = "parser", keep: bool = True) -> DataFrame:
    """Variant crawl: follow links whose root domain equals the root domain of
    the batch's first seed (``keep=False`` returns the skipped ones)."""
    seeds = seed_batches(pages.select("page_id", "url"), batch_size)
    start = (seeds.groupBy("batch_id")
             .agg(F.min_by("url", "page_id").alias("first_seed"))
             .select("batch_id", root_domain(hostname(F.col("first_seed"))).alias("start_root")))
    links = (page_links(pages, method)
             .join(seeds.select("page_id", "batch_id"), "page_id")
             .withColumn("link", drop_query_param_col(F.col("link")))
             .withColumn("link_host", hostname(F.col("link")))
             .withColumn("root_domain", root_domain(F.col("link_host"))))
    # the start root of each batch comes once; both outputs are one filter on it
    same = F.col("root_domain") == F.col("start_root")
    return (links.join(start, "batch_id").where(same if keep else ~F.coalesce(same, F.lit(False)))
            .select("page_id", "batch_id", "link", "root_domain"))


def clean_urls(pages: DataFrame, param: str = C.ESCAPED_FRAGMENT_PARAM) -> DataFrame:
    return pages.select("page_id", "url", drop_query_param_col(F.col("url"), param).alias("clean_url"))


def root_domains(pages: DataFrame) -> DataFrame:
    h = hostname(F.col("url"))
    return pages.select("page_id", h.alias("hostname"), root_domain(h).alias("root_domain"))


def distinct_pages(pages: DataFrame) -> DataFrame:
    """One page per URL with its fragment removed (lowest page id wins)."""
    return (pages.select("page_id", strip_fragment(F.col("url")).alias("url_key"))
            .groupBy("url_key").agg(F.min("page_id").alias("page_id")))


def page_records(pages: DataFrame, run_ts: float, method: str = "parser") -> DataFrame:
    """Page records ``(page_id, host, url, content, timestamp, record_size)``;
    ``record_size`` is the length of the record's JSON encoding."""
    fixed = 41 + len(repr(float(run_ts)))
    return (page_text(pages, method)
            .select("page_id", "host", "url", "content",
                    F.lit(float(run_ts)).alias("timestamp"),
                    (F.lit(fixed) + json_string_length(F.col("url"))
                     + json_string_length(F.col("content"))).cast("bigint").alias("record_size")))


def host_pages(pages: DataFrame, run_ts: float, method: str = "parser") -> DataFrame:
    """Per-host buffer totals: records and JSON characters (no flush reset)."""
    return (page_records(pages, run_ts, method).groupBy("host")
            .agg(F.count(F.lit(1)).alias("n_records"),
                 F.sum("record_size").alias("buffer_chars")))
