"""Freshness of scraped hosts and the fresh/stale split of a URL list.

``(now - t).days <= max_age`` floors whole days, so it is exactly
``t > now - (max_age + 1) days`` (strict); future times count as fresh and
NULL times are ignored.  The comparison is a plain column predicate, so it is
pushed to the Parquet scan.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C


def _cutoff(listing: DataFrame, ts: str, now: str | dt.datetime, max_age_days: int):
    """``now - (max_age + 1) days`` in the listing's own timestamp type (wall-clock
    ``timestamp_ntz`` or instant ``timestamp``), so no session-zone conversion
    enters the comparison."""
    kind = listing.schema[ts].dataType.simpleString()
    now_ts = F.lit(now).cast(kind)
    return now_ts - F.make_dt_interval(F.lit(max_age_days + 1))


def fresh_hosts(listing: DataFrame, now, max_age_days: int = C.MAX_AGE_DAYS,
                host: str = "host", ts: str = "ts") -> DataFrame:
    """``(host, fresh)`` for every host that has at least one timed object."""
    cut = _cutoff(listing, ts, now, max_age_days)
    return (listing.where(F.col(ts).isNotNull())
            .groupBy(host).agg(F.bool_or(F.col(ts) > cut).alias("fresh")))


def fresh_host_set(listing: DataFrame, now, max_age_days: int = C.MAX_AGE_DAYS,
                   host: str = "host", ts: str = "ts") -> DataFrame:
    cut = _cutoff(listing, ts, now, max_age_days)
    return listing.where(F.col(ts) > cut).select(host).distinct()


def split_urls(urls: DataFrame, listing: DataFrame, now, max_age_days: int = C.MAX_AGE_DAYS,
               host: str = "host", ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """``(with_data, to_scrape)``: URLs whose host is fresh, and all others.

    The two outputs partition the input (semi and anti join on host).
    """
    fresh = fresh_host_set(listing, now, max_age_days, host, ts)
    return (urls.join(fresh, host, "left_semi"), urls.join(fresh, host, "left_anti"))
