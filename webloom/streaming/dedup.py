"""Streaming page de-duplication with bounded state.

A page is identified by its URL without fragment.  Duplicates are dropped
within the staleness horizon (30 days by default): the watermark on the fetch
time bounds the de-duplication state, so a URL fetched again after the
horizon counts as new, which is when its stored data would be stale anyway.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.urls import strip_fragment


def distinct_pages_stream(pages: DataFrame, ts_col: str = "fetched_at",
                          horizon_days: int = C.MAX_AGE_DAYS) -> DataFrame:
    """``(page_id, url_key, fetched_at)``: the first arrival of each URL key."""
    return (pages.select("page_id", strip_fragment(F.col("url")).alias("url_key"), ts_col)
            .withWatermark(ts_col, f"{horizon_days} days")
            .dropDuplicatesWithinWatermark(["url_key"]))
