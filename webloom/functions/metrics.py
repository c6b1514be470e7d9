"""Run metrics gathered while a job runs (no extra action).

``observed(df, obs, name)`` attaches a row count to ``df``; after an action
on the result, ``obs.get`` holds ``{name: rows}``.  Used for the counts a
pipeline reports (splits generated, links found, documents loaded).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def observed(df: DataFrame, obs: Observation | None, name: str = "rows") -> DataFrame:
    if obs is None:
        return df
    return df.observe(obs, F.count(F.lit(1)).alias(name))
