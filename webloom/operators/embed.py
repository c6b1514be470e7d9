"""A model-free embedder: signed hashing of tokens to a fixed width.

Each token adds or subtracts one at one place of the vector, both taken from
its md5, so vectors need no fitting, are equal on every machine, and hold whole
numbers (cosines do not depend on the order of summation).  Texts without a
token, null ones included, have no vector.  Counting and hashing are DataFrame
functions; NumPy only fills the vectors.  A text is exchanged once, by its id.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from .retrieval import bounded_parts, explode_tokens

WIDTH = 256


def token_hash(token: Column) -> Column:
    """The first 32 bits of the token's md5, as a bigint."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint")


def _filled(width: int, rows: int = 1024):
    """Vectors from their places and values, some rows at a time."""
    def fill(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                ks, vs = part.column("ks"), part.column("vs")
                out = np.zeros((part.num_rows, width))
                out[np.repeat(np.arange(part.num_rows), ks.value_lengths().to_numpy(zero_copy_only=False)),
                    ks.flatten().to_numpy(zero_copy_only=False)] = vs.flatten().to_numpy(zero_copy_only=False)
                ends = pa.array(np.arange(part.num_rows + 1) * width, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))],
                                                 names=["id", "embedding"])
    return fill


def hashing_embedder(width: int = WIDTH) -> Callable[[DataFrame], DataFrame]:
    """``(id, text)`` to ``(id, embedding array<double>)``: the place of a token is
    its hash modulo ``width``, its sign the parity of the hash divided by ``width``."""
    def embed(texts: DataFrame) -> DataFrame:
        known = texts.where(F.col("id").isNotNull()).select("id", "text")
        parts = bounded_parts(known, "text")
        # a token is hashed once a text, however often it stands there
        rows = (explode_tokens(known.repartition(parts, F.col("id")), [F.col("id")], tokens(F.col("text")))
                .groupBy("id", "token").agg(F.count(F.lit(1)).alias("n")).withColumn("h", token_hash(F.col("token"))))
        sign = F.when(F.floor(F.col("h") / width) % 2 == 0, 1).otherwise(-1)
        places = (rows.select("id", F.pmod("h", F.lit(width)).cast("int").alias("k"), (sign * F.col("n")).alias("v"))
                  .groupBy("id", "k").agg(F.sum("v").cast("double").alias("v")))
        # at most ``width`` entries a text
        at = places.groupBy("id").agg(F.collect_list(F.struct("k", "v")).alias("at"))
        kind = at.schema["id"].dataType.simpleString()
        return (at.select("id", F.col("at.k").alias("ks"), F.col("at.v").alias("vs"))
                .mapInArrow(_filled(width), f"id {kind}, embedding array<double>"))
    return embed
