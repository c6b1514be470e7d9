"""Running feedback statistics over a stream of ratings, as a log of changes.

A micro-batch writes only the keys whose statistics it changed (update mode),
in a folder of its own epoch; a reader takes each key's row of the latest
epoch.  A replayed epoch writes its folder again, so nothing is counted twice.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.answers import EXACT
from ..session import cut_lineage, path_exists, remove_path

EPOCH = "epoch"


def running_feedback(ratings: DataFrame, key: str = "question", rating: str = "rating") -> DataFrame:
    """Streaming aggregate ``(question, feedback_count, feedback_sum, average_feedback)``."""
    t = ratings.groupBy(key).agg(F.count(F.lit(1)).alias("n"),
                                 F.sum(F.col(rating).cast(EXACT)).alias("total"))
    return t.select(key, F.col("n").alias("feedback_count"),
                    F.round("total", 4).cast("double").alias("feedback_sum"),
                    F.round(F.col("total") / F.col("n"), 6).cast("double").alias("average_feedback"))


def write_epoch(changes: DataFrame, epoch_id: int, path: str) -> None:
    """The changed keys' rows of one micro-batch, in the epoch's folder."""
    changes.write.mode("overwrite").parquet(f"{path}/{EPOCH}={epoch_id}")


def write_changes(stats: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Start the stream of changes; returns the ``StreamingQuery``."""
    w = (stats.writeStream.outputMode("update").foreachBatch(lambda df, epoch_id: write_epoch(df, epoch_id, path))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def _latest(log: DataFrame, key: str) -> DataFrame:
    values = [c for c in log.columns if c not in (key, EPOCH)]
    newest = log.groupBy(key).agg(F.max(F.struct(F.col(EPOCH).cast("long").alias("at"), *values)).alias("r"))
    return newest.select(key, F.col("r.at").alias(EPOCH), *[F.col(f"r.{c}").alias(c) for c in values])


def latest_feedback(spark: SparkSession, path: str, key: str = "question") -> DataFrame:
    """Each key's current statistics: one aggregate over the log."""
    return _latest(spark.read.parquet(path), key).drop(EPOCH)


def compact_feedback(spark: SparkSession, path: str, key: str = "question") -> int | None:
    """Fold all epochs but the last, which may still be replayed, into the one before it;
    the epoch they were folded into, None where there is nothing to fold.  The rows are
    checkpointed first; while older folders are still there, readers get the same result."""
    epochs = sorted(r[0] for r in spark.read.parquet(path).select(F.col(EPOCH).cast("long")).distinct().collect())
    if len(epochs) < 3:
        return None
    into = epochs[-2]
    rows = cut_lineage(_latest(spark.read.parquet(path).where(F.col(EPOCH) <= into), key).drop(EPOCH))
    write_epoch(rows, into, path)
    for e in epochs[:-2]:
        if path_exists(spark, f"{path}/{EPOCH}={e}"):
            remove_path(spark, f"{path}/{EPOCH}={e}")
    return into
