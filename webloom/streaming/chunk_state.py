"""Per-host buffer flushes as keyed streaming state.

State per host is two numbers (current fill, current chunk number); each
micro-batch sorts a host's new records by order key, replays the flush rule
from the stored state, emits the chunk number of every record and stores the
new state.  The last, partial chunk needs no timer: its records already carry
their chunk number.

Records that arrive out of order are kept in list state until the watermark has
passed their time, when a timer replays them in the order of (time, ord).
Records later than the delay are dropped by Spark and counted in the query's
progress.  Both forms require the RocksDB state store provider.
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from .. import constants as C

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT_SCHEMA = "host string, ord long, chunk_no long"


class HostBuffer(StatefulProcessor):
    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle) -> None:
        self.buf = handle.getValueState("buf", "fill long, chunk long")

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows)).sort_values("ord")
        fill, chunk = (int(x) for x in self.buf.get()) if self.buf.exists() else (0, 0)
        out = []
        for size in pdf["size"]:
            out.append(chunk)
            fill += int(size)
            if fill >= self.limit:
                fill, chunk = 0, chunk + 1
        self.buf.update((fill, chunk))
        yield pd.DataFrame({"host": key[0], "ord": pdf["ord"].to_numpy(), "chunk_no": out})

    def close(self) -> None:
        pass


class LateHostBuffer(StatefulProcessor):
    """State: (fill, chunk number), and the waiting records as (time in ms, ord, size)."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle) -> None:
        self.handle = handle
        self.buf = handle.getValueState("buf", "fill long, chunk long")
        self.waiting = handle.getListState("waiting", "at long, ord long, size long")

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for pdf in rows:     # one Arrow batch at a time
            at = pdf["at"].astype("int64")
            self.waiting.appendList(list(zip(at.tolist(), pdf["ord"].tolist(), pdf["size"].tolist())))
            first = int(at.min()) if first is None else min(first, int(at.min()))
        if first is not None:
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        upto = timerValues.getCurrentWatermarkInMs()
        due, later = [], []
        for row in (tuple(int(x) for x in r) for r in self.waiting.get()):
            (due if row[0] <= upto else later).append(row)
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(min(r[0] for r in later))
        else:
            self.waiting.clear()
        if not due:          # an earlier timer of this batch has replayed them
            return
        due.sort()
        fill, chunk = (int(x) for x in self.buf.get()) if self.buf.exists() else (0, 0)
        out = []
        for _at, _ord, size in due:
            out.append(chunk)
            fill += size
            if fill >= self.limit:
                fill, chunk = 0, chunk + 1
        self.buf.update((fill, chunk))
        yield pd.DataFrame({"host": key[0], "ord": [r[1] for r in due], "chunk_no": out})

    def close(self) -> None:
        pass


def assign_chunks_late(records: DataFrame, limit: int = C.FLUSH_CHARS, delay: str = "1 hour") -> DataFrame:
    """Streaming ``(host, ord, chunk_no)`` from ``(host, ord, size, ts)`` records that arrive in
    any order, up to ``delay`` late.  Chunks fill in the order of (``ts`` in ms, ``ord``); a
    record's number is emitted once the watermark has passed it.  A task holds the waiting
    records of one host, three numbers each."""
    _rocksdb(records)
    rows = records.withWatermark("ts", delay).withColumn("at", F.unix_millis("ts"))
    return rows.groupBy("host").transformWithStateInPandas(
        statefulProcessor=LateHostBuffer(limit), outputStructType=OUT_SCHEMA, outputMode="Append", timeMode="EventTime")


def _rocksdb(records: DataFrame) -> None:
    spark = records.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def assign_chunks_stream(records: DataFrame, limit: int = C.FLUSH_CHARS) -> DataFrame:
    """Streaming ``(host, ord, chunk_no)`` from ``(host, ord, size)`` records
    that arrive in order per host across micro-batches."""
    _rocksdb(records)
    return records.groupBy("host").transformWithStateInPandas(
        statefulProcessor=HostBuffer(limit), outputStructType=OUT_SCHEMA,
        outputMode="Append", timeMode="None")
