"""Structured Streaming twins of the stateful operators, in event time: a fixed-window rate limiter, a daily cap, and file-drop ingest.

State is dropped when the watermark says that its window or day is over, never because a clock on the wall has moved on: a
replay of old requests, however slow, finds the windows that it had. The state store must be RocksDB (``STORE``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Windows(StatefulProcessor):
    """A key's window: when it began and how many requests it has let through."""

    def __init__(self, limit: int, window_s: int):
        self.limit, self.window_s = limit, window_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "begun long, n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        begun, n = self.window.get() if self.window.exists() else (None, 0)
        was = begun
        got = pd.concat(list(rows)).sort_values(["second", "id"], kind="stable")
        allowed = []
        for t, uncounted in zip(got["second"].tolist(), got["uncounted"].tolist()):
            if begun is None or t >= begun + self.window_s:
                begun, n = t, 0
            allowed.append(n < self.limit)
            n += not uncounted and n < self.limit
        self.window.update((begun, n))
        if begun != was:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(max((begun + self.window_s) * 1000, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"key": got["key"], "ts": got["ts"], "id": got["id"], "allowed": allowed})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.window.clear()
        return iter([])

    def close(self) -> None:
        pass


def limited_stream(requests: DataFrame, limit: int, window_s: int, late: str = "1 day") -> DataFrame:
    """(key, ts, id, allowed) of a stream of requests (key, ts, id[, uncounted]).

    A key's window begins at its first request outside the one before; windows aren't aligned to the clock, so that
    F.window doesn't fit. Seconds count. Requests of a batch are taken in the order of (ts, id), batches as they come; one
    that is late counts in the window that is open. A window is forgotten when the watermark, ``late`` behind the
    latest request, is past its end. Requests without a time are left out.
    """
    uncounted = F.col("uncounted") if "uncounted" in requests.columns else F.lit(False)
    rows = requests.where("ts IS NOT NULL").select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("id").cast("long").alias("id"), uncounted.alias("uncounted"))
    rows = rows.withColumn("second", F.unix_seconds("ts")).withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(Windows(limit, window_s), "key string, ts timestamp, id long, allowed boolean", "Append", "EventTime")


class Days(StatefulProcessor):
    """How many rows of a local day were kept."""

    def __init__(self, cap: int, zone: str):
        self.cap, self.zone = cap, zone

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = not self.count.exists()
        n = 0 if first else self.count.get()[0]
        got = pd.concat(list(rows)).sort_values(["ts", "id"], kind="stable")
        kept = [n + i < self.cap for i in range(len(got))]
        self.count.update((min(self.cap, n + len(got)),))
        if first:
            end = pd.Timestamp(key[0], tz=self.zone) + pd.Timedelta(days=1)
            self.handle.registerTimer(max(int(end.timestamp() * 1000), timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"local_day": key[0], "id": got["id"], "kept": kept})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.count.clear()
        return iter([])

    def close(self) -> None:
        pass


def capped_stream(rows: DataFrame, cap: int, zone: str = "Asia/Seoul", late: str = "1 day") -> DataFrame:
    """(local_day, id, kept) of a stream (id, ts): the first ``cap`` rows of each local day, in the order of (ts, id) in a
    batch and of batches as they come. A day's count is forgotten when the watermark is past the day's end."""
    timed = rows.where("ts IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    day = F.to_date(F.from_utc_timestamp("ts", zone)).cast("string")
    timed = timed.withColumn("local_day", day).withWatermark("ts", late)
    return timed.groupBy("local_day").transformWithStateInPandas(Days(cap, zone), "local_day string, id long, kept boolean", "Append", "EventTime")


def drained(spark: SparkSession, transform: Callable[[DataFrame], DataFrame], schema: T.StructType, inbox: str, out: str, checkpoint: str, partitions: int | None = None) -> None:
    """Runs a stream over the files that were dropped in ``inbox`` since it last ran, and appends what it gives to ``out``.

    State is dealt to ``partitions`` stores, as many as the session has shuffle partitions unless they are given; the first
    run of a checkpoint decides.
    """
    wanted = STORE | ({} if partitions is None else {"spark.sql.shuffle.partitions": str(partitions)})
    kept = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        files = spark.readStream.schema(schema).parquet(inbox)
        transform(files).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ingest_drops(spark: SparkSession, folder: str, schema: T.StructType, process: Callable[[DataFrame, int], None], checkpoint: str, encoding: str = "UTF-8"):
    """Runs the batch pipeline for each batch of files dropped in a folder, exactly once by the checkpoint's ledger."""
    files = spark.readStream.schema(schema).option("header", True).option("encoding", encoding).csv(folder)
    return files.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
