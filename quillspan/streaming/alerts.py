"""Alerts that are told at most once in a while: a state machine with timers for each key.

A key's state is when it was last told.  A timer takes the state away when the cooldown is over, so that keys that fell
silent cost nothing.  The state is in the checkpoint: a restarted query goes on with the cooldowns that ran.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Cooldown(StatefulProcessor):
    """Emits a key's first alert, and each later one that comes ``seconds`` or more after the last that was emitted."""

    def __init__(self, seconds: int):
        self.micros = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.told = handle.getValueState("told", "at long")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        frame = pd.concat(list(rows)).sort_values("micros", kind="stable")
        last = self.told.get()[0] if self.told.exists() else None
        kept = []
        for micros in frame["micros"].tolist():
            fresh = last is None or micros - last >= self.micros
            kept.append(fresh)
            last = micros if fresh else last
        self.told.update((int(last),))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((last + self.micros) // 1000 + 1)
        yield frame.loc[kept, ["key", "title", "micros"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        self.told.clear()
        yield pd.DataFrame({"key": [], "title": [], "micros": []}).astype({"key": str, "title": str, "micros": "int64"})


def cooled(alerts: DataFrame, seconds: int, late: str = "10 minutes") -> DataFrame:
    """A stream of alerts (key, title, at) without those that come within ``seconds`` of the last one told of their key.

    Alerts that are later than the watermark may find their key's state gone and are dropped.  The session's state store
    must be ``STATE_STORE``.
    """
    timed = alerts.withWatermark("at", late).withColumn("micros", F.unix_micros("at")).where("key IS NOT NULL AND at IS NOT NULL")
    told = timed.groupBy("key").transformWithStateInPandas(Cooldown(seconds), "key string, title string, micros long", "append", "EventTime")
    return told.select("key", "title", F.timestamp_micros("micros").alias("at"))


def told_once(alerts: DataFrame, seconds: int) -> DataFrame:
    """The same over a table of alerts (key, title, at): sorted by key and time, scanned with the last one told as only state.

    Alerts at one time come in the order of their titles.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, last = None, 0
        for batch in batches:
            kept = []
            for k, micros in zip(batch.column("key").to_pylist(), batch.column("micros").to_pylist()):
                fresh = k != key or micros - last >= seconds * 1_000_000
                kept.append(fresh)
                key, last = k, micros if fresh else last
            yield batch.filter(pa.array(kept, pa.bool_()))

    timed = alerts.where("key IS NOT NULL AND at IS NOT NULL").select("key", "title", F.unix_micros(F.col("at").cast("timestamp")).alias("micros"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in timed.schema.fields)
    told = timed.repartition("key").sortWithinPartitions("key", "micros", "title").mapInArrow(run, kinds)
    return told.select("key", "title", F.timestamp_micros("micros").alias("at"))


def quiet_keys(alerts: DataFrame, seconds: int, now: Column) -> DataFrame:
    """(key, until): the keys that are told nothing more for now, and until when."""
    last = told_once(alerts.where(F.col("at") <= now), seconds).groupBy("key").agg(F.max("at").alias("last"))
    until = F.timestamp_add("SECOND", F.lit(seconds), F.col("last"))
    return last.select("key", until.alias("until")).where(F.col("until") > now)
