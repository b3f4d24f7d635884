"""Streams: the journal's materialiser, consecutive-duplicate suppression, health tracking and counters.

A journal is a folder of event files.  The checkpoint is the replay cursor, and each batch writes a snapshot of its
own number, so that a batch that is run again after a failure overwrites itself and nothing is applied twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "seq long, source string, source_id string, kind string, payload_hash string, payload string, observed_at timestamp"


def _snapshot(path: str, number: int) -> str:
    return f"{path}/snapshot={number:012d}"


def _numbers(spark: SparkSession, path: str) -> list[int]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    done = lambda p: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(folder) if s.getPath().getName().startswith("snapshot=") and done(s.getPath()))


def read_snapshot(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The last whole snapshot, or the last one before a batch number; no rows if there is none."""
    numbers = [n for n in _numbers(spark, path) if before is None or n < before]
    if not numbers:
        return spark.createDataFrame([], "source string, source_id string, payload_hash string, payload string, version int, first_seen timestamp, last_seen timestamp, last_seq long")
    return spark.read.parquet(_snapshot(path, numbers[-1]))


def apply_events(current: DataFrame, events: DataFrame) -> DataFrame:
    """The projection after some events: versions move on with changed payloads, tombstones take rows out."""
    before = current.select("source", "source_id", F.struct("payload_hash", "payload", "version", "first_seen", "last_seen", "last_seq").alias("was"))
    ordered = events.groupBy("source", "source_id").agg(
        F.max_by(F.struct("kind", "payload_hash", "payload", "observed_at", "seq"), "seq").alias("e"), F.min("observed_at").alias("first"),
        F.array_sort(F.collect_list(F.struct("seq", "kind", "payload_hash"))).alias("all"),
    )
    both = before.join(ordered, ["source", "source_id"], "full_outer")
    start = F.struct(F.col("was.payload_hash").alias("h"), F.coalesce(F.col("was.version"), F.lit(0)).alias("n"))
    step = lambda s, x: F.struct(x["payload_hash"].alias("h"), F.when((x["kind"] == "observation") & ~x["payload_hash"].eqNullSafe(s["h"]), s["n"] + 1).otherwise(s["n"]).alias("n"))
    version = F.when(F.col("e").isNull(), F.col("was.version")).otherwise(F.aggregate("all", start, step)["n"])
    new = lambda name, was: F.coalesce(F.col(f"e.{name}"), F.col(f"was.{was}"))
    rows = both.where(F.col("e").isNull() | (F.col("e.kind") != "tombstone"))
    return rows.select(
        "source", "source_id", new("payload_hash", "payload_hash").alias("payload_hash"), new("payload", "payload").alias("payload"), version.cast("int").alias("version"),
        F.coalesce("was.first_seen", "first").alias("first_seen"), new("observed_at", "last_seen").alias("last_seen"), new("seq", "last_seq").alias("last_seq"),
    )


def materialise_journal(spark: SparkSession, journal: str, store: str, checkpoint: str, files_at_once: int = 100):
    """Replay what a journal folder has gained; returns the finished query."""

    def batch(events: DataFrame, number: int) -> None:
        apply_events(read_snapshot(spark, store, number), events).write.mode("overwrite").parquet(_snapshot(store, number))

    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_at_once).json(journal)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def appended(events: DataFrame) -> DataFrame:
    """A stream of observations without those whose payload is what the identity had last: A, A, B, A gives A, B, A."""

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for frame in frames:
            frame = frame.sort_values("seq")
            shifted = frame["payload_hash"].shift(1)
            if len(frame):
                shifted.iloc[0] = last
                last = frame["payload_hash"].iloc[-1]
            yield frame[frame["payload_hash"] != shifted]
        state.update((last,))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields)
    return events.groupBy("source", "source_id").applyInPandasWithState(run, kinds, "last string", "append", "NoTimeout")


def health(probes: DataFrame, least: int = 2) -> DataFrame:
    """A stream of (source, seen, ok) as alerts (source, seen, event): down at ``least`` failures in a row, recovered after them."""

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        fails, out = state.get[0] if state.exists else 0, []
        for frame in frames:
            for seen, ok in frame.sort_values("seen")[["seen", "ok"]].itertuples(index=False):
                if ok is None or pd.isna(ok):
                    continue
                if ok and fails >= least:
                    out.append((key[0], seen, "recovered"))
                fails = 0 if ok else fails + 1
                if not ok and fails == least:
                    out.append((key[0], seen, "down"))
        state.update((fails,))
        yield pd.DataFrame(out, columns=["source", "seen", "event"])

    return probes.groupBy("source").applyInPandasWithState(run, "source string, seen long, event string", "fails int", "append", "NoTimeout")


def running_yields(hits: DataFrame) -> DataFrame:
    """A stream of (source, rank) as counters of each source, for update mode; the trigger flushes them."""
    return hits.groupBy("source").agg(F.count("*").alias("offered"), F.count("rank").alias("top"), F.min("rank").alias("best_rank"))


def activity(events: DataFrame, late: str = "1 hour", size: str = "6 hours") -> DataFrame:
    """Beyond the standing queries: counts by event-time windows, closed when the watermark passes."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
