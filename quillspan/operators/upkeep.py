"""Keeping stores in order: caches that forget by whole folders, and backlogs that are worked off page by page."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder's rows, none where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class Cache:
    """Values with an end, in folders by the span of time in which they end.

    A folder whose span has passed holds nothing that is alive, so purging takes folders and reads no rows; what has
    ended within a span that still runs is no hit and goes with its folder.
    """

    SCHEMA = "key string, value string, expires_at timestamp, written_at timestamp, span long"

    def __init__(self, spark: SparkSession, path: str, seconds: int = 86_400):
        self.spark, self.path, self.seconds = spark, path, seconds

    def span(self, at: Column) -> Column:
        return F.floor(F.unix_micros(at) / 1_000_000 / self.seconds).cast("long")

    def put(self, rows: DataFrame, now: Column) -> None:
        """Add (key, value, expires_at)."""
        kept = rows.select("key", "value", F.col("expires_at").cast("timestamp").alias("expires_at"), now.cast("timestamp").alias("written_at"))
        kept.withColumn("span", self.span(F.col("expires_at"))).write.mode("append").partitionBy("span").parquet(self.path)

    def entries(self) -> DataFrame:
        return read_or_none(self.spark, self.path, self.SCHEMA)

    def hits(self, keys: DataFrame, now: Column, margin: int = 0, fresh: bool = False) -> DataFrame:
        """(key, value) of the asked keys that live ``margin`` seconds more; the newest value of a key.  ``fresh`` asks for none."""
        until = F.timestamp_add("SECOND", F.lit(margin), now.cast("timestamp"))
        alive = self.entries().where((F.col("span") >= self.span(until)) & (F.col("expires_at") >= until))
        newest = alive.groupBy("key").agg(F.max(F.struct("written_at", "expires_at", "value")).alias("e")).select("key", "e.value")
        return newest.join(keys.select("key").distinct(), "key", "left_semi").where(F.lit(not fresh))

    def purge(self, now: Column) -> int:
        """Empty the folders whose span has passed; how many were emptied."""
        past = self.entries().where(F.col("span") < self.span(now.cast("timestamp")))
        spans = [r["span"] for r in past.select("span").distinct().collect()]  # a row for each folder
        for span in spans:
            self.spark.range(0).write.mode("overwrite").parquet(f"{self.path}/span={span}")
        return len(spans)


def backlog(todo: DataFrame, done: DataFrame, version: str) -> DataFrame:
    """The rows of ``todo`` (key, text) that say something and have no result of this version."""
    stale = done.where(F.col("version") == version).select("key")
    said = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\s\p{Z}]+", "") != ""  # else a blank would come up for ever
    return todo.where(said).join(stale, "key", "left_anti")


def catch_up(todo: DataFrame, path: str, make: Callable[[DataFrame], DataFrame], version: str, page: int = 100_000, most: int | None = None) -> int:
    """Work off a backlog by pages in the order of keys until a whole pass finds nothing; how many pages were written.

    ``make`` gives (key, result) for a page of (key, text).  A page is appended at once and the folder is the only state:
    the last page's greatest key says where a pass stands, and what is there already is never made again.  So a run
    that was stopped, here by ``most`` pages, goes on where it was, and rows that came in behind the cursor are found by
    the next pass.
    """
    spark, schema, written = todo.sparkSession, f"key {todo.schema['key'].dataType.simpleString()}, result string, version string, page long", 0
    fresh_pass = False
    while most is None or written < most:
        done = read_or_none(spark, path, schema)
        last = done.where(F.col("version") == version).agg(F.max(F.struct("page", "key")).alias("at")).first()["at"]
        rows = backlog(todo, done, version)
        if last is not None and not fresh_pass:
            rows = rows.where(F.col("key") > last["key"])
        some = rows.orderBy("key").limit(page)
        made = make(some).select("key", "result", F.lit(version).alias("version"), F.lit((last["page"] if last else 0) + 1).alias("page"))
        if some.isEmpty():
            if fresh_pass or last is None:
                return written
            fresh_pass = True  # once more from the first key
            continue
        made.write.mode("append").parquet(path)
        written, fresh_pass = written + 1, False
    return written
