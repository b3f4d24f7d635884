"""Versioned memory: upserts by identity, first and last sight, retention, novelty; and the observation journal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["source", "source_id"]


def content_hash(title: Column, content: Column, tags: Column | None = None) -> Column:
    parts = [F.coalesce(c, F.lit("")) for c in (title, content, tags if tags is not None else F.lit(""))]
    return F.sha2(F.concat_ws("\x00", *parts), 256)


def upsert(current: DataFrame, staged: DataFrame, now: Column) -> DataFrame:
    """The snapshot after an observation.

    Both are by (source, source_id) with content_hash and seg_version; ``current`` has first_seen, last_seen, version and
    vector too.  An unchanged row only moves last_seen; a changed one takes the next version and drops its vector;
    first_seen never changes.  Rows that were not observed stay, so a partial run speaks for what it saw alone.
    """
    latest = staged.groupBy(*KEY).agg(F.max_by(F.struct("content_hash", "seg_version"), "pos").alias("new"))
    both = current.join(latest, KEY, "full_outer")
    new = F.col("new")
    same = new.isNull() | ((F.col("content_hash") == new["content_hash"]) & (F.col("seg_version") == new["seg_version"]))
    same = F.coalesce(same, F.lit(False))
    return both.select(
        *KEY, F.when(same, F.col("content_hash")).otherwise(new["content_hash"]).alias("content_hash"), F.when(same, F.col("seg_version")).otherwise(new["seg_version"]).alias("seg_version"),
        F.coalesce("first_seen", now).alias("first_seen"), F.when(new.isNull(), F.col("last_seen")).otherwise(now).alias("last_seen"),
        F.when(same, F.col("version")).otherwise(F.coalesce("version", F.lit(0)) + 1).alias("version"), F.when(same, F.col("vector")).alias("vector"),
    )


def swept(rows: DataFrame, now: Column, keep_days: int = 365) -> DataFrame:
    """Tombstones (source, source_id, reason) of rows that are past retention and not immutable."""
    old = F.col("last_seen") < now - F.make_dt_interval(F.lit(keep_days))
    return rows.where(old & ~F.coalesce("immutable", F.lit(False))).select(*KEY, F.lit("expired").alias("reason"))


def seen_before(hits: DataFrame, known: DataFrame | None, start: Column) -> DataFrame:
    """``hits`` with ``seen_before``: first sight before the search began; null where the memory can't be asked."""
    if known is None:
        return hits.withColumn("seen_before", F.lit(None).cast("boolean"))
    firsts = known.groupBy(*KEY).agg(F.min("first_seen").alias("_first"))
    return hits.join(firsts, KEY, "left").withColumn("seen_before", F.coalesce(F.col("_first") < start, F.lit(False))).drop("_first")


def hydrated(rows: DataFrame, watermarks: DataFrame, now: Column) -> DataFrame:
    """``rows`` with still_live (seen in the source's last run) and index_age_days."""
    age = F.round((F.unix_micros(now) - F.unix_micros("last_seen")) / 86_400_000_000.0, 1)
    live = F.col("ran_at").isNotNull() & (F.col("last_seen") >= F.col("ran_at"))
    return rows.join(watermarks, "source", "left").withColumns({"still_live": live, "index_age_days": age}).drop("ran_at")


def journal_events(observations: DataFrame) -> DataFrame:
    """Observations that a journal appends: those whose payload differs from the latest event of the same identity.

    A, A, B, A leaves A, B, A.
    """
    before = F.lag("payload_hash").over(Window.partitionBy("observation_id").orderBy("seq"))
    return observations.withColumn("_before", before).where(~F.col("payload_hash").eqNullSafe(F.col("_before"))).drop("_before")


def chain_faults(events: DataFrame) -> DataFrame:
    """Events whose prev_hash is not the event before them, by seq; a sound journal has none.

    Only the first event may have no one before it.  Each row meets its predecessor by seq, so no task sorts the journal.
    """
    before = events.select((F.col("seq") + 1).alias("seq"), F.col("event_hash").alias("_before"))
    linked = events.join(before, "seq", "left")
    first = events.agg(F.min("seq").alias("_first"))
    bad = F.when(F.col("seq") == F.col("_first"), F.col("prev_hash") != "").otherwise(~F.col("prev_hash").eqNullSafe(F.col("_before")))
    return linked.crossJoin(F.broadcast(first)).where(bad).select("seq", "prev_hash", F.col("_before").alias("expected"))


def event_hash(*fields: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*fields)), 256)
