"""Transparent ranking: recency, engagement within a source, and their blend with relevance and corroboration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NO_DATES = 0.3


def age_days(date: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(date)) / 86_400_000_000.0


def recency(date: Column, now: Column) -> Column:
    """1 today, one half at 30 days; null for no date."""
    return F.when(date.isNotNull(), 1 / (1 + F.greatest(age_days(date, now), F.lit(0.0)) / 30))


def engagement(rows: DataFrame, attention: str = "attention", source: str = "source") -> DataFrame:
    """``rows`` with ``eng``: the mid-rank percentile of attention among the source's rows that have any; else 0.

    Ranks come from the distinct values of each source with their counts, a table that the rows' aggregation makes
    small before it is sorted.
    """
    counts = rows.where(F.col(attention) > 0).groupBy(source, attention).count()
    below = Window.partitionBy(source).orderBy(attention).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(source)
    shares = counts.select(source, attention, ((F.coalesce(F.sum("count").over(below), F.lit(0)) + F.col("count") * F.lit(0.5).cast("double")) / F.sum("count").over(whole)).alias("eng"))
    return rows.join(shares, [source, attention], "left").withColumn("eng", F.coalesce("eng", F.lit(0.0)))


def upper_median(rows: DataFrame, column: str) -> DataFrame:
    """One row ``m``: the element at place n // 2 of the sorted values; null if there is none."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).count()
    order = Window.orderBy(column)
    ranked = counts.select(column, F.sum("count").over(order).alias("upto"), F.sum("count").over(Window.partitionBy()).alias("n"))
    return ranked.where("upto > n div 2").agg(F.min(column).alias("m"))


def composite(rows: DataFrame, now: Column, with_terms: bool) -> DataFrame:
    """``rows`` with ``composite``; they have rel, rrf, date, eng and corroboration, and are the whole candidate set."""
    aged = rows.withColumn("rec", recency(F.col("date"), now))
    unknown = upper_median(aged.withColumn("rec", F.round("rec", 12)), "rec")
    tops = aged.agg(F.max("rel").alias("_rel"), F.max("rrf").alias("_rrf"))
    both = aged.crossJoin(F.broadcast(unknown)).crossJoin(F.broadcast(tops))  # one row each
    one = lambda c: F.when(F.coalesce(F.col(c), F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col(c))
    rec = F.coalesce("rec", "m", F.lit(NO_DATES))
    rel = F.col("rel") / one("_rel")
    rel = F.when(F.coalesce("rrf", F.lit(0.0)) > 0, F.greatest(rel, F.col("rrf") / one("_rrf"))).otherwise(rel)
    base = 0.60 * rel + 0.25 * rec + 0.15 * F.col("eng") if with_terms else 0.70 * rec + 0.30 * F.col("eng")
    return both.select(*rows.columns, (base * (1 + 0.15 * F.least(F.lit(1.0), (F.col("corroboration") - 1) / 3))).alias("composite"))


def freshness(date: Column, now: Column) -> Column:
    days = F.round(age_days(date, now), 1)
    return F.when(days <= 1, "breaking").when(days <= 7, "recent").when(days <= 30, "current").when(days <= 365, "dated").when(days.isNotNull(), "archival")
