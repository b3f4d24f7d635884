"""Standing queries: what is new or gone since a baseline, failure streaks, schedules, and counters of searches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.records import as_date

KEY = ["source", "source_id"]


def diff(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(source, source_id, change): ``new`` rows and ``gone`` ones."""
    new = current.select(*KEY).distinct().join(baseline, KEY, "left_anti").withColumn("change", F.lit("new"))
    gone = baseline.select(*KEY).distinct().join(current, KEY, "left_anti").withColumn("change", F.lit("gone"))
    return new.unionByName(gone)


def absent(current: DataFrame, baseline: DataFrame, stable: list[str]) -> DataFrame:
    """Identities (the part of source_id before a colon) of stable sources that the baseline has and the present lacks."""
    identity = F.split("source_id", ":")[0].alias("identity")
    had, has = (d.where(F.col("source").isin(stable)).select("source", identity).distinct() for d in (baseline, current))
    return had.join(has, ["source", "identity"], "left_anti")


def next_baseline(current: DataFrame, baseline: DataFrame, limit: int) -> DataFrame:
    """What the next run compares with: the present's keys first, then older ones, at most max(10 limit, 200)."""
    both = current.select(*KEY, F.lit(0).alias("age")).unionByName(baseline.select(*KEY, F.lit(1).alias("age")))
    return both.groupBy(*KEY).agg(F.min("age").alias("age")).orderBy("age", *KEY).limit(max(10 * limit, 200)).select(*KEY)


def notified(rows: DataFrame, needles: list[str], text: Column, every: bool = False) -> DataFrame:
    """Rows whose text holds any (or every) needle, in lower case; all rows for no needles."""
    if not needles:
        return rows
    hits = [F.contains(F.lower(text), F.lit(n.lower())) for n in needles]
    return rows.where(reduce(Column.__and__ if every else Column.__or__, hits))


def streaks(probes: DataFrame) -> DataFrame:
    """``probes`` (source, seen, ok) with ``fails``: consecutive failures so far, none after a success, unmoved by unknowns."""
    order = Window.partitionBy("source").orderBy("seen").rowsBetween(Window.unboundedPreceding, 0)
    islands = probes.withColumn("_island", F.count_if(F.col("ok")).over(order))
    within = Window.partitionBy("source", "_island").orderBy("seen").rowsBetween(Window.unboundedPreceding, 0)
    return islands.withColumn("fails", F.count_if(~F.col("ok")).over(within)).drop("_island")


def transitions(tracked: DataFrame, least: int = 2) -> DataFrame:
    """Where a source turns down (``least`` failures) or recovers: (source, seen, event)."""
    order = Window.partitionBy("source").orderBy("seen")
    before = F.coalesce(F.lag("fails").over(order), F.lit(0))
    event = F.when((F.col("fails") == least) & (before == least - 1) & ~F.col("ok"), "down").when((F.col("fails") == 0) & (before >= least), "recovered")
    return tracked.select("source", "seen", event.alias("event")).where("event IS NOT NULL")


# The names of weekdays, from Monday.
WEEKDAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]


def parsed_schedule(spec: Column) -> Column:
    """STRUCT<kind, seconds, minutes, day> of a schedule: minutes of the day in order, ``day`` a weekday from 0 or a day of the month.

    ``every:Ns``, ``daily@HH:MM,HH:MM``, ``weekly@mon-HH:MM``, ``monthly@D-HH:MM``; null for what is none of them.
    """
    s = F.trim(spec)
    kind = F.regexp_extract(s, r"^(every|daily|weekly|monthly)[:@]", 1)
    seconds = F.regexp_extract(s, r"^every:\s*\+?(\d+)\s*s$", 1).try_cast("long")
    clocks = F.filter(F.split(F.regexp_extract(s, r"^(?:daily@|(?:weekly|monthly)@[^-]*-)(.*)$", 1), ","), lambda c: c != "")
    sound = F.forall(clocks, lambda c: c.rlike(r"^\s*\d{1,2}\s*:\s*\d{1,2}\s*$") & (F.split(c, ":")[0].try_cast("int") <= 23) & (F.split(c, ":")[1].try_cast("int") <= 59))
    minutes = F.array_sort(F.transform(clocks, lambda c: F.trim(F.split(c, ":")[0]).try_cast("int") * 60 + F.trim(F.split(c, ":")[1]).try_cast("int")))
    weekday = F.nullif(F.array_position(F.array(*map(F.lit, WEEKDAYS)), F.lower(F.trim(F.regexp_extract(s, r"^weekly@([^-]*)-", 1)))), F.lit(0)).cast("int") - 1
    day = F.regexp_extract(s, r"^monthly@\s*(\d{1,2})\s*-", 1).try_cast("int")
    one = (F.size(clocks) == 1) & ~F.contains(s, F.lit(","))
    made = lambda at, n=F.lit(None).cast("long"), m=F.lit(None).cast("array<int>"): F.struct(kind.alias("kind"), n.alias("seconds"), m.alias("minutes"), at.cast("int").alias("day"))
    return (
        F.when((kind == "every") & (seconds > 0), made(F.lit(None), seconds)).when((kind == "daily") & (F.size(clocks) > 0) & sound, made(F.lit(None), m=minutes))
        .when((kind == "weekly") & one & sound & weekday.isNotNull(), made(weekday, m=minutes)).when((kind == "monthly") & one & sound & day.between(1, 31), made(day, m=minutes))
    )


def checked_schedule(spec: Column) -> Column:
    """``spec``; the job fails on one that is no schedule."""
    return F.when(parsed_schedule(spec).isNotNull(), spec).otherwise(F.raise_error(F.concat(F.lit("not a schedule: "), F.coalesce(spec, F.lit("null")))))


def _slots(plan: Column, now: Column, ahead: bool) -> Column:
    """The slots of this and the neighbouring day, week or month; a month without the day has none."""
    today, sign = F.to_date(now), 1 if ahead else -1
    at = lambda d: F.transform(plan["minutes"], lambda m: F.timestamp_add("MINUTE", m, d.cast("timestamp")))
    days = lambda *ds: F.flatten(F.array(*(F.coalesce(at(d), F.array().cast("array<timestamp>")) for d in ds)))
    to_day = F.pmod(plan["day"] - F.weekday(today), F.lit(7)) if ahead else -F.pmod(F.weekday(today) - plan["day"], F.lit(7))
    first = [F.trunc(today, "month"), F.add_months(F.trunc(today, "month"), sign)]
    in_month = [F.when(plan["day"] <= F.day(F.last_day(m)), F.date_add(m, plan["day"] - 1)) for m in first]
    return F.when(plan["kind"] == "daily", days(today, F.date_add(today, sign))).when(plan["kind"] == "weekly", days(F.date_add(today, to_day), F.date_add(today, to_day + 7 * sign))).when(plan["kind"] == "monthly", days(*in_month))


def latest_slot(plan: Column, now: Column) -> Column:
    """The last time at or before ``now`` that a parsed schedule names; null for intervals and for what is no schedule."""
    return F.array_max(F.filter(_slots(plan, now, False), lambda t: t <= now))


def next_slot(plan: Column, now: Column, last_run: Column) -> Column:
    """The first time after ``now``, to be shown: an interval's end, or now if that has passed; null if the next month has none."""
    ends = F.timestamp_add("SECOND", plan["seconds"], F.coalesce(last_run, now))
    return F.when(plan["kind"] == "every", F.greatest(ends, now)).otherwise(F.array_min(F.filter(_slots(plan, now, True), lambda t: t > now)))


def is_due(plan: Column, slot: Column, now: Column, last_run: Column) -> Column:
    """One run for each slot, however many were missed; an interval is due its seconds after the last run."""
    passed = (F.unix_micros(now) - F.unix_micros(last_run)) / 1_000_000
    in_time = F.coalesce(slot.isNotNull() & (last_run.isNull() | (last_run < slot)), F.lit(False))
    return F.when(plan["kind"] == "every", F.coalesce(passed >= plan["seconds"], F.lit(True))).otherwise(in_time)


def scheduled(jobs: DataFrame, schedule: Column, now: Column, last_run: Column) -> DataFrame:
    """``jobs`` with slot (the latest), due and next; what is no schedule has no slot and is never due."""
    now, last_run = now.cast("timestamp"), last_run.cast("timestamp")
    read = jobs.withColumns({"_plan": parsed_schedule(schedule), "_now": now, "_ran": last_run})
    read = read.withColumn("slot", latest_slot(F.col("_plan"), F.col("_now")))
    return read.withColumns({"due": is_due(F.col("_plan"), F.col("slot"), F.col("_now"), F.col("_ran")), "next": next_slot(F.col("_plan"), F.col("_now"), F.col("_ran"))}).drop("_plan", "_now", "_ran")


# The intervals of standing queries; any other word means daily.
INTERVALS = {"hourly": 3600, "daily": 86_400, "weekly": 604_800}


def due_sensors(sensors: DataFrame, now: Column) -> DataFrame:
    """The ``sensors`` (schedule, last_run_at as an ISO text) whose interval has passed; one that never ran, or whose stamp is none, is due."""
    word = F.lower(F.trim(F.coalesce("schedule", F.lit(""))))
    every = F.coalesce(*(F.when(word == w, s) for w, s in INTERVALS.items()), F.lit(INTERVALS["daily"]))
    passed = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(as_date(F.col("last_run_at")))) / 1_000_000
    return sensors.where(F.coalesce(passed >= every, F.lit(True)))


def yields(hits: DataFrame) -> DataFrame:
    """Counters of each source over searches: (source, searches, offered, top, sole, best_rank, r0_2, r3_5, r6_9, r10).

    ``hits`` are (search, source, work, rank): rank is null for rows that were offered and not returned.
    """
    width = hits.groupBy("search", "work").agg(F.count_distinct("source").alias("n"))
    rows = hits.join(width, ["search", "work"])
    bucket = F.when(F.col("rank") <= 2, 0).when(F.col("rank") <= 5, 1).when(F.col("rank") <= 9, 2).otherwise(3)
    ranked = F.col("rank").isNotNull()
    named = [F.count_if(ranked & (bucket == i)).alias(name) for i, name in enumerate(("r0_2", "r3_5", "r6_9", "r10"))]
    return rows.groupBy("source").agg(F.count_distinct("search").alias("searches"), F.count("*").alias("offered"), F.count_if(ranked).alias("top"), F.count_if(ranked & (F.col("n") == 1)).alias("sole"), F.min("rank").alias("best_rank"), *named)


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(a, b), 3), F.lit(0.0))
