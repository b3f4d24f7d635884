"""Queries over memory, the journal and standing queries; observations and probes are made from documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import memory, monitor
from quillspan.plans.retrieval import table

NOW = "2024-02-10 12:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def current(spark, sf):
    docs = table(spark, sf, "documents").where("doc_id % 4 <> 3")
    return docs.select(
        "source", F.col("doc_id").cast("string").alias("source_id"), memory.content_hash(F.lit(""), F.col("text")).alias("content_hash"), (F.col("doc_id") % 2).cast("int").alias("seg_version"),
        F.expr("timestampadd(DAY, CAST(doc_id % 300 AS INT), TIMESTAMP '2022-06-01')").alias("first_seen"), F.expr("timestampadd(DAY, CAST(doc_id % 400 AS INT), TIMESTAMP '2022-12-01')").alias("last_seen"),
        F.lit(1).alias("version"), F.col("doc_id").alias("vector"), (F.col("doc_id") % 11 == 0).alias("immutable"),
    )


def staged(spark, sf):
    docs = table(spark, sf, "documents").where("doc_id % 3 <> 0")
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    return docs.select("source", F.col("doc_id").cast("string").alias("source_id"), memory.content_hash(F.lit(""), text).alias("content_hash"), F.lit(1).alias("seg_version"), F.col("doc_id").alias("pos"))


CURRENT = """current AS (SELECT source, doc_id::VARCHAR AS source_id, sha256(chr(0) || text || chr(0)) AS content_hash, (doc_id % 2)::INTEGER AS seg_version,
  TIMESTAMP '2022-06-01' + to_days((doc_id % 300)::INTEGER) AS first_seen, TIMESTAMP '2022-12-01' + to_days((doc_id % 400)::INTEGER) AS last_seen, 1 AS version, doc_id AS vector, doc_id % 11 = 0 AS immutable FROM documents WHERE doc_id % 4 <> 3),
staged AS (SELECT source, doc_id::VARCHAR AS source_id, sha256(chr(0) || CASE WHEN doc_id % 5 = 0 THEN text || ' edited' ELSE text END || chr(0)) AS content_hash, 1 AS seg_version FROM documents WHERE doc_id % 3 <> 0)"""


def memory_upsert(spark, sf):
    return memory.upsert(current(spark, sf), staged(spark, sf), now())


def memory_sweep(spark, sf):
    return memory.swept(current(spark, sf), now())


def seen_before(spark, sf):
    return memory.seen_before(staged(spark, sf).select("source", "source_id"), current(spark, sf), F.lit("2022-12-15").cast("timestamp"))


def still_live(spark, sf):
    marks = table(spark, sf, "documents").where("CAST(substr(source, 4) AS INT) % 4 <> 0").groupBy("source").agg(F.expr("timestampadd(DAY, CAST(max(doc_id) % 300 AS INT), TIMESTAMP '2023-01-01')").alias("ran_at"))
    return memory.hydrated(current(spark, sf), marks, now()).select("source", "source_id", "still_live", "index_age_days")


def observations(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("observation_id"), F.col("event_id").alias("seq"), F.sha2(F.col("event_type"), 256).alias("payload_hash"))


def journal_append(spark, sf):
    return memory.journal_events(observations(spark, sf))


def journal_chain(spark, sf):
    """Hashes chain along event ids; every 500th link is broken."""
    e = table(spark, sf, "events")
    own = lambda i: F.sha2(F.concat(F.lit("e"), i.cast("string")), 256)
    first = e.agg(F.min("event_id").alias("least"))
    prev = F.when(F.col("event_id") == F.col("least"), F.lit("")).when(F.col("event_id") % 500 == 7, F.lit("broken")).otherwise(own(F.col("event_id") - 1))
    return memory.chain_faults(e.crossJoin(F.broadcast(first)).select(F.col("event_id").alias("seq"), own(F.col("event_id")).alias("event_hash"), prev.alias("prev_hash")))


def _day(spark, sf, day: int):
    e = table(spark, sf, "events").where(f"day(ts) = {day}")
    return e.selectExpr("event_type AS source", "concat(user_id, ':', event_id % 3) AS source_id").distinct()


def sensor_diff(spark, sf):
    return monitor.diff(_day(spark, sf, 12), _day(spark, sf, 11))


def sensor_absence(spark, sf):
    return monitor.absent(_day(spark, sf, 12), _day(spark, sf, 11), ["click", "view", "purchase"])


def sensor_baseline(spark, sf):
    return monitor.next_baseline(_day(spark, sf, 12), _day(spark, sf, 11), 15)


def sensor_notify(spark, sf):
    docs = table(spark, sf, "documents")
    some = monitor.notified(docs, ["password", "AKIA"], F.col("text")).select("doc_id", F.lit("any").alias("rule"))
    return some.unionByName(monitor.notified(docs, ["the", "and", "of"], F.col("text"), True).select("doc_id", F.lit("every").alias("rule")))


def probes(spark, sf):
    return table(spark, sf, "events").selectExpr("concat('u', user_id % 40) AS source", "event_id AS seen", "CASE WHEN event_type IN ('error', 'purchase') THEN false WHEN event_type = 'view' THEN NULL ELSE true END AS ok")


def health_streaks(spark, sf):
    return monitor.streaks(probes(spark, sf))


def health_transitions(spark, sf):
    return monitor.transitions(monitor.streaks(probes(spark, sf)))


SCHEDULES = ["daily@06:30", "daily@13:00,5:15,", "weekly@mon-09:00", "weekly@Sat-12:00", "monthly@31-08:15", "monthly@5-00:00", "every:3600s", "weekly@1 09:00"]


def schedules(spark, sf):
    events = table(spark, sf, "events")
    rows = events.select("event_id", "ts", F.element_at(F.array(*map(F.lit, SCHEDULES)), (F.col("event_id") / 10 % 8).cast("int") + 1).alias("schedule"))
    ran = F.when(F.col("event_id") % 30 != 0, F.expr("ts - INTERVAL 9 HOURS"))
    found = monitor.scheduled(rows, F.col("schedule"), F.col("ts"), ran)
    return found.select("event_id", "slot", "due", F.when(F.col("schedule") != "every:3600s", F.col("next")).alias("next"))


def search_yields(spark, sf):
    lines = table(spark, sf, "lineitem")
    hits = lines.selectExpr("l_orderkey % 50 AS search", "concat('s', l_suppkey % 12) AS source", "l_partkey AS work", "CASE WHEN l_linenumber < 5 THEN CAST(l_quantity AS INT) % 15 END AS rank")
    found = monitor.yields(hits)
    return found.withColumns({"sole_share": monitor.ratio(F.col("sole"), F.col("top")), "presence_rate": monitor.ratio(F.col("top"), F.col("offered"))})


DAY = lambda d: f"SELECT DISTINCT event_type AS source, user_id || ':' || (event_id % 3) AS source_id FROM events WHERE day(ts) = {d}"
STREAKS = """probes AS (SELECT 'u' || (user_id % 40) AS source, event_id AS seen, CASE WHEN event_type IN ('error', 'purchase') THEN false WHEN event_type = 'view' THEN NULL ELSE true END AS ok FROM events),
isl AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY source ORDER BY seen) AS i FROM probes), st AS (SELECT source, seen, ok, count(*) FILTER (NOT ok) OVER (PARTITION BY source, i ORDER BY seen) AS fails FROM isl)"""
QUERIES = {
    "memory_upsert": memory_upsert, "memory_sweep": memory_sweep, "seen_before": seen_before, "still_live": still_live, "journal_append": journal_append, "journal_chain": journal_chain,
    "sensor_diff": sensor_diff, "sensor_absence": sensor_absence, "sensor_baseline": sensor_baseline, "sensor_notify": sensor_notify, "health_streaks": health_streaks,
    "health_transitions": health_transitions, "schedules": schedules, "search_yields": search_yields,
}
ORACLE_SQL = {
    "memory_upsert": f"""WITH {CURRENT}, j AS (SELECT coalesce(c.source, s.source) AS source, coalesce(c.source_id, s.source_id) AS source_id, c.content_hash AS ch, s.content_hash AS sh, c.seg_version AS cv, s.seg_version AS sv, first_seen, last_seen, version, vector, coalesce(s.content_hash IS NULL OR (c.content_hash = s.content_hash AND c.seg_version = s.seg_version), false) AS same
  FROM current c FULL JOIN staged s ON c.source = s.source AND c.source_id = s.source_id)
SELECT source, source_id, CASE WHEN same THEN ch ELSE sh END AS content_hash, CASE WHEN same THEN cv ELSE sv END AS seg_version, coalesce(first_seen, TIMESTAMP '{NOW}') AS first_seen, CASE WHEN sh IS NULL THEN last_seen ELSE TIMESTAMP '{NOW}' END AS last_seen, CASE WHEN same THEN version ELSE coalesce(version, 0) + 1 END AS version, CASE WHEN same THEN vector END AS vector FROM j""",
    "memory_sweep": f"WITH {CURRENT} SELECT source, source_id, 'expired' AS reason FROM current WHERE last_seen < TIMESTAMP '{NOW}' - INTERVAL 365 DAY AND NOT immutable",
    "seen_before": f"WITH {CURRENT} SELECT s.source, s.source_id, coalesce(c.first_seen < TIMESTAMP '2022-12-15', false) AS seen_before FROM staged s LEFT JOIN current c USING (source, source_id)",
    "still_live": f"""WITH {CURRENT}, m AS (SELECT source, TIMESTAMP '2023-01-01' + to_days((max(doc_id) % 300)::INTEGER) AS ran_at FROM documents WHERE substr(source, 4)::INTEGER % 4 <> 0 GROUP BY source)
SELECT source, source_id, coalesce(last_seen >= ran_at, false) AS still_live, round((epoch(TIMESTAMP '{NOW}') - epoch(last_seen)) / 86400, 1) AS index_age_days FROM current LEFT JOIN m USING (source)""",
    "journal_append": "WITH o AS (SELECT user_id AS observation_id, event_id AS seq, sha256(event_type) AS payload_hash FROM events), l AS (SELECT *, lag(payload_hash) OVER (PARTITION BY observation_id ORDER BY seq) AS b FROM o) SELECT observation_id, seq, payload_hash FROM l WHERE payload_hash IS DISTINCT FROM b",
    "journal_chain": "SELECT event_id AS seq, 'broken' AS prev_hash, sha256('e' || (event_id - 1)) AS expected FROM events WHERE event_id % 500 = 7 AND event_id > (SELECT min(event_id) FROM events)",
    "sensor_diff": f"SELECT *, 'new' AS change FROM ({DAY(12)} EXCEPT {DAY(11)}) UNION ALL SELECT *, 'gone' FROM ({DAY(11)} EXCEPT {DAY(12)})",
    "sensor_absence": f"WITH a AS ({DAY(11)}), b AS ({DAY(12)}) SELECT DISTINCT source, split_part(source_id, ':', 1) AS identity FROM a WHERE source IN ('click', 'view', 'purchase') EXCEPT SELECT source, split_part(source_id, ':', 1) FROM b",
    "sensor_baseline": f"WITH u AS (SELECT *, 0 AS age FROM ({DAY(12)}) UNION ALL SELECT *, 1 FROM ({DAY(11)})) SELECT source, source_id FROM u GROUP BY ALL ORDER BY min(age), source, source_id LIMIT 200",
    "sensor_notify": "SELECT doc_id, 'any' AS rule FROM documents WHERE contains(lower(text), 'password') OR contains(lower(text), 'akia') UNION ALL SELECT doc_id, 'every' FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'and') AND contains(lower(text), 'of')",
    "health_streaks": f"WITH {STREAKS} SELECT * FROM st",
    "health_transitions": f"WITH {STREAKS}, l AS (SELECT *, coalesce(lag(fails) OVER (PARTITION BY source ORDER BY seen), 0) AS b FROM st), e AS (SELECT source, seen, CASE WHEN fails = 2 AND b = 1 AND NOT ok THEN 'down' WHEN fails = 0 AND b >= 2 THEN 'recovered' END AS event FROM l) SELECT * FROM e WHERE event IS NOT NULL",
    "schedules": """WITH s(i, kind, num, mins) AS (VALUES (0, 'daily', 0, [390]), (1, 'daily', 0, [315, 780]), (2, 'weekly', 1, [540]), (3, 'weekly', 6, [720]), (4, 'monthly', 31, [495]), (5, 'monthly', 5, [0]), (6, 'every', 0, []), (7, 'none', 0, [])),
k AS MATERIALIZED (SELECT event_id, ts, ts::DATE AS d, s.*, CASE WHEN event_id % 30 <> 0 THEN ts - INTERVAL 9 HOUR END AS ran FROM events JOIN s ON i = event_id // 10 % 8),
days AS (SELECT k.*, x AS day FROM k, unnest(generate_series(d - 62, d + 62, INTERVAL 1 DAY)) AS g(x)),
named AS (SELECT event_id, ts, day + to_minutes(unnest(mins)) AS slot FROM days WHERE kind = 'daily' AND abs(datediff('day', d, day)) <= 1 OR kind = 'weekly' AND isodow(day) = num AND abs(datediff('day', d, day)) <= 7 OR kind = 'monthly' AND day(day) = num AND abs(datediff('month', d, day)) <= 1),
slots AS (SELECT event_id, max(slot) FILTER (slot <= ts) AS slot, min(slot) FILTER (slot > ts) AS next FROM named GROUP BY event_id)
SELECT event_id, slot, CASE kind WHEN 'every' THEN true ELSE coalesce(slot IS NOT NULL AND (ran IS NULL OR ran < slot), false) END AS due, next FROM k LEFT JOIN slots USING (event_id)""",
    "search_yields": """WITH h AS (SELECT l_orderkey % 50 AS search, 's' || (l_suppkey % 12) AS source, l_partkey AS work, CASE WHEN l_linenumber < 5 THEN trunc(l_quantity)::INTEGER % 15 END AS rank FROM lineitem),
w AS (SELECT search, work, count(DISTINCT source) AS n FROM h GROUP BY ALL), y AS (SELECT source, count(DISTINCT search) AS searches, count(*) AS offered, count(rank) AS top, count(*) FILTER (rank IS NOT NULL AND n = 1) AS sole, min(rank) AS best_rank,
  count(*) FILTER (rank <= 2) AS r0_2, count(*) FILTER (rank BETWEEN 3 AND 5) AS r3_5, count(*) FILTER (rank BETWEEN 6 AND 9) AS r6_9, count(*) FILTER (rank >= 10) AS r10 FROM h JOIN w USING (search, work) GROUP BY source)
SELECT *, coalesce(round(sole::DOUBLE / nullif(top, 0), 3), 0) AS sole_share, coalesce(round(top::DOUBLE / nullif(offered, 0), 3), 0) AS presence_rate FROM y""",
}
