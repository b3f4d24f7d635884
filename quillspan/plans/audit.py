"""Queries over source catalogs, coverage and evaluation runs, made from documents, events, labels and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import audit, evaluate, monitor
from quillspan.plans.memory import search_yields
from quillspan.plans.retrieval import table


def roster(spark, sf):
    docs = table(spark, sf, "documents")
    number = F.substring("source", 4, 9).cast("int")
    return docs.groupBy(F.col("source").alias("name")).agg(F.array_sort(F.collect_set("lang")).alias("domains")).select(
        "name", "domains", F.when(F.substring("name", 4, 9).cast("int") % 3 == 0, F.array(F.lit("search"), F.lit("monitor"))).otherwise(F.array(F.lit("recall"))).alias("modes"),
        (F.substring("name", 4, 9).cast("int") % 4 != 1).alias("healthy"), (F.substring("name", 4, 9).cast("int") % 7 == 0).alias("protected"), (F.substring("name", 4, 9).cast("int") % 5 == 0).alias("credentialed"),
    )


ROSTER = """roster AS (SELECT source AS name, list_sort(list(DISTINCT lang)) AS domains, CASE WHEN substr(source, 4)::INTEGER % 3 = 0 THEN ['search', 'monitor'] ELSE ['recall'] END AS modes,
  substr(source, 4)::INTEGER % 4 <> 1 AS healthy, substr(source, 4)::INTEGER % 7 = 0 AS protected, substr(source, 4)::INTEGER % 5 = 0 AS credentialed FROM documents GROUP BY source)"""
CELLS = "placed AS (SELECT name, healthy, domain, unnest(modes) AS mode FROM (SELECT *, unnest(domains) AS domain FROM roster))"
GRID = f"""{ROSTER}, {CELLS}, cells AS (SELECT domain, mode, count(DISTINCT name) AS sources, count(DISTINCT CASE WHEN healthy AND substr(name, 4)::INTEGER % 6 <> 2 THEN name END) AS h FROM placed GROUP BY ALL),
grid AS (SELECT d.domain, m.mode, coalesce(sources, 0) AS sources, CASE WHEN coalesce(sources, 0) = 0 THEN 'empty' WHEN h = 0 THEN 'dark' WHEN h = 1 THEN 'single' ELSE 'covered' END AS state
  FROM (SELECT unnest(['en', 'fr', 'de', 'es', 'it']) AS domain) d CROSS JOIN (SELECT unnest(['search', 'monitor', 'recall', 'structure']) AS mode) m LEFT JOIN cells USING (domain, mode))"""


def _grid(spark, sf):
    domains = spark.createDataFrame([(d,) for d in ("en", "fr", "de", "es", "it")], "domain string")
    modes = spark.createDataFrame([(m,) for m in ("search", "monitor", "recall", "structure")], "mode string")
    dark = F.substring("name", 4, 9).cast("int") % 6 == 2
    return audit.coverage(roster(spark, sf).withColumn("presumed_dark", dark), domains, modes)


def coverage_grid(spark, sf):
    return _grid(spark, sf)


def coverage_gaps(spark, sf):
    return audit.gap_cells(_grid(spark, sf), spark.createDataFrame([("de", "search"), ("it", "recall")], "domain string, mode string"))


def coverage_impact(spark, sf):
    return audit.impact(roster(spark, sf), "src0")


def search_plan(spark, sf):
    docs = table(spark, sf, "documents")
    number = F.substring("name", 4, 9).cast("int")
    words = docs.select(F.col("source").alias("name"), F.explode_outer(F.array_distinct(F.split(F.lower("text"), r"[^a-z]+"))).alias("word")).distinct()
    rows = words.groupBy("name").agg(F.collect_list("word").alias("tokens"))
    rows = rows.withColumns({"enable": number == 4, "disable": number % 6 == 4, "walled": number % 9 == 2, "group_off": number == 17})
    rows = rows.withColumn("enabled", audit.enabled(rows))
    names = lambda test: rows.where(test).select("name")
    rows = audit.excluded_reason(rows, [("retired", names(number % 8 == 5)), ("org_watch_static", names(number % 8 == 6)), ("emergency", names(number > 17))])
    return audit.plan(rows, names(number % 10 == 1), ["the", "tion", "with", "and", "les"])


def source_dossier(spark, sf):
    yields = search_yields(spark, sf).select(F.concat(F.lit("src"), F.substring("source", 2, 9)).alias("name"), "offered", "top", "sole")
    marks = table(spark, sf, "documents").groupBy(F.col("source").alias("name")).agg(F.count_distinct("lang").alias("langs")).where("langs > 1")
    marks = marks.select("name", (F.substring("name", 4, 9).cast("int") * 7 % 60).alias("silent_days"), F.lit(21).alias("cadence_days"))
    streaks = table(spark, sf, "events").groupBy(F.concat(F.lit("src"), "user_id").alias("name")).agg(F.count_if(F.col("event_type") == "error").alias("e")).select("name", (F.col("e") % 4).alias("fails"))
    found = audit.dossier(roster(spark, sf), yields, marks, streaks)
    return found.select("name", "sole_share", "presence_rate", "evidence_met", "presumed_dark", "blind", "starved", "redundant", "dead", "silent")


RULES = [("r1", "host", "example.com", "hard"), ("r2", "host_suffix", "example.org", "soft"), ("r3", "path_regex", "/(login|private|2)", "soft"), ("r4", "query_term", "9", "hard"), ("r5", "host_suffix", "com", "soft")]


def red_lines(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("id"), "url", F.concat(F.lit("Item "), "page_id").alias("query"), (F.col("page_id") % 4 == 0).alias("discovered"))
    return audit.red_lines(pages, spark.createDataFrame(RULES, "rule string, kind string, value string, severity string"), ["r3", "r4"])


def candidate_moves(spark, sf):
    edges = spark.createDataFrame([("view", "click"), ("click", "purchase"), ("purchase", "view"), ("view", "error")], "a string, b string")
    history = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("step"), F.col("event_type").alias("state"))
    return audit.allowed_moves(history, edges)


PROBE_WORDS = ["HTTP 429", "403 Forbidden", "skip: not configured", "timed out", "Rate-limited, 401", "served Degraded results", "code 4031", "Too many requests; degraded"]


def probe_classes(spark, sf):
    events = table(spark, sf, "events")
    ok = F.when(F.col("event_id") % 5 < 2, True).when(F.col("event_id") % 5 < 4, False)
    word = F.element_at(F.array(*map(F.lit, PROBE_WORDS)), (F.col("event_id") % 8).cast("int") + 1)
    return audit.summary(events.select(audit.probe_class(ok, word).alias("status")), ["up", "degraded", "rate_limited", "blocked", "skipped", "down", "unknown"])


def _reps(spark, sf):
    lines = table(spark, sf, "lineitem")
    status = F.when(F.col("l_linenumber") % 4 == 0, "skipped").when(F.col("l_quantity") > 20, "pass").otherwise("fail")
    return lines.select(F.col("l_orderkey").alias("task"), status.alias("status"))


def suite_rates(spark, sf):
    suites = table(spark, sf, "orders").select(F.col("o_orderkey").alias("task"), F.col("o_orderpriority").alias("suite"))
    dead = table(spark, sf, "orders").where("o_orderkey % 13 = 0").select(F.col("o_orderkey").alias("task"))
    return evaluate.suite_rates(evaluate.majority(_reps(spark, sf)).join(suites, "task"), dead)


def latency_percentiles(spark, sf):
    found = evaluate.latency(table(spark, sf, "events"), "event_type", "value")
    return found.select("event_type", *(F.round(c, 6).alias(c) for c in ("p50", "p90", "p99", "mean_positive")))


def claim_conflicts(spark, sf):
    claims = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("item"), (F.col("l_suppkey") % 5).alias("provenance"), (F.col("l_quantity") - 3).alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    claims = claims.groupBy("item", "pos").agg(F.min("provenance").alias("provenance"), F.min("value").alias("value"))
    return evaluate.conflicts(claims, 3.0).select("item", F.round("ratio", 9).alias("ratio"))


def passages_contained(spark, sf):
    """Passages from the middle of each document, in other case, spacing and punctuation, and passages of a benchmark item."""
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark").select("item_id", F.col("text").alias("item"))
    own = F.expr("substr(text, length(text) div 2, 60)")
    needle = F.when(F.col("doc_id") % 3 == 0, F.upper(F.replace(own, F.lit(" "), F.lit(" , ")))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("1,5"), own)).otherwise(F.col("item"))
    asked = docs.withColumn("item_id", F.col("doc_id") % 40).join(items, "item_id", "left").withColumn("needle", needle)
    return evaluate.contained(asked.select("doc_id", "text", "needle"), "needle", "text").select("doc_id", "contained")


def audit_ratios(spark, sf):
    yields = search_yields(spark, sf)
    return yields.select("source", monitor.ratio(F.col("sole"), F.col("offered")).alias("sole_rate"), monitor.ratio(F.col("r10"), F.col("top")).alias("tail_rate"))


def _sql():
    from quillspan.plans.memory import ORACLE_SQL as MEMORY

    return MEMORY["search_yields"]


def _plain(text: str) -> str:
    """The judges' normal form in SQL: separators between digits are put aside under private characters meanwhile."""
    out = f"trim(regexp_replace(replace(lower(replace({text}, chr(92) || '%', '%')), 'ß', 'ss'), '\\s+', ' ', 'g'))"
    kept = dict(zip(" ,._:/-", range(0xE000, 0xE010)))
    for c, aside in kept.items():
        for _ in range(2):
            out = f"regexp_replace({out}, '(\\d)[{c}](\\d)', '\\1' || chr({aside}) || '\\2', 'g')"
    out = f"regexp_replace({out}, '[ !-/:-@\\[-`{{-~，。、：；！？（）「」『』【】《》〈〉“”‘’]', '', 'g')"
    for c, aside in kept.items():
        out = f"replace({out}, chr({aside}), '{c}')"
    return out


MOVES = "(b IS NULL OR b = event_type OR (b, event_type) IN (('view', 'click'), ('click', 'purchase'), ('purchase', 'view'), ('view', 'error')))"
HOST = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)), '^(www|m)\\.', '')"
PATH = "regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)"
QUERIES = {
    "coverage_grid": coverage_grid, "coverage_gaps": coverage_gaps, "coverage_impact": coverage_impact, "search_plan": search_plan, "source_dossier": source_dossier, "red_lines": red_lines,
    "candidate_moves": candidate_moves, "probe_classes": probe_classes, "suite_rates": suite_rates, "latency_percentiles": latency_percentiles, "claim_conflicts": claim_conflicts,
    "passages_contained": passages_contained, "audit_ratios": audit_ratios,
}
ORACLE_SQL = {
    "coverage_grid": f"WITH {GRID} SELECT * FROM grid",
    "coverage_gaps": f"WITH {GRID} SELECT domain, mode FROM grid WHERE state = 'empty' OR state IN ('single', 'dark') AND (domain, mode) NOT IN (('de', 'search'), ('it', 'recall'))",
    "coverage_impact": f"WITH {ROSTER}, {CELLS}, p AS (SELECT DISTINCT name, domain, mode FROM placed), l AS (SELECT domain, mode, count(*) FILTER (name <> 'src0') AS left_over FROM p WHERE (domain, mode) IN (SELECT (domain, mode) FROM p WHERE name = 'src0') GROUP BY ALL) SELECT domain, mode, left_over AS \"left\", CASE left_over WHEN 0 THEN 'empty' WHEN 1 THEN 'single' ELSE 'covered' END AS turns FROM l",
    "search_plan": """WITH c AS (SELECT source AS name, substr(source, 4)::INTEGER AS k, coalesce(list_distinct(flatten(list(regexp_split_to_array(lower(text), '[^a-z]+')))), []) AS tokens FROM documents GROUP BY source),
f AS (SELECT *, CASE WHEN k = 4 THEN true WHEN k % 6 = 4 OR k % 9 = 2 OR k = 17 THEN false ELSE true END AS enabled, CASE WHEN k % 8 = 5 THEN 'retired' WHEN k % 8 = 6 THEN 'org_watch_static' WHEN k > 17 THEN 'emergency' END AS reason FROM c),
q AS (SELECT t, count(*) FILTER (list_contains(tokens, t)) AS d, count(*) AS n FROM f, unnest(['the', 'tion', 'with', 'and', 'les']) AS u(t) GROUP BY t),
r AS (SELECT f.name, k, enabled, reason, sum(CASE WHEN list_contains(tokens, t) THEN ln(1 + (n - d + 0.5) / (d + 0.5)) ELSE 0 END) AS fit FROM f, q GROUP BY ALL)
SELECT name, CASE WHEN k % 10 = 1 THEN 'down' ELSE 'live' END AS role FROM r WHERE reason IS NULL AND enabled
UNION ALL (SELECT name, 'hint' FROM r WHERE (reason IS NOT NULL OR NOT enabled) AND fit > 0 AND NOT coalesce(starts_with(reason, 'org_watch'), false) ORDER BY round(fit, 9) DESC, name LIMIT 6)""",
    "source_dossier": f"""WITH {ROSTER}, y AS (SELECT 'src' || substr(source, 2) AS name, offered, top, sole FROM ({_sql()})), m AS (SELECT source AS name, substr(source, 4)::INTEGER * 7 % 60 AS silent_days, 21 AS cadence_days FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1),
s AS (SELECT 'src' || user_id AS name, count(*) FILTER (event_type = 'error') % 4 AS fails FROM events GROUP BY user_id),
j AS (SELECT *, coalesce(round(sole::DOUBLE / nullif(top, 0), 3), 0) AS sole_share, coalesce(round(top::DOUBLE / nullif(offered, 0), 3), 0) AS presence_rate, coalesce(offered >= 30, false) AS evidence_met, coalesce(silent_days > cadence_days, false) AS presumed_dark FROM roster LEFT JOIN y USING (name) LEFT JOIN m USING (name) LEFT JOIN s USING (name))
SELECT name, sole_share, presence_rate, evidence_met, presumed_dark, offered IS NULL AS blind, evidence_met AND coalesce(top, 0) = 0 AS starved, evidence_met AND NOT protected AND sole_share = 0 AND coalesce(top, 0) > 0 AS redundant, coalesce(fails >= 2, false) AND NOT credentialed AS dead, coalesce(silent_days >= 30, false) AND presumed_dark AS silent FROM j""",
    "red_lines": f"""WITH p AS (SELECT page_id AS id, {HOST} AS host, {PATH} AS path, 'item ' || page_id AS q, page_id % 4 = 0 AS discovered FROM pages),
h AS (SELECT id, discovered, 'r1' AS rule, 'hard' AS severity FROM p WHERE host = 'example.com' UNION ALL SELECT id, discovered, 'r2', 'soft' FROM p WHERE host = 'example.org' OR ends_with(host, '.example.org') UNION ALL SELECT id, discovered, 'r3', 'soft' FROM p WHERE regexp_matches(path, '/(login|private|2)')
  UNION ALL SELECT id, discovered, 'r4', 'hard' FROM p WHERE contains(q, '9') UNION ALL SELECT id, discovered, 'r5', 'soft' FROM p WHERE host = 'com' OR ends_with(host, '.com'))
SELECT DISTINCT id, rule, CASE WHEN discovered AND rule = 'r3' THEN 'hard' ELSE severity END AS severity FROM h""",
    "candidate_moves": f"WITH l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) SELECT user_id AS id, event_id AS step, event_type AS state, {MOVES} AS allowed FROM l",
    "probe_classes": """WITH words(w, failed, fine) AS (VALUES (0, 'rate_limited', 'rate_limited'), (1, 'blocked', 'up'), (2, 'down', 'up'), (3, 'down', 'up'), (4, 'blocked', 'rate_limited'), (5, 'down', 'degraded'), (6, 'down', 'up'), (7, 'rate_limited', 'rate_limited')),
s AS (SELECT CASE WHEN event_id % 5 = 4 THEN 'skipped' WHEN event_id % 5 < 2 THEN fine ELSE failed END AS status FROM events JOIN words ON w = event_id % 8)
SELECT d.status, count(s.status) AS n FROM (SELECT unnest(['up', 'degraded', 'rate_limited', 'blocked', 'skipped', 'down', 'unknown']) AS status) d LEFT JOIN s USING (status) GROUP BY d.status""",
    "suite_rates": """WITH r AS (SELECT l_orderkey AS task, count(*) AS n, count(*) FILTER (l_linenumber % 4 = 0) AS s, count(*) FILTER (l_linenumber % 4 <> 0 AND l_quantity > 20) AS p FROM lineitem GROUP BY 1),
t AS (SELECT o_orderpriority AS suite, p > n / 2.0 AS ok FROM r JOIN orders ON o_orderkey = task WHERE NOT (p <= n / 2.0 AND s > 0 AND s + p = n) AND o_orderkey % 13 <> 0), g AS (SELECT suite, count(*) FILTER (ok) AS passed, count(*) AS total FROM t GROUP BY suite),
w AS (SELECT *, passed::DOUBLE / total AS p, 1.96 * 1.96 AS z2 FROM g)
SELECT suite, passed, total, round((p + z2 / (2 * total) - 1.96 * sqrt((p * (1 - p) + z2 / (4 * total)) / total)) / (1 + z2 / total), 9)::DOUBLE AS low, round((p + z2 / (2 * total) + 1.96 * sqrt((p * (1 - p) + z2 / (4 * total)) / total)) / (1 + z2 / total), 9)::DOUBLE AS high FROM w""",
    "latency_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value) FILTER (value > 0), 6) AS mean_positive FROM events GROUP BY event_type",
    "claim_conflicts": """WITH c AS (SELECT l_partkey AS item, l_orderkey * 10 + l_linenumber AS pos, min(l_suppkey % 5) AS provenance, min(l_quantity - 3) AS value FROM lineitem GROUP BY 1, 2), f AS (SELECT item, provenance, arg_min(value, pos) AS value FROM c GROUP BY ALL)
SELECT item, round(max(value) / min(value), 9) AS ratio FROM f WHERE value > 0 GROUP BY item HAVING count(*) >= 2 AND max(value) / min(value) >= 3.0""",
    "passages_contained": f"""WITH a AS (SELECT doc_id, d.text, CASE doc_id % 3 WHEN 0 THEN upper(replace(substr(d.text, length(d.text) // 2, 60), ' ', ' , ')) WHEN 1 THEN '1,5' || substr(d.text, length(d.text) // 2, 60) ELSE b.text END AS needle FROM documents d LEFT JOIN benchmark b ON item_id = doc_id % 40),
n AS (SELECT doc_id, {_plain("coalesce(needle, '')")} AS needle, {_plain("coalesce(text, '')")} AS hay FROM a) SELECT doc_id, needle <> '' AND contains(hay, needle) AS contained FROM n""",
    "audit_ratios": f"SELECT source, coalesce(round(sole::DOUBLE / nullif(offered, 0), 3), 0) AS sole_rate, coalesce(round(r10::DOUBLE / nullif(top, 0), 3), 0) AS tail_rate FROM ({_sql()})",
}
