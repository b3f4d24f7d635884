"""Who is who and what is asked: carried facts, resolved names, loosened queries, due sensors, alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import identity, monitor, relax, resolve
from quillspan.plans.retrieval import DOCS, GROUPS, corpus, table
from quillspan.streaming import alerts

NOW = "2024-01-20 00:00:00"


def survivor_carry(spark, sf):
    docs = corpus(spark, sf).withColumns({
        "attention": F.when(F.col("pos") % 3 == 0, None).otherwise(F.col("attention")), "openalex": F.expr("CASE WHEN pos % 4 = 1 THEN concat('W', pos) END"),
        "authorships": F.expr("CASE WHEN pos % 5 = 2 THEN array(concat('A', pos), 'A1') WHEN pos % 5 = 3 THEN array() END"),
    })
    found = resolve.carried(resolve.grouped(docs))
    return found.select("pos", "doi", "arxiv", "ids_from", "openalex", F.array_join("authorships", ",").alias("authorships"))


def asked(spark, sf):
    """Each name of a part is asked for, with a brand as hint and, for some, a known order as paper."""
    names = table(spark, sf, "part").groupBy(F.initcap("p_name").alias("query")).agg(F.min("p_partkey").alias("k"))
    return names.selectExpr("query", "CASE WHEN k % 3 <> 0 THEN concat(' brand#', k % 25 + 1, ' ') END AS hint", "CASE WHEN k % 4 = 1 THEN concat('o', k % 50) ELSE '' END AS paper")


def people(spark, sf):
    """Parts are people; those of one first word come up for a name."""
    parts = table(spark, sf, "part")
    found = parts.selectExpr("p_partkey AS pos", "concat('A', p_partkey) AS id", "CASE WHEN p_partkey % 3 = 0 THEN 's2' ELSE 'openalex' END AS source", "concat(p_type, ' ', p_name) AS name", "CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size % 13 END AS works", "p_brand AS institution", "split_part(p_name, ' ', 1) AS word")
    queries = asked(spark, sf).select("query", F.lower(F.split("query", " ")[0]).alias("word"))
    return found.join(queries, "word").drop("word")


def authors(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.where("l_orderkey < 50").selectExpr("concat('o', l_orderkey) AS paper", "l_orderkey * 10 + l_linenumber AS pos", "concat('A', p_partkey) AS id", "'s2' AS source", "concat(p_name, ' Jr') AS name").dropDuplicates(["paper", "pos"])


def people_resolved(spark, sf):
    return identity.resolved(asked(spark, sf), people(spark, sf), authors(spark, sf))


def tokens_picked(spark, sf):
    named = asked(spark, sf).select(F.col("query").alias("token"))
    ids = table(spark, sf, "supplier").selectExpr("concat('A', s_suppkey, ' + A', s_suppkey + 1) AS token").union(table(spark, sf, "customer").selectExpr("CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey + 999990 AS STRING) ELSE concat('B', c_custkey) END"))
    found = identity.picked(named.union(ids), identity.resolved(asked(spark, sf), people(spark, sf)))
    return found.select("token", F.array_join("ids", "+").alias("ids"), "source", F.array_join("alternatives", ",").alias("alternatives"))


LOOSE = ["how is the Tion of AND with er", "what about ANERTH1 thon heerth of", "de la THE Zürich", "nowhereword", "the of"]


def relaxed_search(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = [relax.relaxed(docs, "text", q, least).select(F.lit(n).alias("q"), "doc_id", "tier") for n, (q, least) in enumerate(zip(LOOSE, (5, 1, 1, 1, 3)))]
    return rows[0].unionAll(rows[1]).unionAll(rows[2]).unionAll(rows[3]).unionAll(rows[4])


def qualified_queries(spark, sf):
    e = table(spark, sf, "events")
    forms = ["concat('sub: A,b,a,, k', event_id)", "concat('rlhf  SUBREDDIT:x', event_id, ' and Sub:y,X', event_id)", "concat('comments: pour over ', event_id)", "concat(' comment:sub:ok ', event_id)", "concat('about sub:, ', event_id)", "concat('subway subs:x ', event_id)"]
    query = F.element_at(F.array(*map(F.expr, forms)), (F.col("event_id") % 6).cast("int") + 1)
    return e.select("event_id", relax.qualified(query).alias("q")).select("event_id", "q.text", F.array_join("q.names", ",").alias("names"), "q.replies")


def sensors_due(spark, sf):
    users = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("ts"))
    rows = users.selectExpr("user_id", "element_at(array('hourly', ' Daily ', 'weekly', 'sometimes', NULL), CAST(user_id % 5 AS INT) + 1) AS schedule", "CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 7 = 1 THEN 'soon' ELSE date_format(timestampadd(HOUR, -CAST(user_id % 200 AS INT), TIMESTAMP '2024-01-20'), \"yyyy-MM-dd'T'HH:mm:ss'Z'\") END AS last_run_at")
    return monitor.due_sensors(rows, F.lit(NOW).cast("timestamp")).select("user_id")


def raised(spark, sf):
    return table(spark, sf, "events").where("event_type = 'error'").selectExpr("concat('u', user_id % 20) AS key", "CAST(event_id AS STRING) AS title", "ts AS at")


def alerts_told(spark, sf):
    return alerts.told_once(raised(spark, sf), 6 * 3600)


def alerts_quiet(spark, sf):
    return alerts.quiet_keys(raised(spark, sf), 6 * 3600, F.lit(NOW).cast("timestamp"))


QUERIES = {
    "survivor_carry": survivor_carry, "people_resolved": people_resolved, "tokens_picked": tokens_picked, "relaxed_search": relaxed_search, "qualified_queries": qualified_queries,
    "sensors_due": sensors_due, "alerts_told": alerts_told, "alerts_quiet": alerts_quiet,
}
WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^a-z]+'), lambda w: length(w) >= 2))"
ASKED = """asked AS (SELECT query, CASE WHEN k % 3 <> 0 THEN 'brand#' || (k % 25 + 1) ELSE '' END AS hint, CASE WHEN k % 4 = 1 THEN 'o' || (k % 50) ELSE '' END AS paper FROM (SELECT array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS query, min(p_partkey) AS k FROM part GROUP BY 1))"""
RANKED = f"""{ASKED}, met AS (SELECT query, p_partkey AS pos, 'A' || p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 's2' ELSE 'openalex' END AS source, p_type || ' ' || p_name AS name, CASE WHEN p_size % 7 = 0 THEN 0 ELSE p_size % 13 END AS works, hint <> '' AND contains(lower(p_brand), hint) AS hit FROM part JOIN asked ON split_part(p_name, ' ', 1) = lower(split_part(query, ' ', 1))),
matched AS (SELECT *, list_has_all({WORDS.format('name')}, {WORDS.format('query')}) AS m FROM met), ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query ORDER BY m DESC, hit DESC, works DESC, pos) AS nth FROM matched),
strong AS (SELECT query, works, row_number() OVER (PARTITION BY query ORDER BY nth) AS k FROM ranked WHERE m AND works >= 2),
close AS (SELECT query, coalesce(2 * max(works) FILTER (k = 2) >= max(works) FILTER (k = 1), false) AS close FROM strong GROUP BY query)"""


def _loose(n: int, steps: list[list[str]], least: int) -> str:
    """One query's rows, its steps told by hand."""
    has = lambda t: f"list_contains(w, '{t}')"
    tiers = " ".join(f"WHEN {' AND '.join(map(has, s))} THEN {i}" for i, s in enumerate(steps))
    return f"SELECT {n} AS q, doc_id, tier FROM (SELECT doc_id, CASE {tiers} END AS own FROM words) m, (SELECT min(t) AS tier FROM (SELECT t, count(*) FILTER (own <= t) AS n FROM (SELECT CASE {tiers} END AS own FROM words), range({len(steps)}) AS r(t) GROUP BY t) WHERE n >= {least}) k WHERE own <= tier"


ORACLE_SQL = {
    "survivor_carry": f"""WITH RECURSIVE {DOCS}, {GROUPS}, m AS (SELECT grp, pos, source, content, nullif(doi, '') AS doi, nullif(arxiv, '') AS arxiv, CASE WHEN pos % 3 = 0 THEN 0 ELSE attention END AS att, CASE WHEN pos % 4 = 1 THEN 'W' || pos END AS oa, CASE WHEN pos % 5 = 2 THEN 'A' || pos || ',A1' END AS who FROM members),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY length(content) DESC, att DESC, pos) AS nth FROM m) WHERE nth = 1),
i AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY pos) AS nth FROM m WHERE coalesce(doi, arxiv) IS NOT NULL) WHERE nth = 1), a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY pos) AS nth FROM m WHERE who IS NOT NULL) WHERE nth = 1)
SELECT b.pos, CASE WHEN coalesce(b.doi, b.arxiv) IS NULL THEN i.doi END AS doi, CASE WHEN coalesce(b.doi, b.arxiv) IS NULL THEN i.arxiv END AS arxiv, CASE WHEN coalesce(b.doi, b.arxiv) IS NULL THEN i.source END AS ids_from, CASE WHEN b.who IS NULL AND b.oa IS NULL THEN a.oa END AS openalex, CASE WHEN b.who IS NULL THEN a.who END AS authorships FROM b LEFT JOIN i USING (grp) LEFT JOIN a USING (grp)""",
    "people_resolved": f"""WITH {RANKED}, line AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) 'o' || l_orderkey AS paper, l_orderkey * 10 + l_linenumber AS pos, 'A' || p_partkey AS id, p_name || ' Jr' AS name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey < 50),
pin AS (SELECT query, id, name, row_number() OVER (PARTITION BY query ORDER BY line.pos, id) AS k, count(*) OVER (PARTITION BY query) AS n FROM asked JOIN line USING (paper) WHERE list_has_all({WORDS.format('name')}, {WORDS.format('query')})),
rest AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY m DESC, nth) AS k FROM ranked r WHERE NOT EXISTS (SELECT 1 FROM pin WHERE pin.query = r.query AND pin.id = r.id)), pinned AS (SELECT DISTINCT query, n FROM pin),
rows AS (SELECT query, k AS nth, id, 's2' AS source, name, true AS name_match, true AS anchored FROM pin UNION ALL SELECT query, k + coalesce(n, 0), id, source, name, m, false FROM rest LEFT JOIN pinned USING (query) WHERE k <= 5)
SELECT query, nth::INTEGER AS nth, id, source, name, name_match, anchored, CASE WHEN n IS NOT NULL THEN n > 1 ELSE coalesce(close, false) END AS ambiguous FROM rows LEFT JOIN pinned USING (query) LEFT JOIN close USING (query)""",
    "tokens_picked": f"""WITH {RANKED}, told AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY m DESC, nth) AS k FROM ranked), few AS (SELECT query, list(id ORDER BY k) AS ids FROM told WHERE k <= 5 AND m AND source = 'openalex' GROUP BY query)
SELECT query AS token, ids[1] AS ids, CASE WHEN ids IS NOT NULL THEN 'openalex' END AS source, coalesce(array_to_string(ids[2:4], ','), '') AS alternatives FROM asked LEFT JOIN few USING (query)
UNION ALL SELECT 'A' || s_suppkey || ' + A' || (s_suppkey + 1), 'A' || s_suppkey || '+A' || (s_suppkey + 1), 'openalex', '' FROM supplier
UNION ALL SELECT CASE WHEN c_custkey % 2 = 0 THEN (c_custkey + 999990)::VARCHAR ELSE 'B' || c_custkey END, CASE WHEN c_custkey % 2 = 0 THEN (c_custkey + 999990)::VARCHAR END, CASE WHEN c_custkey % 2 = 0 THEN 's2' END, '' FROM customer""",
    "relaxed_search": "WITH words AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents) "
    + " UNION ALL ".join([_loose(0, [["tion", "er"], ["tion"]], 5), _loose(1, [["anerth1", "thon", "heerth"], ["anerth1", "heerth"], ["anerth1"]], 1), _loose(2, [["de", "la", "zürich"], ["zürich", "de"], ["zürich"]], 1), _loose(3, [["nowhereword"]], 1), _loose(4, [["the", "of"], ["the"]], 3)]),
    "qualified_queries": """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'k' || event_id WHEN 1 THEN 'rlhf   and' WHEN 2 THEN 'pour over ' || event_id WHEN 3 THEN 'sub:ok ' || event_id WHEN 4 THEN 'about sub:, ' || event_id ELSE 'subway subs:x ' || event_id END AS text,
CASE event_id % 6 WHEN 0 THEN 'A,b' WHEN 1 THEN 'x' || event_id || ',y' END AS names, event_id % 6 IN (2, 3) AS replies FROM events""",
    "sensors_due": f"""WITH u AS (SELECT DISTINCT user_id, [3600, 86400, 604800, 86400, 86400][(user_id % 5 + 1)::INTEGER] AS every, CASE WHEN user_id % 7 > 1 THEN (user_id % 200) * 3600 END AS ago FROM events) SELECT user_id FROM u WHERE ago IS NULL OR ago >= every""",
    "alerts_told": """WITH RECURSIVE a AS MATERIALIZED (SELECT 'u' || (user_id % 20) AS key, event_id::VARCHAR AS title, ts AS at1 FROM events WHERE event_type = 'error'), told AS (SELECT key, min(at1) AS at1 FROM a GROUP BY key
UNION ALL SELECT told.key, (SELECT min(a.at1) FROM a WHERE a.key = told.key AND a.at1 >= told.at1 + INTERVAL 6 HOUR) FROM told WHERE told.at1 IS NOT NULL)
SELECT key, min(title) AS title, at1 AS at FROM told JOIN a USING (key, at1) GROUP BY key, at1""",
    "alerts_quiet": f"""WITH RECURSIVE a AS MATERIALIZED (SELECT 'u' || (user_id % 20) AS key, ts AS at1 FROM events WHERE event_type = 'error' AND ts <= TIMESTAMP '{NOW}'), told AS (SELECT key, min(at1) AS at1 FROM a GROUP BY key
UNION ALL SELECT told.key, (SELECT min(a.at1) FROM a WHERE a.key = told.key AND a.at1 >= told.at1 + INTERVAL 6 HOUR) FROM told WHERE told.at1 IS NOT NULL)
SELECT key, max(at1) + INTERVAL 6 HOUR AS until FROM told GROUP BY key HAVING max(at1) + INTERVAL 6 HOUR > TIMESTAMP '{NOW}'""",
}
