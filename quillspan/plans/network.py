"""Queries over the typed graph and over works, authors and references, made from the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import text as X
from quillspan.operators import biblio, graph
from quillspan.plans.retrieval import table


def edges(spark, sf):
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    customers, suppliers = table(spark, sf, "customer"), table(spark, sf, "supplier")
    made = [
        orders.selectExpr("concat('person:c:', o_custkey) AS src", "concat('work:o:', o_orderkey) AS dst", "'authored' AS type", "'M' AS tier", "'tap' AS method", "o_orderdate AS first_seen"),
        lines.selectExpr("concat('work:o:', l_orderkey) AS src", "concat('topic:p', l_partkey) AS dst", "'about' AS type", "CASE WHEN l_linenumber = 7 THEN 'X' WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'M' END AS tier", "'tap' AS method", "l_shipdate AS first_seen"),
        customers.selectExpr("concat('person:c:', c_custkey) AS src", "concat('inst:n', c_nationkey) AS dst", "'member_of' AS type", "'M' AS tier", "'tap' AS method", "TIMESTAMP '2020-01-01' AS first_seen"),
        suppliers.selectExpr("concat('person:s:', s_suppkey) AS src", "concat('inst:n', s_nationkey) AS dst", "'member_of' AS type", "'M' AS tier", "'tap' AS method", "TIMESTAMP '2020-01-01' AS first_seen"),
        customers.where("c_custkey % 5 = 0").selectExpr("concat('person:c:', c_custkey) AS src", "concat('person:c:', c_custkey - 5 + c_custkey % 2) AS dst", "'same_as' AS type", "'A' AS tier", "CASE c_custkey % 3 WHEN 0 THEN 'id_eq:orcid' WHEN 1 THEN 'align:title_fp' ELSE 'align:name_match' END AS method", "TIMESTAMP '2021-01-01' AS first_seen"),
    ]
    all_edges = made[0]
    for m in made[1:]:
        all_edges = all_edges.unionByName(m)
    return graph.normal_edges(all_edges.withColumn("last_seen", F.col("first_seen")))


EDGES = """raw AS (
  SELECT 'person:c:' || o_custkey AS src, 'work:o:' || o_orderkey AS dst, 'authored' AS type, 'M' AS tier, 'tap' AS method, o_orderdate AS first_seen FROM orders
  UNION ALL SELECT 'work:o:' || l_orderkey, 'topic:p' || l_partkey, 'about', CASE WHEN l_linenumber = 7 THEN 'X' WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'M' END, 'tap', l_shipdate FROM lineitem
  UNION ALL SELECT 'person:c:' || c_custkey, 'inst:n' || c_nationkey, 'member_of', 'M', 'tap', TIMESTAMP '2020-01-01' FROM customer
  UNION ALL SELECT 'person:s:' || s_suppkey, 'inst:n' || s_nationkey, 'member_of', 'M', 'tap', TIMESTAMP '2020-01-01' FROM supplier
  UNION ALL SELECT 'person:c:' || c_custkey, 'person:c:' || (c_custkey - 5 + c_custkey % 2), 'same_as', 'A', CASE c_custkey % 3 WHEN 0 THEN 'id_eq:orcid' WHEN 1 THEN 'align:title_fp' ELSE 'align:name_match' END, TIMESTAMP '2021-01-01' FROM customer WHERE c_custkey % 5 = 0
), edges AS MATERIALIZED (
  SELECT CASE WHEN type = 'same_as' THEN least(src, dst) ELSE src END AS src, CASE WHEN type = 'same_as' THEN greatest(src, dst) ELSE dst END AS dst, type, method, min(tier) AS tier, min(first_seen) AS first_seen
  FROM raw WHERE tier IN ('M', 'A') GROUP BY 1, 2, type, method
)"""
ENDS = "ends AS MATERIALIZED (SELECT DISTINCT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges)"


def nodes(spark, sf):
    e = edges(spark, sf)
    ids = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    return ids.select("id", graph.node_kind(F.col("id")).alias("kind"), F.regexp_replace("id", "^[a-z]+:", "").alias("label"))


NODES = """nodes AS (SELECT id, CASE split_part(id, ':', 1) WHEN 'inst' THEN 'institution' ELSE split_part(id, ':', 1) END AS kind, regexp_replace(id, '^[a-z]+:', '') AS label FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges))"""


def rulings(spark, sf):
    return table(spark, sf, "customer").where("c_custkey % 10 = 0").selectExpr("concat('person:c:', c_custkey) AS a", "concat('person:c:', c_custkey - 5 + c_custkey % 2) AS b", "CASE WHEN c_custkey % 20 = 0 THEN 'not_same' ELSE 'same' END AS verdict")


def graph_stats(spark, sf):
    return graph.stats(nodes(spark, sf), edges(spark, sf))


def graph_neighborhood(spark, sf):
    start = spark.createDataFrame([("person:c:7",), ("person:c:10",)], "node string")
    return graph.neighborhood(edges(spark, sf), start, 2)


def graph_policy_edges(spark, sf):
    kept = graph.accepted(edges(spark, sf), "working", rulings(spark, sf)).where("type = 'same_as'")
    return kept.select("src", "dst", "method").distinct()


def graph_between(spark, sf):
    return graph.between(edges(spark, sf), "person:c:15", "person:c:20")


def graph_since(spark, sf):
    return graph.since(edges(spark, sf), "person:c:7", F.lit("1996-01-01").cast("timestamp")).select("src", "dst", "type", "first_seen")


def graph_find(spark, sf):
    return graph.find(nodes(spark, sf), "C: 12", "person", 10)


def graph_voices(spark, sf):
    return graph.voices(edges(spark, sf).where("type IN ('same_as', 'authored')"), "exploratory")


def works(spark, sf):
    """Orders are works; line items' part numbers, folded onto order keys, are references."""
    refs = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("work")).agg(F.collect_list((F.col("l_partkey") % 997) * 1).alias("refs"))
    return refs


def seeds(spark, sf):
    return table(spark, sf, "orders").where("o_orderkey % 97 = 1").select(F.col("o_orderkey").alias("work"))


def authorship(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("work"), F.col("l_suppkey").alias("author"))


def egos(spark, sf):
    return table(spark, sf, "supplier").where("s_suppkey <= 6").select(F.col("s_suppkey").alias("author"))


def citation_degrees(spark, sf):
    return biblio.citation_degrees(works(spark, sf), seeds(spark, sf)).where("in_degree > 0")


def coauthor_credit(spark, sf):
    return biblio.coauthor_credit(authorship(spark, sf), egos(spark, sf)).select("ego", "author", F.round("credit", 6).alias("credit"), "papers", "nth")


def coauthor_bridges(spark, sf):
    return biblio.bridges(biblio.coauthor_credit(authorship(spark, sf), egos(spark, sf))).select("author", "egos", F.round("credit", 6).alias("credit"))


def coauthor_cooccurrence(spark, sf):
    top = biblio.coauthor_credit(authorship(spark, sf), egos(spark, sf), 14).select("author").distinct()
    return biblio.cooccurrence(authorship(spark, sf), top)


def institution_cohort(spark, sf):
    where = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("author"), F.col("s_nationkey").alias("institution"))
    return biblio.cohort(authorship(spark, sf), where, 3)


def likely_same_people(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("source"), F.concat_ws(" ", "p_name", "p_type").alias("name"))
    return biblio.likely_same(names, X.name_key(F.col("name"))).select("key", "source", "n", F.sha2("merged", 256).alias("merged"))


def name_matches(spark, sf):
    names = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    first = F.element_at(X.name_tokens(F.col("p_type")), 1)
    return names.select("p_partkey", X.name_matches(first, F.concat_ws(" ", "p_name", "p_type")).alias("matches"), X.name_key(F.col("p_type")).alias("key"))


CREDIT = """auth AS (SELECT DISTINCT l_orderkey AS work, l_suppkey AS author FROM lineitem), sizes AS (SELECT work, count(*) AS n FROM auth GROUP BY work),
credit AS (SELECT e.author AS ego, c.author, sum(1.0::DOUBLE / n) AS credit, count(*) AS papers FROM auth e JOIN auth c USING (work) JOIN sizes USING (work) WHERE e.author <= 6 AND c.author <> e.author GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ego ORDER BY round(credit, 9) DESC, author) AS nth FROM credit)"""
KEY = "array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^a-z]+'), lambda w: length(w) >= 2))), ' ')"
QUERIES = {
    "graph_stats": graph_stats, "graph_neighborhood": graph_neighborhood, "graph_policy_edges": graph_policy_edges, "graph_between": graph_between, "graph_since": graph_since,
    "graph_find": graph_find, "graph_voices": graph_voices, "citation_degrees": citation_degrees, "coauthor_credit": coauthor_credit, "coauthor_bridges": coauthor_bridges,
    "coauthor_cooccurrence": coauthor_cooccurrence, "institution_cohort": institution_cohort, "likely_same_people": likely_same_people, "name_matches": name_matches,
}
ORACLE_SQL = {
    "graph_stats": f"WITH {EDGES}, {NODES} SELECT 'kind' AS facet, kind AS name, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'type', type, count(*) FROM edges GROUP BY type UNION ALL SELECT 'tier', tier, count(*) FROM edges GROUP BY tier",
    "graph_neighborhood": f"""WITH {EDGES}, {ENDS}, h0 AS (SELECT unnest(['person:c:7', 'person:c:10']) AS node), h1 AS (SELECT DISTINCT b AS node FROM h0 JOIN ends ON a = node WHERE b NOT IN (SELECT node FROM h0)),
h2 AS (SELECT DISTINCT b AS node FROM h1 JOIN ends ON a = node WHERE b NOT IN (SELECT node FROM h0 UNION SELECT node FROM h1))
SELECT node, 0 AS hops FROM h0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2""",
    "graph_policy_edges": f"""WITH {EDGES}, rul AS (SELECT least(a, b) AS a, greatest(a, b) AS b, min(v) AS v FROM (SELECT 'person:c:' || c_custkey AS a, 'person:c:' || (c_custkey - 5 + c_custkey % 2) AS b, CASE WHEN c_custkey % 20 = 0 THEN 'not_same' ELSE 'same' END AS v FROM customer WHERE c_custkey % 10 = 0) GROUP BY 1, 2)
SELECT DISTINCT src, dst, method FROM edges e WHERE type = 'same_as' AND method IN ('id_eq:doi', 'id_eq:arxiv', 'id_eq:openalex', 'id_eq:orcid', 'ruling') AND NOT EXISTS (SELECT 1 FROM rul WHERE v = 'not_same' AND a = src AND b = dst) UNION SELECT a, b, 'ruling' FROM rul WHERE v = 'same'""",
    "graph_between": f"""WITH {EDGES}, {ENDS}, w1 AS (SELECT 'person:c:15' AS s, b FROM ends WHERE a = 'person:c:15'), w2 AS (SELECT s, w1.b AS m, ends.b FROM w1 JOIN ends ON ends.a = w1.b WHERE ends.b <> s),
v1 AS (SELECT 'person:c:20' AS s, b FROM ends WHERE a = 'person:c:20'), v2 AS (SELECT s, v1.b AS m, ends.b FROM v1 JOIN ends ON ends.a = v1.b WHERE ends.b <> s),
l AS (SELECT 'person:c:15' AS node, ['person:c:15'] AS p UNION ALL SELECT b, [s, b] FROM w1 UNION ALL SELECT b, [s, m, b] FROM w2), r AS (SELECT 'person:c:20' AS node, ['person:c:20'] AS p UNION ALL SELECT b, [s, b] FROM v1 UNION ALL SELECT b, [s, m, b] FROM v2),
met AS (SELECT DISTINCT l.p || list_reverse(r.p)[2:] AS p FROM l JOIN r USING (node))
SELECT (len(p) - 1)::INTEGER AS edges, array_to_string(p, '|') AS path FROM met WHERE len(p) = len(list_distinct(p)) AND len(p) >= 2 ORDER BY len(p), path LIMIT 8""",
    "graph_since": f"WITH {EDGES} SELECT src, dst, type, first_seen FROM edges WHERE (src = 'person:c:7' OR dst = 'person:c:7') AND first_seen >= TIMESTAMP '1996-01-01'",
    "graph_find": f"WITH {EDGES}, {NODES}, f AS (SELECT * FROM nodes WHERE contains(lower(label), 'c:') AND contains(lower(label), '12') AND kind = 'person') SELECT id, kind, label, (SELECT count(*) FROM f) > 10 AS capped FROM f ORDER BY id LIMIT 10",
    "graph_voices": f"""WITH RECURSIVE {EDGES}, part_of AS (SELECT src AS a, dst AS b FROM edges WHERE type = 'same_as' OR type = 'authored'), ways AS (SELECT a, b FROM part_of UNION SELECT b, a FROM part_of),
reach AS (SELECT a AS node, a AS least FROM ways UNION SELECT b, least FROM reach JOIN ways ON a = node WHERE least < b),
roots AS (SELECT node, min(least) AS voice FROM reach GROUP BY node)
SELECT voice, count(*) FILTER (starts_with(node, 'doc:')) AS documents, count(*) FILTER (starts_with(node, 'work:')) AS works, CASE WHEN count(*) FILTER (starts_with(node, 'work:')) >= 1 OR count(*) FILTER (starts_with(node, 'doc:')) >= 2 THEN 'voice' ELSE 'unresolved' END AS verdict FROM roots GROUP BY voice""",
    "citation_degrees": """WITH works AS (SELECT DISTINCT l_orderkey AS work FROM lineitem), refs AS (SELECT l_orderkey AS citing, l_partkey % 997 AS work FROM lineitem), seeds AS (SELECT o_orderkey AS work FROM orders WHERE o_orderkey % 97 = 1)
SELECT w.work, count(*) AS in_degree, count(DISTINCT CASE WHEN citing <> w.work THEN citing END) AS edges, CASE WHEN w.work NOT IN (SELECT work FROM seeds) THEN count(DISTINCT CASE WHEN citing IN (SELECT work FROM seeds) THEN citing END) END AS seed_refs,
  CASE WHEN w.work NOT IN (SELECT work FROM seeds) THEN (SELECT count(DISTINCT r2.work) FROM refs r2 WHERE r2.citing = w.work AND r2.work IN (SELECT work FROM seeds)) END AS seed_cites FROM works w JOIN refs r ON r.work = w.work GROUP BY w.work""",
    "coauthor_credit": f"WITH {CREDIT} SELECT ego, author, round(credit, 6) AS credit, papers, nth::INTEGER AS nth FROM ranked WHERE nth <= 12",
    "coauthor_bridges": f"WITH {CREDIT} SELECT author, count(DISTINCT ego) AS egos, round(sum(credit), 6) AS credit FROM ranked WHERE nth <= 12 GROUP BY author HAVING count(DISTINCT ego) >= 2 ORDER BY round(sum(credit), 9) DESC, author LIMIT 15",
    "coauthor_cooccurrence": f"WITH {CREDIT}, top AS (SELECT DISTINCT author FROM ranked WHERE nth <= 14) SELECT x.author AS a, y.author AS b, count(*) AS works FROM auth x JOIN auth y USING (work) WHERE x.author < y.author AND x.author IN (SELECT author FROM top) AND y.author IN (SELECT author FROM top) GROUP BY ALL",
    "institution_cohort": "SELECT l_suppkey AS author, count(DISTINCT l_orderkey) AS works FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = 3 GROUP BY 1 ORDER BY works DESC, author LIMIT 40",
    "likely_same_people": f"WITH k AS (SELECT {KEY.format(chr(39).join(['p_name || ', ' ', ' || p_type']))} AS key, p_brand AS source, p_partkey::VARCHAR AS id FROM part) SELECT key, source, count(*) AS n, sha256(array_to_string(list_sort(list(DISTINCT id)), '+')) AS merged FROM k WHERE key <> '' GROUP BY ALL HAVING count(*) >= 2",
    "name_matches": f"SELECT p_partkey, len(list_filter(regexp_split_to_array(lower(p_type), '[^a-z]+'), lambda w: length(w) >= 2)) > 0 AS matches, {KEY.format('p_type')} AS key FROM part",
}
