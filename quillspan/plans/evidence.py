"""Queries over the evidence graph of orders, documents, rulings and statements, each under a policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import text as X
from quillspan.operators import evidence, statements
from quillspan.operators.keyindex import KeyIndex
from quillspan.plans import network
from quillspan.plans.retrieval import DOCS, FP, corpus, table
from quillspan.storage import materialise


def requests(spark, sf):
    """Each order says something about its customer, or takes back what was said."""
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS seq", "CASE WHEN o_orderkey % 7 = 0 THEN 'delete' ELSE 'save' END AS op", "concat(' person:c:', o_custkey) AS src",
        "CASE WHEN o_orderkey % 53 = 0 THEN ' ' WHEN o_orderkey % 3 = 0 THEN concat('topic:p', o_orderkey % 200) WHEN o_orderkey % 3 = 1 THEN concat('claim:label:', lower(o_orderstatus)) ELSE concat('inst:n', o_custkey % 25) END AS dst",
        "CASE WHEN o_orderkey % 31 = 0 THEN ' Same  as' WHEN o_orderkey % 37 = 0 THEN '!?' WHEN o_orderkey % 43 = 0 THEN repeat('long ', 9) ELSE o_orderpriority END AS type",
        "CASE WHEN o_orderkey % 41 = 0 THEN '  ' ELSE concat('order ', o_orderkey) END AS note", "CASE WHEN o_orderkey % 2 = 0 THEN concat('work:o:', o_orderkey) END AS doc",
        "concat(date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\"), CASE WHEN o_orderkey % 4 = 0 THEN 'Z' WHEN o_orderkey % 4 = 1 THEN '+00:00' ELSE '' END) AS stated_at",
    )


REQUESTS = r"""asked AS (
  SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 7 = 0 THEN 'delete' ELSE 'save' END AS op, 'person:c:' || o_custkey AS src,
    CASE WHEN o_orderkey % 53 = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN 'topic:p' || (o_orderkey % 200) WHEN o_orderkey % 3 = 1 THEN 'claim:label:' || lower(o_orderstatus) ELSE 'inst:n' || (o_custkey % 25) END AS dst,
    CASE WHEN o_orderkey % 31 = 0 THEN 'same_as' WHEN o_orderkey % 37 = 0 THEN '' WHEN o_orderkey % 43 = 0 THEN 'long_long_long_long_long_long_long_long_long'
      ELSE map {'1-URGENT': '1_urgent', '2-HIGH': '2_high', '3-MEDIUM': '3_medium', '4-NOT SPECIFIED': '4_not_specified', '5-LOW': '5_low'}[o_orderpriority] END AS type,
    CASE WHEN o_orderkey % 41 = 0 THEN '' ELSE 'order ' || o_orderkey END AS note, CASE WHEN o_orderkey % 2 = 0 THEN 'work:o:' || o_orderkey ELSE '' END AS doc,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || CASE WHEN o_orderkey % 4 = 0 THEN 'Z' WHEN o_orderkey % 4 = 1 THEN '+00:00' ELSE '' END AS stated_at, o_orderdate AS added
  FROM orders
), judged AS (
  SELECT *, CASE WHEN src = '' OR dst = '' THEN 'no ends' WHEN type = '' THEN 'no type' WHEN length(type) > 40 THEN 'long type' WHEN type IN ('same_as', 'not_same_as') THEN 'identity' WHEN op = 'save' AND note = '' THEN 'no note' END AS refused FROM asked
), st AS MATERIALIZED (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, type ORDER BY seq DESC) AS nth FROM judged WHERE refused IS NULL) WHERE nth = 1 AND op = 'save')"""


def statements_settled(spark, sf):
    return statements.settled(None, requests(spark, sf))


def statements_refused(spark, sf):
    return statements.checked(requests(spark, sf)).where("refused IS NOT NULL").select("seq", "refused")


def documents(spark, sf):
    """Two documents of three are indexed, a third has thin rows, and some have both."""
    fp = X.fingerprint(*(F.col(c) for c in ("title", "doi", "url", "source", "source_id")))
    docs = corpus(spark, sf).withColumn("fp", fp).selectExpr(
        "pos", "concat('doc:', source, ':', source_id) AS id", "title", "fp", "CASE WHEN pos % 40 = 1 THEN concat('W', pos % 9) END AS openalex", "doi", "arxiv",
        "timestampadd(DAY, CAST(pos % 900 AS INT), TIMESTAMP '2023-01-01') AS last_seen",
    )
    thin = docs.where("pos % 3 = 2").withColumns({"title": F.concat(F.lit("thin "), F.substring("title", 1, 20)), "last_seen": F.lit("2022-01-01").cast("timestamp")})
    return evidence.known_documents(docs.where("pos % 6 <> 5").drop("pos"), thin.drop("pos"))


def tables(spark, sf):
    docs = corpus(spark, sf)
    seen = "timestampadd(DAY, CAST(pos % 900 AS INT), TIMESTAMP '2023-01-01')"
    of_docs = docs.selectExpr("concat('doc:', source, ':', source_id) AS src", "concat('source:', source) AS dst", "'sourced_from' AS type", "'M' AS tier", "'tap' AS method", f"{seen} AS first_seen")
    writers = docs.where("doi IS NOT NULL").selectExpr("concat('person:c:', pos % 100) AS src", "concat('work:doi:', lower(doi)) AS dst", "'authored' AS type", "'M' AS tier", "'tap' AS method", "TIMESTAMP '2023-06-01' AS first_seen").distinct()
    edges = materialise(network.edges(spark, sf).select(*of_docs.columns).unionByName(of_docs).unionByName(writers), "edges")  # each hop reads them twice
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"), "first_seen").where(~F.startswith("id", F.lit("doc:"))).groupBy("id").agg(F.max("first_seen").alias("last_seen"))
    nodes = ends.select("id", network.graph.node_kind(F.col("id")).alias("kind"), F.regexp_replace("id", "^[a-z]+:", "").alias("label"), "last_seen")
    return evidence.Evidence(nodes, edges, materialise(documents(spark, sf), "documents"), network.rulings(spark, sf), materialise(statements_settled(spark, sf), "statements"))


TABLES = f"""{network.EDGES}, {DOCS}, {FP}, {REQUESTS},
stored AS MATERIALIZED (SELECT src, dst, type, tier, method, first_seen FROM edges
  UNION ALL SELECT 'doc:' || source || ':' || source_id, 'source:' || source, 'sourced_from', 'M', 'tap', TIMESTAMP '2023-01-01' + to_days((pos % 900)::INTEGER) FROM docs
  UNION ALL SELECT DISTINCT 'person:c:' || (pos % 100), 'work:doi:' || lower(doi), 'authored', 'M', 'tap', TIMESTAMP '2023-06-01' FROM docs WHERE doi IS NOT NULL),
named AS MATERIALIZED (SELECT id, CASE split_part(id, ':', 1) WHEN 'inst' THEN 'institution' ELSE split_part(id, ':', 1) END AS kind, regexp_replace(id, '^[a-z]+:', '') AS label, max(first_seen) AS last_seen
  FROM (SELECT src AS id, first_seen FROM stored UNION ALL SELECT dst, first_seen FROM stored) WHERE NOT starts_with(id, 'doc:') GROUP BY id),
papers AS MATERIALIZED (SELECT 'doc:' || source || ':' || source_id AS id, CASE WHEN pos % 6 = 5 THEN 'thin ' || title[1:20] ELSE title END AS title, fp, CASE WHEN pos % 40 = 1 THEN 'W' || (pos % 9) END AS openalex, doi, arxiv,
  CASE WHEN pos % 6 = 5 THEN TIMESTAMP '2022-01-01' ELSE TIMESTAMP '2023-01-01' + to_days((pos % 900)::INTEGER) END AS last_seen FROM keyed),
rul AS MATERIALIZED (SELECT least(a, b) AS a, greatest(a, b) AS b, min(v) AS v FROM (SELECT 'person:c:' || c_custkey AS a, 'person:c:' || (c_custkey - 5 + c_custkey % 2) AS b, CASE WHEN c_custkey % 20 = 0 THEN 'not_same' ELSE 'same' END AS v FROM customer WHERE c_custkey % 10 = 0) GROUP BY 1, 2),
carried AS (SELECT id AS src, 'work:openalex:' || openalex AS dst, 'id_eq:openalex' AS method FROM papers WHERE openalex <> '' UNION ALL SELECT id, 'work:doi:' || lower(trim(doi)), 'id_eq:doi' FROM papers WHERE doi <> '' UNION ALL SELECT id, 'work:arxiv:' || arxiv, 'id_eq:arxiv' FROM papers WHERE arxiv <> '')"""
CONSERVATIVE = "'id_eq:doi', 'id_eq:arxiv', 'id_eq:openalex', 'id_eq:orcid'"
NOT_REFUSED = "NOT (type = 'same_as' AND EXISTS (SELECT 1 FROM rul WHERE v = 'not_same' AND rul.a = least(src, dst) AND rul.b = greatest(src, dst)))"
#: Every edge that counts, by policy: the hops of the views find those that touch their frontiers.
WORKING = f"""counted AS MATERIALIZED (SELECT * FROM (SELECT src, dst, type, method, NULL AS tier FROM stored WHERE type <> 'same_as' OR method IN ({CONSERVATIVE}, 'ruling')
  UNION SELECT src, dst, 'same_as', method, NULL FROM carried UNION SELECT a, b, 'same_as', 'ruling', 'J-ruling' FROM rul WHERE v = 'same' UNION SELECT src, dst, type, 'statement', 'J' FROM st) WHERE {NOT_REFUSED})"""
EXPLORATORY = f"""counted AS MATERIALIZED (SELECT * FROM (SELECT src, dst, type, method, NULL AS tier FROM stored WHERE type <> 'same_as' OR method IN ({CONSERVATIVE}, 'ruling', 'align:title_fp', 'align:name_match')
  UNION SELECT src, dst, 'same_as', method, NULL FROM carried UNION SELECT least(x.id, y.id), greatest(x.id, y.id), 'same_as', 'align:title_fp', NULL FROM papers x JOIN papers y USING (fp) WHERE starts_with(fp, 'title:') AND x.id <> y.id
  UNION SELECT a, b, 'same_as', 'ruling', 'J-ruling' FROM rul WHERE v = 'same' UNION SELECT src, dst, type, 'statement', 'J' FROM st) WHERE {NOT_REFUSED})"""




def touching(of: str, nodes: str) -> str:
    """The edges of ``of`` that a hop from ``nodes`` sees: the works of documents, but not the documents of works."""
    return f"SELECT * FROM {of} WHERE src IN (SELECT node FROM {nodes}) UNION SELECT * FROM {of} WHERE dst IN (SELECT node FROM {nodes}) AND NOT (starts_with(src, 'doc:') AND starts_with(method, 'id_eq:'))"


def ends(edges: str) -> str:
    return f"SELECT src AS node FROM {edges} UNION SELECT dst FROM {edges}"


def bounded(anchor: str, most: int) -> str:
    """The nodes of ``found`` and of the anchor, cut to ``most``, and the edges between those that stay."""
    return f"""ids AS (SELECT src AS id FROM found UNION SELECT dst FROM found UNION SELECT '{anchor}'),
degree AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM found UNION ALL SELECT dst FROM found WHERE src <> dst) GROUP BY id),
placed AS (SELECT id, coalesce(named.kind, CASE split_part(id, ':', 1) WHEN 'doc' THEN 'document' WHEN 'inst' THEN 'institution' ELSE split_part(id, ':', 1) END) AS kind,
  coalesce(CASE WHEN named.id IS NOT NULL THEN named.label ELSE title END, CASE WHEN split_part(id, ':', 2) = 'label' THEN substr(id, length(split_part(id, ':', 1)) + 8) END) AS label,
  row_number() OVER (ORDER BY id = '{anchor}' DESC, CASE WHEN papers.id IS NOT NULL THEN papers.last_seen ELSE named.last_seen END DESC NULLS LAST, degree DESC NULLS LAST, id) AS nth, count(*) OVER () > {most} AS capped
  FROM ids LEFT JOIN named USING (id) LEFT JOIN papers USING (id) LEFT JOIN degree USING (id)),
stay AS (SELECT * FROM placed WHERE nth <= {most})"""


def neighborhood(spark, sf):
    found = evidence.neighborhood(tables(spark, sf), "person:c:10", 2, None, "working", 500)
    return found.rows()


def neighborhood_of_document(spark, sf):
    """A document of a title that others share, by title, statements and stored edges of one type alone."""
    anchor = documents(spark, sf).where("fp LIKE 'title:%' AND doi IS NOT NULL").agg(F.min("id")).first()[0]
    return evidence.neighborhood(tables(spark, sf), anchor or "doc:none:0", 2, ["authored", "5_low"], "exploratory", 50).rows().where("part = 'edge'").select("src", "dst", "type", "method", "tier")


def since(spark, sf):
    found = evidence.since(tables(spark, sf), "person:c:7", "1996-01-01", None, 25)
    return found.rows()


def between(spark, sf):
    found = evidence.between(tables(spark, sf), "person:c:10", "person:c:30", None, "exploratory")
    return found.select("nth", F.array_join("path", "|").alias("path"), "edges", "capped")


def asked_voices(spark, sf):
    rows = corpus(spark, sf).where("pos % 50 IN (3, 4) OR pos % 40 = 1").orderBy("pos").limit(60).collect()  # the view takes 64 ids at most
    return [f"doc:{r.source}:{r.source_id}" for r in rows] + ["work:o:1"]


def document_voices(spark, sf):
    found = evidence.voices(tables(spark, sf), asked_voices(spark, sf), "exploratory")
    joined = {c: F.array_join(c, ",").alias(c) for c in ("docs", "works", "persons")}
    return found.select("voice", "verdict", *joined.values(), "speaker_known")


def title_partners(spark, sf):
    """Of each title that documents share, how many; from the bucketed index."""
    return KeyIndex(documents(spark, sf)).partners().where("documents > 1").select(F.sha2("key", 256).alias("title"), "documents")


def anchor_edges(spark, sf):
    """The identities of the first twenty documents that carry a DOI or whose title others share."""
    docs = documents(spark, sf)
    anchors = [r.id for r in docs.where("doi IS NOT NULL OR openalex IS NOT NULL").orderBy("id").limit(20).collect()]
    return KeyIndex(docs).edges(anchors)


QUERIES = {
    "title_partners": title_partners, "anchor_edges": anchor_edges,
    "statements_settled": statements_settled, "statements_refused": statements_refused, "evidence_neighborhood": neighborhood,
    "evidence_neighborhood_of_document": neighborhood_of_document, "evidence_since": since, "evidence_between": between, "document_voices": document_voices,
}
ROWS = "SELECT 'node' AS part, id AS src, kind, label, capped, NULL AS dst, NULL AS type, NULL AS method, NULL AS tier{0} FROM stay UNION ALL SELECT 'edge', src, NULL, NULL, NULL, dst, type, method, tier{1} FROM found WHERE src IN (SELECT id FROM stay) AND dst IN (SELECT id FROM stay)"
ORACLE_SQL = {
    "title_partners": f"WITH {TABLES} SELECT sha256(fp) AS title, count(*) AS documents FROM papers WHERE starts_with(fp, 'title:') GROUP BY fp HAVING count(*) > 1",
    "anchor_edges": f"""WITH {TABLES}, first AS (SELECT id FROM papers WHERE doi IS NOT NULL OR openalex IS NOT NULL ORDER BY id LIMIT 20)
SELECT src, dst, 'same_as' AS type, method FROM carried WHERE src IN (FROM first) UNION SELECT least(x.id, y.id), greatest(x.id, y.id), 'same_as', 'align:title_fp' FROM papers x JOIN papers y USING (fp) WHERE x.id IN (FROM first) AND x.id <> y.id AND starts_with(fp, 'title:')""",
    "statements_settled": f"WITH {REQUESTS} SELECT src, dst, type, note, doc, stated_at FROM st",
    "statements_refused": f"WITH {REQUESTS} SELECT seq, refused FROM judged WHERE refused IS NOT NULL",
    "evidence_neighborhood": f"""WITH {TABLES}, {WORKING}, h0 AS (SELECT 'person:c:10' AS node), e1 AS MATERIALIZED ({touching('counted', 'h0')}), h1 AS ({ends('e1')} UNION FROM h0),
found AS MATERIALIZED ({touching('counted', 'h1')}), {bounded('person:c:10', 500)}
{ROWS.format('', '')}""",
    "evidence_neighborhood_of_document": f"""WITH {TABLES}, {EXPLORATORY}, h0 AS (SELECT coalesce(min(id), 'doc:none:0') AS node FROM papers WHERE starts_with(fp, 'title:') AND doi IS NOT NULL),
allowed AS MATERIALIZED (SELECT * FROM counted WHERE type IN ('authored', '5_low', 'same_as') AND NOT (type = 'same_as' AND method IN ('id_eq:orcid', 'align:name_match'))),
e1 AS MATERIALIZED ({touching('allowed', 'h0')}), h1 AS ({ends('e1')} UNION FROM h0), found AS MATERIALIZED ({touching('allowed', 'h1')}), ids AS ({ends('found')} UNION FROM h0),
degree AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM found UNION ALL SELECT dst FROM found) GROUP BY node),
stay AS (SELECT node FROM ids LEFT JOIN named ON named.id = node LEFT JOIN papers ON papers.id = node LEFT JOIN degree USING (node) ORDER BY node IN (FROM h0) DESC, CASE WHEN papers.id IS NOT NULL THEN papers.last_seen ELSE named.last_seen END DESC NULLS LAST, degree DESC NULLS LAST, node LIMIT 50)
SELECT src, dst, type, method, tier FROM found WHERE src IN (FROM stay) AND dst IN (FROM stay)""",
    "evidence_since": f"""WITH {TABLES}, timed AS (SELECT src, dst, type, method, tier, first_seen AS added FROM stored UNION ALL SELECT src, dst, type, 'statement', 'J', added FROM st),
found AS MATERIALIZED (SELECT * FROM timed WHERE (src = 'person:c:7' OR dst = 'person:c:7') AND added >= TIMESTAMP '1996-01-01'), {bounded('person:c:7', 25)}
{ROWS.format(', NULL AS added', ', added')}""",
    "evidence_between": f"""WITH {TABLES}, {EXPLORATORY}, a0 AS (SELECT 'person:c:10' AS node), b0 AS (SELECT 'person:c:30' AS node), a1 AS MATERIALIZED ({touching('counted', 'a0')}), an AS ({ends('a1')}), b1 AS MATERIALIZED ({touching('counted', 'b0')}), bn AS ({ends('b1')}),
ring AS MATERIALIZED (FROM a1 UNION FROM b1 UNION {touching('counted', 'an')} UNION {touching('counted', 'bn')}),
way AS MATERIALIZED (SELECT src AS a, dst AS b FROM ring WHERE src <> dst UNION SELECT dst, src FROM ring WHERE src <> dst),
l1 AS (SELECT ['person:c:10', b] AS p, b FROM way WHERE a = 'person:c:10'), l2 AS (SELECT p || [way.b] AS p, way.b FROM l1 JOIN way ON way.a = l1.b WHERE NOT list_contains(p, way.b) AND NOT list_contains(p, 'person:c:30')),
r1 AS (SELECT ['person:c:30', b] AS p, b FROM way WHERE a = 'person:c:30'), r2 AS (SELECT p || [way.b] AS p, way.b FROM r1 JOIN way ON way.a = r1.b WHERE NOT list_contains(p, way.b) AND NOT list_contains(p, 'person:c:10')),
met AS (SELECT p FROM l1 WHERE b = 'person:c:30' UNION SELECT l1.p || ['person:c:30'] FROM l1 JOIN r1 USING (b) UNION SELECT l2.p || ['person:c:30'] FROM l2 JOIN r1 USING (b) UNION SELECT l2.p || list_reverse(r2.p)[2:] FROM l2 JOIN r2 USING (b)),
best AS (SELECT p, row_number() OVER (ORDER BY len(p), p) AS nth FROM met WHERE len(list_distinct(p)) = len(p))
SELECT nth::INTEGER AS nth, array_to_string(p, '|') AS path, (len(p) - 1)::INTEGER AS edges, (SELECT count(*) FROM best) > 8 AS capped FROM best WHERE nth <= 8""",
    "document_voices": f"""WITH RECURSIVE {TABLES}, {EXPLORATORY}, given AS MATERIALIZED (SELECT 'doc:' || source || ':' || source_id AS id FROM docs WHERE pos % 50 IN (3, 4) OR pos % 40 = 1 ORDER BY pos LIMIT 60),
same AS MATERIALIZED (SELECT src, dst FROM counted WHERE type = 'same_as' AND method <> 'ruling' AND (src IN (SELECT id FROM given) OR dst IN (SELECT id FROM given))),
links AS MATERIALIZED (SELECT src, dst FROM same UNION SELECT src, dst FROM stored WHERE type = 'authored' AND dst IN (SELECT dst FROM same)),
ways AS MATERIALIZED (SELECT src AS a, dst AS b FROM links UNION SELECT dst, src FROM links UNION SELECT id, id FROM given),
reach AS (SELECT a AS node, a AS least FROM ways UNION SELECT b, least FROM reach JOIN ways ON a = node WHERE least < b),
roots AS (SELECT node, min(least) AS root FROM reach GROUP BY node),
joined AS (SELECT list_sort(list(node) FILTER (node IN (SELECT id FROM given))) AS docs, list_sort(list(node) FILTER (starts_with(node, 'work:'))) AS works, list_sort(list(node) FILTER (starts_with(node, 'person:'))) AS persons FROM roots GROUP BY root)
SELECT docs[1] AS voice, CASE WHEN len(works) > 0 OR len(docs) > 1 THEN 'voice' ELSE 'unresolved' END AS verdict, array_to_string(docs, ',') AS docs, coalesce(array_to_string(works, ','), '') AS works, coalesce(array_to_string(persons, ','), '') AS persons, coalesce(len(persons), 0) > 0 AS speaker_known FROM joined WHERE len(docs) > 0
UNION ALL SELECT 'work:o:1', 'skipped', '', '', '', false""",
}
