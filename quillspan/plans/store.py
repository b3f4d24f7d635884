"""Two batches applied to a new store: documents, thin documents, graph rows, tombstones and marks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import memory
from quillspan.operators.store import Batch, Store
from quillspan.plans.retrieval import corpus, table
from quillspan.storage import shared_dir

FIRST, SECOND = "2024-01-01 00:00:00", "2024-02-01 00:00:00"


def batches(spark, sf):
    docs = corpus(spark, sf).selectExpr("pos", "source", "CASE WHEN pos % 9 = 0 THEN NULL ELSE source_id END AS source_id", "url", "title", "content", "concat('fp:', pos % 100) AS fp", "doi", "arxiv AS arxiv_id", "CAST(NULL AS STRING) AS openalex_id")
    full = docs.where("pos % 3 <> 2").select("*", memory.content_hash(F.col("title"), F.col("content")).alias("content_hash"), F.lit(1).alias("seg_version"))
    again = full.where("pos % 4 = 0").withColumn("content_hash", F.when(F.col("pos") % 8 == 0, F.sha2(F.concat(F.lit("new"), F.col("content_hash")), 256)).otherwise(F.col("content_hash"))).withColumn("seg_version", F.when(F.col("pos") % 16 == 4, 2).otherwise(1))
    thin = docs.where("pos % 3 = 2")
    gone = docs.where("pos % 10 = 0").select("source", F.coalesce("source_id", "url").alias("source_id"))
    orders = table(spark, sf, "orders")
    node = orders.selectExpr("o_orderkey AS pos", "concat('person:c:', o_custkey) AS id", "CASE WHEN o_orderkey % 50 = 0 THEN ' ' ELSE 'person' END AS kind", "concat('c', o_orderkey) AS label", "map('status', o_orderstatus) AS attrs")
    edge = docs.where("pos % 3 = 2").selectExpr("pos", "concat('person:c:', pos % 90) AS src", "concat('doc:', source, ':', coalesce(source_id, url)) AS dst", "CASE WHEN pos % 2 = 0 THEN 'conflicts' ELSE 'authored' END AS type", "CASE WHEN pos % 11 = 0 THEN 'J' ELSE 'M' END AS tier", "'tap' AS method", "map('n', CAST(pos AS STRING)) AS attrs")
    marks = lambda now: docs.groupBy("source").agg(F.lit(now).cast("timestamp").alias("ran_at"), F.count("*").alias("doc_count"))
    one = Batch(documents=full, thin=thin, nodes=node.where("pos % 2 = 0"), edges=edge, marks=marks(FIRST))
    two = Batch(documents=again, thin=thin.where("pos % 5 = 1"), tombstones=gone, nodes=node.where("pos % 3 = 0"), edges=edge.where("pos % 7 = 3").withColumn("attrs", F.expr("map('n', 'again')")), marks=marks(SECOND).where("source <> 'src1'"))
    return one, two


def store_applied(spark, sf):
    """Every row of the store after both batches."""
    store = Store(spark, shared_dir(spark, "store"), 8)
    for batch, now in zip(batches(spark, sf), (FIRST, SECOND)):
        store.apply(batch, F.lit(now).cast("timestamp"))
    docs = store.read("documents").selectExpr("'document' AS part", "concat(source, ':', source_id) AS key", "content_hash AS detail", "first_seen", "last_seen", "version")
    nodes = store.read("nodes").select(F.lit("node").alias("part"), F.col("id").alias("key"), F.concat_ws("|", "kind", "label", F.col("attrs")["status"], F.col("attrs")["fp"], F.col("attrs")["doi"], F.col("attrs")["arxiv_id"]).alias("detail"), "first_seen", "last_seen", F.lit(0).alias("version"))
    edges = store.read("edges").selectExpr("'edge' AS part", "concat_ws(' ', src, dst, type, method) AS key", "concat(tier, attrs['n']) AS detail", "first_seen", "last_seen", "0 AS version")
    marks = store.read("marks").selectExpr("'mark' AS part", "source AS key", "CAST(doc_count AS STRING) AS detail", "ran_at AS first_seen", "ran_at AS last_seen", "0 AS version")
    return docs.unionByName(nodes).unionByName(edges).unionByName(marks)


QUERIES = {"store_applied": store_applied}
ORACLE_SQL = {
    "store_applied": f"""WITH d AS MATERIALIZED (SELECT doc_id AS pos, source, CASE WHEN doc_id % 9 = 0 THEN 'https://www.Site' || (doc_id % 50) || '.org/p/' || (doc_id % 700) || '/?q=' || doc_id ELSE doc_id::VARCHAR END AS sid, split_part(text, chr(10), 1) AS title,
  CASE WHEN doc_id % 50 = 3 THEN 'https://doi.org/10.1234/W' || (doc_id % 11) END AS doi, CASE WHEN doc_id % 90 = 4 THEN '2401.0' || (1000 + doc_id % 5) END AS arxiv, sha256(split_part(text, chr(10), 1) || chr(0) || text || chr(0)) AS h FROM documents),
lasts AS (SELECT 'person:c:' || o_custkey AS id, max_by('c' || o_orderkey || '|' || o_orderstatus, o_orderkey) FILTER (o_orderkey % 3 = 0) AS late, max_by('c' || o_orderkey || '|' || o_orderstatus, o_orderkey) FILTER (o_orderkey % 2 = 0) AS early FROM orders WHERE o_orderkey % 50 <> 0 GROUP BY ALL),
e AS (SELECT *, 'doc:' || source || ':' || sid AS dst, 'person:c:' || (pos % 90) AS src, CASE WHEN pos % 2 = 0 THEN 'conflicts' ELSE 'authored' END AS type FROM d WHERE pos % 3 = 2 AND pos % 11 <> 0 AND (pos % 10 <> 0 OR pos % 7 = 3))
SELECT 'document' AS part, source || ':' || sid AS key, CASE WHEN pos % 8 = 0 THEN sha256('new' || h) ELSE h END AS detail, TIMESTAMP '{FIRST}' AS first_seen, CASE WHEN pos % 4 = 0 THEN TIMESTAMP '{SECOND}' ELSE TIMESTAMP '{FIRST}' END AS last_seen, CASE WHEN pos % 8 = 0 OR pos % 16 = 4 THEN 2 ELSE 1 END AS version FROM d WHERE pos % 3 <> 2 AND pos % 10 <> 0
UNION ALL SELECT 'node', 'doc:' || source || ':' || sid, concat_ws('|', 'document', nullif(trim(title)[1:200], ''), 'fp:' || (pos % 100), nullif(doi, ''), nullif(arxiv, '')), TIMESTAMP '{FIRST}', CASE WHEN pos % 5 = 1 THEN TIMESTAMP '{SECOND}' ELSE TIMESTAMP '{FIRST}' END, 0 FROM d WHERE pos % 3 = 2 AND pos % 10 <> 0
UNION ALL SELECT 'node', id, 'person|' || coalesce(late, early), CASE WHEN early IS NULL THEN TIMESTAMP '{SECOND}' ELSE TIMESTAMP '{FIRST}' END, CASE WHEN late IS NULL THEN TIMESTAMP '{FIRST}' ELSE TIMESTAMP '{SECOND}' END, 0 FROM lasts WHERE early IS NOT NULL OR late IS NOT NULL
UNION ALL SELECT 'edge', CASE WHEN type = 'conflicts' THEN least(src, dst) || ' ' || greatest(src, dst) ELSE src || ' ' || dst END || ' ' || type || ' tap', 'M' || CASE WHEN pos % 7 = 3 THEN 'again' ELSE pos::VARCHAR END, CASE WHEN pos % 10 = 0 THEN TIMESTAMP '{SECOND}' ELSE TIMESTAMP '{FIRST}' END, CASE WHEN pos % 7 = 3 THEN TIMESTAMP '{SECOND}' ELSE TIMESTAMP '{FIRST}' END, 0 FROM e
UNION ALL SELECT 'mark', source, count(*)::VARCHAR, CASE WHEN source = 'src1' THEN TIMESTAMP '{FIRST}' ELSE TIMESTAMP '{SECOND}' END, CASE WHEN source = 'src1' THEN TIMESTAMP '{FIRST}' ELSE TIMESTAMP '{SECOND}' END, 0 FROM d GROUP BY source""",
}
