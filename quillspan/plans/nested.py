"""Results as nested JSON, made from documents: citation counts with their provenance, and compiled assertions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import nested
from quillspan.plans.retrieval import table


def counted_results(spark, sf):
    """Each document as a result that counts citations at several depths, from several origins."""
    docs = table(spark, sf, "documents")
    parts = [
        '{"citation_count": ', F.col("doc_id"), ', "computed_by": "", "source": "', F.col("source"), '", "title": "t", "metadata": {"kind": "', F.when(F.col("doc_id") % 2 == 0, "DOI").otherwise("book"), '", "cited_by_count": ', F.col("doc_id") % 17,
        ', "inner": {"Count": 3.5, "flags": {"count": true}}}, "items": [{"value": 5}, {"provider": "Cited by", "value": 9, "more": {"value": ', F.col("doc_id") % 5, '}}, [{"citationCount": "8"}], {"count": -1, "provenance": "hand"}]}',
    ]
    return docs.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 19 == 0, F.lit("no json {")).otherwise(F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))).alias("json"))


def numeric_provenance(spark, sf):
    return nested.numeric_provenance(counted_results(spark, sf)).select("id", "value", "provenance")


def citation_conflicts(spark, sf):
    found = nested.citation_conflicts(nested.numeric_provenance(counted_results(spark, sf)), 4.0)
    return found.select("id", "provenances", F.round("ratio", 9).alias("ratio"), "passed")


RULES = {
    "shape": [{"path": "$.results", "exists": True}, {"path": "results[0].id", "exists": True}, {"path": "error", "exists": False}, {"path": "results.1.id"}],
    "values": [{"path": "n", "equals": 3}, {"path": "n", "gt": 2}, {"path": "n", "gte": 3.0}, {"path": "name", "equals": "src3"}, {"path": "name", "gt": "src2"}, {"path": "nothing", "equals": None}, {"path": "name", "gt": 1}],
    "lists": [{"path": "results", "each": {"fields": ["id", "source"], "exists_any": ["url", "doi"]}}, {"path": "results", "each_provenance": True}, {"path": "size", "reduction": True}],
    "either": [{"any_of": [{"path": "n", "equals": 1}, {"path": "n", "equals": 2}]}, {"any_of": []}, "no rule", {"exists": True}],
    "empty": [],
}


def checked_results(spark, sf):
    """Each event as an answer of one of the tasks."""
    e = table(spark, sf, "events")
    n, i = F.col("event_id") % 5, F.col("event_id").cast("string")
    parts = [
        '{"n": ', n.cast("string"), ', "name": "src', n.cast("string"), '", "nothing": null, "size": {"in": ', n.cast("string"), ', "out": 2}, "results": [{"id": ', i, ', "source": "', F.when(n == 4, "").otherwise("s"), '", "url": "', F.when(n == 1, "").otherwise("u"), '"}',
        F.when(F.col("event_id") % 2 == 0, ', {"id": 0, "source_name": "x", "source": null, "doi": "d", "metadata": {"id": "m"}}').otherwise(""), "]", F.when(F.col("event_id") % 7 == 0, ', "error": null').otherwise(""), "}",
    ]
    body = F.when(F.col("event_id") % 11 == 0, F.lit("plain text")).when(F.col("event_id") % 11 == 1, F.lit("[1]")).otherwise(F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))
    return e.select(F.col("event_id").alias("id"), F.element_at(F.array(*map(F.lit, [*RULES, "unheard of"])), (F.col("event_id") % 6).cast("int") + 1).alias("task"), body.alias("json"))


def assertions_judged(spark, sf):
    return nested.judged(checked_results(spark, sf), RULES).select("id", "task", "status", F.array_join("failed", ",").alias("failed"))


QUERIES = {"numeric_provenance": numeric_provenance, "citation_conflicts": citation_conflicts, "assertions_judged": assertions_judged}
#: What each result says, told one by one.
TOLD = """told AS (SELECT doc_id AS id, doc_id::DOUBLE AS value, source AS provenance FROM d UNION ALL SELECT doc_id, doc_id % 17, CASE WHEN doc_id % 2 = 0 THEN 'kind:doi' ELSE source END FROM d UNION ALL SELECT doc_id, 3.5, CASE WHEN doc_id % 2 = 0 THEN 'kind:doi' ELSE source END FROM d
  UNION ALL SELECT doc_id, 9, 'Cited by' FROM d UNION ALL SELECT doc_id, doc_id % 5, 'Cited by' FROM d UNION ALL SELECT doc_id, -1, 'hand' FROM d)"""
D = "d AS (SELECT * FROM documents WHERE doc_id % 19 <> 0)"
ORACLE_SQL = {
    "numeric_provenance": f"WITH {D}, {TOLD} SELECT id, value::DOUBLE AS value, provenance FROM told",
    # by place: citation_count, the items in order, then metadata; 'more' comes before 'value' by name
    "citation_conflicts": f"""WITH {D}, firsts AS (SELECT doc_id AS id, source AS provenance, doc_id::DOUBLE AS value FROM d UNION ALL SELECT doc_id, 'kind:doi', doc_id % 17 FROM d WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'Cited by', doc_id % 5 FROM d UNION ALL SELECT doc_id, 'hand', -1 FROM d),
s AS (SELECT id, count(*) AS provenances, CASE WHEN count(*) FILTER (value > 0) >= 2 THEN max(value) FILTER (value > 0) / min(value) FILTER (value > 0) ELSE 0 END AS r FROM firsts GROUP BY id) SELECT id, provenances, round(r, 9)::DOUBLE AS ratio, provenances >= 2 AND r >= 4.0 AS passed FROM s""",
    "assertions_judged": """WITH e AS (SELECT event_id AS id, event_id % 5 AS n, event_id % 6 AS t, event_id % 11 >= 2 AS object, event_id % 2 = 0 AS two, event_id % 7 = 0 AS error FROM events),
c AS (SELECT id, ['shape', 'values', 'lists', 'either', 'empty', 'unheard of'][t + 1] AS task, CASE t
  WHEN 0 THEN [NOT object, NOT object, object AND error, NOT (object AND two)]
  WHEN 1 THEN [NOT (object AND n = 3), NOT (object AND n > 2), NOT (object AND n >= 3), NOT (object AND n = 3), NOT (object AND n >= 3), NOT object, true]
  WHEN 2 THEN [NOT object, NOT (object AND n <> 4 AND (n <> 1 OR id <> 0)), NOT (object AND n > 2)]
  WHEN 3 THEN [NOT (object AND n IN (1, 2)), true, true, true] WHEN 4 THEN [] END AS bad FROM e)
SELECT id, task, CASE WHEN bad IS NULL THEN 'unknown' WHEN NOT list_contains(bad, true) THEN 'pass' ELSE 'fail' END AS status, coalesce(array_to_string(list_filter([CASE WHEN bad[i + 1] THEN i END FOR i IN range(len(bad))], lambda x: x IS NOT NULL), ','), '') AS failed FROM c""",
}
