"""Candidate sources against the roster: hosts in common, names that nearly agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import names
from quillspan.plans.retrieval import DOCS, corpus, table


def page_names(spark, sf):
    """What the pages' hosts are called, without the common domain."""
    return table(spark, sf, "pages").select(F.regexp_replace(names.host(F.col("url")), r"\.example\.\w+$", "").alias("name"))


def similar_hosts(spark, sf):
    """Every page's host against all others'."""
    found = page_names(spark, sf)
    return names.similar_names(found, found)


def nodes(spark, sf):
    return corpus(spark, sf).withColumn("found", F.struct(*(c.alias(n) for c, n in zip(names.node_host(F.col("doi"), F.col("url")), ("host", "edge")))))


def node_hosts(spark, sf):
    return nodes(spark, sf).select("pos", "found.host", "found.edge")


def host_overlap(spark, sf):
    candidates = corpus(spark, sf).select(F.col("source").alias("name"), F.coalesce("doi", "url").alias("url"))
    roster = table(spark, sf, "supplier").selectExpr("s_name AS name", "concat('HTTP://www.site', s_suppkey % 997, '.org:80/about') AS url")
    return names.host_overlap(candidates, roster)


QUERIES = {"similar_hosts": similar_hosts, "node_hosts": node_hosts, "host_overlap": host_overlap}
ORACLE_SQL = {
    "node_hosts": f"WITH {DOCS} SELECT pos, CASE WHEN doi IS NOT NULL THEN 'doi.org' ELSE 'www.site' || (pos % 50) || '.org' END AS host, CASE WHEN doi IS NOT NULL THEN 'venue_doi' ELSE 'venue_url' END AS edge FROM docs",
    "host_overlap": f"WITH {DOCS}, c AS (SELECT DISTINCT source AS name, CASE WHEN doi IS NOT NULL THEN 'doi.org' ELSE 'www.site' || (pos % 50) || '.org' END AS host FROM docs) SELECT name, s_name AS existing, host AS shared_host FROM c JOIN supplier ON host = 'www.site' || (s_suppkey % 997) || '.org'",
}
