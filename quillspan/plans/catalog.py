"""All queries of the engine by name, with the SQL that they are held against."""

from __future__ import annotations

from quillspan.plans import audit, evidence, extract, identity, memory, names, nested, network, retrieval, store

AREAS = [retrieval, network, evidence, memory, store, audit, names, nested, identity, extract]
QUERIES = {name: query for area in AREAS for name, query in area.QUERIES.items()}
ORACLE_SQL = {name: sql for area in AREAS for name, sql in area.ORACLE_SQL.items()}
FLAGSHIP = retrieval.merged_rank
