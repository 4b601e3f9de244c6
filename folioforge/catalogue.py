"""The registered queries and their SQL counterparts."""

from __future__ import annotations

from folioforge.plans import facet_queries, ingest_queries, search_queries

QUERIES = facet_queries.QUERIES | search_queries.QUERIES | ingest_queries.QUERIES
ORACLE_SQL = facet_queries.ORACLE_SQL | search_queries.ORACLE_SQL | ingest_queries.ORACLE_SQL
