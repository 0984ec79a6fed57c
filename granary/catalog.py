"""All registered queries of the library: what they are called, how they run, what SQL gives the same."""

from __future__ import annotations

from granary.plans import discovery_queries, evidence_queries, fetch_queries, research_queries, retrieval_queries, table_queries

QUERIES: dict = {}
SQL: dict = {}
for _m in (retrieval_queries, table_queries, evidence_queries, fetch_queries, research_queries, discovery_queries):
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
