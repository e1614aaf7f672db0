"""Registered queries and the SQL that each must agree with."""

from __future__ import annotations

from tessel.plans import audit_queries, export_queries, fragment_queries, pair_queries, record_queries, rule_queries, score_queries, store_queries, stream_queries, table_queries

_MODULES = (score_queries, table_queries, pair_queries, record_queries, rule_queries, stream_queries, store_queries, export_queries, audit_queries, fragment_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
