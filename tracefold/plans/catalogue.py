"""All named queries of the core, with the SQL of those that SQL can express."""

from __future__ import annotations

from tracefold.plans import event_queries, fact_queries, feature_queries, problems, table_queries, time_queries

_MODULES = [problems, time_queries, event_queries, table_queries, feature_queries, fact_queries]
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
FLAGSHIP = "group_rollup"
