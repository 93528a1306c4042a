"""Every query by name, with the SQL that should give the same rows."""

from __future__ import annotations

from lodestone.plans import analysis_queries, graph_queries, lock_queries, maven_queries, node_queries, project_queries, reader_queries, scalar_queries, set_queries, tree_queries, unit_queries
from lodestone.plans.registry import Query

_REGISTRIES = [m.registry for m in (graph_queries, analysis_queries, reader_queries, scalar_queries, set_queries, lock_queries, project_queries, maven_queries, node_queries, tree_queries, unit_queries)]

QUERIES: dict[str, Query] = {k: v for r in _REGISTRIES for k, v in r.queries.items()}
ORACLE_SQL: dict[str, str] = {k: v for r in _REGISTRIES for k, v in r.oracle_sql.items()}
