"""Registry of the library's queries and of the SQL they are checked against."""

from __future__ import annotations

from factloom.plans import canonical_queries, cohesion_queries, compare_queries, timer_queries, ingestion_queries, detection_queries, fact_queries, history_queries, knowledge_queries, mechanic_queries, record_queries, section_queries, table_queries

_MODULES = (fact_queries, table_queries, knowledge_queries, record_queries, mechanic_queries, detection_queries, compare_queries, section_queries, history_queries, canonical_queries, timer_queries, ingestion_queries, cohesion_queries)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
