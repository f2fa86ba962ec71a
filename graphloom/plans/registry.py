"""All registered queries: name to callable, and name to SQL."""

from . import graph_queries, io_queries, orphan_queries, vector_queries

MODULES = [orphan_queries, graph_queries, vector_queries, io_queries]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
