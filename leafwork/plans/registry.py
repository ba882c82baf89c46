"""All queries of the document engine and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame under a name, with its SQL where there is one."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


from leafwork.plans import documents, gates, geometry, joins, layout, records, scalars  # noqa: E402, F401
