"""All queries of the engine's own operators, by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: The query that the smoke check runs.
FLAGSHIP = "list_pipeline"

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, its DuckDB text."""

    def add(function: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = function
        if sql:
            _SQL[name] = sql
        return function

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _load() -> None:
    from paperloom.plans import business_queries, case_queries, event_queries, file_queries, finding_queries, form_queries, index_queries, page_queries, privacy_queries, record_queries, region_queries, report_queries, ruling_queries, segment_queries, text_queries  # noqa: F401


_load()
