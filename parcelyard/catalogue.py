"""Every query of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracle: dict[str, str] = {}


def query(*views: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name. ``views``: definitions that stand in front of ``sql``."""

    def put(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _oracle[f.__name__] = ("with " + ", ".join(views) + " " if views else "") + sql
        return f

    return put


def _load() -> None:
    from .plans import (  # noqa: F401
        catalog_queries,
        community_queries,
        embedding_queries,
        file_queries,
        graph_queries,
        inference_queries,
        layout_queries,
        parcel_queries,
        path_queries,
        population_queries,
        similarity_queries,
        statistics_queries,
        volume_queries,
    )


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracle)
