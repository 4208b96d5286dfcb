"""Named queries over the test tables, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function of (spark, folder) under its own name, with its oracle."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


from . import case_queries, composed_queries, dataset_queries, evaluation_queries, graph_queries, operations_queries, retrieval_queries, scope_queries, text_queries, workflow_queries  # noqa: E402, F401
