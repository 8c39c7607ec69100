"""The registered queries over the input tables, each with its SQL counterpart where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "relation_facts_all"


def query(name: str, sql: str | None = None):
    """Register a query function under ``name``, with its SQL where SQL can express it."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


from tessera.plans import answer_queries, graph_queries, text_queries  # noqa: E402, F401  (they register themselves)
