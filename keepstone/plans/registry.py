"""Named queries over the supplied tables, and the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its SQL where SQL can express it."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    import importlib

    for m in MODULES:
        importlib.import_module(f"keepstone.plans.{m}")


#: The modules that register queries when they are imported.
MODULES: list[str] = ["q_text", "q_memories", "q_retrieval", "q_graph", "q_timeline", "q_io", "q_more", "q_events", "q_writing", "q_files", "q_questions", "q_state", "q_sources"]


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["r16_retrieve"](spark, sf_dir)
