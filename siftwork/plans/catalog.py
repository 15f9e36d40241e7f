"""Where queries are registered, and the SQL that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import CLIENT_PATH_SQL, PATH_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with the SQL for the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def quoted(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


FILES = f"""files AS (SELECT doc_id AS file_id, source AS project, lang AS language, {PATH_SQL} AS path, {CLIENT_PATH_SQL} AS client_path,
  coalesce(text, '') AS text, strlen(coalesce(text, '')) AS size FROM documents)"""
