"""Named queries over the test tables: a builder (spark, folder) -> DataFrame for each, and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Builder], Builder]:
    """Registers a builder under its name."""

    def add(builder: Builder) -> Builder:
        QUERIES[builder.__name__] = builder
        if sql:
            SQL[builder.__name__] = sql
        return builder

    return add
