"""Named queries: a function of (spark, sf_dir) and, where SQL can say it, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from metaloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        """Register a function of a table loader t, where t("assets") is the table, under a name."""

        def keep(f: Callable[..., DataFrame]):
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = lambda spark, sf_dir: f(lambda n: table(spark, sf_dir, n))
            if sql is not None:
                self.sql[name] = sql
            return f

        return keep
