"""Query registry: a name, a builder (spark, folder) -> DataFrame and, where SQL can say it, the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rollbook.session import importable, read_table

Builder = Callable[[SparkSession, str], DataFrame]


class Tables:
    """Attribute access to the tables of a folder: t.documents."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        importable(spark)

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)


class Registry:
    def __init__(self) -> None:
        self.builders: dict[str, Builder] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
        def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            self.builders[name] = lambda spark, folder: build(Tables(spark, folder))
            if sql:
                self.sql[name] = sql
            return build

        return add
