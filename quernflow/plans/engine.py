"""Running SQL over named views, in two modes.

`native` hands the text to Spark and covers all of Spark SQL. `strict` goes through the dialect's own parser and binder
and keeps its semantics: whole-number division, IEEE doubles, frames counted in rows, text comparison of mixed types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import dialect_session
from .binder import bind_sql
from .parser import SqlError


class Catalog:
    """Views by case-insensitive name."""

    def __init__(self, spark: SparkSession):
        self.spark = dialect_session(spark)
        self.views: dict[str, DataFrame] = {}

    def register(self, name: str, df: DataFrame) -> None:
        if name.lower() in self.views:
            raise ValueError(f"View '{name}' is already registered")
        self.replace(name, df)

    def replace(self, name: str, df: DataFrame) -> None:
        self.views[name.lower()] = df
        df.createOrReplaceTempView(name.lower())

    def lookup(self, name: str) -> DataFrame:
        if name.lower() not in self.views:
            raise KeyError(f"Unknown view '{name}'. Known views: {', '.join(sorted(self.views))}")
        return self.views[name.lower()]

    def sql(self, text: str, mode: str = "native", max_nonequi_rows: int | None = None) -> DataFrame:
        if not text.strip():
            raise SqlError("SQL is empty")
        if mode == "strict":
            return bind_sql(self.spark, text, self.views, max_nonequi_rows)
        return self.spark.sql(text)


def execute(spark: SparkSession, sql: str, tables: dict[str, DataFrame], mode: str = "native") -> DataFrame:
    """One query over DataFrames of this session; strict mode needs a session of the dialect (`dialect_session`)."""
    if mode == "strict":
        return bind_sql(spark, sql, tables)
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)
