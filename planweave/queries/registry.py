"""Where queries register: name -> (spark, sf_dir) -> DataFrame, with the DuckDB SQL of the same result if there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Rows of the inventory that a query stands for.
ROWS: dict[str, tuple[str, ...]] = {}


class Tables:
    """The tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, *names: str) -> SparkSession:
        """A session of its own, in which the tables are views."""
        spark = self.spark.newSession()
        for n in names:
            spark.read.parquet(f"{self.folder}/{n}.parquet").createOrReplaceTempView(n)
        return spark


def query(name: str, rows: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        ROWS[name] = tuple(rows.split())
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register
