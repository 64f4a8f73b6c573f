"""The register of queries: a function (spark, sf_dir) -> DataFrame, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables under this many bytes, as the planner estimates them, are dealt to all cores ahead of heavy work on each row.
SMALL_BYTES = 256 * 2**20


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small table dealt to all cores.

    A small file is one row group, so one task reads it however it is split; dealing its rows costs next to nothing. A
    large table has row groups for all cores and is left as it is, so nothing is shuffled where it would cost anything.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # noqa: SLF001
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SMALL_BYTES else df
