"""Where queries register themselves with the survey rows they cover and their SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Rows of the operator inventory that a query covers.
COVERS: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of `part` for work in Python: rows are few bytes, so files of millions are a task or two unless dealt out."""
    return table(spark, sf_dir, "part").select(*columns).repartition(2 * spark.sparkContext.defaultParallelism)


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name], COVERS[name] = run, covers.split()
        if sql is not None:
            ORACLE_SQL[name] = sql
        return run

    return register
