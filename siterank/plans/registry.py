"""Registered queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan builder under ``name``, with the SQL that must give the same table."""

    def keep(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def row_count(spark: SparkSession, folder: str, name: str) -> int:
    """Rows by the file footers."""
    return table(spark, folder, name).count()


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Fixed decimals for float columns and bigint for counts, so that engines compare by value."""
    out = []
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            out.append((F.round(F.col(name).cast("double"), digits) + F.lit(0.0)).alias(name))
        elif kind in ("int", "smallint", "tinyint"):
            out.append(F.col(name).cast("bigint").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def r(expression: str, digits: int = 6) -> str:
    """The SQL form of ``rounded`` for one expression."""
    return f"(round(CAST({expression} AS DOUBLE), {digits}) + 0e0)"
