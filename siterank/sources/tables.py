"""Tables by logical name, table sinks and JSON record sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType | str, kind: str = "csv") -> DataFrame:
    """A table with a declared schema; CSV has a header row."""
    reader = spark.read.schema(schema)
    return reader.option("header", "true").csv(path) if kind == "csv" else reader.format(kind).load(path)


def read_tables(spark: SparkSession, contracts: dict[str, tuple[str, T.StructType | str, str]]) -> dict[str, DataFrame]:
    """Tables by logical name from {name: (path, schema, kind)}; a missing path is left out."""
    found = {}
    for name, (path, schema, kind) in contracts.items():
        try:
            found[name] = read_table(spark, path, schema, kind)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    return found


def write_table(df: DataFrame, path: str, kind: str = "parquet", partitions: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("overwrite").partitionBy(*partitions) if partitions else df.write.mode("overwrite")
    writer.option("header", "true").format(kind).save(path)


def write_json_records(df: DataFrame, path: str) -> None:
    """One JSON object per row, NULL fields kept."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
