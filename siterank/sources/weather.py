"""Daily weather JSON of two products."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from siterank.functions.columns import SENTINEL, clean

# Fixed renames of the second product.
PARAMETERS = {
    "PRECTOTCORR": "precipitation_sum",
    "T2M": "temperature_2m_mean",
    "T2M_MAX": "temperature_2m_max",
    "T2M_MIN": "temperature_2m_min",
    "RH2M": "relative_humidity_2m_mean",
    "WS10M": "wind_speed_10m_mean",
}


def read_column_json(spark: SparkSession, path: str, variables: Sequence[str]) -> DataFrame:
    """Column-oriented files, one per weather cell; the cell id is the file-name prefix before ``_era5`` or ``_daily``."""
    fields = ", ".join(["time: array<string>", *[f"{v}: array<double>" for v in variables]])
    raw = spark.read.schema(f"daily struct<{fields}>").option("multiLine", "true").json(path)
    cell = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)_(?:era5|daily)", 1)
    zipped = F.arrays_zip(*[F.col(f"daily.{v}").alias(v) for v in ("time", *variables)])
    rows = raw.select(cell.alias("weather_cell_id"), F.explode(zipped).alias("d"))
    return rows.select("weather_cell_id", F.to_date("d.time").alias("date"), *[clean(F.col(f"d.{v}"), SENTINEL["weather"]).alias(v) for v in variables])


def read_map_json(spark: SparkSession, path: str) -> DataFrame:
    """Parameter to (yyyymmdd to value) maps; renamed, sentinels to NULL, one row per date."""
    raw = spark.read.schema("properties struct<parameter: map<string, map<string, double>>>").option("multiLine", "true").json(path)
    long = raw.select(F.explode("properties.parameter").alias("parameter", "days")).select("parameter", F.explode("days").alias("day", "v"))
    kept = long.where(F.col("parameter").isin(*PARAMETERS)).withColumn("v", clean("v", SENTINEL["weather"]))
    wide = kept.groupBy(F.to_date("day", "yyyyMMdd").alias("date")).pivot("parameter", list(PARAMETERS)).agg(F.max("v"))
    return wide.select("date", *[F.col(p).alias(n) for p, n in PARAMETERS.items()])
