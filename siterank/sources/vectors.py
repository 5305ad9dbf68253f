"""GeoJSON points in, enriched GeoJSON out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

POINT_SCHEMA = ("features array<struct<id: string, properties: struct<component_id: string, name: string, coordinate_status: string, "
                "longitude: double, latitude: double, easting_m: double, northing_m: double>, geometry: struct<type: string, coordinates: array<double>>>>")


def read_points(spark: SparkSession, path: str, projected: bool = True, keep_unlocated: bool = False) -> DataFrame:
    """Components from a feature collection; a null geometry is dropped or kept as NULL, never filled in."""
    raw = spark.read.schema(POINT_SCHEMA).option("multiLine", "true").json(path).select(F.explode("features").alias("f"))
    axes = ("x", "y") if projected else ("longitude", "latitude")
    out = raw.select(F.col("f.properties.component_id").alias("component_id"), F.col("f.properties.name").alias("name"),
                     *[F.get("f.geometry.coordinates", F.lit(i)).alias(a) for i, a in enumerate(axes)])
    return out if keep_unlocated else out.where(F.col(axes[0]).isNotNull())


def enriched_features(points: DataFrame, scores: DataFrame, ranks: DataFrame, intervals: DataFrame) -> DataFrame:
    """One GeoJSON feature per row with scores, ranks and rank interval as properties; unmatched points stay."""
    joined = points
    for extra in (scores, ranks, intervals):
        joined = joined.join(extra, "component_id", "left")
    located = F.col("longitude").isNotNull()
    geometry = F.when(located, F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates")))
    properties = F.struct(*[c for c in joined.columns if c not in ("longitude", "latitude")])
    feature = F.struct(F.lit("Feature").alias("type"), F.col("component_id").alias("id"), properties.alias("properties"), geometry.alias("geometry"))
    return joined.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def write_features(features: DataFrame, path: str) -> None:
    """Newline-delimited features, written in parallel."""
    features.write.mode("overwrite").text(path)
