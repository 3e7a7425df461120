"""Area layers from GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.conform import MissingColumns

# Texts that mean a flagged area.
FLAGGED = ("Y", "YES", "TRUE", "1")
_LAYER = "features array<struct<properties: map<string,string>, geometry: string>>"


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature: properties by name and the geometry as its JSON text."""
    layer = spark.read.schema(_LAYER).option("multiLine", True).json(path)
    return layer.select(F.explode("features").alias("f")).select("f.properties", "f.geometry")


def read_flagged_layer(spark: SparkSession, path: str, flag: str = "EJAREA") -> DataFrame:
    """``ejarea`` and geometry; a layer without the property is refused."""
    features = read_layer(spark, path)
    if features.where(F.map_contains_key("properties", flag)).isEmpty():
        raise MissingColumns(f"layer lacks property {flag}")
    value = F.upper(F.try_element_at("properties", F.lit(flag)))
    return features.select(F.coalesce(value.isin(*FLAGGED), F.lit(False)).alias("ejarea"), "geometry")


def polygons(areas: DataFrame) -> DataFrame:
    """Rings as (lon, lat) arrays; a Polygon counts as a MultiPolygon of one part."""
    kind = F.get_json_object("geometry", "$.type")
    text = F.get_json_object("geometry", "$.coordinates")
    one = F.array(F.from_json(text, "array<array<array<double>>>"))
    many = F.from_json(text, "array<array<array<array<double>>>>")
    return areas.withColumn("polygons", F.when(kind == "Polygon", one).otherwise(many))


def as_feature_collection(areas: DataFrame) -> DataFrame:
    """Each area as a GeoJSON feature text, one row per area."""
    return areas.select(
        F.concat(
            F.lit('{"type":"Feature","properties":{"ejarea":'), F.col("ejarea").cast("string"),
            F.lit('},"geometry":'), F.col("geometry"), F.lit("}"),
        ).alias("feature")
    )
