"""Administrative areas from GeoJSON files, plain or gzipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FEATURES = "features ARRAY<STRUCT<properties STRUCT<adcode STRING, name STRING, parent STRUCT<adcode STRING>>, geometry STRUCT<type STRING, coordinates STRING>>>"


def shapes(spark: SparkSession, path: str, level: str) -> DataFrame:
    """(level, place_id, name, parent_id, rings) of polygons and multi-polygons, one row a feature; other geometries are left out.

    A feature collection is one JSON value, so each file is read by one task; give large sets as several files.
    """
    data = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", _FEATURES)["features"]).alias("f"))
    kind, text, own = F.col("f.geometry.type"), F.col("f.geometry.coordinates"), F.col("f.properties")
    many = F.flatten(F.from_json(text, "ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>"))
    rings = F.when(kind == "Polygon", F.from_json(text, "ARRAY<ARRAY<ARRAY<DOUBLE>>>")).when(kind == "MultiPolygon", many)
    points = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))
    named = data.select(F.lit(level).alias("level"), own["adcode"].try_cast("bigint").alias("place_id"), own["name"].alias("name"), own["parent"]["adcode"].try_cast("bigint").alias("parent_id"), points.alias("rings"))
    return named.where("rings IS NOT NULL")
