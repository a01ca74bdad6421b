"""Regions from GeoJSON feature collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RING = "array<array<array<double>>>"
_SCHEMA = "type string, features array<struct<geometry:struct<type:string,coordinates:string>>>"


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """``region, polygon, ring, point, x, y``: every point of every polygon of the collection; ring 0 is the outer one, the
    others are holes."""
    features = spark.read.schema(_SCHEMA).option("multiLine", True).json(path).select(F.posexplode("features").alias("region", "f"))
    geometry = features.select("region", "f.geometry.type", "f.geometry.coordinates")
    one = geometry.filter("type = 'Polygon'").select("region", F.lit(0).alias("polygon"), F.from_json("coordinates", _RING).alias("rings"))
    many = geometry.filter("type = 'MultiPolygon'").select("region", F.posexplode(F.from_json("coordinates", f"array<{_RING}>")).alias("polygon", "rings"))
    rings = one.unionByName(many).select("region", "polygon", F.posexplode("rings").alias("ring", "points"))
    points = rings.select("region", "polygon", "ring", F.posexplode("points").alias("point", "xy"))
    return points.select("region", "polygon", "ring", "point", F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"))


def polygons(points: DataFrame, most_points: int = 10_000) -> list[list[list[tuple[float, float]]]]:
    """The polygons as lists of rings, for the pixel expression: a handful of points. More of them are an error; the scan-line
    join of ``operators.regions`` takes any number."""
    rows = points.orderBy("region", "polygon", "ring", "point").limit(most_points + 1).collect()
    if len(rows) > most_points:
        raise ValueError(f"over {most_points} points: join by scan lines instead")
    out: dict[tuple[int, int], dict[int, list[tuple[float, float]]]] = {}
    for r in rows:
        out.setdefault((r["region"], r["polygon"]), {}).setdefault(r["ring"], []).append((r["x"], r["y"]))
    return [[p[:-1] if len(p) > 1 and p[0] == p[-1] else p for p in rings.values()] for rings in out.values()]


def bounds(points: DataFrame) -> DataFrame:
    return points.agg(F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"))
