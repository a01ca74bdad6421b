"""Registered queries that write and read raster files, and those of projections and regions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cubeloom.functions import projections
from cubeloom.operators import pixel, regions
from cubeloom.plans.cube import WIDTH, cube, height, horizons, placed, statics, table
from cubeloom.plans.queries import DX, REGION, X0, Y0, r9, with_dy
from cubeloom.session import shared_folder
from cubeloom.sources import geotiff

col = F.col


def written(s, pixels, **options):
    """The folder of the raster files of ``file, r, c, v``, and how many rows the grid has (none without pixels)."""
    path, last = f"{shared_folder(s)}/rasters-{uuid.uuid4().hex}", pixels.agg(F.max("r")).first()[0]
    if last is None:
        return None
    geotiff.write(pixels, path, last + 1, WIDTH, **options)
    return geotiff.read(s, path)


def validity_raster(s, d):
    """The validity mask as a raster of LZW tiles, read back."""
    x = placed(statics(s, d)).select(F.lit("hm_static_mask_1000.tiff").alias("file"), "r", "c", pixel.valid(col("tas")).cast("double").alias("v"))
    got = written(s, x, dtype="u1", compression="lzw", predictor=2, block=16, nodata=255)
    if got is None:
        return x.select(col("r").alias("pid"), (col("v") == 1).alias("valid"))
    return got.filter(col("v").isNotNull()).select((col("r") * WIDTH + col("c")).alias("pid"), (col("v") == 1).alias("valid"))


def prediction_raster_window(s, d):
    """Predictions as float rasters, one a year, and a window of one year read back: its blocks alone."""
    x = horizons(s, d).filter(col("pred").isNotNull()).select(F.format_string("prediction_%d_central_blended.tif", 2000 + 5 * col("h")).alias("file"), "r", "c", col("pred").cast("double").alias("v"))
    got = written(s, x, block=32, nodata=-9999)
    if got is None:
        return x.select("file", "r", "c", "v")
    window = got.filter((col("yr") == 2010) & (col("r") >= 1) & (col("r") < 20) & (col("c") > 7) & (col("c") <= 40))
    return window.filter(col("v").isNotNull()).select("file", "r", "c", r9("v").alias("v"))


#: Polygons around a supplier's place, by its key: an outer ring and a hole, as multiples of the polygon's size.
OUTER = [(1.0, 0.1), (0.5, 0.9), (-0.4, 1.0), (-1.0, 0.2), (-0.6, -0.8), (0.7, -0.9)]
HOLE = [(0.4, 0.05), (0.0, 0.45), (-0.4, 0.0), (0.05, -0.4)]
#: A hole of the first region.
REGION_HOLE = [(-60.0, 40.0), (30.0, 45.0), (20.0, -10.0)]
CYLINDER, OVAL, ZONE = projections.EqualAreaCylindrical(30.0), projections.Mollweide(), projections.TransverseMercator.zone(32)


def supplier_points(s, d):
    """``region, ring, point, x, y``: a polygon with a hole around every supplier."""
    rings = F.array(*[F.struct(F.lit(k).alias("ring"), F.lit(i).alias("point"), F.lit(x).alias("ux"), F.lit(y).alias("uy")) for k, ring in enumerate((OUTER, HOLE)) for i, (x, y) in enumerate(ring)])
    x = table(s, d, "supplier").select(col("s_suppkey").cast("long").alias("region"), F.explode(rings).alias("p"))
    size, key = 5.0 + col("region") % 20, col("region")
    return x.select("region", "p.ring", "p.point", ((key * 37) % 300 - 150.0 + col("p.ux") * size).alias("x"), ((key * 53) % 130 - 65.0 + col("p.uy") * size).alias("y"))


def region_scanline(s, d):
    """The pixels inside every supplier's polygon and outside its hole."""
    h = F.broadcast(height(s, d).withColumn("dy", -180.0 / col("height")))
    # a supplier's edges are made and dealt to bands of rows where its points are
    sides = regions.edges(supplier_points(s, d).repartition(64, "region"), ["region"]).crossJoin(h)
    pixels = placed(cube(s, d).select("pid").distinct()).crossJoin(h)
    return regions.within(pixels, sides, ["region"], ["pid"], regions.Grid(X0, Y0, DX, "dy"), col("height"), WIDTH)


def region_holes(s, d):
    """The pixels of the first region without its hole."""
    p = with_dy(s, d, placed(cube(s, d).select("pid").distinct()))
    lon, lat = pixel.lonlat(col("r"), col("c"), X0, Y0, DX, col("dy"))
    return p.filter(pixel.in_polygon(lon, lat, [REGION[0], REGION_HOLE])).select("pid")


def pixel_lonlat_projected(s, d):
    """Longitude and latitude of the pixels of a grid in each of two projections; null outside the outline."""
    p = placed(cube(s, d).select("pid").distinct()).crossJoin(F.broadcast(height(s, d)))
    u, v = (col("c") + 0.5) / WIDTH * 2 - 1, 1 - (col("r") + 0.5) / col("height") * 2
    places = {"cylindrical": CYLINDER.inverse(u * 17_300_000.0, v * 7_300_000.0), "oval": OVAL.inverse(u * 18_000_000.0, v * 9_000_000.0)}
    return p.select("pid", *[F.round(c, 6).alias(f"{name}_{axis}") for name, pair in places.items() for axis, c in zip(("lon", "lat"), pair, strict=True)])


def pixel_zone_metres(s, d):
    """Metres of the pixels within 30 degrees of a zone's meridian, and back to degrees."""
    p = with_dy(s, d, placed(cube(s, d).select("pid").distinct()))
    lon, lat = pixel.lonlat(col("r"), col("c"), X0, Y0, DX, col("dy"))
    p = p.select("pid", lon.alias("lon"), lat.alias("lat")).filter(F.abs(col("lon") - ZONE.meridian) < 30)
    x, y = ZONE.forward(col("lon"), col("lat"))
    p = p.select("pid", "lon", "lat", x.alias("x"), y.alias("y"))
    back = ZONE.inverse(col("x"), col("y"))
    near = F.greatest(F.abs(back[0] - col("lon")), F.abs(back[1] - col("lat")))
    return p.select("pid", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), (near < 1e-6).alias("back"))


def bbox_projected(s, d):
    """Each supplier's polygon in metres: the window of the projected grid that covers it."""
    x, y = CYLINDER.forward(col("x"), col("y"))
    b = supplier_points(s, d).select("region", x.alias("x"), y.alias("y")).groupBy("region").agg(F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"))
    b = b.crossJoin(F.broadcast(height(s, d)))
    at = lambda c, x0, step, top: F.greatest(F.lit(0), F.least(c((col(x0[0]) - x0[1]) / step), top)).cast("long")
    dx, dy = 34_600_000.0 / WIDTH, -14_600_000.0 / col("height")
    left, top = -17_300_000.0, 7_300_000.0
    return b.select("region", at(F.floor, ("ymax", top), dy, col("height")).alias("r0"), at(F.ceil, ("ymin", top), dy, col("height")).alias("r1"), at(F.floor, ("xmin", left), dx, F.lit(WIDTH)).alias("c0"), at(F.ceil, ("xmax", left), dx, F.lit(WIDTH)).alias("c1"))


PLAIN = [validity_raster, prediction_raster_window, region_scanline, region_holes, pixel_lonlat_projected, pixel_zone_metres, bbox_projected]
QUERIES = {f.__name__: f for f in PLAIN}
