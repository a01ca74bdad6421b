"""Map projections there and back, and the scan-line join against ray casting."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeloom.functions import projections
from cubeloom.operators import regions


@pytest.mark.parametrize(("p", "most"), [(projections.EqualAreaCylindrical(30.0), 180.0), (projections.EqualAreaCylindrical(0.0), 180.0), (projections.Mollweide(), 180.0), (projections.TransverseMercator.zone(32), 3.0), (projections.TransverseMercator.zone(1, south=True), 3.0)])
def test_there_and_back(spark, p, most):
    rng = np.random.default_rng(1)
    middle = getattr(p, "meridian", 0.0)
    rows = [(float(middle + rng.uniform(-most, most)), float(rng.uniform(-89.9, 89.9))) for _ in range(300)] + [(middle + s * most, lat) for s in (-1, 0, 1) for lat in (-89.99, 0.0, 45.0, 89.99)]
    df = spark.createDataFrame(rows, "lon double, lat double")
    x, y = p.forward(F.col("lon"), F.col("lat"))
    out = df.select("lon", "lat", x.alias("x"), y.alias("y"))
    back = p.inverse(F.col("x"), F.col("y"))
    for r in out.select("lon", "lat", back[0].alias("a"), back[1].alias("b")).collect():
        assert abs(r["lon"] - r["a"]) < 1e-7 / math.cos(math.radians(r["lat"])) and abs(r["lat"] - r["b"]) < 1e-9 / max(0.01, math.cos(math.radians(r["lat"])))


def test_known_places(spark):
    """Published values: the corner of the 36 km grid on the cylinder true at 30 degrees, the oval's outline, the zone's origin and
    the length of a meridian's quarter."""
    one = spark.createDataFrame([(180.0, 90.0, 0.0)], "e double, n double, o double")
    cylinder, oval, zone = projections.EqualAreaCylindrical(30.0), projections.Mollweide(), projections.TransverseMercator(0.0, 1.0, 0.0)
    (x, y), (u, _), (_, top), (_, quarter) = cylinder.forward(F.col("e"), F.lit(85.04456640)), oval.forward(F.col("e"), F.col("o")), oval.forward(F.col("o"), F.col("n")), zone.forward(F.col("o"), F.lit(89.9999999))
    r = one.select(x.alias("x"), y.alias("y"), u.alias("u"), top.alias("top"), quarter.alias("quarter")).first()
    assert (r["x"], r["y"]) == pytest.approx((17367530.445, 7314540.831), abs=0.02)
    assert (r["u"], r["top"]) == pytest.approx((2 * math.sqrt(2) * 6371007.181, math.sqrt(2) * 6371007.181), abs=1.0)
    assert r["quarter"] == pytest.approx(10001965.7293, abs=0.05)
    out = oval.inverse(F.lit(1.8e7), F.lit(8.0e6))
    assert one.select(out[0], out[1]).first()[:] == (None, None)


def inside(rings, x, y):
    """Even-odd ray casting with numpy."""
    n = np.zeros(x.shape, int)
    for ring in rings:
        a, b = np.array(ring), np.roll(np.array(ring), -1, axis=0)
        for (x1, y1), (x2, y2) in zip(a, b, strict=True):
            if y1 != y2:
                n += ((y1 > y) != (y2 > y)) & (x < (y - y1) * (x2 - x1) / (y2 - y1) + x1)
    return n % 2 == 1


def test_scan_lines(spark):
    rng = np.random.default_rng(2)
    h, w = 40, 60
    grid = regions.Grid(-3.0, 7.0, 0.25, -0.3)
    y, x = (7.0 - 0.3 * (np.arange(h) + 0.5))[:, None], (-3.0 + 0.25 * (np.arange(w) + 0.5))[None, :]
    x, y = np.broadcast_arrays(x, y)
    shapes = []
    for k in range(1500):  # some reach over the grid's ends, some rings cross themselves
        middle, size = rng.uniform((-4, -6), (13, 8)), rng.uniform(0.1, 3)
        rings = [[tuple(middle + size * rng.uniform(-1, 1, 2)) for _ in range(int(rng.integers(3, 8)))] for _ in range(1 + k % 3)]
        shapes.append(rings)
    shapes.append([[(-3.0, 7.0), (12.0, 7.0), (12.0, -5.0), (-3.0, -5.0)], [(0.0, 0.1), (3.0, 0.1), (3.0, 3.1), (0.0, 3.1)]])  # the whole grid with a hole
    angle = np.linspace(0, 2 * np.pi, 100_000, endpoint=False)
    many = np.stack([4 + 5 * np.cos(angle) * (1 + 0.1 * np.sin(50 * angle)), 1 + 4 * np.sin(angle) * (1 + 0.1 * np.sin(50 * angle))], axis=1)
    shapes.append([many.tolist()])
    rows = [(k, j, i, float(px), float(py)) for k, rings in enumerate(shapes) for j, ring in enumerate(rings) for i, (px, py) in enumerate(ring)]
    points = spark.createDataFrame(rows, "region long, ring int, point int, x double, y double")
    runs = regions.spans(regions.crossings(regions.edges(points, ["region"]), ["region"], grid, F.lit(h)), ["region"], grid, w)
    pixels = spark.range(h * w).select((F.col("id") / w).cast("long").alias("r"), (F.col("id") % w).alias("c"))
    got = {(r["region"], r["r"], r["c"]) for r in regions.inside(pixels, runs, ["region"], 16).collect()}
    want = {(k, int(r), int(c)) for k in [*range(0, 1500, 10), 1500, 1501] for r, c in np.argwhere(inside(shapes[k], x, y))}
    assert {g for g in got if g[0] % 10 == 0 or g[0] >= 1500} == want and len(want) > 3000
    assert regions.inside(pixels, runs.limit(0), ["region"]).isEmpty()


def test_polygons_meet_pixels_by_bands(spark):
    """The same pairs as by scan lines, of pixels that are missing, doubled or outside the grid too."""
    rng = np.random.default_rng(5)
    h, w = 50, 40
    rings = [(k, j, i, float(x), float(y)) for k in range(60) for j in range(1 + k % 2) for i, (x, y) in enumerate(rng.uniform((-25, -18), (25, 18), 2) + rng.uniform(-15, 15, (3 + k % 5, 2)))]
    points = spark.createDataFrame(rings, "region long, ring int, point int, x double, y double")
    cells = [(i, int(r), int(c)) for i, (r, c) in enumerate(rng.integers((-2, -2), (h + 2, w + 2), (1500, 2)))]
    pixels = spark.createDataFrame(cells, "pid long, r long, c long")
    sides = regions.edges(points, ["region"])
    grid = regions.Grid(-20.0, 15.0, 1.0, -0.6)
    runs = regions.spans(regions.crossings(sides, ["region"], grid, F.lit(h)), ["region"], grid, w)
    want = sorted(tuple(x) for x in regions.inside(pixels, runs, ["region"], 16).select("pid", "region").collect())
    for block, bands, parts in ((16, 256, 4), (7, 2, 1), (64, 1, 3)):
        got = regions.within(pixels, sides, ["region"], ["pid"], grid, F.lit(h), w, block, bands, parts, 5)
        assert sorted(tuple(x) for x in got.collect()) == want and len(want) > 3000
    assert regions.within(pixels, sides.limit(0), ["region"], ["pid"], grid, F.lit(h), w).isEmpty()
    assert regions.within(pixels.limit(0), sides, ["region"], ["pid"], grid, F.lit(h), w).isEmpty()


def shuffled_rows(spark) -> int:
    """Rows written to all shuffles of this session so far."""
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_tall_grids_shuffle_no_crossings(spark, sf, tmp_path):
    """Two pixels far apart, on a grid of 50,001 rows: a polygon's rows are not shuffled."""
    from cubeloom.plans.rasters import region_scanline

    lines = spark.read.parquet(f"{sf}/lineitem.parquet").limit(1)
    lines.crossJoin(spark.createDataFrame([(0,), (4 * 64 * 50_000,)], "k long")).withColumn("l_orderkey", F.col("k")).drop("k").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.read.parquet(f"{sf}/supplier.parquet").limit(10).write.parquet(f"{tmp_path}/supplier.parquet")
    before = shuffled_rows(spark)
    assert {r["pid"] for r in region_scanline(spark, str(tmp_path)).collect()} <= {0, 64 * 50_000}
    assert shuffled_rows(spark) - before < 20_000
