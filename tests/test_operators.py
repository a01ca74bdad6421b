"""Values worked out by hand, and properties."""

from __future__ import annotations

import hashlib
import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeloom.functions import encoders
from cubeloom.functions.histogram import bin_of, midpoints, widths
from cubeloom.operators import arrays, convlstm, metrics, neighbourhood, networks, pixel, predictor, tiles
from cubeloom.plans import queries
from cubeloom.sources import catalog, layers, options, raster, regions, weights
from cubeloom.streaming import incremental


def test_pinball(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 1.0)], "p double, t double")
    row = df.agg(metrics.pinball(F.col("p"), F.col("t"), 0.5).alias("half")).first()
    assert row["half"] == pytest.approx(0.5)
    for q, error, loss in ((0.025, 1.0, 0.025), (0.025, -1.0, 0.975), (0.975, 1.0, 0.975), (0.975, -1.0, 0.025)):
        one = spark.createDataFrame([(0.0, error)], "p double, t double")
        assert one.agg(metrics.pinball(F.col("p"), F.col("t"), q).alias("v")).first()["v"] == pytest.approx(loss)
    assert df.filter("p > 9").agg(metrics.pinball(F.col("p"), F.col("t"), 0.5).alias("v")).first()["v"] == 0


def test_bins(spark):
    xs = [(-1.0, 0), (-0.005, 1), (0.0, 1), (0.6, 7), (1.0, 7), (-2.0, None), (1.01, None)]
    got = spark.createDataFrame([(x,) for x, _ in xs], "x double").select("x", bin_of(F.col("x")).alias("b")).collect()
    assert {r["x"]: r["b"] for r in got} == dict(xs)
    assert midpoints() == pytest.approx([-0.5025, 0, 0.0125, 0.06, 0.15, 0.3, 0.5, 0.8])
    assert widths() == pytest.approx([0.5025, 0.0125, 0.0475, 0.09, 0.15, 0.2, 0.3, 0.3])


def test_proportions_of_an_empty_histogram(spark):
    h = metrics.histogram(spark.createDataFrame([("a", 5.0), ("b", 0.0)], "k string, x double"), F.col("x"), ["k"])
    p = {(r["k"], r["bin"]): r["p"] for r in metrics.proportions(h, ["k"]).collect()}
    assert all(p["a", b] == 0.125 for b in range(8))
    assert p["b", 1] == 1 and sum(v for (k, _), v in p.items() if k == "b") == 1


def test_wasserstein(spark):
    hot = lambda b: spark.createDataFrame([("k", i, 1.0 if i == b else 0.0) for i in range(8)], "k string, bin int, p double")
    assert metrics.wasserstein(hot(1), hot(2), ["k"]).first()["w2"] == pytest.approx(0.0125)


def test_rarity(spark):
    h = spark.createDataFrame([("k", 0, 1), ("k", 1, 3)], "k string, bin int, n long")
    w = {r["bin"]: r["weight"] for r in metrics.rarity(h, ["k"]).collect()}
    assert w[0] == pytest.approx(1.49975012, abs=1e-8) and w[1] == pytest.approx(0.50024988, abs=1e-8)


def test_kernel():
    assert arrays.gaussian(5, 1.0) == pytest.approx([0.05448868, 0.24420134, 0.40261995, 0.24420134, 0.05448868], abs=1e-8)


def grid(spark, n, p, t, m=lambda r, c: True):
    return spark.createDataFrame([("k", r, c, float(p(r, c)), float(t(r, c)), m(r, c)) for r in range(n) for c in range(n)], "tile string, r long, c long, p double, t double, m boolean")


def test_edge_distance(spark):
    w = {(r["r"], r["c"]): r["weight"] for r in neighbourhood.edge_distance(grid(spark, 5, max, min), ["tile"], 5).collect()}
    assert all(w[r, c] == min(r, c, 4 - r, 4 - c) for r in range(5) for c in range(5))


def test_similarity_and_pyramid_of_equal_images(spark):
    img = lambda r, c: ((r * 7 + c * 3) % 11) / 11
    df = grid(spark, 16, img, img)
    assert neighbourhood.ssim(df, ["tile"], 16).first()["ssim"] == pytest.approx(1)
    assert all(r["loss"] == pytest.approx(0) for r in neighbourhood.pyramid_loss(df, ["tile"], 16).collect())


def test_mask_pool(spark):
    three = neighbourhood.mask_downsample(grid(spark, 2, max, max, lambda r, c: (r, c) != (1, 1)), ["tile"]).first()["m"]
    two = neighbourhood.mask_downsample(grid(spark, 2, max, max, lambda r, c: r == 0), ["tile"]).first()["m"]
    assert three is True and two is False


def test_blend(spark):
    df = spark.createDataFrame([(1, 0.2, 1.0), (1, 0.6, 3.0), (2, 0.5, 0.0)], "k int, v double, w double")
    got = {r["k"]: r["v"] for r in metrics.blend(df, ["k"]).collect()}
    assert got[1] == pytest.approx(0.5) and got[2] is None


def test_validity_and_clip(spark):
    df = spark.createDataFrame([(1, 0.5), (2, -1.0), (3, float("nan")), (4, float("inf")), (5, None)], "k int, v double")
    got = {r["k"]: r for r in df.select("k", pixel.valid(F.col("v")).alias("v"), pixel.finite(F.col("v")).alias("f"), pixel.clip01(F.col("v")).alias("c")).collect()}
    assert [got[k]["v"] for k in range(1, 6)] == [True, False, False, True, False]
    assert [got[k]["f"] for k in range(1, 6)] == [True, True, False, False, False]
    assert got[2]["c"] == 0 and got[5]["c"] is None


def test_encoders(spark):
    one = spark.createDataFrame([(90.0, 0.0)], "lon double, lat double")
    x = one.select(F.array(*encoders.cartesian3d(F.col("lon"), F.col("lat"))).alias("v")).first()["v"]
    assert x == pytest.approx([0, 1, 0], abs=1e-15)
    y = one.select(F.array(*encoders.harmonics(F.col("lon"), F.col("lat"), 2)).alias("v")).first()["v"]
    assert y[0] == pytest.approx(0.28209479) and len(y) == 4
    t = one.select(F.array(*encoders.theory(F.col("lon"), F.col("lat"), [1.0, 0.5, 0.25])).alias("v")).first()["v"]
    angle = -0.5 * 90 * 0.5  # the second direction at the second frequency
    # nine values a half: the first half ends with a sine, and the second starts with one
    assert len(t) == 18 and t[0] == pytest.approx(math.sin(90)) and t[1] == pytest.approx(math.cos(90))
    assert t[8] == pytest.approx(math.sin(angle)) and t[9] == pytest.approx(math.sin(angle)) and t[10] == pytest.approx(math.cos(angle))
    r = encoders.random_frequencies(5, 3.0, 1)
    assert len(set(r)) == 5 and all(0 <= f < 3 for f in r) and r == encoders.random_frequencies(5, 3.0, 1)
    with pytest.raises(ValueError):
        encoders.encoder("none")


def test_region_and_window(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    df = spark.createDataFrame([(1.0, 1.0), (5.0, 1.0), (-1.0, 2.0)], "x double, y double")
    assert [r[0] for r in df.select(pixel.in_ring(F.col("x"), F.col("y"), square)).collect()] == [True, False, False]
    b = spark.createDataFrame([(-10.0, 3.2, 1.0, 99.0)], "xmin double, xmax double, ymin double, ymax double")
    w = pixel.window_of_bounds(b, 0.0, 8.0, 1.0, -1.0, F.lit(8), 8).first()
    assert (w["r0"], w["r1"], w["c0"], w["c1"]) == (0, 7, 0, 4)


def test_tiles_cover_every_pixel_once_or_more(spark):
    df = spark.range(400).select((F.col("id") / 20).cast("long").alias("r"), (F.col("id") % 20).alias("c"))
    got = tiles.explode_tiles(df, 8, 4).collect()
    assert all(x["ti"] <= x["r"] < x["ti"] + 8 and x["tj"] <= x["c"] < x["tj"] + 8 and x["ti"] % 4 == 0 for x in got)
    want = sum(1 for r in range(20) for c in range(20) for a in range(0, r + 1, 4) if r < a + 8 for b in range(0, c + 1, 4) if c < b + 8)
    assert len(got) == want
    bounds = spark.createDataFrame([(2, 12, 3, 9)], "r0 long, r1 long, c0 long, c1 long")
    sizes = {(r["ti"], r["tj"]): (r["h"], r["w"]) for r in tiles.tile_grid(bounds, 8, 4).collect()}
    assert sizes == {(2, 3): (8, 6), (2, 7): (8, 2), (6, 3): (6, 6), (6, 7): (6, 2), (10, 3): (2, 6), (10, 7): (2, 2)}
    assert tiles.tile_grid(bounds.withColumn("r1", F.lit(2).cast("long")), 8, 4).isEmpty()


def test_splits(spark):
    chips = spark.range(37).select(F.col("id").alias("ci"))
    got = tiles.assign_splits(chips, [F.col("ci")]).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {1: 25, 2: 3, 3: 3, 4: 6}


def test_convolution_and_recurrence():
    x = np.zeros((1, 5, 5))
    x[0, 2, 2] = 1
    k = np.arange(9.0).reshape(1, 1, 3, 3)
    assert np.allclose(convlstm.conv(x, k, np.zeros(1))[0, 1:4, 1:4], k[0, 0, ::-1, ::-1])
    w = convlstm.Weights.drawn(1, 2, 3, 12)
    assert convlstm.forward(np.random.default_rng(0).normal(size=(3, 2, 8, 8)), w).shape == (12, 8, 8)


def test_catalog(spark):
    df = spark.createDataFrame([("/x/HM_1990_AA_1000.tiff",), ("hm_static_dpi_dsi_1000.tiff",), ("other.txt",)], "path string")
    got = {(r["layer"], r["year"]) for r in catalog.manifest(df).collect()}
    assert got == {("AA", 1990), ("dpi_dsi", None)}
    assert catalog.file_name("ele", None) == "hm_static_ele_1000.tiff"


def test_regions(spark, tmp_path):
    ring = [[0, 0], [2, 0], [2, 3], [0, 0]]
    collection = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring, [[1, 0.5], [1.5, 0.5], [1.5, 1], [1, 0.5]]]}}, {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}}]}
    (tmp_path / "r.geojson").write_text(json.dumps(collection))
    points = regions.read_regions(spark, str(tmp_path / "r.geojson"))
    outer = [(0.0, 0.0), (2.0, 0.0), (2.0, 3.0)]
    assert regions.polygons(points) == [[outer, [(1.0, 0.5), (1.5, 0.5), (1.5, 1.0)]], [outer], [outer]]
    with pytest.raises(ValueError):
        regions.polygons(points, 5)
    spots = spark.createDataFrame([(1.4, 0.6), (1.9, 0.1), (0.1, 2.0)], "x double, y double")
    assert [r[0] for r in spots.select(pixel.in_polygon(F.col("x"), F.col("y"), regions.polygons(points)[0])).collect()] == [False, True, False]
    assert tuple(regions.bounds(points).first()) == (0.0, 2.0, 0.0, 3.0)


def test_layers_window_and_stream(spark, tmp_path):
    df = spark.range(64).select(F.lit("AA").alias("layer"), F.lit(2000).alias("year"), (F.col("id") / 8).cast("int").alias("row"), (F.col("id") % 8).cast("int").alias("col"), F.when(F.col("id") == 9, float("nan")).otherwise(F.col("id").cast("double")).alias("value"))
    layers.write_layers(df, str(tmp_path / "cube"), 4)
    window = layers.read_window(spark, str(tmp_path / "cube"), ["AA"], [2000], (1, 3), (0, 2))
    assert sorted((r["row"], r["col"], r["value"]) for r in window.collect() if r["value"] is not None) == [(1, 0, 8.0), (2, 0, 16.0), (2, 1, 17.0)]
    assert "PushedFilters: [IsNotNull(row)" in window._jdf.queryExecution().toString()

    src, out = tmp_path / "in", str(tmp_path / "sums")
    df.drop("year").limit(32).coalesce(1).write.parquet(str(src / "a"))
    stream = lambda: spark.readStream.schema("layer string, row int, col int, value double").parquet(str(src / "*"))
    incremental.keep_layer_moments(stream(), out, str(tmp_path / "cp")).awaitTermination()
    df.drop("year").filter("row >= 4").coalesce(1).write.parquet(str(src / "b"))
    incremental.keep_layer_moments(stream(), out, str(tmp_path / "cp")).awaitTermination()
    got = incremental.finished(incremental.latest(spark, out)).first()
    values = np.array([i for i in range(64) if i != 9], float)
    assert got["mean"] == pytest.approx(values.mean()) and got["std"] == pytest.approx(values.std(), abs=1e-6)


def test_moments_of_large_values_and_blend_state(spark, tmp_path):
    big = [1e9 + x for x in (1.0, 2.0, 3.0, 4.0)]
    parts = [spark.createDataFrame([("a", v) for v in vs], "layer string, value double") for vs in (big[:1], big[1:], [])]
    moments = [incremental.layer_moments(p) for p in parts]
    one = incremental.finished(moments[0].unionByName(moments[1]).unionByName(moments[2])).first()
    assert one["std"] == pytest.approx(np.std(big), abs=1e-6)
    none = incremental.finished(incremental.layer_moments(spark.createDataFrame([("b", None)], "layer string, value double"))).first()
    assert (none["mean"], none["std"]) == (0.0, 1.0)
    src, out = tmp_path / "parts", str(tmp_path / "state")
    schema = "row int, col int, v double, w double"
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(src))
    for k, rows in enumerate(([(0, 0, 1.0, 1.0), (0, 1, 5.0, 0.0)], [(0, 0, 4.0, 2.0)], [(0, 0, 1.0, 3.0)], [(1, 1, 2.0, 1.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / str(k)))
        incremental.keep_blend_sums(stream(), out, str(tmp_path / "cp2")).awaitTermination()
    got = {(r["row"], r["col"]): r["v"] for r in incremental.blended(incremental.latest(spark, out)).collect()}
    assert got == {(0, 0): pytest.approx(12 / 6), (0, 1): None, (1, 1): 2.0}
    assert len([p for p in (tmp_path / "state").iterdir() if p.name.startswith("version=")]) == 2


def test_split_positions(spark):
    chips = spark.range(1000).withColumn("k", F.md5(F.col("id").cast("string")))
    got = {r["id"]: r["split"] for r in tiles.assign_splits(chips, [F.col("k"), F.col("id")]).collect()}
    want = sorted(range(1000), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
    assert [got[i] for i in want] == [1] * 700 + [2] * 100 + [3] * 100 + [4] * 100
    assert tiles.assign_splits(chips.filter("id < 0"), [F.col("k")]).isEmpty()


def test_sinks_and_progress(spark, tmp_path):
    pred = spark.createDataFrame([(0, 0, 0.5, 2005, "central"), (0, 8, None, 2005, "lower"), (8, 8, 0.1, 2010, "central")], "ti int, tj int, pred double, target_year int, quantile string")
    seen, progress = layers.observed(pred)
    layers.write_predictions(seen, str(tmp_path / "p"))
    assert progress.get == {"tiles": 3, "pixels": 3, "valid_pixels": 2}
    assert spark.read.parquet(str(tmp_path / "p")).filter("target_year = 2005 and quantile = 'lower'").count() == 1
    per = spark.createDataFrame([(1, 0.5, 0.2), (4, 1.5, 0.4)], "h int, mae double, mse double")
    rows = layers.full_validation_rows(per, 3, ["mae", "mse"])
    layers.write_metrics(rows, str(tmp_path / "m"))
    steps = spark.createDataFrame([(0, 8, 1.0), (0, 2, 2.0)], "epoch int, batch_size int, loss double")
    layers.write_metrics(layers.step_rows(steps, "train", ["loss"]), str(tmp_path / "m"))
    got = {(r["phase"], r["horizon"], r["metric"]): r["value"] for r in spark.read.parquet(str(tmp_path / "m")).collect()}
    assert got["val_full", 5, "mae"] == 0.5 and got["val_full", 20, "mse"] == 0.4 and got["val_full", 0, "mae_avg"] == pytest.approx(1.0)
    assert got["train", 0, "loss"] == pytest.approx(1.2)


def test_rasters(spark, tmp_path):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 250, (21, 13))
    image[3, 4] = 255
    rows = [(r, c, int(image[r, c]) if (r, c) != (3, 4) else None) for r in range(21) for c in range(13)]
    df = spark.createDataFrame(rows, "r long, c long, v int")
    raster.write(df, str(tmp_path / "a"), 21, 13, "u1", (0.5, -0.25), (-180.0, 90.0), 255, band_rows=8)
    got = {(r["r"], r["c"]): r["v"] for r in raster.read(spark, str(tmp_path / "a")).collect()}
    assert got == {(r, c): None if v is None else float(v) for r, c, v in rows}
    window = raster.read(spark, str(tmp_path / "a"), (6, 10), (2, 5), 8)
    assert {(r["r"], r["c"]): r["v"] for r in window.collect()} == {(r, c): float(image[r, c]) for r in range(6, 10) for c in range(2, 5)}
    assert "PartitionFilters: [isnotnull(band" in window._jdf.queryExecution().toString()
    m = raster.metadata(spark, str(tmp_path / "a")).first()
    assert (m["height"], m["width"], m["dtype"], m["dx"], m["dy"], m["x0"], m["y0"], m["nodata"], m["y1"]) == (21, 13, "u1", 0.5, -0.25, -180.0, 90.0, 255.0, 90 - 21 * 0.25)
    # a file of another writer: big-endian, strips of five rows
    floats, strips = image.astype(">f4"), [(s, min(21, s + 5)) for s in range(0, 21, 5)]
    body, offsets = b"", []
    for s, e in strips:
        offsets.append(8 + len(body))
        body += floats[s:e].tobytes()
    tags = [(256, 3, 1, struct.pack(">HH", 13, 0)), (257, 3, 1, struct.pack(">HH", 21, 0)), (258, 3, 1, struct.pack(">HH", 32, 0)), (273, 4, 5, struct.pack(">I", 8 + len(body))), (278, 3, 1, struct.pack(">HH", 5, 0)), (339, 3, 1, struct.pack(">HH", 3, 0))]
    at = 8 + len(body) + 20
    raw = b"MM\0*" + struct.pack(">I", at) + body + struct.pack(">5I", *offsets) + struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHI", *t[:3]) + t[3] for t in tags) + bytes(4)
    (tmp_path / "b.tif").write_bytes(raw)
    other = raster.read(spark, str(tmp_path / "b.tif"), (4, 11), (0, 2))
    assert {(r["r"], r["c"]): r["v"] for r in other.collect()} == {(r, c): float(image[r, c]) for r in range(4, 11) for c in range(2)}
    with pytest.raises(ValueError):
        raster.header(b"something else")


def test_options():
    config = {"batch_size": 4, "inference": {"region_geojson": "a.json"}}
    got = options.Options.parsed(["--region", "b.json", "--use_location_encoder", "FALSE", "--epochs", "3"], config)
    assert (got.region, got.batch_size, got.use_location_encoder, got.epochs) == ("b.json", 4, False, 3)
    assert options.Options.parsed([], config).region == "a.json"
    assert options.Options.parsed([], None) == options.Options() and options.Options.parsed([], {"inference": 3}).region is None


def test_networks_and_weights(spark, tmp_path):
    with pytest.raises(ValueError):
        networks.network("none")
    for name in ("linear", "siren", "fcnet"):
        w = networks.initial(name, 2, 6, 3, seed=1)
        x = np.random.default_rng(0).normal(size=(7, 2))
        assert networks.network(name)(x, w).shape == (7, 3)
        weights.save(spark, w, str(tmp_path / name))
        back = weights.load(spark, weights.resolved(spark, None, str(tmp_path / "none"), str(tmp_path / name)))
        assert all(np.array_equal(back[k], w[k]) for k in w)
    assert weights.resolved(spark, None, str(tmp_path / "none")) is None
    w = networks.initial("fcnet", 2, 6, 3)
    inner = np.maximum(x @ w["w_in"].T + w["b_in"], 0)
    for k in range(4):
        inner = inner + np.maximum(np.maximum(inner @ w[f"u{k}"].T + w[f"ub{k}"], 0) @ w[f"v{k}"].T + w[f"vb{k}"], 0)
    assert networks.fcnet(x, w) == pytest.approx(inner @ w["w_out"].T)


def test_predictor_layers_and_heads():
    w = predictor.drawn(1, channels=3, hidden=4, layers=2)
    x = np.random.default_rng(2).normal(size=(3, 3, 8, 8))
    out = predictor.forward(x, w)
    assert out.shape == (12, 8, 8)
    single = convlstm.Weights(w["gates0"], w["gates0_bias"], np.eye(4)[:, :, None, None] * 1.0, np.zeros(4))
    first = {k: v for k, v in w.items() if not k.startswith("gates1")}
    one = predictor.forward(x, first)
    hidden = convlstm.forward(x, single)  # the last hidden state itself
    inner = np.maximum(convlstm.conv(hidden, w["upper2_a"], w["upper2_a_bias"]), 0)
    assert one[2 * 3 + 2] == pytest.approx(convlstm.conv(inner, w["upper2_b"], w["upper2_b_bias"])[0])
    assert w["central0_a"].shape == (4, 4, 3, 3) and w["lower0_a"].shape == (2, 4, 3, 3)
    assert not np.allclose(one, out)


def test_losses_hold_all_terms(spark):
    """The registered totals against SSIM and Laplacian terms computed with numpy, on tables that have whole chips."""
    sf = "/root/testdata/sf0.01"
    x, height = queries.scored(spark, sf).toPandas(), queries.height(spark, sf).first()[0]
    x = x[x["r"] < height // 16 * 16]

    def filtered(a, size, sigma):
        g, h = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2)), size // 2
        b = np.pad(a, h)
        b = sum(w * b[i : i + len(a)] for i, w in enumerate(g / g.sum()))
        return sum(w * b[:, i : i + len(a)] for i, w in enumerate(g / g.sum()))

    def half(a, f=np.mean):
        return f(a.reshape(len(a) // 2, 2, len(a) // 2, 2), axis=(1, 3))

    def twice(a):
        at = np.clip((np.arange(2 * len(a)) + 0.5) / 2 - 0.5, 0, None)
        low = at.astype(int)
        m = np.zeros((len(at), len(a)))
        np.add.at(m, (range(len(at)), low), 1 - at + low)
        np.add.at(m, (range(len(at)), np.minimum(low + 1, len(a) - 1)), at - low)
        return m @ a @ m.T

    spatial = {}
    for h, rows in x.groupby("h"):
        scores, bands = [], ([], [], [])
        for _, chip in rows.groupby([rows["r"] // 16, rows["c"] // 16]):
            p, t, m = np.zeros((16, 16)), np.zeros((16, 16)), np.zeros((16, 16))
            for a, v in ((p, chip["pred"]), (t, chip["target"]), (m, 1)):
                a[chip["r"] % 16, chip["c"] % 16] = v
            mp, mt, pp, tt, pt = (filtered(a, 11, 1.5) for a in (p, t, p * p, t * t, p * t))
            score = (2 * mp * mt + 1e-4) * (2 * (pt - mp * mt) + 9e-4) / ((mp**2 + mt**2 + 1e-4) * (pp - mp**2 + tt - mt**2 + 9e-4))
            scores.append(score[5:-5, 5:-5].mean())
            for level in range(3):
                p2, t2 = half(filtered(p, 5, 1)), half(filtered(t, 5, 1))
                gap = p - t if level == 2 else p - twice(p2) - (t - twice(t2))
                bands[level].append(np.abs(gap)[m > 0])
                p, t, m = p2, t2, half(m, np.sum) > 2
        lap = np.mean([np.concatenate(b).mean() if len(np.concatenate(b)) else 0 for b in bands])
        spatial[h] = 2 * (1 - np.mean(scores)) + lap
    w2 = {r["h"]: r["w2"] for r in queries.wasserstein_histogram(spark, sf).collect()}
    each = {r["h"]: r for r in queries.horizon_losses(spark, sf).collect()}
    got = {r["h"]: r["total"] for r in queries.composite_loss(spark, sf).collect()}
    assert set(got) == set(spatial) and min(spatial.values()) > 1e-3
    for h in got:
        assert got[h] == pytest.approx(each[h]["mse"] + each[h]["pin_l"] + each[h]["pin_u"] + 0.67 * w2[h] + spatial[h], abs=1e-6)
    assert queries.sweep_objective(spark, sf).first()[0] == pytest.approx(np.mean([each[h]["mse"] + 0.67 * w2[h] + spatial[h] for h in got]), abs=1e-6)


def test_sweep_grid_is_one_task(spark):
    from cubeloom.plans.queries import sweep_grid

    grid = sweep_grid(spark, "/nowhere")
    assert grid.rdd.getNumPartitions() == 1 and len({tuple(r) for r in grid.collect()}) == 36


def test_channels_of_a_pixel_are_one_group(spark, sf, capsys):
    from cubeloom.operators import metrics
    from cubeloom.plans.queries import weighted_blend

    parts = spark.createDataFrame([(1, 1.0, 5.0, 0.5), (1, 3.0, None, 0.25), (2, 1.0, 2.0, 0.0), (3, None, 4.0, 2.0)], "pid long, a double, b double, w double")
    got = {r["pid"]: r for r in metrics.blend_columns(parts, ["pid"], ["a", "b"]).collect()}
    for name in "ab":
        assert {p: (r[name], r["w"]) for p, r in got.items()} == {r["pid"]: (r[name], r["w"]) for r in metrics.blend(parts, ["pid"], name).collect()}
    weighted_blend(spark, sf).explain()
    shuffles = [x for x in capsys.readouterr().out.splitlines() if "hashpartitioning(" in x]
    assert shuffles and not [x for x in shuffles if "channel#" in x]
