"""Registered queries of the raster operators."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cubeloom.functions import encoders
from cubeloom.functions.histogram import REPORT_EDGES
from cubeloom.operators import arrays, convlstm, metrics, neighbourhood, pixel, tiles
from cubeloom.plans.cube import CHIP, WIDTH, YEARS, cube, height, horizons, images, long_layers, placed, scored, statics, table, tensor, wide
from cubeloom.session import stored

col = F.col
X0, Y0, DX = -180.0, 90.0, 360.0 / WIDTH
#: Two overlapping regions in degrees (closed rings).
REGION = [[(-120.0, 60.0), (40.0, 75.0), (100.0, -20.0), (-30.0, -70.0)], [(50.0, 10.0), (150.0, 10.0), (150.0, 80.0), (50.0, 80.0)]]
FREQS = encoders.frequencies(4, 1.0, 360.0)
TILE, STRIDE = 8, 4


def r9(c):
    return F.round(c, 9)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r9(col(n)) for n in names})


def with_dy(s, d, df):
    """Row height in degrees, from the one-row height of the grid."""
    return df.crossJoin(F.broadcast(height(s, d))).withColumn("dy", -180.0 / col("height"))


def stats(s, d) -> DataFrame:
    """Mean and deviation of each layer over all its years: a handful of rows."""
    return long_layers(s, d).groupBy("layer").agg(F.avg("v").alias("mean"), (F.stddev_pop("v") + 1e-8).alias("std"))


# pixels

def validity_mask(s, d):
    return statics(s, d).select("pid", pixel.valid(col("tas")).alias("valid"))


def validity_summary(s, d):
    v = pixel.valid(col("tas")).cast("long")
    return statics(s, d).agg(F.count("*").alias("total"), F.sum(v).alias("n_valid"), r9(100.0 * F.sum(v) / F.count("*")).alias("percent"))


def zscore_normalize(s, d):
    z = long_layers(s, d).join(F.broadcast(stats(s, d)), "layer")
    return z.select("layer", "yr", "pid", F.round(pixel.zscore(col("v"), col("mean"), col("std")), 6).alias("z"))


def denormalize_clip(s, d):
    h = scored(s, d).crossJoin(F.broadcast(stats(s, d).filter("layer = 'hm'")))
    z = pixel.zscore(col("pred"), col("mean"), col("std"))
    return h.select("pid", "h", r9(pixel.clip01(pixel.denormalize(z, col("mean"), col("std")))).alias("v"))


def grid_values(s, d):
    """Every pixel in every year, missing values included."""
    c = cube(s, d)
    years = F.explode(F.array(*[F.lit(y) for y in YEARS])).alias("yr")
    return c.select("pid").distinct().select("pid", years).join(c, ["pid", "yr"], "left")


def impute_zero_components(s, d):
    return grid_values(s, d).groupBy("yr").agg(*[r9(F.avg(F.coalesce(col(x), F.lit(0.0)))).alias(x) for x in ("ag", "ti", "gdp")])


def impute_zero_static(s, d):
    pix = cube(s, d).select("pid").distinct()
    x = pix.join(statics(s, d).withColumn("ele", F.when(col("ele") > 100000, col("ele"))).withColumn("tas", F.when(col("tas") > 0, col("tas"))), "pid", "left").unpivot("pid", ["ele", "tas"], "layer", "v")
    return x.select("pid", "layer", r9(pixel.impute_before(col("layer"), col("v"), ["ele"])).alias("v"))


def mean_impute(s, d):
    g = grid_values(s, d).select("pid", "yr", "hm").crossJoin(F.broadcast(stats(s, d).filter("layer = 'hm'")))
    return g.select("pid", "yr", F.round(F.coalesce(pixel.zscore(col("hm"), col("mean"), col("std")), F.lit(0.0)), 6).alias("z"))


def pixel_validity(s, d):
    inputs = [col("y1990"), col("y1995"), col("y2000")]
    w = wide(s, d).join(statics(s, d), "pid", "left")
    return w.select("pid", pixel.all_finite(inputs).alias("dynamic_valid"), pixel.all_finite([col("ele"), col("tas")]).alias("static_valid"))


def validation_mask(s, d):
    w = wide(s, d).join(statics(s, d), "pid", "left")
    base = pixel.all_finite([col(c) for c in ("y2020", "y1990", "y1995", "y2000", "ele", "tas")])
    return w.select("pid", *[(base & pixel.finite(col(f"y{y}"))).alias(f"mask_{y}") for y in (2005, 2010, 2015, 2020)])


def prediction_mask(s, d):
    w = with_dy(s, d, wide(s, d).join(statics(s, d), "pid", "left"))
    lon, lat = pixel.lonlat(col("r"), col("c"), X0, Y0, DX, col("dy"))
    ok = pixel.in_region(lon, lat, REGION) & pixel.all_finite([col(c) for c in ("y2010", "y2015", "y2020", "ele")])
    return w.select("pid", ok.alias("mask"))


def masked_prediction(s, d):
    mask = pixel.all_finite([col(c) for c in ("first", "prev", "last", "target")])
    return horizons(s, d).select("pid", "h", r9(pixel.masked(mask, col("pred"))).alias("masked"), r9(pixel.masked_zero(mask, col("pred"))).alias("zeroed"))


def change_delta(s, d):
    return scored(s, d).select("pid", "h", r9(col("pred") - col("last")).alias("pred_delta"), r9(col("target") - col("last")).alias("target_delta"))


def delta_range_filter(s, d):
    x = scored(s, d).select("pid", "h", F.round(col("pred") - col("last"), 6).alias("pred_delta"), F.round(col("target") - col("last"), 6).alias("target_delta"))
    return x.filter(col("pred_delta").between(-0.01, 0.2) & col("target_delta").between(-0.01, 0.2))


def abs_error(s, d):
    return scored(s, d).select("pid", "h", r9(F.abs(col("pred") - col("target"))).alias("error"))


def interval_width(s, d):
    return scored(s, d).select("pid", "h", r9(col("upper") - col("lower")).alias("width"))


def pixel_lonlat(s, d):
    p = with_dy(s, d, placed(cube(s, d).select("pid").distinct()))
    lon, lat = pixel.lonlat(col("r"), col("c"), X0, Y0, DX, col("dy"))
    return p.select("pid", r9(lon).alias("lon"), r9(lat).alias("lat"))


def bounds(s, d):
    xs, ys = [x for ring in REGION for x, _ in ring], [y for ring in REGION for _, y in ring]
    one = height(s, d).select("height", F.lit(min(xs)).alias("xmin"), F.lit(max(xs)).alias("xmax"), F.lit(min(ys)).alias("ymin"), F.lit(max(ys)).alias("ymax"))
    return pixel.window_of_bounds(one, X0, Y0, DX, -180.0 / col("height"), col("height"), WIDTH)


def nonempty_chips(s, d):
    chips = tiles.with_chip(placed(cube(s, d)).crossJoin(F.broadcast(height(s, d))), CHIP, col("height"), WIDTH)
    return chips.filter("yr = 2020").groupBy("ci", "cj").agg(F.count("hm").alias("n")).filter("n > 0")


def channel_unpivot(s, d):
    x = scored(s, d).select("pid", "h", F.explode(F.array(*[F.struct((3 * (col("h") - 1) + q).cast("int").alias("ch"), col(n).alias("v")) for q, n in enumerate(("lower", "pred", "upper"))])).alias("x"))
    return x.select("pid", F.expr("cast(x.ch div 3 as int)").alias("horizon"), (col("x.ch") % 3).alias("quantile"), r9(col("x.v")).alias("v"))


def layer_name_parse(s, d):
    names = table(s, d, "part").select("p_partkey", F.format_string("hm_static_%s_1000.tiff", F.lower(F.regexp_replace("p_type", " ", "-"))).alias("file"))
    return names.select("p_partkey", F.regexp_extract("file", "^hm_static_(.+)_1000\\.tiff$", 1).alias("layer"))


# joins and alignment

def stack_layers(s, d):
    aggs = [F.max(F.when(col("yr") == y, col(x))).alias(f"{x}_{y}") for y in (1990, 1995, 2000) for x in ("hm", "ag", "ti", "gdp")]
    return rounded(cube(s, d).groupBy("pid").agg(*aggs), *[f"{x}_{y}" for y in (1990, 1995, 2000) for x in ("hm", "ag", "ti", "gdp")])


def temporal_offset_join(s, d):
    """Every possible end year with its three inputs and the targets there are: one pass over a pixel's years."""
    c = cube(s, d).groupBy("pid").agg(F.map_from_entries(F.collect_list(F.struct("yr", "hm"))).alias("m"))
    e = c.select("pid", "m", F.explode(F.array(*[F.lit(y) for y in (2000, 2005, 2010, 2015)])).alias("end_year"))
    at = lambda k: F.try_element_at("m", col("end_year") + k)
    x = e.select("pid", "end_year", *[r9(at(k)).alias(f"in{i}") for i, k in enumerate((-10, -5, 0))], *[r9(at(k)).alias(f"t{k}") for k in (5, 10, 15, 20)])
    return x.dropna(subset=["in0", "in1", "in2"])


def temporal_sampling_targets(s, d):
    x = temporal_offset_join(s, d)
    return x.groupBy("end_year").agg(F.count("*").alias("n"), *[F.count(f"t{k}").alias(f"n{k}") for k in (5, 10, 15, 20)])


def static_repeat(s, d):
    years = F.explode(F.array(*[F.lit(y) for y in (1990, 1995, 2000)])).alias("yr")
    return rounded(statics(s, d).select("pid", years, "ele", "tas"), "ele", "tas")


def region_pixels(s, d, rings):
    p = with_dy(s, d, placed(cube(s, d).select("pid").distinct()))
    lon, lat = pixel.lonlat(col("r"), col("c"), X0, Y0, DX, col("dy"))
    return p.filter(pixel.in_region(lon, lat, rings))


def pixel_in_polygon(s, d):
    return region_pixels(s, d, REGION[:1]).select("pid")


def region_union(s, d):
    return region_pixels(s, d, REGION).select("pid")


def region_tiles(s, d):
    return tiles.explode_tiles(region_pixels(s, d, REGION), TILE, TILE).select("ti", "tj").distinct()


def all_tiles(s, d):
    return tiles.explode_tiles(placed(cube(s, d).select("pid").distinct()), TILE, TILE).select("ti", "tj").distinct()


def tile_semi_join(s, d):
    return all_tiles(s, d).join(region_tiles(s, d), ["ti", "tj"], "left_semi")


def tile_anti_join(s, d):
    return all_tiles(s, d).join(region_tiles(s, d), ["ti", "tj"], "left_anti")


def pixel_tile_explode(s, d):
    return tiles.explode_tiles(placed(cube(s, d).select("pid").distinct()), TILE, STRIDE).groupBy("ti", "tj").agg(F.count("*").alias("n"), F.sum("pid").alias("pids"))


def tile_grid(s, d):
    return tiles.tile_grid(bounds(s, d), TILE, STRIDE)


def tile_pad(s, d):
    p = tiles.explode_tiles(placed(cube(s, d).filter("yr = 2020").select("pid", "hm")), TILE, TILE)
    vals = p.select("ti", "tj", (col("r") - col("ti")).cast("int").alias("i"), (col("c") - col("tj")).cast("int").alias("j"), col("hm").alias("v"))
    return rounded(tiles.pad(vals.select("ti", "tj").distinct(), vals, TILE), "v")


def sweep_grid(s, d):
    # axes of literals, exploded in one task: a product of frames has the product of their partitions
    grid = s.range(0, 1, 1, 1)
    for name, values in (("hidden", [16, 32, 64]), ("layers", [1, 2]), ("lr", [0.0001, 0.001]), ("w_ssim", [0.5, 1.0, 2.0])):
        grid = grid.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return grid.drop("id")


def logit_fusion(s, d):
    e = table(s, d, "embeddings")
    a = e.select("vec_id", F.slice("embedding", 1, 10).alias("a"))
    b = e.select("vec_id", F.slice("embedding", 11, 10).alias("b"))
    z = a.join(b, "vec_id").select("vec_id", F.posexplode(F.zip_with("a", "b", lambda x, y: x.cast("double") + y.cast("double"))).alias("k", "v"))
    return rounded(z, "v")


# splits and sampling

def chips(s, d):
    h = F.broadcast(height(s, d))
    p = placed(cube(s, d).select("pid").distinct()).join(statics(s, d), "pid", "left").crossJoin(h)
    c = tiles.with_chip(p, CHIP, col("height"), WIDTH)
    return c.groupBy("ci", "cj").agg(r9(F.sum(pixel.valid(col("tas")).cast("int")) / float(CHIP * CHIP)).alias("ratio"))


def chip_valid_ratio(s, d):
    return chips(s, d).filter(col("ratio") >= 0.2)


def chip_grid(s, d):
    g = height(s, d).select(F.explode(F.sequence(F.lit(0).cast("long"), F.floor(col("height") / CHIP) - 1)).alias("ci"), "height").filter(col("height") >= CHIP)
    return g.select("ci", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(WIDTH // CHIP - 1).cast("long"))).alias("cj")).select("ci", "cj", (col("ci") * CHIP).alias("r0"), (col("cj") * CHIP).alias("c0"))


def sliding_chips(s, d):
    step = F.lit(4).cast("long")
    g = height(s, d).filter(col("height") >= CHIP).select(F.explode(F.sequence(F.lit(0).cast("long"), col("height") - CHIP, step)).alias("r0"))
    return g.select("r0", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(WIDTH - CHIP).cast("long"), step)).alias("c0"), F.lit(2020).alias("yr"))


def split_chips(s, d):
    key = F.md5(F.concat_ws("_", col("ci").cast("string"), col("cj").cast("string")))
    return tiles.assign_splits(chip_valid_ratio(s, d), [key, col("ci"), col("cj")])


def spatial_split_assign(s, d):
    return split_chips(s, d).select("ci", "cj", "split")


def split_pixel_counts(s, d):
    n = split_chips(s, d).groupBy("split").agg((F.count("*") * CHIP * CHIP).cast("long").alias("pixels"))
    return n.withColumn("percent", r9(100.0 * col("pixels") / F.sum("pixels").over(Window.partitionBy(F.lit(1)))))


def split_semi_join(s, d):
    """Sliding chips that hold a pixel of the training split."""
    cell = F.explode(F.sequence(F.floor(col("r0") / CHIP), F.floor((col("r0") + CHIP - 1) / CHIP))).alias("ci")
    x = sliding_chips(s, d).select("r0", "c0", cell)
    x = x.withColumn("cj", F.explode(F.sequence(F.floor(col("c0") / CHIP), F.floor((col("c0") + CHIP - 1) / CHIP))))
    return x.join(split_chips(s, d).filter("split = 1").select("ci", "cj"), ["ci", "cj"], "left_semi").select("r0", "c0").distinct()


def split_chip_jitter(s, d):
    c = split_chips(s, d).crossJoin(F.broadcast(height(s, d)))
    jitter = lambda salt: F.conv(F.substring(F.md5(F.concat_ws("_", F.lit(salt), col("ci").cast("string"), col("cj").cast("string"))), 1, 6), 16, 10).cast("long") % 8 - 4
    clamp = lambda v, top: F.greatest(F.lit(0), F.least(v, top)).cast("long")
    return c.select("ci", "cj", "split", clamp(col("ci") * CHIP + jitter("r"), col("height") - CHIP).alias("r0"), clamp(col("cj") * CHIP + jitter("c"), F.lit(WIDTH - CHIP)).alias("c0"))


def latitude_band_counts(s, d):
    h = F.broadcast(height(s, d))
    p = placed(cube(s, d).select("pid").distinct()).crossJoin(h).withColumns({"ci": F.floor(col("r") / CHIP), "cj": F.floor(col("c") / CHIP), "band": F.floor(col("r") / F.floor(col("height") / 20)).cast("int")})
    return p.filter("band < 20").join(split_chips(s, d).select("ci", "cj", "split"), ["ci", "cj"]).groupBy("band", "split").agg(F.count("*").alias("n"))


# statistics and metrics

def hm_stats(s, d):
    return cube(s, d).agg(r9(F.avg("hm")).alias("mean"), r9(F.stddev_pop("hm") + 1e-8).alias("std"))


def layer_stats(s, d):
    return stats(s, d).select("layer", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def fallback_stats(s, d):
    e = cube(s, d).filter("yr > 2020").agg(F.avg("hm").alias("m"), F.stddev_pop("hm").alias("x"))
    return e.select(F.coalesce("m", F.lit(0.0)).alias("mean"), F.coalesce("x", F.lit(1.0)).alias("std"))


def changes(s, d, every=None):
    """The changes in whole chips, of ``every`` change if they are at hand."""
    x = all_changes(s, d) if every is None else every
    return tiles.with_chip(x.crossJoin(F.broadcast(height(s, d))), CHIP, col("height"), WIDTH)


def change_histogram(s, d):
    return metrics.histogram(changes(s, d), col("dt"), ["ci", "cj", "h"])


def histogram_proportions(s, d):
    return rounded(metrics.proportions(change_histogram(s, d), ["ci", "cj", "h"]).drop("n"), "p")


def histogram_cdf(s, d):
    w = Window.partitionBy("ci", "cj", "h").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    p = metrics.proportions(change_histogram(s, d), ["ci", "cj", "h"])
    return p.select("ci", "cj", "h", "bin", r9(F.sum("p").over(w)).alias("cdf"))


def all_changes(s, d):
    return scored(s, d).withColumns({"dp": F.round(col("pred") - col("last"), 6), "dt": F.round(col("target") - col("last"), 6)})


def change_histogram_report(s, d):
    return metrics.histogram(all_changes(s, d), col("dt"), ["h"], REPORT_EDGES)


def rarity_weights(s, d):
    return rounded(metrics.rarity(metrics.histogram(all_changes(s, d), col("dt"), ["h"]), ["h"]).drop("n"), "weight")


def chip_wasserstein(s, d, every=None):
    """``ci, cj, h, w2``: the distance of each chip's two histograms of changes."""
    keys = ["ci", "cj", "h"]
    both = metrics.paired_proportions(changes(s, d, every), col("dt"), col("dp"), keys)
    weights = F.broadcast(metrics.rarity(metrics.histogram(all_changes(s, d) if every is None else every, col("dt"), ["h"]), ["h"]).select("h", "bin", "weight"))
    return metrics.wasserstein_of(both, keys, weights, ["h"])


def wasserstein_histogram(s, d):
    return chip_wasserstein(s, d).groupBy("h").agg(F.round(F.avg("w2"), 8).alias("w2"))


def masked_mse(s, d):
    return scored(s, d).groupBy("h").agg(r9(metrics.mse(col("pred") - col("last"), col("target") - col("last"))).alias("mse"))


def masked_mae(s, d):
    return scored(s, d).groupBy("h").agg(r9(metrics.mae(col("pred"), col("target"))).alias("mae"))


def pinball_loss(s, d):
    return scored(s, d).groupBy("h").agg(r9(metrics.pinball(col("lower"), col("target"), 0.025)).alias("lower"), r9(metrics.pinball(col("upper"), col("target"), 0.975)).alias("upper"))


def interval_coverage(s, d):
    x = scored(s, d).withColumns({c: F.round(c, 6) for c in ("lower", "target", "upper")})
    return x.groupBy("h").agg(r9(metrics.coverage(col("lower"), col("target"), col("upper"))).alias("coverage"), F.count("*").alias("n"))


def losses_of(x):
    return x.groupBy("h").agg(metrics.mse(col("pred"), col("target")).alias("mse"), metrics.mae(col("pred"), col("target")).alias("mae"), metrics.pinball(col("lower"), col("target"), 0.025).alias("pin_l"), metrics.pinball(col("upper"), col("target"), 0.975).alias("pin_u"))


def horizon_losses(s, d):
    return losses_of(scored(s, d))


def macro_average_losses(s, d):
    return rounded(metrics.macro(horizon_losses(s, d), 4, ["mse", "mae", "pin_l", "pin_u"]), "mse", "mae", "pin_l", "pin_u")


def spatial_losses(s, d, every=None):
    """``h, ssim, lap``: losses of the whole chips that have a scored cell, with 0 where a horizon has none. A chip is built
    once, and both losses come from its row."""
    x = changes(s, d, every).select("h", "ci", "cj", (col("r") % CHIP).alias("r"), (col("c") % CHIP).alias("c"), col("pred").alias("p"), col("target").alias("t"), F.lit(True).alias("m"))
    chips = neighbourhood.images(x, ["h", "ci", "cj"], CHIP)
    each = arrays.with_pyramid(arrays.with_similarity(chips, CHIP), CHIP)
    both = each.groupBy("h").agg((1 - F.avg("ssim")).alias("ssim"), *arrays.pyramid_levels())
    return both.select("h", "ssim", ((col("level0") + col("level1") + col("level2")) / 3).alias("lap"))


def weighted_losses(s, d):
    """The losses of each horizon, and ``spatial``: SSIM, Laplacian and histogram losses by the reference's weights. All of
    them read the changes, which are stored once."""
    every = stored(all_changes(s, d))
    spatial = 2.0 * col("ssim") + 1.0 * col("lap") + 0.67 * col("w2")
    wasserstein = chip_wasserstein(s, d, every).groupBy("h").agg(F.round(F.avg("w2"), 8).alias("w2"))
    return losses_of(every).join(wasserstein, "h").join(spatial_losses(s, d, every), "h").withColumn("spatial", spatial)


def composite_loss(s, d):
    return weighted_losses(s, d).select("h", F.round(col("mse") + col("pin_l") + col("pin_u") + col("spatial"), 7).alias("total"))


def full_val_metrics(s, d):
    p, t, l, v, h = (col(c) for c in ("pred", "target", "last", "prev", "h"))
    return rounded(scored(s, d).groupBy("h").agg(
        F.count("*").alias("n"), metrics.mse(p - l, t - l).alias("mse"), metrics.mae(p, t).alias("mae"),
        metrics.mae(l, t).alias("mae_no_change"), metrics.mse(l, t).alias("mse_no_change"), metrics.mae(l + (l - v) * h, t).alias("mae_linear"),
    ), "mse", "mae", "mae_no_change", "mse_no_change", "mae_linear")


def baseline_no_change(s, d):
    return rounded(scored(s, d).groupBy((2000 + 5 * col("h")).alias("target_year")).agg(F.count("*").alias("n"), metrics.mae(col("last"), col("target")).alias("mae_no_change")), "mae_no_change")


def baseline_linear(s, d):
    """The flagship: both naive baselines against each horizon's target."""
    l, v, t, h = (col(c) for c in ("last", "prev", "target", "h"))
    x = scored(s, d).groupBy((2000 + 5 * h).alias("target_year")).agg(F.count("*").alias("n"), metrics.mae(l, t).alias("mae_no_change"), metrics.mae(l + (l - v) * h, t).alias("mae_linear"))
    return rounded(x, "mae_no_change", "mae_linear")


def pixel_weighted_metric(s, d):
    """The histogram distance of batches (here: chips), each counted by its pixels."""
    n = changes(s, d).groupBy("ci", "cj", "h").agg(F.count("*").alias("n"))
    return chip_wasserstein(s, d).join(n, ["ci", "cj", "h"]).groupBy("h").agg(F.round(F.sum(col("w2") * col("n")) / F.sum("n"), 8).alias("w2"))


def sweep_objective(s, d):
    return weighted_losses(s, d).agg(F.round(F.avg(col("mse") + col("spatial")), 7).alias("objective"))


def hexbin_density(s, d):
    x = delta_range_filter(s, d)
    q, r = neighbourhood.hexagon(col("target_delta"), col("pred_delta"), 0.21 / 80)
    return x.groupBy(q.alias("q"), r.alias("hr")).agg(F.count("*").alias("n"))


def best_checkpoint(s, d):
    runs = table(s, d, "orders").groupBy("o_custkey").agg(F.min("o_totalprice").alias("loss"))
    return runs.agg(F.min_by("o_custkey", F.struct("loss", "o_custkey")).alias("best"), F.round(F.min("loss"), 6).alias("loss"))


def logits(s, d):
    return table(s, d, "embeddings").filter(F.col("label").isNotNull()).select("vec_id", F.col("label").cast("int").alias("label"), F.slice("embedding", 1, 10).cast("array<double>").alias("z"))


def classification_metrics(s, d):
    """Accuracy and the mean Jaccard index of the classes, from one pass: each row counts for its two classes."""
    x = logits(s, d).withColumn("guess", (F.array_position("z", F.array_max("z")) - 1).cast("int"))
    each = x.select(F.explode(F.array(F.struct(col("label").alias("k"), (col("label") == col("guess")).cast("long").alias("tp"), F.lit(1).alias("t"), F.lit(0).alias("g")), F.struct(col("guess").alias("k"), F.lit(0).cast("long").alias("tp"), F.lit(0).alias("t"), F.lit(1).alias("g")))).alias("x")).select("x.*")
    per = each.groupBy("k").agg(F.sum("tp").alias("tp"), F.sum("t").alias("t"), F.sum("g").alias("g"))
    return per.agg(r9(F.sum("tp") / F.sum("t")).alias("accuracy"), r9(F.avg(col("tp") / (col("t") + col("g") - col("tp")))).alias("jaccard"))


def topk_accuracy(s, d):
    own = F.element_at("z", col("label") + 1)
    above = F.size(F.filter("z", lambda v: v > own))
    return logits(s, d).agg(r9(F.avg((above < 1).cast("double"))).alias("top1"), r9(F.avg((above < 3).cast("double"))).alias("top3"))


def cross_entropy(s, d):
    total = F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v))
    return logits(s, d).agg(r9(F.avg(F.log(total) - F.element_at("z", col("label") + 1))).alias("loss"))


def linear_head(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda v, i: v.cast("double") * (i % 7 - 3) / 10.0).alias("t"))
    return e.select("vec_id", r9(F.aggregate("t", F.lit(0.5), lambda a, v: a + v)).alias("y"))


# neighbourhoods

def filtered_images(s, d, of, size):
    """Each embedding, an image of eight by eight, after a filter. Nothing is shuffled: a row is a tile."""
    e = table(s, d, "embeddings").filter("embedding is not null").select(col("vec_id").alias("tile"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return rounded(arrays.opened(arrays.on_images(e, 8, of, ["x"], "p"), ["tile"], "p", size), "p")


def gaussian_blur(s, d):
    return filtered_images(s, d, arrays.blurred, 8)


def downsample2x(s, d):
    return filtered_images(s, d, arrays.halved, 4)


def upsample_bilinear(s, d):
    return filtered_images(s, d, lambda x: arrays.enlarged(arrays.halved(x)), 8)


def mask_downsample(s, d):
    return neighbourhood.mask_downsample(images(s, d).withColumn("m", col("p") > 0), ["tile"])


def laplacian_pyramid(s, d):
    # the images are arrays as they are read: nothing is shuffled to build a tile
    x = tensor(s, d).filter("p is not null and t is not null").withColumns({c: F.transform(c, lambda v: v.cast("double")) for c in "pt"})
    x = x.withColumn("m", F.zip_with("p", "t", lambda a, b: a + b > -0.1))
    each = arrays.with_pyramid(x, 8).agg(*arrays.pyramid_levels())
    return each.select(r9((col("level0") + col("level1") + col("level2")) / 3).alias("loss"))


def dense_chips(s, d):
    """Every cell of the whole chips in 2020, with 0 where a value is missing."""
    cells = chip_grid(s, d).select("ci", "cj", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(CHIP - 1).cast("long"))).alias("r"))
    cells = cells.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(CHIP - 1).cast("long"))))
    v = wide(s, d).select(F.floor(col("r") / CHIP).alias("ci"), F.floor(col("c") / CHIP).alias("cj"), (col("r") % CHIP).alias("r"), (col("c") % CHIP).alias("c"), col("y2020").alias("t"), col("y2015").alias("p"))
    return cells.join(v, ["ci", "cj", "r", "c"], "left").withColumn("m", col("t").isNotNull()).fillna(0.0, ["t", "p"])


def ssim(s, d):
    return neighbourhood.ssim(dense_chips(s, d), ["ci", "cj"], CHIP).select("ci", "cj", F.round("ssim", 8).alias("ssim"))


def edt_weights(s, d):
    return rounded(neighbourhood.edge_distance(dense_chips(s, d), ["ci", "cj"], CHIP).select("ci", "cj", "r", "c", "weight"), "weight")


def tile_weights(s, d):
    """Overlapping tiles with the exact distance of their valid cells to the nearest invalid or border cell: at a border 0,
    inwards more. A cell is valid if its first and its last year are."""
    x = tiles.explode_tiles(wide(s, d).select("pid", "r", "c", "y1990", "y2020"), TILE, STRIDE)
    own = x.select("pid", "ti", "tj", (col("r") - col("ti")).alias("r"), (col("c") - col("tj")).alias("c"), col("y2020").alias("v"), pixel.all_finite([col("y1990"), col("y2020")]).alias("m"))
    return neighbourhood.edge_distance(own, ["ti", "tj"], TILE).filter(col("pid").isNotNull()).withColumnRenamed("weight", "w")


def weighted_blend(s, d):
    """The twelve outputs of a stand-in model (three quantiles of four horizons, each tile its own), blended by the weight
    that all of them share."""
    channels = [(f"v{h * 3 + k}", col("v") + k * 0.2 + h * 0.01 + col("ti") * 0.001) for h in range(4) for k in range(3)]
    # channels are columns until the tiles are blended: a pixel is one group, not twelve
    x = metrics.blend_columns(tile_weights(s, d).select("pid", "w", *[v.alias(name) for name, v in channels]), ["pid"], [name for name, _ in channels])
    x = x.select("pid", F.posexplode(F.array(*[name for name, _ in channels])).alias("channel", "v"), "w")
    return rounded(x, "v", "w").withColumnRenamed("w", "weight")


def blend_coverage(s, d):
    b = tile_weights(s, d).groupBy("pid").agg(F.sum("w").alias("w"))
    n = F.sum((col("w") > 0).cast("long"))
    return b.agg(n.alias("n"), r9(100.0 * n / F.count("*")).alias("percent"))


def temporal_lag(s, d):
    w = Window.partitionBy("pid").orderBy("yr")
    x = cube(s, d).select("pid", "yr", "hm", F.lag("hm", 1).over(w).alias("last"), F.lag("hm", 2).over(w).alias("second_last"))
    return rounded(x, "hm", "last", "second_last")


def nearest_downsample(s, d):
    return rounded(wide(s, d).filter((col("r") % 4 == 0) & (col("c") % 4 == 0)).select((col("r") / 4).cast("long").alias("r"), (col("c") / 4).cast("long").alias("c"), col("y2020").alias("v")), "v")


# sets

def valid_intersect(s, d):
    # both sides are predicates on the same row: no set operation, one scan
    return wide(s, d).filter("y2000 is not null and y2020 is not null").select("pid")


def invalid_except(s, d):
    return wide(s, d).filter("y2020 is null").select("pid")


def mask_union(s, d):
    return wide(s, d).filter("y2000 is null or y2020 is null").select("pid")


def union_all_batches(s, d):
    """The changes of all horizons' batches together: they are parts of one frame, so that one scan holds their union."""
    return all_changes(s, d).groupBy("h").agg(F.count("*").alias("n"), F.round(F.sum("dt"), 5).alias("total"))


# encoders and models

def encoded(s, d, name, **options):
    p = pixel_lonlat(s, d)
    lon, lat = col("lon"), col("lat")
    values = encoders.encoder(name, **options)(lon, lat)
    return p.select("pid", F.posexplode(F.array(*values)).alias("k", "v")).select("pid", "k", F.round("v", 8).alias("v"))


def pe_spherical_harmonics_analytic(s, d):
    p = pixel_lonlat(s, d)
    return p.select("pid", F.posexplode(F.array(*encoders.harmonics(col("lon"), col("lat"), 4, analytic=True))).alias("k", "v")).select("pid", "k", F.round("v", 8).alias("v"))


def convlstm_predict(s, d):
    """Twelve outputs (four horizons by lower, central, upper) of a recurrent convolution over the three inputs of each
    chip, with weights drawn from a seed."""
    x = dense_years(s, d)
    return convlstm.predict(x, ["ci", "cj"], CHIP, convlstm.Weights.drawn(seed=7, channels=1, hidden=4, outputs=12))


def dense_years(s, d):
    cells = chip_grid(s, d).select("ci", "cj", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(CHIP - 1).cast("long"))).alias("r"))
    cells = cells.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(CHIP - 1).cast("long"))))
    v = wide(s, d).select(F.floor(col("r") / CHIP).alias("ci"), F.floor(col("c") / CHIP).alias("cj"), (col("r") % CHIP).alias("r"), (col("c") % CHIP).alias("c"), "y1990", "y1995", "y2000")
    x = cells.join(v, ["ci", "cj", "r", "c"], "left").fillna(0.0)
    return x.select("ci", "cj", "r", "c", F.array(F.array("y1990"), F.array("y1995"), F.array("y2000")).alias("x"))


PLAIN = [
    validity_mask, validity_summary, zscore_normalize, denormalize_clip, impute_zero_components, impute_zero_static, mean_impute,
    pixel_validity, validation_mask, prediction_mask, masked_prediction, change_delta, delta_range_filter, abs_error, interval_width,
    pixel_lonlat, nonempty_chips, channel_unpivot, layer_name_parse, stack_layers, temporal_offset_join, temporal_sampling_targets,
    static_repeat, pixel_in_polygon, region_union, tile_semi_join, tile_anti_join, pixel_tile_explode, tile_grid, tile_pad, sweep_grid,
    logit_fusion, chip_valid_ratio, chip_grid, sliding_chips, spatial_split_assign, split_pixel_counts, split_semi_join,
    split_chip_jitter, latitude_band_counts, hm_stats, layer_stats, fallback_stats, change_histogram, histogram_proportions,
    histogram_cdf, change_histogram_report, rarity_weights, wasserstein_histogram, masked_mse, masked_mae, pinball_loss,
    interval_coverage, macro_average_losses, composite_loss, full_val_metrics, baseline_no_change, baseline_linear,
    pixel_weighted_metric, sweep_objective, hexbin_density, best_checkpoint, classification_metrics, topk_accuracy, cross_entropy,
    linear_head, gaussian_blur, downsample2x, upsample_bilinear, mask_downsample, laplacian_pyramid, ssim, edt_weights,
    weighted_blend, blend_coverage, temporal_lag, nearest_downsample, valid_intersect, invalid_except, mask_union, union_all_batches,
    pe_spherical_harmonics_analytic, convlstm_predict,
]

QUERIES = {f.__name__: f for f in PLAIN}
QUERIES["bbox_to_rowcol"] = bounds
for _name in ("direct", "cartesian3d", "wrap"):
    QUERIES[f"pe_{_name}"] = partial(encoded, name=_name)
for _name in ("grid", "spherec", "spherecplus", "spherem", "spheremplus", "theory"):
    QUERIES[f"pe_{_name}"] = partial(encoded, name=_name, freqs=FREQS)
QUERIES["pe_spherical_harmonics"] = partial(encoded, name="sphericalharmonics", degrees=4)
QUERIES["pe_discretized_sh"] = partial(encoded, name="discretized", degrees=3)
