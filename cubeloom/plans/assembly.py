"""Registered queries of sampling, batches, masks, reports and models."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.functions.histogram import CHANGE_EDGES
from cubeloom.functions.encoders import encoder
from cubeloom.operators import metrics, networks, pixel, predictor, tiles
from cubeloom.plans import queries as base
from cubeloom.plans.cube import CHIP, WIDTH, cube, height, horizons, long_layers, scored, statics, wide
from cubeloom.sources import weights as stored_weights
from cubeloom.session import shared_folder

col = F.col
r9 = base.r9
SAMPLES, END_YEARS, BATCH, STEPS = 200, (2000, 2005, 2010, 2015), 16, 10
INPUTS = ("y1990", "y1995", "y2000", "ele", "tas")


def raster_metadata(s, d):
    """The size, the transform and the values of every layer and year."""
    x = long_layers(s, d).groupBy("layer", "yr").agg(F.count("v").alias("n_values"), r9(F.min("v")).alias("least"), r9(F.max("v")).alias("most"))
    x = base.with_dy(s, d, x)
    return x.select("layer", "yr", "height", F.lit(WIDTH).alias("width"), F.lit(base.X0).alias("x0"), F.lit(base.Y0).alias("y0"), F.lit(base.DX).alias("dx"), r9(col("dy")).alias("dy"), "n_values", "least", "most")


def input_invalid_mask(s, d):
    """Predictions, missing where any input is: dynamic or static."""
    x = horizons(s, d).join(statics(s, d), "pid", "left")
    ok = pixel.all_finite([col(c) for c in ("first", "prev", "last", "ele", "tas")])
    return x.select("pid", "h", r9(pixel.masked(ok, col("pred"))).alias("pred"))


def horizon_index(s, d):
    """Names of horizons to numbers; an unknown name is 0."""
    known = F.create_map(*[F.lit(v) for i, name in enumerate(("5yr", "10yr", "15yr", "20yr")) for v in (name, i)])
    x = horizons(s, d).select("pid", F.concat((col("h") * 5 + F.when(col("pid") % 3 == 0, 1).otherwise(0)).cast("string"), F.lit("yr")).alias("name"))
    return x.select("pid", "name", F.coalesce(F.element_at(known, col("name")), F.lit(0)).alias("idx"))


def static_stack(s, d):
    """The static layers in order, one value a row."""
    return statics(s, d).select("pid", F.posexplode(F.array("ele", "tas")).alias("idx", "v"))


def first_statics(s, d):
    return static_stack(s, d).filter(col("idx") < 1).select("pid", "idx", r9(col("v")).alias("v"))


def static_stats(s, d):
    x = static_stack(s, d).groupBy("idx").agg(F.avg("v").alias("mean"), (F.stddev_pop("v") + 1e-8).alias("std"))
    return x.select("idx", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


def stack_all_layers(s, d):
    """Every layer of every input year in one row a pixel, and every static layer."""
    years = [F.max(F.when(col("yr") == y, col(v))).alias(f"{v}_{y}") for v in ("hm", "ag", "ti", "gdp") for y in (1990, 1995, 2000)]
    x = cube(s, d).groupBy("pid").agg(*years).join(statics(s, d), "pid", "left")
    return base.rounded(x, *[c for c in x.columns if c != "pid"])


def channel_concat(s, d):
    x = wide(s, d).join(statics(s, d), "pid", "left")
    both = F.concat(F.array("y1990", "y1995", "y2000"), F.array("ele", "tas"))
    return x.select("pid", F.posexplode(both).alias("k", "v")).select("pid", "k", r9(F.coalesce("v", F.lit(0.0))).alias("v"))


def panel_histogram(s, d):
    """Eight bins of each sample's predicted changes, de-normalised and cut to 0 and 1."""
    one = F.broadcast(base.stats(s, d).filter("layer = 'hm'").select("mean", "std"))
    x = tiles.with_chip(scored(s, d).crossJoin(F.broadcast(height(s, d))), CHIP, col("height"), WIDTH).crossJoin(one)
    back = lambda c: pixel.clip01(pixel.denormalize(pixel.zscore(col(c), col("mean"), col("std")), col("mean"), col("std")))
    return metrics.histogram(x.withColumn("delta", F.round(back("pred") - back("last"), 6)), col("delta"), ["ci", "cj", "h"], CHANGE_EDGES)


def picked(salt: str, of, n):
    """A number from 0 to n - 1 by the hash of a sample's number."""
    return F.conv(F.substring(F.md5(F.concat_ws("_", F.lit(salt), of.cast("string"))), 1, 7), 16, 10).cast("long") % n


def random_samples(s, d):
    """Chips anywhere on the grid, each with an end year, the same ones at every layout."""
    x = s.range(SAMPLES).withColumnRenamed("id", "sample").crossJoin(F.broadcast(height(s, d))).filter(col("height") >= CHIP)
    year = F.element_at(F.array(*[F.lit(y) for y in END_YEARS]), (picked("year", col("sample"), len(END_YEARS)) + 1).cast("int"))
    return x.select("sample", picked("row", col("sample"), col("height") - CHIP + 1).alias("r0"), picked("col", col("sample"), F.lit(WIDTH - CHIP + 1)).alias("c0"), year.alias("end_year"))


def tile_batches(s, d):
    """Prediction tiles in batches of 16, by their place in the grid: no order over all tiles is needed."""
    b = F.broadcast(base.bounds(s, d))
    x = base.tile_grid(s, d).crossJoin(b)
    step = base.STRIDE
    place = F.floor((col("ti") - col("r0")) / step) * F.ceil((col("c1") - col("c0")) / step) + F.floor((col("tj") - col("c0")) / step)
    return x.select("ti", "tj", F.floor(place / BATCH).cast("long").alias("batch"))


def first_batches(s, d):
    return tile_batches(s, d).filter(col("batch") < STEPS)


def first_batch(s, d):
    x = tile_batches(s, d)
    return x.join(F.broadcast(x.agg(F.min("batch").alias("batch"))), "batch").select("ti", "tj")


def rarity_weights_sampled(s, d):
    """Rarity weights by the changes of the first batches of chips."""
    x = base.changes(s, d).filter(F.floor((col("ci") * (WIDTH // CHIP) + col("cj")) / 2) < STEPS)
    return base.rounded(metrics.rarity(metrics.histogram(x, col("dt"), ["h"]), ["h"]).drop("n"), "weight")


def tile_crop(s, d):
    """Padded edge tiles, cut back to the grid."""
    p = base.tile_pad(s, d).crossJoin(F.broadcast(height(s, d)))
    r, c = col("ti") + col("i"), col("tj") + col("j")
    return p.filter((r < col("height")) & (c < WIDTH)).select(r.alias("r"), c.alias("c"), "v")


def overview(s, d, most: int = 32):
    """Every k-th row and column, k the least by which no side is longer than ``most``."""
    x = wide(s, d).crossJoin(F.broadcast(height(s, d))).withColumn("k", F.greatest(F.lit(1), F.ceil(F.greatest(col("height"), F.lit(WIDTH)) / most)).cast("long"))
    return x.filter((col("r") % col("k") == 0) & (col("c") % col("k") == 0)).select((col("r") / col("k")).cast("long").alias("r"), (col("c") / col("k")).cast("long").alias("c"), r9(col("y2020")).alias("v"))


def binary_metrics(s, d):
    """A threshold at 0 against two classes, and the regression variant's mean absolute error."""
    x = base.logits(s, d).select((col("label") >= 5).alias("y"), (F.element_at("z", 1) > 0).alias("g"), F.abs(F.element_at("z", 1) - col("label")).alias("e"))
    count = lambda c: F.sum(c.cast("long"))
    return x.agg(r9(F.avg((col("y") == col("g")).cast("double"))).alias("accuracy"), r9(count(col("y") & col("g")) / count(col("y") | col("g"))).alias("jaccard"), r9(F.avg("e")).alias("mae"))


def fixed_weight(name: str, i: int, j: int) -> float:
    """The weights of the registered models: a rule that SQL can follow too."""
    return ((7 * i + 5 * j + 3 * len(name) + sum(map(ord, name))) % 11 - 5) / 10.0


def fixed(name: str, shape: tuple[int, ...]) -> np.ndarray:
    flat = np.zeros(shape).reshape(shape[0], -1)
    for i in range(flat.shape[0]):
        for j in range(flat.shape[1]):
            flat[i, j] = fixed_weight(name, i, j)
    return flat.reshape(shape)


SIREN = {n: fixed(n, s) for n, s in {"w0": (4, 2), "b0": (4,), "w1": (4, 4), "b1": (4,), "w_out": (3, 4), "b_out": (3,)}.items()}
FCNET = {n: fixed(n, s) for n, s in ({"w_in": (4, 2), "b_in": (4,)} | {f"{c}{k}": (4, 4) if len(c) == 1 else (4,) for k in range(4) for c in ("u", "ub", "v", "vb")} | {"w_out": (3, 4)}).items()}
PIXELWISE = {n: fixed(n, s) for n, s in predictor.shapes(channels=5, hidden=2, layers=2, kernel=1, head_kernel=1).items()}


def located(s, d, name: str, weights) -> DataFrame:
    x = networks.encode(base.pixel_lonlat(s, d), encoder("direct")(col("lon"), col("lat")), name, weights)
    return x.select("pid", F.posexplode("loc").alias("k", "v")).select("pid", "k", (F.round("v", 6) + 0.0).alias("v"))


def location_siren(s, d):
    return located(s, d, "siren", SIREN)


def location_fcnet(s, d):
    return located(s, d, "fcnet", FCNET)


def model_cells(s, d, encoding=None) -> DataFrame:
    """Cells of whole chips with their dynamic channels by time and their static ones, the location's included."""
    cells = base.chip_grid(s, d).select("ci", "cj", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(CHIP - 1).cast("long"))).alias("r"))
    cells = cells.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(CHIP - 1).cast("long"))))
    v = wide(s, d).join(statics(s, d), "pid", "left").select(F.floor(col("r") / CHIP).alias("ci"), F.floor(col("c") / CHIP).alias("cj"), (col("r") % CHIP).alias("r"), (col("c") % CHIP).alias("c"), *INPUTS)
    x = base.with_dy(s, d, cells.join(v, ["ci", "cj", "r", "c"], "left").fillna(0.0))
    lon, lat = pixel.lonlat(col("ci") * CHIP + col("r"), col("cj") * CHIP + col("c"), base.X0, base.Y0, base.DX, col("dy"))
    x = x.withColumns({"lon": r9(lon), "lat": r9(lat)})
    if encoding is None:
        place = F.array(F.radians("lon") / np.pi, F.radians("lat") / np.pi)
    else:
        x = networks.encode(x, encoder(encoding[0], degrees=4)(col("lon"), col("lat")), "siren", encoding[1])
        place = col("loc")
    statics_of = F.concat(F.array(col("ele") / 1e6, col("tas") / 1e4), place)
    return x.select("ci", "cj", "r", "c", F.array(F.array("y1990"), F.array("y1995"), F.array("y2000")).alias("x"), statics_of.alias("s"))


def predictor_pixelwise(s, d):
    """The twelve outputs of two stacked layers whose kernels are one cell."""
    return predictor.predict(model_cells(s, d), ["ci", "cj"], CHIP, PIXELWISE)


def predictor_predict(s, d):
    """The twelve outputs of the model as it is configured: 3 x 3 kernels, location channels by harmonics and a sinusoidal
    network, weights read from where they are stored."""
    path = f"{shared_folder(s)}/weights-{uuid.uuid4().hex}"
    stored_weights.save(s, predictor.drawn(7, channels=1 + 2 + 4, hidden=8, layers=2), path)
    location = networks.initial("siren", 16, 16, 4, layers=2, seed=7)
    return predictor.predict(model_cells(s, d, ("sphericalharmonics", location)), ["ci", "cj"], CHIP, stored_weights.load(s, stored_weights.resolved(s, path)))


PLAIN = [
    raster_metadata, input_invalid_mask, horizon_index, first_statics, static_stats, stack_all_layers, channel_concat, panel_histogram,
    random_samples, tile_batches, first_batches, first_batch, rarity_weights_sampled, tile_crop, overview,
    binary_metrics, location_siren, location_fcnet, predictor_pixelwise, predictor_predict,
]
QUERIES = {f.__name__: f for f in PLAIN}
