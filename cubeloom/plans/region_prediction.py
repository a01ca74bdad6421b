"""Prediction of the registered region, from layers to maps of each year and quantile."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.operators import pixel, prediction, predictor
from cubeloom.plans import assembly
from cubeloom.plans import queries as base
from cubeloom.plans.cube import statics, wide

col = F.col
YEARS, STATIC, LAST = ("y2010", "y2015", "y2020"), ["ele", "tas", "lo", "la"], 2020


def region_inputs(s, d) -> DataFrame:
    """Every pixel with its channels, scaled by their layers' statistics. A missing first static layer means 0; other missing
    layers make the pixel incomplete."""
    one = base.stats(s, d).filter("layer = 'hm'").select(col("mean").alias("hm_mean"), col("std").alias("hm_std"))
    st = statics(s, d)
    moments = st.agg(*[e.alias(f"{c}_{n}") for c in ("ele", "tas") for n, e in (("mean", F.avg(c)), ("std", F.stddev_pop(c) + 1e-8))])
    x = base.with_dy(s, d, wide(s, d).join(st, "pid", "left")).crossJoin(F.broadcast(one)).crossJoin(F.broadcast(moments))
    lon, lat = pixel.lonlat(col("r"), col("c"), base.X0, base.Y0, base.DX, col("dy"))
    valid = pixel.in_region(lon, lat, base.REGION) & pixel.all_finite([col(c) for c in YEARS])
    scaled = {c: pixel.zscore(col(c), col("hm_mean"), col("hm_std")) for c in YEARS} | {"ele": pixel.zscore(F.coalesce("ele", F.lit(0.0)), col("ele_mean"), col("ele_std")), "tas": pixel.zscore(col("tas"), col("tas_mean"), col("tas_std"))}
    place = {"lo": F.radians(base.r9(lon)) / np.pi, "la": F.radians(base.r9(lat)) / np.pi}
    return x.select("r", "c", valid.alias("valid"), pixel.all_finite([col(c) for c in (*YEARS, "tas")]).alias("complete"), "hm_mean", "hm_std", *[v.alias(k) for k, v in (scaled | place).items()])


def mapped(s, d, weights, size: int = base.TILE, stride: int = base.STRIDE) -> DataFrame:
    """``r, c, yr, q, v, weight``: a row a pixel, target year and quantile (lower, central, upper), de-normalised and cut to 0
    and 1 after the blend; null where an input is missing."""
    maps = prediction.predict_region(region_inputs(s, d), base.bounds(s, d), size, stride, [[y] for y in YEARS], STATIC, weights, predictor.forward, 12)
    one = F.broadcast(base.stats(s, d).filter("layer = 'hm'").select("mean", "std"))
    x = maps.select("r", "c", "weight", F.posexplode("v").alias("k", "z")).crossJoin(one)
    v = pixel.clip01(pixel.denormalize(col("z"), col("mean"), col("std")))
    return x.select("r", "c", (LAST + 5 * (F.floor(col("k") / 3) + 1)).cast("int").alias("yr"), (col("k") % 3).alias("q"), (F.round(v, 6) + 0.0).alias("v"), base.r9(col("weight")).alias("weight"))


def region_prediction(s, d):
    """By the model whose kernels are one cell, which SQL can follow."""
    return mapped(s, d, assembly.PIXELWISE)


def region_prediction_coverage(s, d):
    """Pixels that have a weight, and those of them that have a value."""
    x = region_prediction(s, d).filter((col("yr") == LAST + 5) & (col("q") == 1))
    return x.agg(F.count("*").alias("weighted"), F.count("v").alias("with_value"), F.round(F.sum("weight"), 6).alias("weight"))


PLAIN = [region_prediction, region_prediction_coverage]
QUERIES = {f.__name__: f for f in PLAIN}
