"""Prediction of a region from its pixels to blended maps: overlapping tiles, a model a tile, and a mean of what overlaps,
weighted by how far a cell is from its tile's border and from cells without data."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.operators.arrays import bound, count_to, edge_distances, on_images, packed
from cubeloom.operators.tiles import explode_tiles

Weights = dict[str, np.ndarray]
#: About how many cells the model sees at once: its memory is bounded by them.
CELLS = 1 << 15


def predict_region(pixels: DataFrame, window: DataFrame, size: int, stride: int, dynamic: list[list[str]], static: list[str], weights: Weights, run_model: Callable[[np.ndarray, Weights], np.ndarray], outputs: int) -> DataFrame:
    """``r, c, v, weight``: the ``outputs`` values of each pixel that a tile reaches with a weight above 0.

    ``pixels``: ``r, c, valid, complete``, scaled channels ``dynamic`` (a list a time) and ``static``; missing channels are 0 to
    the model, which takes images by time, tile, channel, row and column. ``window`` is one row ``r0, r1, c0, c1``: tiles start at its corner, those at its far edges are shortened and
    padded with 0, and pixels outside are left out. Only valid pixels have weights; those that are not ``complete`` have null
    values. Tiles without a valid pixel are dropped before the model. A tile is one row, so that one exchange feeds model and
    weights and a second one blends.
    """
    names = [*dict.fromkeys([c for step in dynamic for c in step] + static)]
    x = pixels.crossJoin(F.broadcast(window)).filter((F.col("r") >= F.col("r0")) & (F.col("r") < F.col("r1")) & (F.col("c") >= F.col("c0")) & (F.col("c") < F.col("c1")))
    x = x.withColumns({"_r": F.col("r") - F.col("r0"), "_c": F.col("c") - F.col("c0")})
    x = explode_tiles(x, size, stride, "_r", "_c")
    last = lambda v, lo, hi: F.least(F.lit(size).cast("long"), F.col(hi) - F.col(lo) - F.col(v)) - 1
    r, c = F.col("_r") - F.col("ti"), F.col("_c") - F.col("tj")
    inner = F.col("valid") & (r > 0) & (c > 0) & (r < last("ti", "r0", "r1")) & (c < last("tj", "c0", "c1"))
    flag = lambda v: F.coalesce(v, F.lit(False)).cast("double")
    x = x.select("ti", "tj", "r0", "c0", r.alias("r"), c.alias("c"), flag(inner).alias("_inner"), flag(F.col("complete")).alias("_complete"), *[F.col(n).cast("double") for n in names])
    tiles = packed(x, ["ti", "tj", "r0", "c0"], size, {"_inner": 0.0, "_complete": 0.0, **{n: 0.0 for n in names}})
    tiles = tiles.filter(F.array_contains("_inner", 1.0))

    together = max(1, CELLS // size**2)

    def run(inner: np.ndarray, complete: np.ndarray, *channels: np.ndarray) -> np.ndarray:
        of = dict(zip(names, channels, strict=True))
        away = edge_distances(inner > 0)
        out = np.empty((len(inner), size, size, outputs + 1))
        for k in range(0, len(inner), together):
            image = np.stack([np.stack([of[n][k : k + together] for n in (*step, *static)], axis=1) for step in dynamic])
            out[k : k + together, ..., :outputs] = np.moveaxis(run_model(image, weights), -3, -1)
        out[complete == 0, :outputs] = np.nan
        out[..., outputs] = away
        return out

    made = on_images(tiles, size, run, ["_inner", "_complete", *names], "_out")
    wide = outputs + 1
    cell = bound(F.col("_out"), lambda s: F.transform(count_to(size * size), lambda i: F.struct(i.alias("at"), F.slice(s, i * wide + 1, wide).alias("v"))))
    cells = made.select("ti", "tj", "r0", "c0", F.explode(cell).alias("_cell")).withColumn("_w", F.get("_cell.v", F.lit(outputs))).filter("_w > 0")
    row, column = F.expr(f"r0 + ti + cast(_cell.at div {size} as bigint)"), F.col("c0") + F.col("tj") + F.col("_cell.at") % size
    total = lambda k: F.sum(F.get("_cell.v", F.lit(k)) * F.col("_w")) / F.sum("_w")
    # a pixel is incomplete in all of its tiles or in none
    known = lambda v: F.when(~F.isnan(v), v)
    return cells.groupBy(row.alias("r"), column.cast("long").alias("c")).agg(F.array(*[known(total(k)) for k in range(outputs)]).alias("v"), F.sum("_w").alias("weight"))
