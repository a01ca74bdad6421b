"""Neighbourhood operators on cells: they build array tiles (``arrays``) and open them again."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.operators import arrays


def mask_downsample(df: DataFrame, tile: list[str], mask: str = "m") -> DataFrame:
    """A cell of half the resolution is valid if over half of its four are."""
    half = lambda c: F.floor(F.col(c) / 2).cast("long").alias(c)
    return df.groupBy(*tile, half("r"), half("c")).agg((F.sum(F.col(mask).cast("int")) > 2).alias(mask))


def pyramid_loss(df: DataFrame, tile: list[str], size: int, levels: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """``level, loss`` of masked mean absolute differences of two images' Laplacian bands (columns ``p, t, m``) in square
    tiles; the last level is the coarsest image itself. Levels without a valid cell lose 0. ``by``: columns of ``tile`` whose
    values are scored apart."""
    x = arrays.with_pyramid(images(df, tile, size), size, levels).groupBy(*by).agg(*arrays.pyramid_levels(levels))
    return x.select(*by, F.posexplode(F.array(*[f"level{i}" for i in range(levels)])).alias("level", "loss"))


def images(df: DataFrame, tile: list[str], size: int) -> DataFrame:
    """``tile, p, t, m`` as flat arrays; missing values are 0, missing masks false."""
    return arrays.packed(df, tile, size, {"p": 0.0, "t": 0.0, "m": False})


def ssim(df: DataFrame, tile: list[str], size: int, kernel: int = 11, sigma: float = 1.5, data_range: float = 1.0) -> DataFrame:
    """Structural similarity of columns ``p, t`` a tile: the mean over the places whose window is within the tile."""
    return arrays.with_similarity(arrays.packed(df, tile, size, {"p": 0.0, "t": 0.0}), size, kernel, sigma, data_range).select(*tile, "ssim")


def edge_distance(df: DataFrame, tile: list[str], size: int, valid: str = "m") -> DataFrame:
    """``weight`` of each cell of each tile: the exact distance of a valid cell to the nearest that is invalid, missing or on
    the tile's border, else 0. Other columns are kept; those of missing cells are null."""
    kept = [c for c in df.columns if c not in (*tile, "r", "c")]
    flat = arrays.packed(df, tile, size, {c: False if c == valid else None for c in kept})
    cells = arrays.edge_weights(flat, size, valid).select(*tile, F.posexplode(F.arrays_zip(*kept, "weight")).alias("_at", "_cell"))
    return cells.select(*tile, F.expr(f"cast(_at div {size} as bigint)").alias("r"), (F.col("_at") % size).cast("long").alias("c"), *[F.col("_cell")[c].alias(c) for c in (*kept, "weight")])


def hexagon(x, y, size: float):
    """Axial coordinates of the hexagon of ``size`` that holds a point (the centre nearest to it). Of the three rounded
    cube coordinates, the one moved farthest is replaced; of equal moves, the third is, then the second."""
    # coordinates and moves are rounded, so that points on an edge fall to the same side on every engine
    q, r = F.round((x * (math.sqrt(3) / 3) - y / 3.0) / size, 6), F.round(y * (2.0 / 3.0) / size, 6)
    s = -q - r
    near = lambda v: F.floor(v + 0.5)
    dq, dr, ds = (F.round(F.abs(near(v) - v), 6) for v in (q, r, s))
    hq = F.when((dq > dr) & (dq > ds), -near(r) - near(s)).otherwise(near(q))
    hr = F.when((dq > dr) & (dq > ds), near(r)).when(dr > ds, -near(q) - near(s)).otherwise(near(r))
    return hq.cast("long"), hr.cast("long")
