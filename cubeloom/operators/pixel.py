"""Operators on single pixels: validity, scaling, imputation, masks, changes, coordinates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid(v: Column) -> Column:
    """Present, not NaN and not negative (infinity passes)."""
    return F.coalesce(~F.isnan(v) & (v >= 0), F.lit(False))


def finite(v: Column) -> Column:
    return F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))


def all_finite(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [finite(c) for c in columns])


def zscore(v: Column, mean: Column, std: Column) -> Column:
    return (v - mean) / std


def denormalize(z: Column, mean: Column, std: Column) -> Column:
    return z * std + mean


def clip01(v: Column) -> Column:
    """Into [0, 1]; null stays null (least and greatest would skip it)."""
    return F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def impute_before(layer: Column, v: Column, zero_layers: list[str]) -> Column:
    """Missing values of the layers that mean none are 0; those of others stay missing."""
    return F.when(layer.isin(*zero_layers), F.coalesce(v, F.lit(0.0))).otherwise(v)


def masked(mask: Column, v: Column) -> Column:
    return F.when(mask, v)


def masked_zero(mask: Column, v: Column) -> Column:
    return F.when(mask, v).otherwise(0.0)


def lonlat(row: Column, col: Column, x0: float, y0: float, dx: float, dy) -> tuple[Column, Column]:
    """Pixel centres by an affine transform without rotation."""
    return F.lit(x0) + (col + 0.5) * dx, F.lit(y0) + (row + 0.5) * dy


def window_of_bounds(bounds: DataFrame, x0: float, y0: float, dx: float, dy: float, height: Column, width: int) -> DataFrame:
    """``r0, r1, c0, c1`` of the raster window that covers ``xmin, ymin, xmax, ymax``, clamped to the raster."""
    clamp = lambda v, top: F.greatest(F.lit(0), F.least(v, top)).cast("long")
    c = [(F.col(n) - x0) / dx for n in ("xmin", "xmax")]
    r = [(F.col(n) - y0) / dy for n in ("ymin", "ymax")]
    top = F.lit(width)
    return bounds.select(
        clamp(F.floor(F.least(*r)), height).alias("r0"), clamp(F.ceil(F.greatest(*r)), height).alias("r1"),
        clamp(F.floor(F.least(*c)), top).alias("c0"), clamp(F.ceil(F.greatest(*c)), top).alias("c1"),
    )


def crossed(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """How many edges of a closed ring a ray to the right crosses."""
    n = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 != y2:
            meets = (F.lit(y1) > y) != (F.lit(y2) > y)
            n = n + F.when(meets & (x < (y - y1) * (x2 - x1) / (y2 - y1) + x1), 1).otherwise(0)
    return n


def in_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    return crossed(x, y, ring) % 2 == 1


def in_polygon(x: Column, y: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """In the outer ring and in no hole: the crossings of all rings together are odd."""
    return reduce(lambda a, b: a + b, [crossed(x, y, r) for r in rings]) % 2 == 1


def in_region(x: Column, y: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """In the union of the rings, each a polygon without holes."""
    return reduce(lambda a, b: a | b, [in_ring(x, y, r) for r in rings])
