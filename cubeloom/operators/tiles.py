"""Chips and tiles: grids, padding, membership of pixels by arithmetic (no range join), splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubeloom.session import stored

#: Shares of the four splits in order; the last takes the rest.
SPLITS = ((1, 0.7), (2, 0.1), (3, 0.1), (4, None))


def with_chip(pixels: DataFrame, size: int, height, width: int, row: str = "r", col: str = "c") -> DataFrame:
    """``ci, cj`` of the whole chips of a grid without overlap; pixels of cut edges are dropped."""
    full = (F.col(row) < F.floor(height / size) * size) & (F.col(col) < width // size * size)
    return pixels.filter(full).withColumns({"ci": F.floor(F.col(row) / size).cast("long"), "cj": F.floor(F.col(col) / size).cast("long")})


def explode_tiles(pixels: DataFrame, size: int, stride: int, row: str = "r", col: str = "c") -> DataFrame:
    """Each pixel in every tile that covers it (``ti, tj``: the tile's first row and column)."""
    first = lambda v: F.greatest(F.lit(0), F.ceil((v - (size - 1)) / stride) * stride).cast("long")
    steps = lambda v: F.sequence(first(v), (F.floor(v / stride) * stride).cast("long"), F.lit(stride).cast("long"))
    return pixels.withColumn("ti", F.explode(steps(F.col(row)))).withColumn("tj", F.explode(steps(F.col(col))))


def tile_grid(bounds: DataFrame, size: int, stride: int) -> DataFrame:
    """Tiles of a window ``r0, r1, c0, c1``, edge tiles shortened: ``ti, tj, h, w``."""
    step = F.lit(stride).cast("long")
    rows = bounds.filter((F.col("r1") > F.col("r0")) & (F.col("c1") > F.col("c0"))).withColumn("ti", F.explode(F.sequence(F.col("r0"), F.col("r1") - 1, step)))
    cells = rows.withColumn("tj", F.explode(F.sequence(F.col("c0"), F.col("c1") - 1, step)))
    return cells.select("ti", "tj", F.least(F.lit(size).cast("long"), F.col("r1") - F.col("ti")).alias("h"), F.least(F.lit(size).cast("long"), F.col("c1") - F.col("tj")).alias("w"))


def pad(tiles: DataFrame, values: DataFrame, size: int) -> DataFrame:
    """Every cell of every tile, with 0 where ``values`` (``ti, tj, i, j, v``) has none."""
    cells = tiles.select("ti", "tj", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    return cells.join(values, ["ti", "tj", "i", "j"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def assign_splits(chips: DataFrame, order: list[Column]) -> DataFrame:
    """``split`` of each chip: shares by position in ``order``. Chips are dealt to ranges of that order; a position is the
    place in the range and the sizes of the ranges before, so that no task has to order all chips."""
    names = [f"_o{i}" for i in range(len(order))]
    ranged = stored(chips.withColumns(dict(zip(names, order, strict=True))).repartitionByRange(*names).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"), F.sum("_size").over(Window.partitionBy(F.lit(1))).alias("_n"))
    placed = ranged.join(F.broadcast(offsets), "_part").withColumn("_p", F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*names)))
    split, until = None, F.lit(0)
    for value, share in SPLITS:
        if share is None:
            split = split.otherwise(value)
        else:
            until = until + F.floor(F.col("_n") * share)
            split = (F if split is None else split).when(F.col("_p") <= until, value)
    return placed.withColumn("split", split.cast("int")).drop("_n", "_p", "_part", "_before", *names)
