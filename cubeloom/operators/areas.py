"""Summed-area tables: prefix sums over both axes of a grid, by which the sum over any window is four look-ups.

The grid is cut to square blocks. A block's own prefix sums are built in its own row; what lies above and to the left of it
comes from running sums over the blocks' last rows and columns, one row a block, so that no task sees a whole layer. Values
are whole numbers: differences of prefix sums are exact, at any size of the grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 16


def added(a, b):
    return F.zip_with(a, b, lambda x, y: x + y)


def summed_area(cells: DataFrame, names: DataFrame, height: DataFrame, width: int, value: str = "v", block: int = BLOCK) -> DataFrame:
    """``by, bi, bj, area``: for each block of each grid of ``names`` (columns ``by``, a row a grid) the sums of all cells above and to the left of each of its cells,
    those of its row and column included, by rows of the block.

    ``cells`` has ``by, r, c`` and a whole number ``value``; missing cells and nulls count 0, cells of one place are added, those
    outside the grid or of grids without a name are dropped, a grid without cells has zeros. ``height`` is a frame of one row
    with the column ``height``. A sum beyond a long is an error.
    """
    by = names.columns
    at = lambda c: (F.col(c) % block).cast("long")
    of = lambda c: F.floor(F.col(c) / block).cast("long")
    x = cells.crossJoin(F.broadcast(height)).filter((F.col("r") >= 0) & (F.col("c") >= 0) & (F.col("r") < F.col("height")) & (F.col("c") < width))
    x = x.select(*by, of("r").alias("bi"), of("c").alias("bj"), at("r").alias("_r"), at("c").alias("_c"), F.col(value).cast("long").alias("_v"))
    # a row of a block: the sums up to each of its columns
    x = x.groupBy(*by, "bi", "bj", "_r").agg(F.array(*[F.coalesce(F.sum(F.when(F.col("_c") <= k, F.col("_v"))), F.lit(0).cast("long")) for k in range(block)]).alias("_p"))
    zeros = F.array_repeat(F.lit(0).cast("long"), block)
    x = x.groupBy(*by, "bi", "bj").agg(F.collect_list(F.struct("_r", "_p")).alias("_rows"))
    # blocks without cells carry sums too
    grid = F.broadcast(height).select(F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("height") - 1) / block).cast("long"))).alias("bi"))
    grid = grid.withColumn("bj", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((width - 1) // block).cast("long"))))
    x = names.crossJoin(grid).join(x, [*by, "bi", "bj"], "left")
    rows = F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda i: F.aggregate(F.filter(F.coalesce("_rows", F.array().cast(x.schema["_rows"].dataType)), lambda e: e["_r"] <= i), zeros, lambda a, e: added(a, e["_p"])))
    x = x.select(*by, "bi", "bj", rows.alias("_own"))
    x = x.withColumn("_right", F.transform("_own", lambda a: F.element_at(a, -1))).withColumn("_low", F.element_at("_own", -1))
    along, down = (Window.partitionBy(*by, p).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for p, o in (("bi", "bj"), ("bj", "bi")))
    before = lambda c, w: F.array(*[F.coalesce(F.sum(F.col(c)[k]).over(w), F.lit(0).cast("long")) for k in range(block)])
    x = x.withColumn("_left", before("_right", along))
    x = x.withColumn("_above", before("_low", down)).withColumn("_corner", F.coalesce(F.sum(F.element_at("_left", -1)).over(down), F.lit(0).cast("long")))
    whole = F.transform("_own", lambda a, i: F.transform(added(a, F.col("_above")), lambda v: v + F.col("_corner") + F.get(F.col("_left"), i)))
    return x.select(*by, "bi", "bj", F.flatten(whole).alias("area"))


def window_sums(areas: DataFrame, windows: DataFrame, by: list[str], key: list[str], block: int = BLOCK) -> DataFrame:
    """``key, by, total`` of each window ``key, by, r0, c0, r1, c1`` (ends are not within): its four corners find their blocks by
    one equi-join. Windows must lie in the grid; empty ones, and those of grids without a name, have the total 0."""
    corner = lambda r, c, sign: F.struct((F.col(r) - 1).alias("r"), (F.col(c) - 1).alias("c"), F.lit(sign).alias("sign"))
    corners = F.explode(F.array(corner("r1", "c1", 1), corner("r0", "c1", -1), corner("r1", "c0", -1), corner("r0", "c0", 1)))
    w = windows.select(*key, *by, corners.alias("_at")).select(*key, *by, F.floor(F.col("_at.r") / block).cast("long").alias("bi"), F.floor(F.col("_at.c") / block).cast("long").alias("bj"), "_at")
    place = (F.col("_at.r") % block * block + F.col("_at.c") % block).cast("int")
    # corners before the first row or column have blocks of -1, which nothing matches: their sums are 0
    found = w.join(areas, [*by, "bi", "bj"], "left").select(*key, *by, (F.coalesce(F.get("area", F.when(place >= 0, place)), F.lit(0).cast("long")) * F.col("_at.sign")).alias("_v"))
    return found.groupBy(*key, *by).agg(F.sum("_v").alias("total"))


def window_cells(cells: DataFrame, windows: DataFrame, by: list[str], block: int = BLOCK) -> DataFrame:
    """``cells`` (``by, r, c``) once for each of the ``windows`` (``by, r0, c0, r1, c1``, ends are not within) that holds them. For
    so few windows that each task can have them: cells are not shuffled, and no prefix sums are built."""
    of = lambda c: F.floor(F.col(c) / block).cast("long")
    span = lambda a, b: F.explode(F.sequence(of(a), F.floor((F.col(b) - 1) / block).cast("long")))
    w = windows.filter((F.col("r0") < F.col("r1")) & (F.col("c0") < F.col("c1"))).select(*by, "r0", "c0", "r1", "c1", span("r0", "r1").alias("_bi"))
    w = w.withColumn("_bj", span("c0", "c1"))
    x = cells.withColumns({"_bi": of("r"), "_bj": of("c")}).join(F.broadcast(w), [*by, "_bi", "_bj"])
    held = (F.col("r") >= F.col("r0")) & (F.col("r") < F.col("r1")) & (F.col("c") >= F.col("c0")) & (F.col("c") < F.col("c1"))
    return x.filter(held).select(*cells.columns)
