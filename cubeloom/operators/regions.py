"""Polygons from a table, of any number and size, joined with pixels by scan lines.

Every edge of every ring is dealt to the raster rows whose centres it crosses, and only the places of the crossings go on. In
a row, a polygon's crossings in order bound the spans inside it by pairs, holes and islands included (even-odd). Spans are
cut to blocks of columns, and pixels meet them by row and block.

``within`` gives the same pairs without a row a crossing: edges meet pixels by bands of rows, of which a grid has a fixed number,
and crossings, spans and pairs are made behind that exchange. What it moves grows with edges and pixels, not with the rows
that a polygon covers. No task holds more of a polygon than its edges in one band.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cubeloom.session import ship

#: The most pairs of a pixel and a polygon that a task looks at together.
PAIRS = 4_000_000


@dataclass(frozen=True)
class Grid:
    """The place of the first row and column, and a pixel's size; ``dy`` may be a column's name."""

    x0: float
    y0: float
    dx: float
    dy: float | str

    def step(self):
        return F.col(self.dy) if isinstance(self.dy, str) else F.lit(self.dy)


def edges(points: DataFrame, keys: list[str], ring: str = "ring", point: str = "point") -> DataFrame:
    """``keys, x1, y1, x2, y2``: each point with the next of its ring, the last with the first; level edges are left out."""
    ordered = Window.partitionBy(*keys, ring).orderBy(point)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = lambda c: F.coalesce(F.lead(c).over(ordered), F.first(c).over(whole))
    kept = [c for c in points.columns if c not in {*keys, ring, point, "x", "y"}]
    x = points.select(*keys, *kept, F.col("x").alias("x1"), F.col("y").alias("y1"), following("x").alias("x2"), following("y").alias("y2"))
    return x.filter(F.col("y1") != F.col("y2"))


def crossings(sides: DataFrame, keys: list[str], grid: Grid, height) -> DataFrame:
    """``keys, r, x``: where an edge crosses the line through the centres of row ``r``."""
    v1, v2 = ((F.col(c) - grid.y0) / grid.step() for c in ("y1", "y2"))
    first = F.greatest(F.lit(0), F.floor(F.least(v1, v2) - 0.5)).cast("long")  # a row more, for rounding
    last = F.least(height - 1, F.floor(F.greatest(v1, v2) + 0.5)).cast("long")
    rows = sides.withColumns({"_a": first, "_b": last}).filter(F.col("_a") <= F.col("_b"))
    rows = rows.withColumn("r", F.explode(F.sequence("_a", "_b")))
    y = F.lit(grid.y0) + (F.col("r") + 0.5) * grid.step()
    met = rows.filter((F.col("y1") > y) != (F.col("y2") > y))
    return met.select(*keys, "r", ((y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")) + F.col("x1")).alias("x"))


def spans(crossed: DataFrame, keys: list[str], grid: Grid, width: int) -> DataFrame:
    """``keys, r, c0, c1``: half-open runs of columns whose centres are inside."""
    row = Window.partitionBy(*keys, "r").orderBy("x")
    x = crossed.withColumns({"_n": F.row_number().over(row), "_to": F.lead("x").over(row)}).filter(F.col("_n") % 2 == 1)
    at = lambda c: F.ceil((c - grid.x0) / grid.dx - 0.5)
    x = x.select(*keys, "r", F.greatest(F.lit(0), at(F.col("x"))).cast("long").alias("c0"), F.least(F.lit(width), at(F.col("_to"))).cast("long").alias("c1"))
    return x.filter(F.col("c0") < F.col("c1"))


def inside(pixels: DataFrame, runs: DataFrame, keys: list[str], block: int = 256) -> DataFrame:
    """``pixels`` (with ``r, c``) and the ``keys`` of every polygon that a pixel's centre is in."""
    cut = runs.withColumn("_k", F.explode(F.sequence(F.expr(f"c0 div {block}"), F.expr(f"(c1 - 1) div {block}"))))
    cut = cut.select(*keys, F.col("r").alias("_r"), "_k", "c0", "c1")
    at = pixels.withColumn("_j", F.expr(f"c div {block}"))
    on = (F.col("r") == F.col("_r")) & (F.col("_j") == F.col("_k")) & (F.col("c") >= F.col("c0")) & (F.col("c") < F.col("c1"))
    return at.join(cut, on).select(*pixels.columns, *keys)


def counted(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of lengths ``n``: of each element, its run and its place there."""
    run = np.repeat(np.arange(len(n)), n)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)


def pairs_within(polygon: np.ndarray, side: np.ndarray, line: np.ndarray, y: np.ndarray, c: np.ndarray, grid: Grid, width: int, ends: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The polygons and pixels of all pairs: ``side`` holds ``x1, y1, x2, y2`` of each edge of each ``polygon``; pixels are ordered
    by ``line``, a number from 0 in the order of their ``y``, and by ``c``; ``ends`` are the columns that they lie between."""
    x1, y1, x2, y2 = side
    ys = y[np.searchsorted(line, np.arange(line[-1] + 1))]
    first, last = np.searchsorted(ys, np.minimum(y1, y2)), np.searchsorted(ys, np.maximum(y1, y2))
    e, row = counted(last - first)
    row += first[e]
    x = (ys[row] - y1[e]) * (x2[e] - x1[e]) / (y2[e] - y1[e]) + x1[e]
    group = polygon[e] * len(ys) + row
    order = np.lexsort((x, group))
    group, x = group[order], x[order]
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    odd = np.flatnonzero((np.arange(len(group)) - np.repeat(starts, np.diff(starts, append=len(group)))) % 2 == 0)
    after = np.minimum(odd + 1, len(group) - 1)
    paired = (after > odd) & (group[after] == group[odd])
    at = lambda v: np.ceil((v - grid.x0) / grid.dx - 0.5)
    c0, c1 = np.maximum(ends[0], at(x[odd])), np.minimum(ends[1], np.where(paired, at(x[after]), width))
    some = c0 < c1
    group, c0, c1 = group[odd][some], c0[some].astype(np.int64), c1[some].astype(np.int64)
    places, of = line * (width + 1) + c, group % len(ys) * (width + 1)
    start = np.searchsorted(places, of + c0)
    run, place = counted(np.searchsorted(places, of + c1) - start)
    return group[run] // len(ys), start[run] + place


def within(pixels: DataFrame, sides: DataFrame, keys: list[str], columns: list[str], grid: Grid, height, width: int, block: int = 16, bands: int = 256, parts: int = 4, tasks: int = 128) -> DataFrame:
    """``columns`` of ``pixels`` and the ``keys`` of every polygon that a pixel's centre is in, as ``inside`` finds them; ``sides`` are
    ``edges``. Both frames have the columns that ``height`` and ``grid.dy`` name. Pixels outside the grid are in no polygon.

    A group is a band's block of columns with one of ``parts`` of the polygons that reach it."""
    ship(pixels.sparkSession)
    band = lambda r: F.floor(r / F.greatest(F.lit(16), F.ceil(height / bands))).cast("long")
    v1, v2 = ((F.col(c) - grid.y0) / grid.step() for c in ("y1", "y2"))
    first = F.greatest(F.lit(0), F.floor(F.least(v1, v2) - 0.5)).cast("long")  # a row more, for rounding
    last = F.least(height - 1, F.floor(F.greatest(v1, v2) + 0.5)).cast("long")
    e = sides.withColumns({"_a": first, "_b": last}).filter(F.col("_a") <= F.col("_b"))
    e = e.select(*keys, F.struct("x1", "y1", "x2", "y2").alias("_e"), F.explode(F.sequence(band(F.col("_a")), band(F.col("_b")))).alias("_band"))
    ends = [f((F.col(f"_e.{x}") - grid.x0) / grid.dx) for f, x in ((F.min, "x1"), (F.min, "x2"), (F.max, "x1"), (F.max, "x2"))]
    e = e.groupBy(*keys, "_band").agg(F.collect_list("_e").alias("_edges"), F.least(*ends[:2]).alias("_c0"), F.greatest(*ends[2:]).alias("_c1"))
    part = lambda c: F.greatest(F.lit(0), F.least(F.lit((width - 1) // block), F.floor(c / block))).cast("long")
    # a column more at both ends, for rounding
    e = e.select(*keys, "_band", "_edges", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int").alias("_part"), F.explode(F.sequence(part(F.col("_c0") - 1), part(F.col("_c1") + 1))).alias("_k"))

    y = F.lit(grid.y0) + (F.col("r") + 0.5) * grid.step()
    held = pixels.filter((F.col("r") >= 0) & (F.col("r") < height) & (F.col("c") >= 0) & (F.col("c") < width))
    each = F.explode(F.array(*map(F.lit, range(parts)))).alias("_part")
    held = held.select(band(F.col("r")).alias("_band"), F.expr(f"c div {block}").cast("long").alias("_k"), each, y.cast("double").alias("_y"), F.col("c").cast("long").alias("_c"), *[F.col(c).alias(f"_of_{c}") for c in columns])

    def taken(polygons: pa.Table, cells: pa.Table, p, at) -> pa.Table:
        p, at = pa.array(p, pa.int64()), pa.array(at, pa.int64())
        return pa.table({**{x: cells[f"_of_{x}"].take(at) for x in columns}, **{x: polygons[x].take(p) for x in keys}})

    def run(key: tuple, polygons: pa.Table, cells: pa.Table) -> pa.Table:
        if not len(polygons) or not len(cells):
            return taken(polygons, cells, [], [])
        k = key[1].as_py()
        ordered = cells.take(pa.array(np.lexsort((cells["_c"].to_numpy(), cells["_y"].to_numpy()))))
        y, c = ordered["_y"].to_numpy(), ordered["_c"].to_numpy()
        line = np.cumsum(np.diff(y, prepend=y[0]) != 0)
        made = []
        step = max(1, PAIRS // len(c))
        for i in range(0, len(polygons), step):
            some = polygons.slice(i, step).combine_chunks()
            lists = some["_edges"].combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            side = np.stack([x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten()])
            polygon = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            p, at = pairs_within(polygon, side, line, y, c, grid, width, (k * block, min(width, (k + 1) * block)))
            made.append(taken(some, ordered, p, at))
        return pa.concat_tables(made)

    on = ["_band", "_k", "_part"]
    fields = [*[f for c in columns for f in pixels.schema.fields if f.name == c], *[f for k in keys for f in sides.schema.fields if f.name == k]]
    return e.repartition(tasks, *on).groupBy(*on).cogroup(held.repartition(tasks, *on).groupBy(*on)).applyInArrow(run, StructType(fields))
