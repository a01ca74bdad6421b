"""Square tiles as array columns: a tile is one row, an image a flat array, row by row. Filters, pyramids, similarity and
distances work within that row, so that one exchange builds the tiles and none follows.

Tiles are built and opened by Catalyst; their arrays go to numpy in Arrow batches, many tiles at once. As higher-order
functions the same pyramid took four times as long in all. Every separable filter is a matrix: an image is multiplied by it from both
sides. Functions of numpy take and return stacks of images (tile, row, column); images are bounded by their side.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubeloom.session import ship


def gaussian(size: int, sigma: float) -> list[float]:
    g = [math.exp(-((i - (size - 1) / 2) ** 2) / (2 * sigma**2)) for i in range(size)]
    return [x / sum(g) for x in g]


def bound(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def count_to(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def packed(cells: DataFrame, tile: list[str], size: int, fill: dict[str, object]) -> DataFrame:
    """One row a tile with a flat array, row by row, of each column of ``fill``, whose values stand in for nulls and for cells
    that are missing. Cells are ``tile, r, c`` and those columns, other columns are dropped; of several cells of a place the
    least stays, cells outside ``0 .. size - 1`` are left out."""
    inside = F.col("r").between(0, size - 1) & F.col("c").between(0, size - 1)
    of = lambda c, v: F.lit(v).cast(cells.schema[c].dataType) if v is not None else F.lit(None).cast(cells.schema[c].dataType)
    cell = F.struct((F.col("r") * size + F.col("c")).cast("int").alias("at"), F.lit(False).alias("blank"), *[F.coalesce(F.col(c), of(c, v)).alias(c) for c, v in fill.items()])
    blanks = F.transform(count_to(size * size), lambda i: F.struct(i.alias("at"), F.lit(True).alias("blank"), *[of(c, v).alias(c) for c, v in fill.items()]))
    got = cells.filter(inside).groupBy(*tile).agg(F.collect_list(cell).alias("_cells"))
    # behind each place's own cells stands its blank; the first of each place stays
    first = bound(F.array_sort(F.concat("_cells", blanks)), lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["at"] != x["at"])))
    return got.withColumn("_cells", first).select(*tile, *[F.col("_cells").getField(c).alias(c) for c in fill])


def opened(df: DataFrame, keys: list[str], image: str, size: int) -> DataFrame:
    """``keys, r, c`` and the image's cells."""
    cell = df.select(*keys, F.posexplode(image).alias("_at", image))
    return cell.select(*keys, F.expr(f"cast(_at div {size} as bigint)").alias("r"), (F.col("_at") % size).cast("long").alias("c"), image)


def on_images(df: DataFrame, size: int, of: Callable[..., np.ndarray], columns: list[str], name: str) -> DataFrame:
    """``name``: the flat array of doubles that ``of`` makes of each tile's images. No array and none of its cells may be null."""
    ship(df.sparkSession)

    def run(*images: pa.Array) -> pa.Array:
        stacks = [x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), size, size) for x in images]
        out = np.asarray(of(*stacks), dtype=np.float64).reshape(len(images[0]), -1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))

    return df.withColumn(name, F.arrow_udf(run, "array<double>")(*[F.col(c) for c in columns]))


def smoothing(size: int, kernel: int, sigma: float, pad: bool = True) -> np.ndarray:
    """The matrix of a Gaussian along an axis, with zeros outside, or at the places only whose window is within."""
    g = gaussian(kernel, sigma)
    out = sum(w * np.eye(size, size, k - kernel // 2) for k, w in enumerate(g))
    return out if pad else out[kernel // 2 : size - kernel // 2]


def halving(size: int) -> np.ndarray:
    return np.repeat(np.eye(size // 2), 2, axis=1) / 2


def enlarging(size: int, to: int) -> np.ndarray:
    """Bilinear; corners are not aligned."""
    at = np.maximum(0.0, (np.arange(to) + 0.5) * (size / to) - 0.5)
    low = at.astype(int)
    out = np.zeros((to, size))
    out[np.arange(to), low] = 1 - (at - low)
    out[np.arange(to), np.minimum(low + 1, size - 1)] += at - low
    return out


def filtered(images: np.ndarray, by: np.ndarray) -> np.ndarray:
    return by @ images @ by.T


def blurred(images: np.ndarray, kernel: int = 5, sigma: float = 1.0) -> np.ndarray:
    return filtered(images, smoothing(images.shape[-1], kernel, sigma))


def halved(images: np.ndarray) -> np.ndarray:
    return filtered(images, halving(images.shape[-1]))


def enlarged(images: np.ndarray) -> np.ndarray:
    return filtered(images, enlarging(images.shape[-1], 2 * images.shape[-1]))


def mask_halved(masks: np.ndarray) -> np.ndarray:
    """A cell of half the resolution is valid if over half of its four are."""
    n, size, _ = masks.shape
    return masks.reshape(n, size // 2, 2, size // 2, 2).sum(axis=(2, 4)) > 2


def similarity(p: np.ndarray, t: np.ndarray, kernel: int, sigma: float, data_range: float) -> np.ndarray:
    """Structural similarity: the mean over the places whose window is within the tile."""
    by = smoothing(p.shape[-1], kernel, sigma, pad=False)
    a, b, aa, bb, ab = (filtered(x, by) for x in (p, t, p * p, t * t, p * t))
    c1, c2 = (0.01 * data_range) ** 2, (0.03 * data_range) ** 2
    ratio = (2 * a * b + c1) * (2 * (ab - a * b) + c2) / ((a * a + b * b + c1) * (aa - a * a + bb - b * b + c2))
    return ratio.mean(axis=(1, 2))


def pyramid(p: np.ndarray, t: np.ndarray, m: np.ndarray, levels: int) -> np.ndarray:
    """For each tile and level the sum of absolute differences of the Laplacian bands over valid cells, and their number."""
    out = []
    for level in range(levels):
        d = p - t
        if level < levels - 1:
            p, t = halved(blurred(p)), halved(blurred(t))
            d = d - enlarged(p - t)
        out += [np.where(m, np.abs(d), 0.0).sum(axis=(1, 2)), m.sum(axis=(1, 2))]
        if level < levels - 1:
            m = mask_halved(m)
    return np.stack(out, axis=1)


def with_similarity(tiles: DataFrame, size: int, kernel: int = 11, sigma: float = 1.5, data_range: float = 1.0) -> DataFrame:
    """``ssim`` of the images ``p`` and ``t`` of each tile."""
    if size < kernel:
        raise ValueError("no window of the kernel is within a tile")
    of = lambda p, t: similarity(p, t, kernel, sigma, data_range)
    return on_images(tiles, size, of, ["p", "t"], "ssim").withColumn("ssim", F.get("ssim", F.lit(0)))


def with_pyramid(tiles: DataFrame, size: int, levels: int = 3) -> DataFrame:
    """``pyramid``: what ``pyramid`` finds in images ``p, t`` and masks ``m``. ``size`` must halve ``levels - 1`` times."""
    if size % (1 << levels - 1):
        raise ValueError("the side must halve at each level")
    return on_images(tiles, size, lambda p, t, m: pyramid(p, t, m, levels), ["p", "t", "m"], "pyramid")


def pyramid_levels(levels: int = 3) -> list[Column]:
    """Aggregates of ``with_pyramid``: each level's mean, 0 where no cell is valid."""
    part = lambda k: F.sum(F.get("pyramid", F.lit(k)))
    return [F.coalesce(part(2 * i) / F.nullif(part(2 * i + 1), F.lit(0.0)), F.lit(0.0)).alias(f"level{i}") for i in range(levels)]


def envelope(f: np.ndarray) -> np.ndarray:
    """For each line of squared heights, ``min over q of (x - q)² + f[q]`` at each place ``x``: the lower envelope of a
    parabola a place, each pushed and popped once. All lines go on together."""
    lines, n = f.shape
    top, row = np.zeros(lines, dtype=np.int64), np.arange(lines)
    apex = np.zeros((lines, n), dtype=np.int64)
    start = np.full((lines, n + 1), np.inf)
    start[:, 0] = -np.inf
    for q in range(1, n):
        live, cross = row, np.empty(lines)
        while len(live):
            v = apex[live, top[live]]
            cross[live] = ((f[live, q] + q * q) - (f[live, v] + v * v)) / (2.0 * (q - v))
            live = live[cross[live] <= start[live, top[live]]]
            top[live] -= 1
        top += 1
        apex[row, top], start[row, top] = q, cross
        start[row, top + 1] = np.inf
    out, at = np.empty_like(f), np.zeros(lines, dtype=np.int64)
    for x in range(n):
        live = row[start[row, at + 1] < x]
        while len(live):
            at[live] += 1
            live = live[start[live, at[live] + 1] < x]
        v = apex[row, at]
        out[:, x] = (x - v) ** 2 + f[row, v]
    return out


def edge_distances(valid: np.ndarray) -> np.ndarray:
    """The exact distance of each cell to the nearest that is invalid or on its tile's border; ``valid``: tiles, rows, columns."""
    tiles, size, _ = valid.shape
    inner = valid.copy()
    inner[:, [0, -1], :] = inner[:, :, [0, -1]] = False
    far, at = 2 * size, np.arange(size)[None, :, None]
    before = at - np.maximum.accumulate(np.where(inner, -far, at), axis=1)
    after = np.minimum.accumulate(np.where(inner, 3 * far, at)[:, ::-1], axis=1)[:, ::-1] - at
    near = np.minimum(before, after).astype(np.float64)
    return np.sqrt(envelope((near * near).reshape(-1, size))).reshape(valid.shape) * valid


def edge_weights(tiles: DataFrame, size: int, valid: str = "m") -> DataFrame:
    """``weight``, a flat array beside the flat mask: see ``edge_distances``; 0 where a cell is not valid."""
    return on_images(tiles, size, edge_distances, [valid], "weight")
