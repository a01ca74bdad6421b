"""Uncompressed TIFF rasters: a folder of files, each some rows of the grid, with its place in the tags.

A grid is written by its row bands, one file a band and task, so that no raster has to fit a worker; a file's name says
where its rows start, and a window reads the files that it needs and, of these, its own rows. Other writers' files are read
too, if they are uncompressed and stored by strips, one sample a pixel.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.session import ship

#: Tags and types of the TIFF format (fixed values): width, height, bits, compression, photometric, strip offsets, samples,
#: rows a strip, strip sizes, sample format; pixel scale, tie point and missing value of georeferenced files.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, STRIP_ROWS, SIZES, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 339
SCALE, TIE, NODATA = 33550, 33922, 42113
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}
KINDS = {(8, 1): "u1", (16, 1): "u2", (32, 1): "u4", (16, 2): "i2", (32, 2): "i4", (32, 3): "f4", (64, 3): "f8"}


@dataclass
class Header:
    width: int
    height: int
    dtype: np.dtype
    strip_rows: int
    offsets: tuple[int, ...]
    scale: tuple[float, float]
    origin: tuple[float, float]
    nodata: float | None

    def rows(self, raw: bytes, first: int, end: int) -> np.ndarray:
        """The rows from ``first`` to ``end``: of each strip, only what is asked for."""
        out, line = [], self.width * self.dtype.itemsize
        for k in range(first // self.strip_rows, -(-end // self.strip_rows)):
            low, high = max(first, k * self.strip_rows), min(end, (k + 1) * self.strip_rows)
            at = self.offsets[k] + (low - k * self.strip_rows) * line
            out.append(np.frombuffer(raw, self.dtype, (high - low) * self.width, at).reshape(-1, self.width))
        return np.concatenate(out) if out else np.zeros((0, self.width), self.dtype)


def header(raw: bytes) -> Header:
    if raw[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("not a TIFF file")
    e = "<" if raw[:2] == b"II" else ">"
    (at,) = struct.unpack_from(e + "I", raw, 4)
    (count,) = struct.unpack_from(e + "H", raw, at)
    tags: dict[int, tuple] = {}
    for k in range(count):
        tag, kind, n = struct.unpack_from(e + "HHI", raw, at + 2 + 12 * k)
        if kind not in TYPES:
            continue
        form = f"{e}{n}{TYPES[kind]}"
        place = at + 10 + 12 * k
        if struct.calcsize(form) > 4:
            (place,) = struct.unpack_from(e + "I", raw, place)
        tags[tag] = struct.unpack_from(form, raw, place)
    if tags.get(COMPRESSION, (1,))[0] != 1 or tags.get(SAMPLES, (1,))[0] != 1 or OFFSETS not in tags:
        raise ValueError("only uncompressed rasters of one sample, stored by strips, are read")
    scale, tie = tags.get(SCALE, (1.0, 1.0, 0.0)), tags.get(TIE, (0.0,) * 6)
    missing = tags[NODATA][0].rstrip(b"\0 ").decode() if NODATA in tags else None
    dtype = np.dtype(KINDS[tags.get(BITS, (8,))[0], tags.get(FORMAT, (1,))[0]]).newbyteorder(e)
    height = tags[HEIGHT][0]
    return Header(tags[WIDTH][0], height, dtype, min(height, tags.get(STRIP_ROWS, (height,))[0]), tags[OFFSETS], (scale[0], -scale[1]), (tie[3], tie[4]), float(missing) if missing else None)


def encoded(values: np.ndarray, scale: tuple[float, float], origin: tuple[float, float], nodata: float | None) -> bytes:
    """One file of a band's rows, as one strip."""
    kind = {v: k for k, v in KINDS.items()}[values.dtype.str[1:]]
    entries = [(WIDTH, "I", (values.shape[1],)), (HEIGHT, "I", (values.shape[0],)), (BITS, "H", (kind[0],)), (COMPRESSION, "H", (1,)), (PHOTOMETRIC, "H", (1,)), (OFFSETS, "I", (8,)), (SAMPLES, "H", (1,)), (STRIP_ROWS, "I", (values.shape[0],)), (SIZES, "I", (values.nbytes,)), (FORMAT, "H", (kind[1],))]
    entries += [(SCALE, "d", (scale[0], -scale[1], 0.0)), (TIE, "d", (0.0, 0.0, 0.0, *origin, 0.0))]
    if nodata is not None:
        text = f"{nodata:g}".encode() + b"\0"
        entries.append((NODATA, "s", (text,)))
    body = values.astype(values.dtype.newbyteorder("<")).tobytes()
    body += b"\0" * (len(body) % 2)
    start = 8 + len(body)
    directory, more = struct.pack("<H", len(entries)), b""
    after = start + 2 + 12 * len(entries) + 4
    for tag, form, items in entries:
        n = len(items[0]) if form == "s" else len(items)
        raw = items[0] if form == "s" else struct.pack(f"<{n}{form}", *items)
        if len(raw) > 4:
            place = struct.pack("<I", after + len(more))
            more += raw + b"\0" * (len(raw) % 2)
        else:
            place = raw.ljust(4, b"\0")
        directory += struct.pack("<HHI", tag, {v: k for k, v in TYPES.items()}[form], n) + place
    return b"II*\0" + struct.pack("<I", start) + body + directory + struct.pack("<I", 0) + more


def write(pixels: DataFrame, path: str, height: int, width: int, dtype: str = "u1", scale: tuple[float, float] = (1.0, -1.0), origin: tuple[float, float] = (0.0, 0.0), nodata: float | None = None, band_rows: int = 512) -> None:
    """Write ``r, c, v``. Pixels that are not there, or null, get ``nodata`` (else 0). Files go through Spark's own writer:
    a row a band, in a table of contents."""
    bands = pixels.sparkSession.range(-(-height // band_rows)).select((F.col("id") * band_rows).alias("band"))
    rows = pixels.select((F.floor(F.col("r") / band_rows) * band_rows).cast("long").alias("band"), "r", "c", "v").unionByName(bands, allowMissingColumns=True)
    ship(pixels.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        band = table.column("band")[0].as_py()
        some = table.filter(pa.compute.is_valid(table.column("v")))
        r, c, v = (some.column(x).to_numpy() for x in ("r", "c", "v"))
        image = np.full((min(band_rows, height - band), width), 0 if nodata is None else nodata).astype(dtype)
        image[r.astype(int) - band, c.astype(int)] = v
        raw = encoded(image, scale, (origin[0], origin[1] + band * scale[1]), nodata)
        return pa.table([pa.array([band]), pa.array([raw], pa.binary())], names=["band", "raw"])

    rows.groupBy("band").applyInArrow(run, "band long, raw binary").write.mode("overwrite").partitionBy("band").parquet(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """``band, raw``: the files of a folder, written by ``write``, or any TIFF files, as one band each."""
    if re.search(r"\.tiff?$", path, re.I):
        return spark.read.format("binaryFile").load(path).select(F.lit(0).cast("long").alias("band"), F.col("content").alias("raw"))
    return spark.read.parquet(path).select(F.col("band").cast("long").alias("band"), "raw")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row: the grid's ``height, width, dtype``, its pixel size, its origin, its bounds and its missing value."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(b, header(raw)) for b, raw in zip(batch.column("band").to_pylist(), batch.column("raw").to_pylist(), strict=True)]
            columns = [[b for b, _ in found], *([f(h) for _, h in found] for f in (lambda h: h.height, lambda h: h.width, lambda h: h.dtype.str[1:], lambda h: float(h.scale[0]), lambda h: float(h.scale[1]), lambda h: float(h.origin[0]), lambda h: float(h.origin[1]), lambda h: h.nodata))]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.float64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names="band rows width dtype dx dy x0 y0 nodata".split())

    each = files(spark, path).mapInArrow(run, "band long, rows long, width long, dtype string, dx double, dy double, x0 double, y0 double, nodata double")
    one = each.agg(F.max(F.col("band") + F.col("rows")).alias("height"), *[F.first(c).alias(c) for c in ("width", "dtype", "dx", "dy")], F.min_by("x0", "band").alias("x0"), F.min_by("y0", "band").alias("y0"), F.first("nodata").alias("nodata"))
    return one.withColumns({"x1": F.col("x0") + F.col("width") * F.col("dx"), "y1": F.col("y0") + F.col("height") * F.col("dy")})


def read(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None, band_rows: int = 512) -> DataFrame:
    """``r, c, v`` of a half-open window (the whole grid without one); missing values are null. Bands outside the window are
    not read: their folders say so."""
    ship(spark)
    low, high = rows or (0, 1 << 62)
    left, right = cols or (0, 1 << 62)
    found = files(spark, path).filter((F.col("band") < high) & (F.col("band") > low - band_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for band, raw in zip(batch.column("band").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                h = header(raw)
                end = min(h.height, high - band)
                # some rows at a time, so that a band is never held as pixels
                for first in range(max(0, low - band), end, max(1, 1_000_000 // h.width)):
                    part = h.rows(raw, first, min(end, first + max(1, 1_000_000 // h.width)))[:, left : min(h.width, right)]
                    values = part.astype(float)
                    if h.nodata is not None:
                        values[part == h.nodata] = np.nan
                    r, c = np.indices(part.shape)
                    yield pa.RecordBatch.from_arrays([pa.array((r + band + first).ravel()), pa.array((c + left).ravel()), pa.array(values.ravel(), from_pandas=True)], names=["r", "c", "v"])

    return found.mapInArrow(run, "r long, c long, v double")
