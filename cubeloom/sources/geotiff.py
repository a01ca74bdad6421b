"""Raster files as a Spark data source, ``geotiff``: a folder (or one file) of rasters as ``file, layer, yr, r, c, v``.

Reading plans partitions of a few blocks each. Filters on layer, year and file choose files by their names; filters on r and c
choose blocks by the directory of a file; a task reads the bytes of its blocks and no others, through the file system that
the path names. Missing values are null.

Writing takes pixels of any number of files. Blocks are encoded where their pixels meet (a group is one block), written to
the shared folder, and joined with the sizes of all blocks of their file, whose sums are the offsets. One task then streams a
file's blocks to a temporary name. Names become final in one commit of all files; where a task fails, none does.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from cubeloom.session import ship, stored
from cubeloom.sources import blocks

PIXELS = "file string, layer string, yr int, r long, c long, v double"
#: Names of layers by year, static layers, and predictions by year and quantile.
NAMES = [r"HM_(?P<yr>[0-9]{4})_(?P<layer>.+)_1000\.tiff?", r"hm_static_(?P<layer>.+)_1000\.tiff?", r"prediction_(?P<yr>[0-9]{4})_(?P<layer>[^_]+)_blended\.tiff?"]
COMPRESSIONS = {"none": blocks.NONE, "lzw": blocks.LZW, "deflate": blocks.DEFLATE}
EVERY = (0, 1 << 62)
#: Pixels of the blocks that one task reads, unless their number is given.
TASK_PIXELS = 1 << 18


def system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def named(file: str) -> tuple[str | None, int | None]:
    """Layer and year of a file's name."""
    for pattern in NAMES:
        m = re.fullmatch(pattern, file)
        if m:
            year = m.groupdict().get("yr")
            return m["layer"], None if year is None else int(year)
    return None, None


@dataclass
class Blocks(InputPartition):
    path: str
    header: blocks.Header
    numbers: list[int]


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("blocks", "0"))
        self.window = {"r": EVERY, "c": EVERY}
        self.chosen: list[tuple[str, set]] = []
        self.years = EVERY

    def _narrow(self, window: tuple[int, int], f: Filter) -> tuple[int, int]:
        low, high = window
        v = f.value
        if isinstance(f, EqualTo):
            return max(low, v), min(high, v + 1)
        if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            return max(low, v + isinstance(f, GreaterThan)), high
        return low, min(high, v + isinstance(f, LessThanOrEqual))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            ranged = isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and isinstance(f.value, int)
            if column in ("r", "c") and ranged:
                self.window[column] = self._narrow(self.window[column], f)
            elif column == "yr" and ranged:
                self.years = self._narrow(self.years, f)
            elif column in ("file", "layer", "yr") and isinstance(f, (EqualTo, In)):
                self.chosen.append((column, {f.value} if isinstance(f, EqualTo) else set(f.value)))
            elif not (isinstance(f, IsNotNull) and column in ("r", "c", "file")):
                yield f

    def _taken(self, file: str) -> bool:
        layer, year = named(file)
        values = {"file": file, "layer": layer, "yr": year}
        in_years = self.years == EVERY or year is not None and self.years[0] <= year < self.years[1]
        return in_years and all(values[column] in some for column, some in self.chosen)

    def partitions(self) -> list[InputPartition]:
        files, path = system(self.path)
        info = files.get_file_info(path)
        paths = [path] if info.is_file else [x.path for x in files.get_file_info(fs.FileSelector(path)) if x.is_file and re.search(r"\.tiff?$", x.path, re.I)]
        out: list[InputPartition] = []
        for p in sorted(p for p in paths if self._taken(p.rsplit("/", 1)[-1])):
            with files.open_input_file(p) as f:
                h = blocks.header(lambda at, size, f=f: f.read_at(size, at))
            numbers = h.meeting(self.window["r"], self.window["c"])
            most = self.most or max(1, TASK_PIXELS // (h.block[0] * h.block[1]))
            for i in range(0, len(numbers), most):
                part = numbers[i : i + most]
                # a partition carries the offsets of its own blocks only
                offsets, sizes = ({k: x[k] for k in part} for x in (h.offsets, h.sizes))
                out.append(Blocks(p, blocks.Header(**{**h.__dict__, "offsets": offsets, "sizes": sizes}), part))
        return out

    def read(self, partition: Blocks | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no block meets the filters
            return
        files, _ = system(self.path)
        h, (r_low, r_high), (c_low, c_high) = partition.header, self.window["r"], self.window["c"]
        file = partition.path.rsplit("/", 1)[-1]
        layer, year = named(file)
        with files.open_input_file(partition.path) as f:
            for k in partition.numbers:
                r0, c0 = h.place(k)
                part = h.pixels(k, lambda at, size: f.read_at(size, at))
                top, left = max(0, r_low - r0), max(0, c_low - c0)
                part = part[top : max(top, r_high - r0), left : max(left, c_high - c0)]
                n, values = part.size, part.astype(float)
                if h.nodata is not None:
                    values[part == h.nodata] = np.nan
                r, c = np.indices(part.shape)
                columns = [pa.array([file] * n), pa.array([layer] * n, pa.string()), pa.array([year] * n, pa.int32()), pa.array((r + r0 + top).ravel()), pa.array((c + c0 + left).ravel()), pa.array(values.ravel(), from_pandas=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "layer", "yr", "r", "c", "v"])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class Writer(DataSourceArrowWriter):
    """Rows ``file, k, raw, sizes``, each file's together and in order; the first of a file has the sizes of all its blocks."""

    def __init__(self, options: dict):
        self.path, self.run = options["path"], options["run"]
        kind, size = np.dtype(options["dtype"]), int(options["block"])
        number = lambda name: (float(options[name + "x"]), float(options[name + "y"]))
        nodata = options.get("nodata")
        self.header = blocks.Header(int(options["columns"]), int(options["rows"]), kind, (size, size), True, (), (), COMPRESSIONS[options["compression"]], int(options["predictor"]), number("scale"), number("origin"), None if nodata is None else float(nodata))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, path = system(self.path)
        done: list[tuple[str, str]] = []
        name, out, tail = None, None, b""

        def close() -> None:
            if out is not None:
                out.write(tail)
                out.close()

        try:
            for batch in iterator:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]  # a batch's blocks are not copied all at once
                    if row["file"] != name:
                        close()
                        name = row["file"]
                        files.create_dir(f"{path}/_temporary", recursive=True)
                        done.append((f"{path}/_temporary/{self.run}-{uuid.uuid4().hex}-{name}", f"{path}/{name}"))
                        sizes = [0] * (self.header.across * -(-self.header.height // self.header.block[0]))
                        for x in row["sizes"]:
                            sizes[x["k"]] = x["size"]
                        head, tail = blocks.framed(self.header, sizes)
                        out = files.open_output_stream(done[-1][0])
                        out.write(head)
                    out.write(row["raw"])
            close()
        except BaseException:
            if out is not None and not out.closed:
                out.close()
            for temporary, _ in done:
                files.delete_file(temporary)
            raise
        return Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, _ = system(self.path)
        for m in messages:
            for temporary, final in m.files if m else ():
                files.move(temporary, final)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, _ = system(self.path)
        for m in messages:
            for temporary, _ in m.files if m else ():
                files.delete_file(temporary)


class GeoTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return PIXELS

    def reader(self, schema) -> DataSourceReader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoTiff)
    return spark


def read(spark: SparkSession, path: str, blocks_a_task: int = 0) -> DataFrame:
    """``file, layer, yr, r, c, v`` of every raster of a folder, or of one file; 0 blocks a task: as many as ``TASK_PIXELS`` hold."""
    return register(spark).read.format("geotiff").option("blocks", blocks_a_task).load(path)


def write(pixels: DataFrame, path: str, height: int, width: int, dtype: str = "f4", compression: str = "deflate", predictor: int = 1, block: int = 512, scale: tuple[float, float] = (1.0, -1.0), origin: tuple[float, float] = (0.0, 0.0), nodata: float | None = None) -> None:
    """Write ``file, r, c, v``. Pixels that are not there, or null, get ``nodata`` (else 0); blocks without any pixel are not
    stored. Blocks are squares of ``block`` (a multiple of 16); ``predictor`` 2 stores differences of whole numbers."""
    if block % 16 or compression not in COMPRESSIONS or predictor not in (1, 2):
        raise ValueError("blocks are multiples of 16, compressed by none, lzw or deflate, with predictor 1 or 2")
    kind, how, across = np.dtype(dtype), COMPRESSIONS[compression], -(-width // block)
    spark = register(pixels.sparkSession)

    def encode(table: pa.Table) -> pa.Table:
        some = table.filter(pa.compute.is_valid(table.column("v")))
        r, c, v = (some.column(x).to_numpy() for x in ("r", "c", "v"))
        image = np.full((block, block), 0 if nodata is None else nodata).astype(kind)
        image[r.astype(int) % block, c.astype(int) % block] = v
        raw = blocks.compressed(image, how, predictor)
        return pa.table([table.column("file")[:1], table.column("k")[:1], pa.array([raw], pa.binary()), pa.array([len(raw)], pa.int64())], names=["file", "k", "raw", "size"])

    k = F.expr(f"cast((r div {block}) * {across} + c div {block} as long)").alias("k")
    inside = pixels.filter((F.col("r") >= 0) & (F.col("r") < height) & (F.col("c") >= 0) & (F.col("c") < width))
    found = stored(inside.select("file", k, "r", "c", "v").groupBy("file", "k").applyInArrow(encode, "file string, k long, raw binary, size long"))
    # no more than the blocks of one file, beside its first block alone
    sizes = found.groupBy("file").agg(F.min("k").alias("k"), F.collect_list(F.struct("k", "size")).alias("sizes"))
    rows = found.drop("size").join(sizes, ["file", "k"], "left").repartition("file").sortWithinPartitions("file", "k")
    options = {"run": uuid.uuid4().hex, "rows": height, "columns": width, "dtype": dtype, "block": block, "compression": compression, "predictor": predictor, "scalex": scale[0], "scaley": scale[1], "originx": origin[0], "originy": origin[1]}
    if nodata is not None:
        options["nodata"] = nodata
    rows.select("file", "k", "raw", "sizes").write.format("geotiff").options(**options).mode("append").save(path)
