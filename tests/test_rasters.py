"""Compressed, tiled rasters: codecs, the data source's reader and its committed writer."""

from __future__ import annotations

import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeloom.sources import blocks, geotiff


def packed(codes: list[int]) -> bytes:
    """Codes of nine bits each, the highest bit first."""
    bits = "".join(f"{c:09b}" for c in codes)
    return bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))


def test_lzw():
    # made by hand: 258 is "7 7", 259 "7 7 8", 258 again, and 263 is defined by the code that uses it
    assert blocks.lzw_decoded(packed([256, 7, 258, 8, 8, 258, 6, 6, 257])) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert blocks.lzw_encoded(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == packed([256, 7, 258, 8, 8, 258, 6, 6, 257])
    rng = np.random.default_rng(2)
    for n in (*range(0, 6), 253, 254, 255, 256, 257, 511, 1021, 4000, 40_000):
        for high in (1, 2, 256):
            raw = rng.integers(0, high, n).astype(np.uint8).tobytes()
            assert blocks.lzw_decoded(blocks.lzw_encoded(raw)) == raw
    for n in range(700, 1100):  # every place where codes get wider
        raw = rng.integers(0, 256, n).astype(np.uint8).tobytes()
        assert blocks.lzw_decoded(blocks.lzw_encoded(raw)) == raw
    with pytest.raises(ValueError):
        blocks.lzw_decoded(packed([256, 7, 400, 257]))


def pixels(spark, image, file="HM_2000_AA_1000.tiff"):
    rows = [(file, r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(image)]
    return spark.createDataFrame(rows, "file string, r long, c long, v double")


@pytest.mark.parametrize(("dtype", "compression", "predictor"), [("u1", "lzw", 1), ("i2", "lzw", 2), ("u2", "deflate", 2), ("f4", "deflate", 1), ("f8", "none", 1)])
def test_round_trip(spark, tmp_path, dtype, compression, predictor):
    rng = np.random.default_rng(3)
    image = rng.integers(0, 200, (70, 45)).astype(float)
    image[3, 4] = np.nan
    image[48:64, 16:32] = np.nan  # a block that is not stored
    path = str(tmp_path / "a")
    geotiff.write(pixels(spark, image).dropna(), path, 70, 45, dtype, compression, predictor, 16, (0.5, -0.25), (-180.0, 90.0), 255)
    got = geotiff.read(spark, path, 3)
    values = {(r["r"], r["c"]): r["v"] for r in got.collect()}
    assert values == {(r, c): None if np.isnan(v) else v for (r, c), v in np.ndenumerate(image)}
    assert {(r["file"], r["layer"], r["yr"]) for r in got.select("file", "layer", "yr").distinct().collect()} == {("HM_2000_AA_1000.tiff", "AA", 2000)}
    with open(f"{path}/HM_2000_AA_1000.tiff", "rb") as f:
        h = blocks.header(lambda at, size: (f.seek(at), f.read(size))[1])
    assert (h.width, h.height, h.block, h.scale, h.origin, h.nodata, h.dtype.str[1:]) == (45, 70, (16, 16), (0.5, -0.25), (-180.0, 90.0), 255.0, dtype)
    assert sum(n == 0 for n in h.sizes) == 1 and not [p for p in Path(path).rglob("*") if "_temporary/" in str(p)]


def test_a_window_reads_its_own_blocks(spark, tmp_path):
    """All other blocks are overwritten with bytes that can't be decoded."""
    image = np.arange(64 * 64).reshape(64, 64) % 251
    path = str(tmp_path / "a")
    geotiff.write(pixels(spark, image), path, 64, 64, "u1", "lzw", 1, 16)
    geotiff.write(pixels(spark, image, "HM_2005_AA_1000.tiff"), path, 64, 64, "u1", "lzw", 1, 16)
    file = Path(path) / "HM_2000_AA_1000.tiff"
    raw = bytearray(file.read_bytes())
    h = blocks.header(lambda at, size: bytes(raw[at : at + size]))
    wanted = set(h.meeting((20, 40), (10, 20)))
    assert wanted == {4, 5, 8, 9}
    for k in set(range(16)) - wanted:
        raw[h.offsets[k] : h.offsets[k] + h.sizes[k]] = b"\xff" * h.sizes[k]
    file.write_bytes(raw)
    (Path(path) / "HM_2005_AA_1000.tiff").write_bytes(b"not a raster")
    df = geotiff.read(spark, path)
    window = df.filter((F.col("r") >= 20) & (F.col("r") < 40) & (F.col("c") > 9) & (F.col("c") <= 19) & (F.col("yr") == 2000))
    assert {(r["r"], r["c"]): r["v"] for r in window.collect()} == {(r, c): float(image[r, c]) for r in range(20, 40) for c in range(10, 20)}
    assert df.filter("yr = 2000 and r = 21 and c between 12 and 13").count() == 2
    assert df.filter("yr < 1990").count() == 0 and df.filter("layer in ('BB', 'CC')").count() == 0
    assert df.filter("yr = 2000 and r = 70").count() == 0
    with pytest.raises(Exception, match="not a TIFF"):
        df.filter("yr = 2005").collect()


def test_strips_and_float_predictor():
    """Strips of another writer, big-endian; floats whose bytes are stored by weight as differences."""
    rng = np.random.default_rng(4)
    image = rng.normal(size=(10, 7)).astype(">f4")
    parts = [zlib.compress(image[i : i + 4].tobytes()) for i in (0, 4, 8)]
    at = np.cumsum([8, *map(len, parts)]).tolist()
    h = blocks.Header(7, 10, np.dtype(">f4"), (4, 7), False, tuple(at[:3]), tuple(map(len, parts)), blocks.DEFLATE, 1, (1.0, -1.0), (0.0, 0.0), None)
    body = bytes(8) + b"".join(parts)
    assert np.array_equal(np.concatenate([h.pixels(k, lambda a, n: body[a : a + n]) for k in range(3)]), image)
    planes = image.view(np.uint8).reshape(10, 7, 4).transpose(0, 2, 1).reshape(10, 28)
    stored = zlib.compress(np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1).astype(np.uint8).tobytes())
    h = blocks.Header(7, 10, np.dtype("<f4"), (10, 7), True, (5,), (len(stored),), blocks.DEFLATE, 3, (1.0, -1.0), (0.0, 0.0), None)
    assert np.array_equal(h.pixels(0, lambda a, n: stored), image)


def test_big_files():
    """A directory beyond 4 GB: blocks' places and sizes survive."""
    h = blocks.Header(2048, 1024, np.dtype("<f4"), (512, 512), True, (), (), blocks.NONE, 1, (1.0, -1.0), (3.0, 4.0), -1.0)
    sizes = [1 << 30, 0, 1 << 30, 5, 1 << 30, 1 << 30, 1 << 30, 7]
    head, tail = blocks.framed(h, sizes)
    end = len(head) + sum(sizes)
    got = blocks.header(lambda at, size: head[at : at + size] if at < len(head) else tail[at - end : at - end + size])
    assert head[:4] == b"II+\0" and list(got.sizes) == sizes and got.offsets[1] == 0 and got.offsets[2] == 16 + (1 << 30) and got.origin == (3.0, 4.0)


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "a")
    rows = spark.createDataFrame([("a.tif", 0, b"x" * 300, [(0, 300)]), ("b.tif", 0, None, [(0, 3)])], "file string, k long, raw binary, sizes array<struct<k:long,size:long>>")
    options = {"run": "x", "rows": 16, "columns": 16, "dtype": "u1", "block": 16, "compression": "none", "predictor": 1, "scalex": 1, "scaley": -1, "originx": 0, "originy": 0}
    with pytest.raises(Exception, match="(?i)abort|bytes|failed"):
        geotiff.register(spark)
        rows.repartition("file").write.format("geotiff").options(**options).mode("append").save(path)
    assert not [p for p in Path(path).rglob("*") if p.is_file()]
    with pytest.raises(ValueError):
        geotiff.write(pixels(spark, np.ones((2, 2))), path, 2, 2, block=10)


def test_sizes_stand_once_a_file(spark, tmp_path, monkeypatch):
    """A file's list of sizes goes with its first block, not with every block; a task reads many small blocks."""
    image = np.arange(160 * 64).reshape(160, 64) % 251
    path, kind = str(tmp_path / "a"), type(spark.range(1))
    sort, rows = kind.sortWithinPartitions, []
    monkeypatch.setattr(kind, "sortWithinPartitions", lambda df, *c: rows.append(df) or sort(df, *c))
    geotiff.write(pixels(spark, image), path, 160, 64, "u1", "lzw", 1, 16)
    assert sorted(len(r["sizes"] or ()) for r in rows[0].collect()) == [0] * 39 + [40]
    df = geotiff.read(spark, path)
    assert df.rdd.getNumPartitions() == 1 and geotiff.read(spark, path, 16).rdd.getNumPartitions() == 3
    assert {(r["r"], r["c"]): r["v"] for r in df.collect()} == {at: float(v) for at, v in np.ndenumerate(image)}
