"""Blocks of TIFF rasters: tiles or strips, uncompressed, LZW or deflate, with or without a predictor; classic and big files.

Everything is read by ranges of bytes, so that a block costs its own bytes and those of the file's directory.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: Tags of the TIFF format (fixed values).
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PREDICTOR, FORMAT = 256, 257, 258, 259, 262, 277, 317, 339
STRIP_OFFSETS, STRIP_ROWS, STRIP_SIZES, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES = 273, 278, 279, 322, 323, 324, 325
SCALE, TIE, NODATA = 33550, 33922, 42113
#: Types of tags, kinds of samples (bits and format) and numbers of compressions (fixed values).
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}
KINDS = {(8, 1): "u1", (16, 1): "u2", (32, 1): "u4", (16, 2): "i2", (32, 2): "i4", (32, 3): "f4", (64, 3): "f8"}
NONE, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
CLEAR, END, TOP = 256, 257, 4094
SINGLE = [bytes([i]) for i in range(256)]


def lzw_decoded(data: bytes) -> bytes:
    out, table, width, bits, held = [], [*SINGLE, b"", b""], 9, 0, 0
    before = b""
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == END:
            break
        if code == CLEAR:
            table, width, before = [*SINGLE, b"", b""], 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and before:
            entry = before + before[:1]
        else:
            raise ValueError("not an LZW stream")
        out.append(entry)
        if before:
            table.append(before + entry[:1])
            if len(table) == (1 << width) - 1 and width < 12:
                width += 1
        before = entry
    return b"".join(out)


def lzw_encoded(data: bytes) -> bytes:
    out, held, bits, width = bytearray(), 0, 0, 9

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    table: dict[tuple[int, int], int] = {}
    put(CLEAR)
    prefix, free = -1, 258
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        found = table.get((prefix, byte))
        if found is not None:
            prefix = found
            continue
        put(prefix)
        table[prefix, byte] = free
        free += 1
        if free == TOP:
            put(CLEAR)
            table, free, width = {}, 258, 9
        elif free == 1 << width:
            width += 1
        prefix = byte
    if prefix >= 0:
        put(prefix)
        if free + 1 == 1 << width and width < 12:  # the reader adds an entry for this code too
            width += 1
    put(END)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def compressed(values: np.ndarray, compression: int, predictor: int = 1) -> bytes:
    if predictor == 2:
        values = np.concatenate([values[:, :1], np.diff(values, axis=1)], axis=1)
    raw = values.astype(values.dtype.newbyteorder("<")).tobytes()
    return lzw_encoded(raw) if compression == LZW else zlib.compress(raw, 6) if compression == DEFLATE else raw


@dataclass
class Header:
    """What a file's first directory says."""

    width: int
    height: int
    dtype: np.dtype
    block: tuple[int, int]
    tiled: bool
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]
    compression: int
    predictor: int
    scale: tuple[float, float]
    origin: tuple[float, float]
    nodata: float | None

    @property
    def across(self) -> int:
        return -(-self.width // self.block[1])

    def meeting(self, rows: tuple[int, int], cols: tuple[int, int]) -> list[int]:
        """The blocks that meet a half-open window."""
        r, c = ((max(0, w[0]) // b, -(-min(n, w[1]) // b)) for w, b, n in zip((rows, cols), self.block, (self.height, self.width), strict=True))
        return [i * self.across + j for i in range(*r) for j in range(*c)]

    def place(self, k: int) -> tuple[int, int]:
        return k // self.across * self.block[0], k % self.across * self.block[1]

    def pixels(self, k: int, read: Callable[[int, int], bytes]) -> np.ndarray:
        """A block's pixels inside the raster; a block that was not written has the missing value (else 0)."""
        r0, c0 = self.place(k)
        h, w = self.block[0] if self.tiled else min(self.block[0], self.height - r0), self.block[1]
        if not self.offsets[k] or not self.sizes[k]:
            out = np.full((h, w), self.nodata or 0).astype(self.dtype)
        else:
            raw = read(self.offsets[k], self.sizes[k])
            raw = lzw_decoded(raw) if self.compression == LZW else zlib.decompress(raw) if self.compression in (DEFLATE, OLD_DEFLATE) else raw
            if self.predictor == 3:
                # bytes of equal weight stand together, the highest first, as differences
                planes = np.cumsum(np.frombuffer(raw, np.uint8, h * w * self.dtype.itemsize).reshape(h, -1), axis=1, dtype=np.uint8)
                out = planes.reshape(h, self.dtype.itemsize, w).transpose(0, 2, 1).copy().view(self.dtype.newbyteorder(">"))[:, :, 0]
            else:
                out = np.frombuffer(raw, self.dtype, h * w).reshape(h, w)
                if self.predictor == 2:
                    out = np.cumsum(out, axis=1, dtype=self.dtype.newbyteorder("="))
        return out[: self.height - r0, : self.width - c0]


def header(read: Callable[[int, int], bytes]) -> Header:
    """``read(offset, size)`` gives bytes of the file."""
    first = read(0, 16)
    if first[:4] not in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+"):
        raise ValueError("not a TIFF file")
    e, big = "<" if first[:2] == b"II" else ">", b"+" in first[2:4]
    (at,) = struct.unpack_from(e + ("Q" if big else "I"), first, 8 if big else 4)
    count_form, entry_form, inline = ("Q", "HHQ", 8) if big else ("H", "HHI", 4)
    (count,) = struct.unpack(e + count_form, read(at, struct.calcsize(e + count_form)))
    size = struct.calcsize(e + entry_form) + inline
    raw, tags = read(at + struct.calcsize(e + count_form), count * size), {}
    for k in range(count):
        tag, kind, n = struct.unpack_from(e + entry_form, raw, k * size)
        if kind not in TYPES:
            continue
        form, value = f"{e}{n}{TYPES[kind]}", raw[(k + 1) * size - inline : (k + 1) * size]
        if struct.calcsize(form) > inline:
            value = read(struct.unpack(e + ("Q" if big else "I"), value)[0], struct.calcsize(form))
        tags[tag] = struct.unpack_from(form, value)
    compression, tiled = tags.get(COMPRESSION, (1,))[0], TILE_OFFSETS in tags
    if compression not in (NONE, LZW, DEFLATE, OLD_DEFLATE) or tags.get(SAMPLES, (1,))[0] != 1 or not tiled and STRIP_OFFSETS not in tags:
        raise ValueError("only rasters of one sample are read, plain, LZW or deflate")
    width, height = tags[WIDTH][0], tags[HEIGHT][0]
    block = (tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0]) if tiled else (min(height, tags.get(STRIP_ROWS, (height,))[0]), width)
    dtype = np.dtype(KINDS[tags.get(BITS, (8,))[0], tags.get(FORMAT, (1,))[0]]).newbyteorder(e)
    offsets = tags[TILE_OFFSETS if tiled else STRIP_OFFSETS]
    plain = (block[0] * block[1] * dtype.itemsize,) * len(offsets)
    scale, tie = tags.get(SCALE, (1.0, 1.0, 0.0)), tags.get(TIE, (0.0,) * 6)
    missing = tags[NODATA][0].rstrip(b"\0 ").decode() if NODATA in tags else None
    return Header(width, height, dtype, block, tiled, offsets, tags.get(TILE_SIZES if tiled else STRIP_SIZES, plain), compression, tags.get(PREDICTOR, (1,))[0], (scale[0], -scale[1]), (tie[3], tie[4]), float(missing) if missing else None)


def framed(h: Header, sizes: list[int]) -> tuple[bytes, bytes]:
    """What stands before and after the blocks of a tiled file, which follow each other in order; a size of 0 is a block that
    is not written. Files beyond 4 GB are big ones."""
    total = sum(sizes)
    big = total + 40 * len(sizes) > 0xFFFF0000
    start = 16 if big else 8
    offsets, at = [], start
    for n in sizes:
        offsets.append(at if n else 0)
        at += n
    pad = at % 2
    at += pad
    bits, form = {v: k for k, v in KINDS.items()}[h.dtype.str[1:]]
    wide = "Q" if big else "I"
    entries = [(WIDTH, "I", (h.width,)), (HEIGHT, "I", (h.height,)), (BITS, "H", (bits,)), (COMPRESSION, "H", (h.compression,)), (PHOTOMETRIC, "H", (1,)), (SAMPLES, "H", (1,)), (PREDICTOR, "H", (h.predictor,)), (TILE_WIDTH, "I", (h.block[1],)), (TILE_HEIGHT, "I", (h.block[0],)), (TILE_OFFSETS, wide, offsets), (TILE_SIZES, wide, sizes), (FORMAT, "H", (form,))]
    entries += [(SCALE, "d", (h.scale[0], -h.scale[1], 0.0)), (TIE, "d", (0.0, 0.0, 0.0, *h.origin, 0.0))]
    if h.nodata is not None:
        entries.append((NODATA, "s", (f"{h.nodata:g}".encode() + b"\0",)))
    inline, entry = (8, "<HHQ") if big else (4, "<HHI")
    directory, more = struct.pack("<Q" if big else "<H", len(entries)), b""
    after = at + len(directory) + len(entries) * (struct.calcsize(entry) + inline) + inline
    for tag, kind, items in entries:
        n = len(items[0]) if kind == "s" else len(items)
        raw = items[0] if kind == "s" else struct.pack(f"<{n}{kind}", *items)
        if len(raw) > inline:
            value = struct.pack("<" + wide, after + len(more))
            more += raw + b"\0" * (len(raw) % 2)
        else:
            value = raw.ljust(inline, b"\0")
        directory += struct.pack(entry, tag, {v: k for k, v in TYPES.items()}[kind], n) + value
    head = b"II+\0" + struct.pack("<HHQ", 8, 0, at) if big else b"II*\0" + struct.pack("<I", at)
    return head, b"\0" * pad + directory + bytes(inline) + more
