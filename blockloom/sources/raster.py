"""Rasters as frames of cells: from array columns, from dense keys, from GeoTIFF files; and a PNG sink."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Raster:
    """Cells (x, y, v) of a grid with known extent."""

    cells: DataFrame
    width: int
    height: int


def from_arrays(rows: DataFrame, key: str, array: str, value, width: int) -> Raster:
    """Each row's array is a line of the grid; ``key`` counts lines from 0, ``value`` maps an element to its value."""
    cells = rows.select(F.col(key).cast("int").alias("y"), F.posexplode(array).alias("x", "e")).select("x", "y", value(F.col("e")).alias("v"))
    return Raster(cells, width, rows.count())


def from_key(rows: DataFrame, key: str, value: Column, width: int) -> Raster:
    """A dense key from 0 numbers the cells line by line; cells beyond the last full line are outside."""
    cells = rows.select((F.col(key) % width).cast("int").alias("x"), F.floor(F.col(key) / width).cast("int").alias("y"), value.alias("v"))
    return Raster(cells, width, rows.count() // width)


# ---- GeoTIFF

_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
_TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 273: "offsets", 277: "bands", 278: "strip_rows", 279: "sizes", 317: "predictor", 322: "tile_width", 323: "tile_height", 324: "offsets", 325: "sizes", 284: "planar", 339: "format"}


def _directory(data: bytes) -> tuple[str, dict[str, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack_from(f"{order}I", data, 4)[0]
    found = {}
    for i in range(struct.unpack_from(f"{order}H", data, at)[0]):
        tag, kind, n = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * i)
        if tag in _TAGS and kind in _TYPES:
            form = f"{order}{n}{_TYPES[kind]}"
            place = at + 10 + 12 * i
            if struct.calcsize(form) > 4:
                place = struct.unpack_from(f"{order}I", data, place)[0]
            found[_TAGS[tag]] = struct.unpack_from(form, data, place)
    return order, found


def _unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def _unpack_lzw(data: bytes) -> bytes:
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    words, out, width, before = list(table), bytearray(), 9, b""
    bits = held = 0
    for byte in data:
        bits, held = bits << 8 | byte, held + 8
        while held >= width:
            held -= width
            code = bits >> held
            bits &= (1 << held) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                words, width, before = list(table), 9, b""
                continue
            word = words[code] if code < len(words) else before + before[:1]
            out += word
            if before:
                words.append(before + word[:1])
            before = word
            width = 9 if len(words) < 511 else 10 if len(words) < 1023 else 11 if len(words) < 2047 else 12
    return bytes(out)


_UNPACK = {1: bytes, 5: _unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _unpack_bits}


def read_tiff(data: bytes) -> np.ndarray:
    """The first band of a TIFF file, in its own type."""
    order, tags = _directory(data)
    one = lambda name, default: int(tags.get(name, (default,))[0])
    width, height, bits, bands = one("width", 0), one("height", 0), one("bits", 8), one("bands", 1)
    kind = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[one('format', 1)]}{bits // 8}")
    if one("compression", 1) not in _UNPACK:
        raise ValueError(f"TIFF compression {one('compression', 1)} is not supported")
    unpack, predictor = _UNPACK[one("compression", 1)], one("predictor", 1)
    if predictor not in (1, 2):
        raise ValueError(f"TIFF predictor {predictor} is not supported")
    if one("planar", 1) == 2:
        bands = 1
    w, h = (one("tile_width", width), one("tile_height", height)) if "tile_width" in tags else (width, one("strip_rows", height))
    out = np.zeros((height, width), kind.newbyteorder("="))
    across = -(-width // w)
    down = -(-height // h)
    for i, (at, size) in enumerate(zip(tags["offsets"], tags["sizes"], strict=True)):
        if i >= across * down:
            break  # further planes
        x, y = i % across * w, i // across * h
        rows = h if "tile_width" in tags else min(h, height - y)
        raw = np.frombuffer(unpack(data[at : at + size]), kind, count=rows * w * bands).reshape(rows, w, bands)
        if predictor == 2:
            raw = np.cumsum(raw, axis=1, dtype=raw.dtype)
        part = raw[: height - y, : width - x, 0]
        out[y : y + part.shape[0], x : x + part.shape[1]] = part
    return out


def geotiff_blocks(spark: SparkSession, path: str, size: int) -> DataFrame:
    """Blocks of the files' first bands: raster, width, height, block_x, block_y (in blocks), w, h, value array (doubles).

    Partial blocks at the right and lower edges have w or h below ``size``. Each file is decoded once, in one task.
    """

    def decode(frames: Iterator) -> Iterator:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                grid = read_tiff(data)
                rows = []
                for y in range(0, grid.shape[0], size):
                    for x in range(0, grid.shape[1], size):
                        part = grid[y : y + size, x : x + size]
                        rows.append((name, grid.shape[1], grid.shape[0], x // size, y // size, part.shape[1], part.shape[0], part.astype(float).ravel().tolist()))
                yield type(frame)(rows, columns=["raster", "width", "height", "block_x", "block_y", "w", "h", "values"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(decode, "raster string, width int, height int, block_x int, block_y int, w int, h int, values array<double>")


def geotiff_cells(spark: SparkSession, path: str, size: int = 256) -> DataFrame:
    """Cells (raster, x, y, value) of the files' first bands."""
    one = geotiff_blocks(spark, path, size).select("raster", "block_x", "block_y", "w", F.posexplode("values").alias("i", "value"))
    return one.select("raster", (F.col("block_x") * size + F.col("i") % F.col("w")).alias("x"), (F.col("block_y") * size + F.floor(F.col("i") / F.col("w"))).cast("int").alias("y"), "value")


def write_tiff(grid: np.ndarray, deflate: bool = False, rows: int = 16) -> bytes:
    """A little-endian single-band TIFF file in strips."""
    grid = np.ascontiguousarray(grid)
    strips = [grid[y : y + rows].astype(grid.dtype.newbyteorder("<")).tobytes() for y in range(0, len(grid), rows)]
    strips = [zlib.compress(s) if deflate else s for s in strips]
    body, places = b"", []
    for s in strips:
        places.append(8 + len(body))
        body += s
    form = {"u": 1, "i": 2, "f": 3}[grid.dtype.kind]
    n = len(strips)
    entries = [(256, 4, 1, grid.shape[1]), (257, 4, 1, grid.shape[0]), (258, 3, 1, 8 * grid.dtype.itemsize), (259, 3, 1, 8 if deflate else 1), (262, 3, 1, 1)]
    at = 8 + len(body)
    extra = b""
    where = []
    for values in (places, [len(s) for s in strips]):
        where.append(values[0] if n == 1 else at + len(extra))
        extra += b"" if n == 1 else struct.pack(f"<{n}I", *values)
    entries += [(273, 4, n, where[0]), (277, 3, 1, 1), (278, 4, 1, rows), (279, 4, n, where[1]), (339, 3, 1, form)]
    directory = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in sorted(entries)) + struct.pack("<I", 0)
    return b"II*\0" + struct.pack("<I", at + len(extra)) + body + extra + directory


def to_png(grid: np.ndarray) -> bytes:
    """A grey PNG image of a grid of integers, 8 bits deep if they fit, else 16."""
    if grid.min() < 0 or grid.max() > 65535:
        raise ValueError("values must be between 0 and 65535")
    kind, depth = (">u1", 8) if grid.max() < 256 else (">u2", 16)
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    lines = b"".join(b"\0" + line.astype(kind).tobytes() for line in grid)
    head = struct.pack(">IIBBBBB", grid.shape[1], grid.shape[0], depth, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def png_images(spark: SparkSession, path: str) -> DataFrame:
    """The files at ``path`` as images: raster, png."""

    def convert(frames: Iterator) -> Iterator:
        for frame in frames:
            yield type(frame)({"raster": frame["path"], "png": [to_png(read_tiff(d)) for d in frame["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(convert, "raster string, png binary")
