"""A plain GeoTIFF codec: one image, striped or tiled, uncompressed, LZW (reading) or deflate, with its grid and band names.

Only what rasters of this engine need; other compressions raise.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed numbers of the file format: field type -> (size, struct code), and (sample format, bits) -> dtype.
_TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
_DTYPES = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _PHOTOMETRIC, _OFFSETS, _SAMPLES, _ROWS, _COUNTS, _PLANAR, _PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
_TILE_W, _TILE_H, _TILE_OFFSETS, _TILE_COUNTS, _FORMAT, _SCALE, _TIE, _META, _NODATA = 322, 323, 324, 325, 339, 33550, 33922, 42112, 42113


def unpack_lzw(data: bytes) -> bytes:
    """The bytes of a block in the format's variable-length codes, most significant bit first: 256 clears the table, 257 ends."""
    out = bytearray()
    table: list[bytes] = []
    width, held, n_held, last = 9, 0, 0, b""
    for byte in data:
        held, n_held = held << 8 | byte, n_held + 8
        if n_held < width:
            continue
        n_held -= width
        code, held = held >> n_held, held & ((1 << n_held) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not table:
            raise ValueError("a block that doesn't begin with a clear code")
        if code < len(table):
            entry = table[code]
        elif last and code == len(table):
            entry = last + last[:1]
        else:
            raise ValueError("a code beyond the table")
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        # codes grow one entry before the table is full
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def decode(data: bytes) -> tuple[np.ndarray, dict]:
    """(bands x height x width, {'scale', 'origin', 'nodata', 'tags'}) of a file's first image."""
    end = {b"II": "<", b"MM": ">"}.get(data[:2])
    if end is None or struct.unpack(end + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(end + "I", data[4:8])[0]
    tags: dict[int, tuple] = {}
    for i in range(struct.unpack(end + "H", data[at : at + 2])[0]):
        tag, kind, n, raw = struct.unpack(end + "HHI4s", data[at + 2 + 12 * i : at + 14 + 12 * i])
        if kind not in _TYPES:
            continue
        size, code = _TYPES[kind]
        if size * n > 4:
            place = struct.unpack(end + "I", raw)[0]
            raw = data[place : place + size * n]
        tags[tag] = (raw[:n].rstrip(b"\0").decode("utf-8", "replace"),) if code == "s" else struct.unpack(end + code * n, raw[: size * n])
    w, h, n = tags[_WIDTH][0], tags[_HEIGHT][0], tags.get(_SAMPLES, (1,))[0]
    dtype = np.dtype(_DTYPES[tags.get(_FORMAT, (1,))[0], tags.get(_BITS, (1,))[0]]).newbyteorder(end)
    planar, compression, predictor = tags.get(_PLANAR, (1,))[0], tags.get(_COMPRESSION, (1,))[0], tags.get(_PREDICTOR, (1,))[0]
    if compression not in (1, 5, 8, 32946) or predictor not in (1, 2):
        raise ValueError(f"compression {compression} with predictor {predictor} is not supported")
    tiled = _TILE_W in tags
    bw, bh = (tags[_TILE_W][0], tags[_TILE_H][0]) if tiled else (w, min(h, tags.get(_ROWS, (h,))[0]))
    offsets, counts = (tags[_TILE_OFFSETS], tags[_TILE_COUNTS]) if tiled else (tags[_OFFSETS], tags[_COUNTS])
    across, down = -(-w // bw), -(-h // bh)
    out = np.zeros((n, h, w), dtype.newbyteorder("="))
    for k, (o, c) in enumerate(zip(offsets, counts)):
        block = data[o : o + c]
        if compression != 1:
            block = unpack_lzw(block) if compression == 5 else zlib.decompress(block)
        plane, cell = divmod(k, across * down) if planar == 2 else (None, k)
        y, x = cell // across * bh, cell % across * bw
        rows = bh if tiled else min(bh, h - y)
        a = np.frombuffer(block, dtype)[: rows * bw * (1 if planar == 2 else n)].reshape(rows, bw, 1 if planar == 2 else n)
        if predictor == 2:
            a = np.cumsum(a, axis=1, dtype=a.dtype.newbyteorder("="))
        a = a[: h - y, : w - x]
        if planar == 2:
            out[plane, y : y + a.shape[0], x : x + a.shape[1]] = a[:, :, 0]
        else:
            out[:, y : y + a.shape[0], x : x + a.shape[1]] = np.moveaxis(a, 2, 0)
    nodata = tags.get(_NODATA, (None,))[0]
    tie = tags.get(_TIE)
    meta = {"scale": tags.get(_SCALE, (1.0, 1.0))[:2], "origin": (tie[3], tie[4]) if tie else (0.0, 0.0), "nodata": float(nodata) if nodata else None, "tags": {}}
    try:
        meta["tags"] = json.loads(tags.get(_META, ("{}",))[0])
    except ValueError:
        pass
    return out, meta


def encode(bands: np.ndarray, *, scale: float = 1.0, origin: tuple[float, float] = (0.0, 0.0), nodata: float | None = None, tags: dict | None = None, rows_per_strip: int = 512, tile: int | None = None) -> bytes:
    """A little-endian, band-sequential, deflate-compressed file of bands x height x width, in strips or in square tiles of ``tile`` pixels, a multiple of 16."""
    n, h, w = bands.shape
    if tile is not None and (tile < 16 or tile % 16):
        raise ValueError("tiles must be a multiple of 16 pixels")
    kinds = {"u": 1, "i": 2, "f": 3}
    a = bands.astype(bands.dtype.newbyteorder("<"))
    if tile is None:
        strips = [zlib.compress(a[b, y : y + rows_per_strip].tobytes()) for b in range(n) for y in range(0, h, rows_per_strip)]
    else:
        full = np.zeros((n, -(-h // tile) * tile, -(-w // tile) * tile), a.dtype)
        full[:, :h, :w] = a
        strips = [zlib.compress(full[b, y : y + tile, x : x + tile].tobytes()) for b in range(n) for y in range(0, h, tile) for x in range(0, w, tile)]
    entries: list[tuple[int, int, int, bytes]] = []
    put = lambda tag, kind, *v: entries.append((tag, kind, len(v), struct.pack("<" + _TYPES[kind][1] * len(v), *v)))
    text = lambda tag, s: entries.append((tag, 2, len(s.encode()) + 1, s.encode() + b"\0"))
    put(_WIDTH, 4, w)
    put(_HEIGHT, 4, h)
    put(_BITS, 3, *[a.dtype.itemsize * 8] * n)
    put(_COMPRESSION, 3, 8)
    put(_PHOTOMETRIC, 3, 1)
    put(_SAMPLES, 3, n)
    if tile is None:
        put(_ROWS, 4, rows_per_strip)
    else:
        put(_TILE_W, 4, tile)
        put(_TILE_H, 4, tile)
    put(_PLANAR, 3, 2)
    put(_FORMAT, 3, *[kinds[a.dtype.kind]] * n)
    put(_SCALE, 12, scale, scale, 0.0)
    put(_TIE, 12, 0.0, 0.0, 0.0, origin[0], origin[1], 0.0)
    text(_META, json.dumps(tags or {}))
    if nodata is not None:
        text(_NODATA, repr(float(nodata)))
    put(_COUNTS if tile is None else _TILE_COUNTS, 4, *map(len, strips))
    head = 8 + 2 + 12 * (len(entries) + 1) + 4
    extra = sum(len(v) + len(v) % 2 for *_, v in entries if len(v) > 4) + (4 * len(strips) if len(strips) > 1 else 0)
    first, offsets = head + extra, []
    for s in strips:
        offsets.append(first)
        first += len(s)
    put(_OFFSETS if tile is None else _TILE_OFFSETS, 4, *offsets)
    entries.sort()
    body, tail, place = b"", b"", head
    for tag, kind, count, v in entries:
        if len(v) > 4:
            body += struct.pack("<HHII", tag, kind, count, place + len(tail))
            tail += v + b"\0" * (len(v) % 2)
        else:
            body += struct.pack("<HHI", tag, kind, count) + v.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(entries)) + body + b"\0\0\0\0" + tail + b"".join(strips)


def read_pixels(spark: SparkSession, folder: str, *, bands: list[str] | None = None) -> DataFrame:
    """(path, band, y, x, value) of all .tif and .tiff files below a folder. Band names come from the file's tags, else b1, b2, ...

    Nodata and NaN are null. Asking for a band a file does not have leaves that file without rows of it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                a, meta = decode(content)
                names = meta["tags"].get("bands") or [f"b{i + 1}" for i in range(len(a))]
                for name, band in zip(names, a):
                    if bands is not None and name not in bands:
                        continue
                    y, x = np.indices(band.shape)
                    v = pd.Series(band.astype(float).ravel())
                    if meta["nodata"] is not None:
                        v = v.where(v != meta["nodata"])
                    yield pd.DataFrame({"path": path, "band": name, "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32"), "value": v.astype("Float64").where(v.notna(), None)})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{tif,tiff}").load(folder)
    return files.select("path", "content").mapInPandas(run, "path string, band string, y int, x int, value double")


def write_rasters(pixels: DataFrame, folder: str, *, key: str, height: int, width: int, dtype: str = "float32", scale: float = 10.0, tile: int | None = None, step: str | None = None) -> DataFrame:
    """One file per key of (key, band, y, x, value) pixels, bands in name order; returns (key, file). The folder is shared.

    With ``step``, a time column, there is one file per key and time, named KEY_yyyyMMdd with the time of day if there is
    one; ``tile`` writes square tiles. A task holds one raster at a time. Missing pixels and nulls are NaN for floats, 0 for integers.
    """
    import os

    os.makedirs(folder, exist_ok=True)
    fill = np.nan if dtype.startswith("float") else 0

    def put(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(pdf["band"].unique())
        a = np.full((len(names), height, width), fill, dtype)
        ok = pdf[pdf["value"].notna()]
        a[ok["band"].map({n: i for i, n in enumerate(names)}), ok["y"], ok["x"]] = ok["value"]
        name = str(pdf["_name"].iloc[0])
        path = os.path.join(folder, f"{name}.tif")
        with open(path + ".part", "wb") as f:
            f.write(encode(a, scale=scale, nodata=None if fill == 0 else float("nan"), tags={"bands": names}, tile=tile))
        os.replace(path + ".part", path)
        return pd.DataFrame({"key": [name], "file": [path]})

    ok = pixels.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1) & F.col("band").isNotNull())
    name = F.col(key).cast("string")
    if step is not None:
        day = F.date_format(step, "yyyyMMdd")
        when = F.when(F.date_format(step, "HHmmss") == "000000", day).otherwise(F.concat(day, F.lit("T"), F.date_format(step, "HHmmss")))
        name = F.concat_ws("_", name, when)
    return ok.withColumn("_name", name).select("_name", "band", "y", "x", "value").groupBy("_name").applyInPandas(put, "key string, file string")
