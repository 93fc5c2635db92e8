"""Reading and writing chunked arrays in the Zarr version 3 layout, one chunk file to a row.

Supports regular chunk grids, the default and v2 chunk key encodings, little- and big-endian numbers, and the bytes,
zstd and gzip codecs. A store's metadata is read once on the driver; chunks are listed, read and decoded by executors.
"""

from __future__ import annotations

import gzip
import itertools
import json
import math
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Side of the chunks that are written; time is never split.
DISK_CHUNK = 512

_CHUNKS = "path string, variable string, chunk string, origin array<int>, shape array<int>, values array<double>"


def array_metadata(folder: str) -> dict:
    with open(os.path.join(folder, "zarr.json"), encoding="utf-8") as f:
        meta = json.load(f)
    if meta.get("zarr_format") != 3 or meta.get("node_type") != "array":
        raise ValueError(f"{folder} is not an array of Zarr version 3")
    return meta


def variables(store: str) -> list[str]:
    """Arrays below a store's folder, as relative paths in order."""
    found = []
    for at, _, names in os.walk(store):
        if "zarr.json" in names:
            with open(os.path.join(at, "zarr.json"), encoding="utf-8") as f:
                if json.load(f).get("node_type") == "array":
                    found.append(os.path.relpath(at, store))
    return sorted(found)


def attributes(store: str) -> dict:
    path = os.path.join(store, "zarr.json")
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return json.load(f).get("attributes", {})


def _decode(data: bytes, codecs: list[dict], dtype: np.dtype) -> np.ndarray:
    order = "little"
    for c in reversed(codecs):
        if c["name"] == "zstd":
            import zstandard

            data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        elif c["name"] == "gzip":
            data = gzip.decompress(data)
        elif c["name"] == "bytes":
            order = c.get("configuration", {}).get("endian", "little")
        else:
            raise ValueError(f"codec {c['name']} is not supported")
    return np.frombuffer(data, dtype.newbyteorder("<" if order == "little" else ">"))


def _fill(value) -> float:
    return {"NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}.get(value, value) if isinstance(value, str) else float(value or 0)


def read_chunks(spark: SparkSession, store: str, names: list[str] | None = None) -> DataFrame:
    """Every chunk of the store's arrays: path, variable, chunk key, origin, shape (cut at the border) and its values.

    A chunk without a file holds the array's fill value; fill values are null. Unknown arrays raise.
    """
    known = variables(store)
    missing = [n for n in names or [] if n not in known]
    if missing:
        raise ValueError(f"{store} has no arrays {', '.join(missing)}")
    tasks = []
    for name in names or known:
        meta = array_metadata(os.path.join(store, name))
        chunk = meta["chunk_grid"]["configuration"]["chunk_shape"]
        sep = meta["chunk_key_encoding"].get("configuration", {}).get("separator", "/")
        prefix = "c" + sep if meta["chunk_key_encoding"]["name"] == "default" else ""
        for at in itertools.product(*[range(math.ceil(s / c)) for s, c in zip(meta["shape"], chunk)]):
            key = prefix + sep.join(map(str, at)) if at else "c"
            tasks.append((store, name, key, [i * c for i, c in zip(at, chunk)], [min(c, s - i * c) for i, c, s in zip(at, chunk, meta["shape"])], json.dumps({"chunk": chunk, "dtype": meta["data_type"], "codecs": meta["codecs"], "fill": meta.get("fill_value")})))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, name, key, origin, shape, info in pdf.itertuples(index=False):
                m = json.loads(info)
                fill = _fill(m["fill"])
                file = os.path.join(path, name, key)
                if os.path.exists(file):
                    with open(file, "rb") as f:
                        a = _decode(f.read(), m["codecs"], np.dtype(m["dtype"])).reshape(m["chunk"])
                    a = a[tuple(slice(0, n) for n in shape)].astype(float).ravel()
                else:
                    a = np.full(math.prod(int(n) for n in shape), fill)
                values = [None if math.isnan(v) or v == fill else v for v in a.tolist()]
                out.append((path, name, key, list(map(int, origin)), list(map(int, shape)), values))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _CHUNKS.split(", ")])

    frame = spark.createDataFrame(tasks, "path string, variable string, chunk string, origin array<int>, shape array<int>, info string")
    return frame.repartition(max(1, min(len(tasks), 4 * spark.sparkContext.defaultParallelism))).mapInPandas(run, _CHUNKS)


def chunk_pixels(chunks: DataFrame) -> DataFrame:
    """(path, variable, y, x, value) of chunks whose last two axes are y and x; axes before them, of length one, are left out."""
    w, h = F.element_at("shape", -1), F.element_at("shape", -2)
    p = chunks.select("path", "variable", "origin", w.alias("w"), h.alias("h"), F.posexplode("values").alias("i", "value"))
    y = F.element_at("origin", -2) + F.floor(F.col("i") / F.col("w")) % F.col("h")
    x = F.element_at("origin", -1) + F.col("i") % F.col("w")
    return p.select("path", "variable", y.cast("int").alias("y"), x.cast("int").alias("x"), "value")


def write_arrays(pixels: DataFrame, store: str, *, height: int, width: int, dtype: str = "float32", chunk: int = DISK_CHUNK, attrs: dict | None = None) -> None:
    """Writes (variable, y, x, value) pixels as arrays of one group; the store's folder must be shared by all executors.

    Chunks are grouped by their place and encoded by executors; arrays of the same names are overwritten, others stay.
    Nulls and pixels that are not there get the fill value: NaN for floats, 0 for integers.
    """
    if not store.rstrip("/").endswith(".zarr"):
        raise ValueError("a store's name must end with .zarr")
    fill = math.nan if dtype.startswith("float") else 0
    names = [r[0] for r in pixels.select("variable").distinct().collect()]
    os.makedirs(store, exist_ok=True)
    with open(os.path.join(store, "zarr.json"), "w", encoding="utf-8") as f:
        json.dump({"zarr_format": 3, "node_type": "group", "attributes": attrs or {}}, f)
    shape = [min(chunk, height), min(chunk, width)]
    for n in names:
        os.makedirs(os.path.join(store, n), exist_ok=True)
        with open(os.path.join(store, n, "zarr.json"), "w", encoding="utf-8") as f:
            json.dump({"zarr_format": 3, "node_type": "array", "shape": [height, width], "data_type": dtype, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": shape}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": "NaN" if fill != 0 else 0, "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "zstd", "configuration": {"level": 3, "checksum": False}}], "attributes": {}}, f)

    def put(pdf: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        name, cy, cx = pdf["variable"].iloc[0], int(pdf["cy"].iloc[0]), int(pdf["cx"].iloc[0])
        a = np.full(shape, fill, dtype)
        ok = pdf[pdf["value"].notna()]
        a[ok["y"] - cy * shape[0], ok["x"] - cx * shape[1]] = ok["value"]
        folder = os.path.join(store, name, "c", str(cy))
        os.makedirs(folder, exist_ok=True)
        part = os.path.join(folder, f".{cx}.part")
        with open(part, "wb") as f:
            f.write(zstandard.ZstdCompressor(3).compress(a.tobytes()))
        os.replace(part, os.path.join(folder, str(cx)))
        return pd.DataFrame({"n": [len(pdf)]})

    placed = pixels.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).withColumn("cy", F.floor(F.col("y") / shape[0])).withColumn("cx", F.floor(F.col("x") / shape[1]))
    placed.groupBy("variable", "cy", "cx").applyInPandas(put, "n long").agg(F.sum("n")).collect()
