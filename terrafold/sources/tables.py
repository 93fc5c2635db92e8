"""Keyed tables, split lists, sample folders and provenance files."""

from __future__ import annotations

import os
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafold.functions.strings import extract_key
from terrafold.operators.datasets import has_layers


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A csv (with header), Parquet or, for small ones, xlsx table by the ending of its name."""
    end = os.path.splitext(path.rstrip("/"))[1].lower()
    if end == ".csv":
        r = spark.read.option("header", True)
        return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)
    if end == ".parquet":
        return spark.read.parquet(path)
    if end == ".xlsx":
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path))
    raise ValueError(f"tables of type {end or path} are not supported")


def read_split(spark: SparkSession, path: str, key: str = "sample_id") -> DataFrame:
    """Keys of a split file: its non-empty lines without outer blanks."""
    return spark.read.text(path).select(F.trim("value").alias(key)).where(F.col(key) != "")


def list_stores(spark: SparkSession, folder: str, *, required: list[str] | None = None, pattern: str | None = None) -> DataFrame:
    """(sample_id, path, layers) of the .zarr stores below a folder that have all required layers, by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "zarr.json").load(folder).select("path")
    parts = F.regexp_extract_all("path", F.lit(r"^(.*?\.zarr)(?:/([^/]+))?.*/zarr\.json$"), F.lit(1))
    store, layer = F.get(parts, F.lit(0)), F.regexp_extract("path", r"^.*?\.zarr/([^/]+)/.*zarr\.json$", 1)
    found = files.select(store.alias("path"), F.when(layer != "", layer).alias("layer")).where("path IS NOT NULL")
    s = found.groupBy("path").agg(F.array_sort(F.collect_set("layer")).alias("layers"))
    if required:
        s = s.where(has_layers(F.col("layers"), required))
    return s.select(extract_key(F.col("path"), pattern).alias("sample_id"), "path", "layers")


def relative_path(path: str, root: str):
    """Column of a path below a root folder."""
    return F.regexp_replace(F.regexp_replace(path, r"^file:/+", "/"), "^" + root.rstrip("/").replace(".", r"\.") + "/", "")


def read_provenance(spark: SparkSession, folder: str) -> DataFrame:
    """(sample_id, item_no, item) of the <stem>.stac.json lists below a folder; item is JSON text."""
    t = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.stac.json")
    stem = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.stac\.json$", "")
    e = t.select(stem.alias("sample_id"), F.from_json("value", "array<string>").alias("items"))
    return e.select("sample_id", F.posexplode("items").alias("item_no", "item"))


def extract_archive(path: str, folder: str) -> str:
    """Unpacks a zip archive unless the folder has content; leaves out resource forks and paths outside the folder."""
    if os.path.isdir(folder) and os.listdir(folder):
        return folder
    os.makedirs(folder, exist_ok=True)
    top = os.path.realpath(folder)
    with zipfile.ZipFile(path) as z:
        for n in z.namelist():
            parts = n.split("/")
            if "__MACOSX" in parts or parts[-1].startswith("._"):
                continue
            if not os.path.realpath(os.path.join(folder, n)).startswith(top + os.sep) and n.rstrip("/"):
                raise ValueError(f"{n} lies outside the archive's folder")
            z.extract(n, folder)
    return folder
