"""Images as samples: one file each, georeferenced or not."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions.strings import extract_key
from terrafold.sources import tiff

#: Endings of files that are one sample each.
RASTERS, PICTURES = ("tif", "tiff"), ("jpg", "jpeg", "png")

#: Names of the bands of a picture in the order its bytes have.
_NAMES = {1: ["gray"], 3: ["blue", "green", "red"], 4: ["blue", "green", "red", "alpha"]}


def list_samples(spark: SparkSession, folder: str, *, georeferenced: bool = True, pattern: str | None = None) -> DataFrame:
    """(sample_id, path, kind) of the rasters below a folder, pictures too if they need no place on earth, by path.

    Of files with one key the last path counts. .jp2 files are not listed, as nothing here can read them.
    """
    ends = RASTERS if georeferenced else RASTERS + PICTURES
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join([*ends, *[e.upper() for e in ends]]) + "}").load(folder).select("path")
    from terrafold.operators.align import last_duplicate

    kind = F.lower(F.regexp_extract("path", r"([^.]*)$", 1))
    return last_duplicate(files.select(extract_key(F.col("path"), pattern).alias("sample_id"), "path", kind.alias("kind")), "sample_id", "path")


def read_pictures(spark: SparkSession, folder: str) -> DataFrame:
    """(path, band, y, x, value) of the .jpg, .jpeg and .png files below a folder, 8 bits a band: gray, or red, green, blue and alpha.

    Files that can't be read have no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, h, w, n, data in zip(pdf["path"], pdf["h"], pdf["w"], pdf["n"], pdf["data"]):
                a = np.frombuffer(data, np.uint8)[: h * w * n].reshape(h, w, n)
                y, x = np.indices((h, w))
                for i, band in enumerate(_NAMES[n]):
                    yield pd.DataFrame({"path": path, "band": band, "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32"), "value": a[:, :, i].ravel().astype(float)})

    glob = "*.{" + ",".join([*PICTURES, *[e.upper() for e in PICTURES]]) + "}"
    images = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    i = images.select(F.col("image.origin").alias("path"), F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("n"), F.col("image.data").alias("data"))
    return i.where(F.col("n").isin(1, 3, 4)).mapInPandas(run, "path string, band string, y int, x int, value double")


def read_samples(spark: SparkSession, folder: str, *, georeferenced: bool = True, pattern: str | None = None, bands: list[str] | None = None) -> DataFrame:
    """(sample_id, band, y, x, value) of the samples of a folder, whatever their format."""
    listed = list_samples(spark, folder, georeferenced=georeferenced, pattern=pattern)
    pixels = tiff.read_pixels(spark, folder, bands=bands)
    if not georeferenced:
        p = read_pictures(spark, folder)
        pixels = pixels.unionByName(p if bands is None else p.where(F.col("band").isin(bands)))
    # paths of the two readers differ in the slashes of their scheme
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return pixels.withColumn("_p", plain("path")).join(listed.select("sample_id", plain("path").alias("_p")), "_p").select("sample_id", "band", "y", "x", "value")
