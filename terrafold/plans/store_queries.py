"""Queries through stores: whole tables written by the sinks and read back by the scans, each with the SQL of what must come out.

Stores lie in the shared folder of the checkpoints, each in one of its own. Rasters and arrays are written by plain files, so
there the folder must be mounted on all executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions import strings
from terrafold.operators import datasets, grid, tiles
from terrafold.session import checkpoint_folder, table
from terrafold.sources import layers, tables, tiff, zarr

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


def _folder(spark: SparkSession, name: str, *, files: bool = False) -> str:
    path = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}-{name}"
    if not files:
        return path
    scheme, _, rest = path.rpartition(":")
    if scheme not in ("", "file"):
        raise RuntimeError(f"{path} is no mounted folder")
    return "/" + rest.lstrip("/")


@query("SELECT anchor_id, layer, ts, band, y, x, value FROM pixels WHERE layer IN ('ndvi', 'scl')")
def store_layers(spark, d):
    path = _folder(spark, "layers")
    p = table(spark, d, "pixels")
    layers.save_layers(p, path)
    # a layer that is required and not there raises, so those of the table are
    there = [n for n in ("ndvi", "scl") if n in layers.layers_of(spark, path)]
    return layers.load_layers(spark, path, required=there, schema=p.schema).select("anchor_id", "layer", "ts", "band", "y", "x", "value")


@query("SELECT strftime(date_trunc('month', ts), '%Y%m%dT%H%M%S') AS step, count(*) AS n, round(sum(value), 3) AS total FROM pixels GROUP BY 1")
def store_steps(spark, d):
    path = _folder(spark, "steps")
    p = table(spark, d, "pixels").withColumn("ts", F.date_trunc("month", "ts").cast("timestamp_ntz"))
    layers.write_steps(p, path)
    return spark.read.schema(p.withColumn("step", F.lit("")).schema).parquet(path).groupBy("step").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("""WITH a AS (SELECT anchor_id, collection, ts FROM scenes WHERE ts < TIMESTAMP '2019-06-01'), b AS (SELECT anchor_id, collection, ts FROM scenes WHERE (anchor_id, collection) NOT IN (SELECT (anchor_id, collection) FROM a))
SELECT anchor_id AS stem, collection AS layer, count(*) AS n, max(ts) AS latest FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL""")
def store_new(spark, d):
    """Pairs that a store has are not written again."""
    path = _folder(spark, "new")
    s = table(spark, d, "scenes").select(F.col("anchor_id").alias("stem"), F.col("collection").alias("layer"), "ts")
    layers.write_new(s.where("ts < TIMESTAMP_NTZ '2019-06-01'"), path)
    layers.write_new(s, path)
    if not layers.layers_of(spark, path):  # nothing was new
        return s.limit(0).groupBy("stem", "layer").agg(F.count("*").alias("n"), F.max("ts").alias("latest"))
    return spark.read.parquet(path).groupBy("stem", "layer").agg(F.count("*").alias("n"), F.max("ts").alias("latest"))


@query("SELECT vec_id AS sample_id, label FROM embeddings")
def store_manifest(spark, d):
    path = _folder(spark, "manifest.parquet")
    datasets.write_manifest(datasets.manifest(table(spark, d, "embeddings"), ["label"], "vec_id"), path)
    return tables.read_table(spark, path).select(F.col("sample_id").cast("long").alias("sample_id"), "label")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def store_csv(spark, d):
    path = _folder(spark, "supplier.csv")
    t = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    t.write.option("header", True).csv(path)
    return tables.read_table(spark, path, t.schema)


@query("SELECT label_no FROM yolo_labels WHERE image_key IN (SELECT trim(image_key) FROM yolo_labels WHERE trim(image_key) <> '' AND label_no % 3 = 0)")
def store_split(spark, d):
    """Labels of a split list that was written as text and read again."""
    path = _folder(spark, "split.txt")
    labels = table(spark, d, "yolo_labels")
    keys = labels.where("label_no % 3 = 0 AND image_key IS NOT NULL").select(F.concat(F.lit("  "), "image_key", F.lit(" ")).alias("value"))
    keys.unionAll(spark.createDataFrame([("",), ("   ",)], "value string")).write.text(path)
    return datasets.keep_split(labels, tables.read_split(spark, path, "image_key"), "image_key").select("label_no")


_FLAT = "SELECT anchor_id || '-' || layer AS name, y, x, max(value) AS value FROM pixels WHERE layer IN ('ndvi', 'scl') AND value IS NOT NULL AND y BETWEEN 0 AND 511 AND x BETWEEN 0 AND 511 GROUP BY ALL"


def _flat(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pixels").where("layer IN ('ndvi', 'scl') AND value IS NOT NULL AND y BETWEEN 0 AND 511 AND x BETWEEN 0 AND 511")
    return p.groupBy(F.concat_ws("-", "anchor_id", "layer").alias("name"), "y", "x").agg(F.max("value").alias("value"))


@query(_FLAT)
def store_zarr(spark, d):
    path = _folder(spark, "flat.zarr", files=True)
    zarr.write_arrays(_flat(spark, d).withColumnRenamed("name", "variable"), path, height=512, width=512, dtype="float64", chunk=256)
    return zarr.chunk_pixels(zarr.read_chunks(spark, path)).where("value IS NOT NULL").select(F.col("variable").alias("name"), "y", "x", "value")


@query(_FLAT)
def store_rasters(spark, d):
    path = _folder(spark, "rasters", files=True)
    tiff.write_rasters(_flat(spark, d).withColumn("band", F.lit("value")), path, key="name", height=512, width=512, dtype="float64", tile=256).count()
    return tiff.read_pixels(spark, path).where("value IS NOT NULL").select(strings.file_stem(F.col("path")).alias("name"), "y", "x", "value")


@query("""SELECT anchor_id, band, y, x, max(value) - min(value) AS value FROM pixels WHERE layer = 'sentinel_2_l2a' AND ts IS NOT NULL GROUP BY ALL""")
def mosaic_range(spark, d):
    """A mosaic by a function: what lies between the least and the greatest value of a pixel."""
    import numpy as np

    def spread(a):
        some = ~np.isnan(a).all(axis=1)
        out = np.full(len(a), np.nan)
        out[some] = np.nanmax(a[some], axis=1) - np.nanmin(a[some], axis=1)
        return out

    p = table(spark, d, "pixels").where("layer = 'sentinel_2_l2a' AND ts IS NOT NULL")
    m = grid.mosaic_with(p, ["anchor_id", "band", "y", "x"], spread, order="ts")
    return m.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


@query("""SELECT anchor_id, layer, band, ts, y, x, CASE layer WHEN 'ndvi' THEN CAST(CAST(value AS FLOAT) AS DOUBLE) WHEN 'scl' THEN CASE WHEN trunc(value) BETWEEN 0 AND 255 THEN trunc(value) END
WHEN 'sentinel_2_l2a' THEN CASE WHEN trunc(value) BETWEEN -32768 AND 32767 THEN trunc(value) END ELSE value END AS value FROM pixels""")
def cast_layers(spark, d):
    p = tiles.cast_layers(table(spark, d, "pixels"), {"ndvi": "float32", "scl": "uint8", "sentinel_2_l2a": "int16"})
    return p.select("anchor_id", "layer", "band", "ts", "y", "x", "value")


@query("SELECT anchor_id, layer, CASE WHEN count(DISTINCT band) FILTER (band IN ('B04', 'B03', 'B02')) = 3 THEN 'B04,B03,B02' END AS rgb FROM pixels GROUP BY ALL")
def rgb_layers(spark, d):
    s = tiles.layer_summary(table(spark, d, "pixels"))
    return s.select("anchor_id", "layer", F.array_join(tiles.rgb_subset(F.split("bands", ","), ["B04", "B03", "B02"]), ",").alias("rgb"))


@query("SELECT rec_id, coalesce(catalog, platform) AS source, CAST((platform IS NOT NULL)::INT + (catalog IS NOT NULL)::INT + (mgrs_tile IS NOT NULL)::INT - (platform IS NOT NULL AND catalog IS NOT NULL)::INT AS INTEGER) AS n, stac_version AS crs FROM stac_items")
def rebase_metadata(spark, d):
    """Metadata that are merged, the newer value counting, beside a column that is replaced."""
    one = lambda k, c: F.when(F.col(c).isNotNull(), F.create_map(F.lit(k), F.col(c)))
    both = lambda a, b: tiles.merge_metadata(a, b)
    t = table(spark, d, "stac_items").select("rec_id", both(one("source", "platform"), one("tile", "mgrs_tile")).alias("metadata"), F.lit("old").alias("crs"), "catalog", "stac_version")
    r = tiles.rebase(t, metadata=one("source", "catalog"), crs=F.col("stac_version"))
    return r.select("rec_id", F.try_element_at("metadata", F.lit("source")).alias("source"), F.size("metadata").alias("n"), "crs")


@query("SELECT n_nationkey, concat_ws(', ', n_name, CASE WHEN r_regionkey % 2 = 0 THEN r_name END, 'Earth') AS place FROM nation JOIN region ON n_regionkey = r_regionkey")
def address_text(spark, d):
    """Addresses of parts, the first known name of a chain without its suffix, and a country."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    even = F.when(F.col("r_regionkey") % 2 == 0, F.concat("r_name", F.lit(" Region")))
    return n.select("n_nationkey", strings.address([F.col("n_name")], [F.lit(None).cast("string"), even], F.lit("Earth")).alias("place"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
