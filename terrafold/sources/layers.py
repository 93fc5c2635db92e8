"""Stores of layers: Parquet folders partitioned by layer, written layer by layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def layers_of(spark: SparkSession, path: str) -> list[str]:
    """Layers of a store, from the names of its partitions."""
    if not _exists(spark, path):
        return []
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
    return sorted(n[len("layer=") :] for n in names if n.startswith("layer="))


def save_layers(pixels: DataFrame, path: str, *, overwrite: bool = True) -> None:
    """Writes the layers of pixels; other layers of the store stay. Without ``overwrite`` a layer that is there raises."""
    spark = pixels.sparkSession
    if not overwrite:
        there = set(layers_of(spark, path))
        both = sorted(there & {r[0] for r in pixels.select("layer").distinct().collect()}) if there else []
        if both:
            raise ValueError(f"{path} already has {', '.join(both)}")
    # by blocks of pixels, so that a large anchor is written by several tasks
    out = pixels.repartition("layer", "anchor_id", F.floor(F.col("y") / 512), F.floor(F.col("x") / 512)).sortWithinPartitions("layer", "anchor_id", "y", "x")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("layer").parquet(path)


def load_layers(spark: SparkSession, path: str, *, required: list[str] | None = None, schema: StructType | None = None) -> DataFrame:
    """Pixels of the required layers, or of all; a missing one raises. Only their folders are read."""
    missing = sorted(set(required or []) - set(layers_of(spark, path)))
    if missing:
        raise KeyError(f"{path} has no layers {', '.join(missing)}")
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    return df if required is None else df.where(F.col("layer").isin(required))


def write_new(predictions: DataFrame, path: str, *, keys: tuple[str, ...] = ("stem", "layer")) -> int:
    """Appends the rows of (stem, layer) pairs that the store does not have yet; returns how many pairs were new."""
    spark = predictions.sparkSession
    new = predictions
    if _exists(spark, path):
        new = predictions.join(spark.read.parquet(path).select(*keys).distinct(), list(keys), "left_anti")
    n = new.select(*keys).distinct().count()
    if n:
        new.write.mode("append").partitionBy("layer").parquet(path)
    return n


def write_steps(pixels: DataFrame, path: str) -> None:
    """One folder per time step, named by its time; pixels without a time go to the default one."""
    step = F.date_format("ts", "yyyyMMdd'T'HHmmss")
    pixels.withColumn("step", step).write.mode("overwrite").partitionBy("step").parquet(path)


def write_provenance(items: DataFrame, path: str) -> int:
    """Writes (sample_id, item_no, item) rows as JSON lines if there are any; returns their number."""
    n = items.count()
    if n:
        items.write.mode("overwrite").json(path)
    return n
