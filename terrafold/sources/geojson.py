"""GeoJSON texts and files: shapes, features and anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_GEOMETRY = "struct<type:string,coordinates:string>"
_DOC = f"struct<type:string,coordinates:string,geometry:{_GEOMETRY},properties:map<string,string>,features:array<struct<geometry:{_GEOMETRY},properties:map<string,string>>>>"


def shape_summary(regions: DataFrame, *, key: str, polygon: str) -> DataFrame:
    """(key, shape, crs, n) of region texts; n is the number of entries of the coordinates. Null and broken texts are left out."""
    p = F.from_json(polygon, "struct<geojson:struct<type:string,coordinates:string>,polygon_crs:string>")
    r = regions.where(F.col(polygon).isNotNull()).select(key, p.alias("p")).where("p.geojson.type IS NOT NULL")
    n = F.json_array_length("p.geojson.coordinates")
    return r.select(key, F.col("p.geojson.type").alias("shape"), F.col("p.polygon_crs").alias("crs"), n.alias("n"))


def parse_features(texts: DataFrame, text: str = "value") -> DataFrame:
    """One row per feature of FeatureCollection, Feature and bare geometry texts: the other columns, feature_no, shape, coordinates, properties."""
    d = texts.withColumn("_d", F.from_json(text, _DOC))
    bare = F.array(F.struct(F.struct(F.col("_d.type").alias("type"), F.col("_d.coordinates").alias("coordinates")).alias("geometry"), F.lit(None).cast("map<string,string>").alias("properties")))
    one = F.array(F.struct(F.col("_d.geometry").alias("geometry"), F.col("_d.properties").alias("properties")))
    kind = F.col("_d.type")
    each = F.when(kind == "FeatureCollection", F.col("_d.features")).when(kind == "Feature", one).when(F.col("_d.coordinates").isNotNull(), bare)
    e = d.select(*[c for c in texts.columns if c != text], F.posexplode(each).alias("feature_no", "_f"))
    return e.select(*[c for c in e.columns if c != "_f"], F.col("_f.geometry.type").alias("shape"), F.col("_f.geometry.coordinates").alias("coordinates"), F.col("_f.properties").alias("properties"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Features of a file, or of all .geojson and .json files below a folder, with their path."""
    t = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{geojson,json}")
    return parse_features(t.select(F.col("_metadata.file_path").alias("path"), "value"))
