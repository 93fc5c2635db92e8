"""Object annotations in one JSON file for a whole split: images, annotations and categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions.strings import file_stem

_FILE = "images array<struct<id:bigint,file_name:string,width:int,height:int>>, annotations array<struct<id:bigint,image_id:bigint,category_id:int,bbox:array<double>,iscrowd:int>>, categories array<struct<id:int,name:string>>"


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, image_id, annotation_id, class_id, class, x, y, w, h, cx, cy, sw, sh), one row per box.

    sample_id is the stem of the image's file name; x and y are the upper left corner in pixels as the file has them, cx to sh
    the same box by its centre in shares of the image. Images without boxes have one row with nulls, so that none is
    lost; annotations without an image, or without four numbers, have none.
    """
    f = spark.read.schema(_FILE).option("multiLine", True).json(path)
    images = f.select(F.inline("images")).select(F.col("id").alias("image_id"), file_stem(F.col("file_name")).alias("sample_id"), "width", "height").where("image_id IS NOT NULL")
    boxes = f.select(F.inline("annotations")).where((F.size("bbox") == 4) & ~F.exists("bbox", lambda v: v.isNull())).select("image_id", F.col("id").alias("annotation_id"), F.col("category_id").alias("class_id"), *[F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate("xywh")])
    names = f.select(F.inline("categories")).select(F.col("id").alias("class_id"), F.col("name").alias("class"))
    out = images.join(boxes, "image_id", "left").join(names, "class_id", "left")
    share = [((F.col("x") + F.col("w") / 2) / F.col("width")).alias("cx"), ((F.col("y") + F.col("h") / 2) / F.col("height")).alias("cy"), (F.col("w") / F.col("width")).alias("sw"), (F.col("h") / F.col("height")).alias("sh")]
    return out.select("sample_id", "image_id", "annotation_id", "class_id", "class", *"xywh", *share)
