"""Object labels as text: one box per line, class and centre, width and height in shares of the image."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions.strings import extract_key

_LINE = r"^\s*\d{1,9}(\s+[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?){4}\s*$"


def read_labels(spark: SparkSession, folder: str, *, pattern: str | None = None) -> DataFrame:
    """(sample_id, path, body) of the .txt files below a folder, empty files too. Of files with one key the last path wins."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    # an empty file has no row of text, so the list of files comes from its own scan
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(folder).select("path")
    rows = listed.join(files, "path", "left").select(extract_key(F.col("path"), pattern, strict=True).alias("sample_id"), "path", F.coalesce("body", F.lit("")).alias("body"))
    from terrafold.operators.align import last_duplicate

    return last_duplicate(rows, "sample_id", "path")


def lines(labels: DataFrame, *, key: str, body: str) -> DataFrame:
    """(key, line_no from 1, line, ok) of the non-blank lines; ok tells whether a line is well-formed."""
    e = labels.select(key, F.posexplode(F.split(body, "\n")).alias("_i", "line"))
    return e.where(F.trim(F.regexp_replace("line", r"\s", " ")) != "").select(key, (F.col("_i") + 1).alias("line_no"), "line", F.col("line").rlike(_LINE).alias("ok"))


def boxes(labels: DataFrame, *, key: str, body: str, strict: bool = False) -> DataFrame:
    """(key, line_no, class_id, cx, cy, w, h) of the well-formed lines; a malformed one raises if ``strict``, else it is left out."""
    rows = lines(labels, key=key, body=body)
    if strict:
        rows = rows.where(F.when(F.col("ok"), F.lit(True)).otherwise(F.raise_error(F.concat_ws(":", F.col(key).cast("string"), F.col("line_no").cast("string"), F.lit(" not five fields"))).cast("boolean")))
    v = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    num = lambda i: F.get("v", F.lit(i)).cast("double")
    return rows.where("ok").withColumn("v", v).select(key, "line_no", F.get("v", F.lit(0)).cast("int").alias("class_id"), num(1).alias("cx"), num(2).alias("cy"), num(3).alias("w"), num(4).alias("h"))


def malformed(labels: DataFrame, *, key: str, body: str) -> DataFrame:
    return lines(labels, key=key, body=body).where("NOT ok").select(key, "line_no", "line")


def as_arrays(labels: DataFrame, *, key: str, body: str) -> DataFrame:
    """(key, class_ids, boxes) per label file, with empty arrays for a file without boxes."""
    b = boxes(labels, key=key, body=body).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line_no", "class_id", F.array("cx", "cy", "w", "h").alias("box")))).alias("p"))
    j = labels.select(key).join(b, key, "left")
    return j.select(key, F.coalesce(F.transform("p", lambda s: s["class_id"]), F.array().cast("array<int>")).alias("class_ids"), F.coalesce(F.transform("p", lambda s: s["box"]), F.array().cast("array<array<double>>")).alias("boxes"))
