"""Streaming queries over the whole scenes table, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.streaming import windows


def stream_daily(spark: SparkSession, d: str) -> DataFrame:
    s = windows.window_stats(windows.scene_stream(spark, d), ["collection"], size="1 day")
    out = windows.run_to_end(s)
    return out.select("collection", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n", F.round("mean", 6).alias("mean"))


def stream_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Scenes of a collection and anchor by month of arrival, each scene once."""
    s = windows.scene_stream(spark, d).where("ts IS NOT NULL AND item_id IS NOT NULL")
    once = windows.without_repeats(s, ["anchor_id", "collection", "item_id", "ts", "value"])
    out = windows.run_to_end(once.select("anchor_id", "collection", "item_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "value"), mode="append")
    return out.select("anchor_id", "collection", "item_id", "ts", "value")


def queries() -> dict:
    return {f.__name__: f for f in (stream_daily, stream_distinct)}


def oracle_sql() -> dict[str, str]:
    return {
        "stream_daily": "SELECT collection, CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, CAST(date_trunc('day', ts) + INTERVAL 1 DAY AS TIMESTAMP) AS \"end\", count(*) AS n, round(avg(value), 6) AS mean FROM scenes WHERE ts IS NOT NULL GROUP BY ALL",
        "stream_distinct": "SELECT DISTINCT anchor_id, collection, item_id, ts, value FROM scenes WHERE ts IS NOT NULL AND item_id IS NOT NULL",
    }
