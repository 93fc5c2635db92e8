"""Scene windows: buckets, reduction, nearest fallback and slots.

Scenes are rows with the columns of ``by`` (what belongs to one series), ``ts`` (timestamp_ntz) and a value. A series'
range is [start, end], both inclusive; buckets of a day are 24 hours from the start, of a month or year they end with
the calendar's, and the first begins at the start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FREQUENCIES = ("scene", "day", "month", "year")
REDUCERS = ("first", "last", "median", "mean")


def series_range(scenes: DataFrame, by: list[str]) -> DataFrame:
    """Adds start and end: first and last time of the series. One aggregation, joined back."""
    ends = scenes.where("ts IS NOT NULL").groupBy(*by).agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    return scenes.join(ends, by)


def bucket_start(ts: Column, start: Column, frequency: str) -> Column:
    """First moment of the bucket that a time lies in."""
    if frequency == "scene":
        return ts
    if frequency == "day":
        # micros between, by the difference of local times; no time zone is involved
        days = F.floor(F.timestamp_diff("MICROSECOND", start, ts) / F.lit(86_400_000_000))
        return F.timestamp_add("DAY", days.cast("int"), start)
    if frequency in ("month", "year"):
        return F.greatest(start, F.date_trunc(frequency, ts).cast("timestamp_ntz"))
    raise ValueError(f"frequency must be one of {FREQUENCIES}")


def bucket_end(begin: Column, end: Column, frequency: str) -> Column:
    """Last microsecond of a bucket, at most the end of the series."""
    if frequency == "scene":
        return begin
    micro = F.expr("INTERVAL '0.000001' SECOND")
    if frequency == "day":
        return F.least(end, F.timestamp_add("DAY", F.lit(1), begin) - micro)
    step = F.expr(f"INTERVAL '1' {frequency.upper()}")
    return F.least(end, F.date_trunc(frequency, begin).cast("timestamp_ntz") + step - micro)


def reduce_scenes(scenes: DataFrame, by: list[str], *, frequency: str = "month", reducer: str = "median", value: str = "value", ties: str = "item_id") -> DataFrame:
    """One row per bucket with scenes: by, bucket, label_ts, n_scenes, value.

    Null times are in no bucket. first and last take the scene's own value, null or not; median and mean skip null
    values. The label is the bucket's start, but a lone time keeps its own. Scenes of one time are ordered by ``ties``.
    """
    if reducer not in REDUCERS:
        raise ValueError(f"reducer must be one of {REDUCERS}")
    s = series_range(scenes.where("ts IS NOT NULL"), by).withColumn("bucket", bucket_start(F.col("ts"), F.col("start"), frequency))
    order = F.struct("ts", F.coalesce(F.col(ties), F.lit("")), F.coalesce(F.col(value), F.lit(float("-inf"))))
    how = {"first": F.min_by(value, order), "last": F.max_by(value, order), "median": F.median(value), "mean": F.avg(value)}[reducer]
    out = s.groupBy(*by, "bucket").agg(how.alias("value"), F.count("*").alias("n_scenes"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    own = {"first": F.col("lo"), "last": F.col("hi")}.get(reducer, F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("bucket")))
    return out.select(*by, "bucket", own.alias("label_ts"), "n_scenes", "value")


def all_buckets(scenes: DataFrame, by: list[str], *, frequency: str = "month") -> DataFrame:
    """Every bucket of every series, those without scenes too: by, bucket, bucket_end."""
    ends = scenes.where("ts IS NOT NULL").groupBy(*by).agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    if frequency == "day":
        steps = F.sequence(F.col("start"), F.col("end"), F.expr("INTERVAL '1' DAY"))
    else:
        trunc = F.date_trunc(frequency, F.col("start")).cast("timestamp_ntz")
        steps = F.sequence(trunc, F.col("end"), F.expr(f"INTERVAL '1' {frequency.upper()}"))
    rows = ends.select(*by, "start", "end", F.explode(steps).alias("at"))
    rows = rows.withColumn("bucket", F.greatest("start", "at"))
    return rows.select(*by, "bucket", bucket_end(F.col("bucket"), F.col("end"), frequency).alias("bucket_end"))


def fill_nearest(buckets: DataFrame, scenes: DataFrame, by: list[str], *, value: str = "value", ties: str = "item_id", piece_days: int = 61) -> DataFrame:
    """Per bucket its earliest scene, or for an empty one the scene nearest to its middle: by, bucket, scene_ts, value, filled.

    The nearest scene is the last one up to the middle or the first one after it; of two equally near ones the earlier
    wins. Series are cut into pieces of time: a bucket meets the scenes of the pieces it reaches into, and a middle is
    ordered with those of its own piece and with the last scene of any piece before and the first of any after.
    """
    piece = lambda t: F.floor(F.unix_micros(t.cast("timestamp")) / F.lit(piece_days * 86_400_000_000))
    s = scenes.where("ts IS NOT NULL").select(*by, "ts", F.struct("ts", F.coalesce(F.col(ties), F.lit("")).alias("tie"), F.col(value).alias("v")).alias("scene"), piece(F.col("ts")).alias("piece"))
    mid = F.timestamp_add("MICROSECOND", F.floor(F.timestamp_diff("MICROSECOND", F.col("bucket"), F.col("bucket_end")) / 2), F.col("bucket"))
    b = buckets.select(*by, "bucket", "bucket_end", mid.alias("mid"))
    # of scenes at one time the first in order counts
    times = s.groupBy(*by, "piece", "ts").agg(F.min("scene").alias("scene"))
    null = F.lit(None)
    both = times.select(*by, "piece", F.col("ts").alias("at"), F.lit(0).alias("kind"), "scene", null.cast("timestamp_ntz").alias("bucket")).unionAll(
        b.select(*by, piece(F.col("mid")).alias("piece"), F.col("mid").alias("at"), F.lit(1).alias("kind"), null.cast(s.schema["scene"].dataType).alias("scene"), "bucket")
    )
    # one row per piece, those with middles only too: what lies before and after it
    ends = both.groupBy(*by, "piece").agg(F.max("scene").alias("_last"), F.min("scene").alias("_first"))
    over = Window.partitionBy(*by).orderBy("piece")
    ends = ends.select(*by, "piece", F.last("_last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"), F.first("_first", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    w = Window.partitionBy(*by, "piece").orderBy("at", "kind")
    before = F.last("scene", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("scene", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    got = both.withColumn("before", before).withColumn("after", after).where("kind = 1").join(ends, [*by, "piece"])
    got = got.withColumn("before", F.coalesce("before", "_earlier")).withColumn("after", F.coalesce("after", "_later"))
    gap = lambda c: F.abs(F.timestamp_diff("MICROSECOND", F.col(f"{c}.ts"), F.col("at")))
    nearest = F.when(F.col("after").isNull() | (gap("before") <= gap("after")), F.col("before")).otherwise(F.col("after"))
    got = got.withColumn("near", nearest).select(*by, "bucket", "near")
    reached = b.withColumn("piece", F.explode(F.sequence(piece(F.col("bucket")), piece(F.col("bucket_end"))))).select(*by, "piece", "bucket", "bucket_end")
    inside = times.join(reached, [*by, "piece"]).where("ts BETWEEN bucket AND bucket_end").groupBy(*by, "bucket").agg(F.min("scene").alias("own"))
    out = got.join(inside, [*by, "bucket"], "left")
    use = F.coalesce("own", "near")
    return out.select(*by, "bucket", use["ts"].alias("scene_ts"), use["v"].alias("value"), F.col("own").isNull().alias("filled"))


def slots(steps: DataFrame, by: list[str], *, slots: int, strides: int | None = None, at: str = "bucket") -> DataFrame:
    """Sequences of ``slots`` consecutive steps, a new one every ``strides`` (as many as slots if not given).

    Adds sample (from 0) and slot (from 0); a step in several sequences comes once for each, a trailing partial
    sequence is left out. Every row finds its sequences from its own number, so nothing is joined.
    """
    if slots < 1 or (strides is not None and strides < 1):
        raise ValueError("slots and strides must be at least 1")
    stride = strides or slots
    w = Window.partitionBy(*by)
    r = F.row_number().over(w.orderBy(at)) - 1
    n = F.count("*").over(w)
    rows = steps.withColumn("_r", r).withColumn("_n", n)
    first = F.greatest(F.lit(0), F.ceil((F.col("_r") - (slots - 1)) / stride)).cast("int")
    last = F.least(F.floor(F.col("_r") / stride), F.floor((F.col("_n") - slots) / stride)).cast("int")
    # sequence() would count down where the first is beyond the last
    which = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("sample", F.explode(which))
    return rows.withColumn("slot", (F.col("_r") - F.col("sample") * stride).cast("int")).drop("_r", "_n")


def floor_time(ts: Column, unit: str | None) -> Column:
    """Time floored to D, W, M or Y; None leaves it."""
    units = {"D": "day", "W": "week", "M": "month", "Y": "year"}
    if unit is None:
        return ts
    if unit not in units:
        raise ValueError(f"unit must be one of {', '.join(units)}")
    return F.date_trunc(units[unit], ts).cast("timestamp_ntz")
