import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from terrafold.operators import align, temporal

T = dt.datetime
BY = ["anchor_id"]


def scenes(spark, *ts, value=1.0, anchor="a"):
    return spark.createDataFrame([(anchor, f"i{k}", t, value + k) for k, t in enumerate(ts)], "anchor_id string, item_id string, ts timestamp_ntz, value double")


DAYS = [T(2023, 1, d) for d in range(1, 6)]


def test_slots_drop_the_trailing_part(spark):
    s = temporal.reduce_scenes(scenes(spark, *DAYS), BY, frequency="scene")
    assert [tuple(r) for r in temporal.slots(s, BY, slots=2).select("sample", "slot").orderBy("sample", "slot").collect()] == [(0, 0), (0, 1), (1, 0), (1, 1)]
    got = temporal.slots(s, BY, slots=3, strides=1)
    assert got.select("sample").distinct().count() == 3 and got.count() == 9
    assert temporal.slots(s, BY, slots=6).count() == 0
    assert [r.value for r in temporal.slots(s, BY, slots=1, strides=2).orderBy("sample").collect()] == [1.0, 3.0, 5.0]
    with pytest.raises(ValueError):
        temporal.slots(s, BY, slots=0)


def test_reducers_and_labels(spark):
    s = scenes(spark, T(2023, 1, 5), T(2023, 1, 20), T(2023, 2, 12, 10, 15, 23, 456000)).unionAll(spark.createDataFrame([("a", "n", None, 9.0), ("a", "z", T(2023, 1, 25), None)], "anchor_id string, item_id string, ts timestamp_ntz, value double"))
    r = lambda how: [(x.bucket, x.label_ts, x.n_scenes, x.value) for x in temporal.reduce_scenes(s, BY, frequency="month", reducer=how).orderBy("bucket").collect()]
    feb = (T(2023, 2, 1), T(2023, 2, 12, 10, 15, 23, 456000), 1, 3.0)
    assert r("median") == [(T(2023, 1, 5), T(2023, 1, 5), 3, 1.5), feb] == r("mean")
    assert r("first") == [(T(2023, 1, 5), T(2023, 1, 5), 3, 1.0), feb]
    assert r("last") == [(T(2023, 1, 5), T(2023, 1, 25), 3, None), feb]
    with pytest.raises(ValueError):
        temporal.reduce_scenes(s, BY, reducer="mode")
    assert temporal.reduce_scenes(s.limit(0), BY).collect() == []


def test_day_buckets_run_from_the_start(spark):
    s = scenes(spark, T(2023, 1, 1, 18), T(2023, 1, 2, 17, 59), T(2023, 1, 2, 18), T(2023, 1, 4, 1))
    got = temporal.reduce_scenes(s, BY, frequency="day", reducer="mean").orderBy("bucket").collect()
    assert [(r.bucket, r.n_scenes) for r in got] == [(T(2023, 1, 1, 18), 2), (T(2023, 1, 2, 18), 1), (T(2023, 1, 3, 18), 1)]


def test_empty_buckets_take_the_nearest(spark):
    s = scenes(spark, T(2023, 1, 15), T(2023, 4, 10))
    b = temporal.all_buckets(s, BY, frequency="month")
    assert [(r.bucket, r.bucket_end) for r in b.orderBy("bucket").collect()][0] == (T(2023, 1, 15), T(2023, 1, 31, 23, 59, 59, 999999))
    got = temporal.fill_nearest(b, s, BY).orderBy("bucket").collect()
    assert [(r.bucket.month, r.scene_ts.month, r.filled) for r in got] == [(1, 1, False), (2, 1, True), (3, 4, True), (4, 4, False)]


def test_alignment_drops_samples_that_miss_a_source(spark):
    t = [("a", "x", 1, T(2023, 1, 1), T(2023, 1, 31)), ("a", "x", 2, T(2023, 2, 1), T(2023, 2, 28)), ("a", "y", 1, T(2023, 1, 1), T(2023, 1, 2)), ("a", "y", 2, T(2023, 1, 1), T(2023, 1, 9)), ("b", "x", 1, T(2023, 1, 1), T(2023, 1, 2))]
    df = spark.createDataFrame(t, "anchor_id string, source string, ord int, start timestamp_ntz, end timestamp_ntz")
    got = align.align_sources(df, BY, ["x", "y"]).collect()
    assert [(r.anchor_id, r.lead, r.ref_ord, r.x.ord, r.y.ord) for r in got] == [("a", "x", 1, 1, 1)]
    assert [(r.anchor_id, r.ref_ord) for r in align.align_sources(df.where("source = 'x'"), BY, ["x"]).orderBy("anchor_id", "ref_ord").collect()] == [("a", 1), ("a", 2), ("b", 1)]
    assert align.align_sources(df.limit(0), BY, ["x", "y"]).collect() == []
    refs = spark.createDataFrame([("a", 7, T(2023, 1, 1)), ("a", 8, T(2024, 1, 1))], "anchor_id string, ref_id int, at timestamp_ntz")
    assert [(r.ref_id, r.tile.ord, r.tile.source) for r in align.covering_first(refs, df.where("source = 'y'"), BY).collect()] == [(7, 1, "y")]


def test_cubes_fill_gaps_and_split_again(spark):
    a = spark.createDataFrame([("s", 1, 2.0), ("s", 2, None)], "k string, t int, value double")
    b = spark.createDataFrame([("s", 3, 4.0)], "k string, t int, value double")
    st = spark.createDataFrame([("s", 9.0)], "k string, value double")
    cube = align.to_cube({"a": a, "b": b}, ["k"], "t", nodata=-1.0, static={"c": st})
    assert rows(cube, "t", "a", "b", "c") == [(1, 2.0, -1.0, 9.0), (2, -1.0, -1.0, 9.0), (3, -1.0, 4.0, 9.0)]
    assert align.from_cube(cube, ["k"], "t", ["a", "b"]).count() == 6


def test_floor_time(spark):
    df = spark.createDataFrame([(T(2021, 1, 3, 5),)], "t timestamp_ntz")
    got = df.select(*[temporal.floor_time(df.t, u).alias(u or "N") for u in ("D", "W", "M", "Y", None)]).first()
    assert list(got) == [T(2021, 1, 3), T(2020, 12, 28), T(2021, 1, 1), T(2021, 1, 1), T(2021, 1, 3, 5)]
    with pytest.raises(ValueError):
        temporal.floor_time(df.t, "Q")
