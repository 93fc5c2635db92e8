import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from terrafold.functions import classes, dates, geo, names, strings

T = dt.datetime
US = dt.timedelta(microseconds=1)

RANGES = [
    ("2019", T(2019, 1, 1), T(2020, 1, 1) - US, "2019"),
    ("2019-05", T(2019, 5, 1), T(2019, 6, 1) - US, "201905"),
    ("2019-05-07", T(2019, 5, 7), T(2019, 5, 8) - US, "20190507"),
    ("20190507", T(2019, 5, 7), T(2019, 5, 8) - US, "20190507"),
    ("2019-05-07T10", T(2019, 5, 7, 10), T(2019, 5, 7, 11) - US, "20190507T10"),
    ("2019-05-07T10:30", T(2019, 5, 7, 10, 30), T(2019, 5, 7, 10, 31) - US, "20190507T1030"),
    ("20190507T103015", T(2019, 5, 7, 10, 30, 15), T(2019, 5, 7, 10, 30, 16) - US, "20190507T103015"),
    ("2019-05-07T10:30:15.5", T(2019, 5, 7, 10, 30, 15, 500000), T(2019, 5, 7, 10, 30, 15, 500000), "20190507T103015.500000"),
    ("2022-09-27T22:34:56+07:00", T(2022, 9, 27, 15, 34, 56), T(2022, 9, 27, 15, 34, 57) - US, "20220927T153456"),
    ("2022-09-27T22:34:56-0530", T(2022, 9, 28, 4, 4, 56), T(2022, 9, 28, 4, 4, 57) - US, "20220928T040456"),
    ("2022-09-27T22:34:56Z", T(2022, 9, 27, 22, 34, 56), T(2022, 9, 27, 22, 34, 57) - US, "20220927T223456"),
    ("2023-02-30", None, None, None),
    ("yesterday", None, None, None),
    ("", None, None, None),
    (None, None, None, None),
]


def test_ranges_of_every_precision(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(RANGES)], "i int, t string")
    got = df.select("i", dates.parse_start(F.col("t")).alias("s"), dates.parse_end(F.col("t")).alias("e"))
    got = got.withColumn("c", F.when(F.col("s").isNotNull(), strings.compact_range(F.col("s"), F.col("e")))).orderBy("i").collect()
    assert [(r.s, r.e, r.c) for r in got] == [r[1:] for r in RANGES]


def test_compact_range_of_two_sides(spark):
    df = spark.createDataFrame([(T(2019, 5, 7), T(2019, 5, 10) - US), (T(2019, 5, 1), T(2019, 7, 1) - US), (T(2019, 5, 7, 1, 2, 3, 4), T(2020, 1, 1) - US)], "s timestamp_ntz, e timestamp_ntz")
    assert [r[0] for r in df.select(strings.compact_range(df.s, df.e)).collect()] == ["20190507-20190509", "201905-201906", "20190507T010203.000004-2019"]


def test_stems_and_keys(spark):
    df = spark.createDataFrame([("/a/dw_107.9459135480_22.1422143633-20190923_consensus.zarr/",), ("x/tile-20190507-20190509.tif",), ("labels_042.txt",), ("plain",)], "p string")
    got = [tuple(r) for r in df.select(strings.extract_key(df.p), strings.stem_dates(strings.extract_key(df.p)), strings.extract_key(df.p, r"(\d+)\.txt$")).collect()]
    assert got == [("dw_107.9459135480_22.1422143633-20190923_consensus", "20190923", None), ("tile-20190507-20190509", "20190507/20190509", None), ("labels_042", None, "042"), ("plain", None, None)]
    with pytest.raises(Exception, match="no key"):
        df.select(strings.extract_key(df.p, r"(\d+)\.txt$", strict=True)).collect()


def test_names(spark):
    df = spark.createDataFrame([(" 7lns", "Train"), ("T47NPK", " valid\t"), ("MGRS-30LZH", "TESTING"), ("07H DF", "unassigned"), ("??", ""), (None, None)], "t string, s string")
    got = [tuple(r) for r in df.select(names.tile_code(df.t, F.lit("x/S2A_MSIL1C_20230104T185320_N0212_R135_T47NPK_20230105T030056.SAFE")), names.split_name(df.s)).collect()]
    assert got == [("07LNS", "train"), ("47NPK", "val"), ("30LZH", "test"), ("07HDF", None), ("47NPK", None), ("47NPK", None)]


def test_zones_and_projection(spark):
    df = spark.createDataFrame([(13.0, 52.0), (110.43, -7.12), (0.0, 85.0), (0.0, -81.0), (190.0, 0.0), (180.0, 10.0)], "x double, y double")
    got = df.select(geo.utm_epsg(df.x, df.y), geo.wrap_longitude(df.x), *geo.utm_forward(df.x, df.y)).collect()
    assert [r[0] for r in got] == [32633, 32749, 5041, 5042, 32660, 32660]
    assert [r[1] for r in got][-2:] == [-170.0, -180.0]
    assert abs(got[0][2] - 362705.63) < 0.01
    # on the central meridian the northing is the scaled length of the meridian's arc
    e2 = 0.0066943799901413165
    steps = np.radians((np.arange(200_000) + 0.5) * 52 / 200_000)
    arc = float((6378137.0 * (1 - e2) / (1 - e2 * np.sin(steps) ** 2) ** 1.5).sum() * np.radians(52 / 200_000))
    mid = spark.createDataFrame([(15.0, 52.0), (15.0, -52.0)], "x double, y double")
    north, south = mid.select(*geo.utm_forward(mid.x, mid.y)).collect()
    assert abs(north[0] - 500000) < 1e-6 and abs(north[1] - 0.9996 * arc) < 1e-3 and abs(south[1] - (1e7 - 0.9996 * arc)) < 1e-3
    half = spark.createDataFrame([(-25.5850655,), (0.0000005,), (2.5,), (-0.0,)], "v double")
    assert [r[0] for r in half.select(geo.fixed_text(half.v, 6)).collect()] == [f"{v:.6f}" for v in (-25.5850655, 0.0000005, 2.5)] + ["0.000000"]
    assert [r[0] for r in half.select(geo.fixed_text(half.v, 1)).collect()][2] == "2.5"


def test_classes(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(12)], "c int, v double")
    assert [r[0] for r in df.select(classes.scl_mask(df.c)).collect()] == [True, True, False, True, False, False, False, False, True, True, True, False]
    assert [r[0] for r in df.where("c < 2").select(classes.remap(df.c, {0: 1, 1: 2})).collect()] == [2, 2]
    assert df.select(classes.colorize(df.c, {0: "#ff0000"}), classes.hex_channel(F.lit("#ff8001"), 1)).first()[:] == ("#ff0000", 128)
    b = spark.createDataFrame([(0.5, 0.5, 0.2, 0.2)], "cx double, cy double, w double, h double")
    assert [round(x) for x in b.select(*classes.yolo_to_corners(b.cx, b.cy, b.w, b.h, 200.0, 100.0)).first()] == [80, 40, 120, 60]
    assert classes.default_nodata("uint16") == 65535
    with pytest.raises(ValueError):
        classes.default_nodata("bool")
