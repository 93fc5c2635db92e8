import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from terrafold.functions import geo, planes
from terrafold.operators import warp

GRID = "epsg int, minx double, maxy double, res double, height int, width int"


def test_planes_and_back(spark):
    rng = np.random.default_rng(4)
    pts = [(float(x), float(y), 32601 + int((x + 180) // 6) if y >= 0 else 32701 + int((x + 180) // 6)) for x, y in zip(rng.uniform(-180, 180, 60), rng.uniform(-79, 83, 60))]
    pts += [(float(x), float(y), 5041 if y > 0 else 5042) for x, y in zip(rng.uniform(-180, 180, 20), rng.choice([-89.0, -81.5, 84.5, 88.0], 20))] + [(10.0, 50.0, 3857), (-170.0, -60.0, 4326), (3.0, 0.0, 32631), (178.0, 10.0, 32601)]
    lon, lat, epsg = (np.array(c) for c in zip(*pts))
    lon2, lat2 = planes.unproject(*planes.project(lon, lat, epsg), epsg)
    assert (np.abs(lon - lon2) * np.cos(np.radians(lat)) < 1e-7).all() and (np.abs(lat - lat2) < 1e-7).all()
    # known values: the middle of a zone on the equator, and the pole
    x, y = planes.project(np.array([3.0, 0.0, 0.0, 0.0, 1.0]), np.array([0.0, 90.0, -90.0, 84.0, 1.0]), np.array([32631, 5041, 5042, 5041, 9999]))
    assert np.allclose(x[:3], [500000, 2e6, 2e6]) and np.allclose(y[:3], [0, 2e6, 2e6]) and abs(y[3] - 1333272.0) < 300 and np.isnan(x[4])
    df = spark.createDataFrame(pts, "lon double, lat double, epsg int").where("epsg > 32600")
    e, n = geo.utm_forward(F.col("lon"), F.col("lat"), F.col("epsg"))
    got = df.select("lon", "lat", "epsg", e.alias("e"), n.alias("n"))
    back = geo.utm_inverse(F.col("e"), F.col("n"), F.col("epsg"))
    for r in got.select("*", back[0].alias("lon2"), back[1].alias("lat2")).collect():
        assert abs(r.lon - r.lon2) * math.cos(math.radians(r.lat)) < 1e-7 and abs(r.lat - r.lat2) < 1e-7
        assert np.allclose([v[0] for v in planes.project(np.array([r.lon]), np.array([r.lat]), np.array([r.epsg]))], [r.e, r.n], atol=1e-6)


def test_wgs84_box_over_the_line(spark):
    g = spark.createDataFrame([("a", 32660, 700000.0, 10000.0, 10.0, 1000, 20000), ("b", 32633, 400000.0, 5600000.0, 10.0, 500, 500)], "k string, " + GRID)
    got = {r.k: r.wgs84 for r in warp.with_bounds(g).collect()}
    assert got["a"].w < 180 < got["a"].e and got["a"].e - got["a"].w < 2
    assert 13.5 < got["b"].w < got["b"].e < 13.8 and 50 < got["b"].s < got["b"].n < 51


def pix(a, *names):
    return [(*names, int(y), int(x), float(v)) for (y, x), v in np.ndenumerate(a)]


def test_warp_in_one_plane_is_resampling(spark):
    a = np.arange(36, dtype=float).reshape(6, 6)
    p = spark.createDataFrame(pix(a, "t") + [("t", 0, 0, None)], "k string, y int, x int, value double").where("NOT (y = 5 AND x = 5)")
    src = spark.createDataFrame([("t", 32633, 0.0, 60.0, 10.0, 6, 6), ("u", 32633, 0.0, 60.0, 10.0, 6, 6)], "k string, " + GRID)
    dst = spark.createDataFrame([("t", 32633, -20.0, 60.0, 20.0, 3, 4)], "k string, " + GRID)
    got = {(r.y, r.x): r.value for r in warp.warp(p, src, dst, ["k"]).collect()}
    assert got == {(y, x + 1): a[2 * y + 1, 2 * x + 1] for y in range(3) for x in range(3) if (y, x) != (2, 2)}
    got = {(r.y, r.x): r.value for r in warp.warp(p, src, dst, ["k"], method="bilinear").collect()}
    assert got[0, 1] == a[:2, :2].mean() and got[2, 3] == pytest.approx((a[4, 4] + a[4, 5] + a[5, 4]) / 3)
    with pytest.raises(ValueError):
        warp.warp(p, src, dst, ["k"], method="cubic")


def test_warp_across_planes_agrees_pixel_by_pixel(spark):
    a = np.random.default_rng(1).uniform(0, 1, (40, 40))
    p = spark.createDataFrame(pix(a, "t", "red"), "k string, band string, y int, x int, value double")
    src = spark.createDataFrame([("t", 32633, 499800.0, 5600200.0, 10.0, 40, 40)], "k string, " + GRID)
    dst = warp.grids_in(src, 4326, 0.0002)
    g = dst.first()
    assert g.height * g.width > 100
    got = {(r.y, r.x): r.value for r in warp.warp(p, src, dst, ["k"], extra=["band"]).collect()}
    cells = spark.createDataFrame([(y, x, g.minx + (x + 0.5) * g.res, g.maxy - (y + 0.5) * g.res) for y in range(g.height) for x in range(g.width)], "y int, x int, lon double, lat double")
    e, n = geo.utm_forward(F.col("lon"), F.col("lat"), F.lit(32633))
    want = {}
    for r in cells.select("y", "x", e.alias("e"), n.alias("n")).collect():
        i, j = math.floor((5600200.0 - r.n) / 10), math.floor((r.e - 499800.0) / 10)
        if 0 <= i < 40 and 0 <= j < 40:
            want[r.y, r.x] = a[i, j]
    assert got == want and len(want) > 80


def test_tiles_must_agree_or_are_warped(spark):
    grids = spark.createDataFrame(
        [("a", "l1", 32633, 0.0, 40.0, 10.0, 4, 4), ("a", "l2", 32633, 20.0, 50.0, 10.0, 4, 4), ("b", "l1", 32633, 0.0, 40.0, 10.0, 4, 4), ("b", "l2", 32634, 0.0, 40.0, 10.0, 4, 4), ("c", "l1", 32633, 0.0, 40.0, 10.0, 4, 4), ("c", "l2", 32633, 0.0, 40.0, 20.0, 4, 4), ("d", "l1", 32633, 0.0, 40.0, 10.0, 4, 4), ("d", "l2", 32633, 5.0, 40.0, 10.0, 4, 4), ("e", "l1", 32633, 0.0, 40.0, 10.0, 4, 4), ("e", "l2", 32633, 40.0, 40.0, 10.0, 4, 4)],
        "g string, layer string, " + GRID,
    )
    assert rows(warp.grid_problems(grids, ["g"])) == [("b", "planes differ"), ("c", "resolutions differ"), ("d", "off grid"), ("e", "no overlap")]
    a = np.arange(16, dtype=float).reshape(4, 4)
    p = spark.createDataFrame(pix(a, "a", "l1") + pix(a + 100, "a", "l2"), "g string, layer string, y int, x int, value double")
    got = {(r.layer, r.y, r.x): r.value for r in warp.align_spatial(p, grids.where("g = 'a'"), ["g"]).collect()}
    want = {("l1", y, x): a[y, x + 2] for y in range(3) for x in range(2)} | {("l2", y, x): 100 + a[y + 1, x] for y in range(3) for x in range(2)}
    assert got == want
    m = {(r.y, r.x): r.value for r in warp.mosaic_spatial(p, grids.where("g = 'a'"), ["g"], tile="layer").collect()}
    assert m[0, 2] == 100 and m[1, 2] == a[0, 2] and m[1, 4] == 106 and len(m) == 32 - 6
    with pytest.raises(Exception, match="planes differ"):
        warp.mosaic_spatial(p.withColumn("g", F.lit("b")), grids.where("g = 'b'"), ["g"], tile="layer").collect()
    fixed = warp.mosaic_spatial(p.withColumn("g", F.lit("c")), grids.where("g = 'c'"), ["g"], tile="layer", epsg=32633, res=10.0)
    assert fixed.count() == 64


def test_items_load_onto_anchors(spark):
    a = np.full((4, 4), 1.0)
    p = spark.createDataFrame(pix(a, "i1", "red") + pix(a * 2, "i2", "red") + pix(a * 9, "i1", "nir"), "item_id string, band string, y int, x int, value double")
    items = spark.sql("SELECT * FROM VALUES ('i1', 'A', timestamp_ntz '2020-01-01 10:00:00', 32633, 0.0D, 40.0D, 10.0D, 4, 4), ('i2', 'A', timestamp_ntz '2020-01-01 09:00:00', 32633, 20.0D, 40.0D, 10.0D, 4, 4) AS t(item_id, anchor_id, ts, epsg, minx, maxy, res, height, width)")
    anchors = spark.createDataFrame([("A", 32633, 0.0, 40.0, 10.0, 4, 4), ("B", 32633, 0.0, 40.0, 10.0, 4, 4)], "anchor_id string, " + GRID)
    got = {(r.x, r.value) for r in warp.load_onto(p, items, anchors, bands=["red"], group=F.to_date("ts"), method="nearest").collect()}
    assert got == {(0, 1.0), (1, 1.0), (2, 2.0), (3, 2.0)}
    assert warp.load_onto(p, items, anchors, bands=["red"]).select("group").distinct().count() == 2
