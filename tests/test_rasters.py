import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from terrafold.functions import indices
from terrafold.operators import components, focal, grid, patches


def test_hand_values(spark):
    df = spark.createDataFrame([(0.5, 0.1)], "nir double, red double")
    got = {n: df.select(indices.index(n, {"nir": "nir", "red": "red"})).first()[0] for n in ("ndvi", "evi2", "savi", "msavi2")}
    assert {k: round(v, 6) for k, v in got.items()} == {"ndvi": 0.666666, "evi2": 0.574712, "savi": 0.545454, "msavi2": 0.552786}
    assert spark.createDataFrame([(-5e-7, -5e-7)], "nir double, red double").select(indices.index("ndvi", {"nir": "nir", "red": "red"})).first()[0] is None
    with pytest.raises(ValueError):
        indices.index("ndvi", {"nir": "nir"})
    with pytest.raises(ValueError):
        indices.index("nope", {})


def pixels(spark, a, **extra):
    return spark.createDataFrame([(1, int(y), int(x), float(v)) for (y, x), v in np.ndenumerate(a)], "g int, y int, x int, value double")


def symmetric_box(a, side=7):
    r = side // 2
    p = np.pad(a, r, mode="symmetric")
    return np.array([[p[y : y + side, x : x + side].mean() for x in range(a.shape[1])] for y in range(a.shape[0])])


def test_filters_match_padded_arrays(spark):
    a = np.random.default_rng(5).normal(size=(11, 9))
    got = {(r.y, r.x): r.variance for r in focal.box_variance(pixels(spark, a), ["g"], "value", F.lit(11), F.lit(9)).collect()}
    want = symmetric_box(a * a) - symmetric_box(a) ** 2
    assert len(got) == 99 and all(abs(got[k] - v) < 1e-9 for k, v in np.ndenumerate(want))
    w = np.array(focal.gaussian_weights())
    p = np.pad(a, 4, mode="symmetric")
    p = np.array([[p[y : y + 9, x] @ w for x in range(p.shape[1])] for y in range(11)])
    want = np.array([[p[y, x : x + 9] @ w for x in range(9)] for y in range(11)])
    got = {(r.y, r.x): r.value for r in focal.gaussian(pixels(spark, a), ["g"], ["value"], F.lit(11), F.lit(9)).collect()}
    assert all(abs(got[k] - v) < 1e-9 for k, v in np.ndenumerate(want))


def test_patches_and_stitching(spark):
    assert patches.positions(10, 4, 0.5) == [0, 2, 4, 6] and patches.positions(9, 4, 0.5) == [0, 2, 4, 5]
    a = np.random.default_rng(6).normal(size=(8, 8))
    p = patches.split_patches(pixels(spark, a), ["g"], height=8, width=8, size=4, overlap=0.5, pad=2)
    q = np.pad(a, 2, mode="reflect")
    for r in p.collect():
        assert abs(r.value - q[r.row + r.py, r.col + r.px]) < 1e-12
    assert p.count() == 25 * 16
    s = {(r.y, r.x): r.value for r in patches.stitch_patches(p.drop("y", "x"), ["g"], height=8, width=8, size=4, pad=2).collect()}
    assert all(abs(s[k] - v) < 1e-3 * max(1, abs(v)) for k, v in np.ndenumerate(a))
    with pytest.raises(ValueError):
        patches.grid_size(0)


def test_mosaics_take_valid_pixels(spark):
    df = spark.createDataFrame([(0, 0, 1, None), (0, 0, 2, 5.0), (0, 0, 3, 7.0), (0, 1, 1, None), (1, 0, 2, 3.0), (1, 0, 1, 9.0)], "y int, x int, tile_ord int, value double")
    got = {m: [r.value for r in grid.mosaic(df, ["y", "x"], method=m).orderBy("y", "x").collect()] for m in grid.MOSAIC}
    assert got == {"first": [5.0, None, 9.0], "last": [7.0, None, 3.0], "min": [5.0, None, 3.0], "max": [7.0, None, 9.0], "sum": [12.0, None, 12.0], "count": [2, 0, 2]}
    assert [r.value for r in grid.mosaic_with(df, ["y", "x"], lambda a: (~np.isnan(a)).sum(axis=1)).orderBy("y", "x").collect()] == [2.0, 0.0, 2.0]
    with pytest.raises(ValueError):
        grid.mosaic(df, ["y"], method="median")


def test_windows_chunks_shadow_and_clip(spark):
    e = spark.createDataFrame([("a", 0, 0, 32, 32), ("a", 0, 10, 32, 42), ("b", 0, 0, 5, 5), ("b", 5, 0, 9, 9)], "k string, y0 int, x0 int, y1 int, x1 int")
    assert rows(grid.common_window(e, ["k"])) == [("a", 0, 10, 32, 32)]
    c = grid.chunk_cells(spark.createDataFrame([(70, 33)], "width int, height int"), 32)
    assert rows(c, "cy", "cx", "h", "w") == [(0, 0, 32, 32), (0, 1, 32, 32), (0, 2, 32, 6), (1, 0, 1, 32), (1, 1, 1, 32), (1, 2, 1, 6)]
    assert grid.shadow_offsets(0, 20, 10) == [(1, 0), (2, 0)]
    s = grid.cast_shadow(spark.createDataFrame([(2, 2)], "y int, x int"), [], [(1, 0), (2, 0), (9, 0)], 5, 5)
    assert rows(s) == [(3, 2), (4, 2)]
    ring = grid.clip_ring([[0, 0], [4, 0], [4, 4], [0, 4]], 2, 2, 9, 9)
    xs, ys = zip(*ring[:-1])
    assert (min(xs), max(xs), min(ys), max(ys)) == (2, 4, 2, 4)
    assert grid.clip_ring([[0, 0], [1, 0], [1, 1]], 5, 5, 6, 6) == []


def test_resample(spark):
    a = np.arange(16.0).reshape(4, 4)
    p = pixels(spark, a)
    assert rows(grid.resample_nearest(p, ["g"], 2.0), "y", "x", "value") == [(0, 0, 5.0), (0, 1, 7.0), (1, 0, 13.0), (1, 1, 15.0)]
    fine = {(r.y, r.x): r.value for r in grid.resample_nearest(p, ["g"], 0.5).collect()}
    assert len(fine) == 64 and all(fine[k] == a[k[0] // 2, k[1] // 2] for k in fine)
    assert rows(grid.resample_mean(p, ["g"], 2), "y", "x", "value") == [(0, 0, 2.5), (0, 1, 4.5), (1, 0, 10.5), (1, 1, 12.5)]


def test_components_of_chains_copies_and_nulls(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (200, 200)], "a long, b long")
    got = dict(rows(components.connected(edges)))
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 200: 200}
    assert components.connected(edges.limit(0)).collect() == []
    boxes = spark.createDataFrame([(1, "a", 0.0, 0.0, 1.0, 1.0), (2, "a", 1.0, 1.0, 2.0, 2.0), (3, "a", 1.5, 1.5, 9.0, 9.0), (4, "b", 0.0, 0.0, 9.0, 9.0), (5, "a", 0.0, 0.0, 1.0, 1.0), (6, "a", None, 0.0, 1.0, 1.0), (7, "a", 20.0, 20.0, 21.0, 21.0)], "key long, kind string, w double, s double, e double, n double")
    for cell in (0.3, 50.0):
        assert rows(components.box_components(boxes, ["kind"], cell=cell)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 1), (6, 6), (7, 7)]
    assert rows(components.touching_boxes(boxes, ["kind"], cell=0.7, rows_per_salt=1), "a", "b") == [(1, 2), (1, 5), (2, 3), (2, 5)]


def test_boxes_over_the_line_and_of_any_size(spark):
    boxes = spark.createDataFrame(
        [(1, 179.0, 0.0, -179.0, 1.0), (2, -179.5, 0.5, -178.0, 2.0), (3, 181.5, 0.0, 183.0, 1.0), (4, 178.0, 0.0, 179.0, 0.5), (5, -180.0, -90.0, 180.0, -10.0), (6, 10.0, -10.0, 10.0, 5.0), (7, 12.0, 4.0, 13.0, 6.0), (8, 170.0, -5.0, -170.0, -20.0)],
        "key long, w double, s double, e double, n double",
    )
    want = [(1, 2), (1, 4), (2, 3), (5, 6)]
    for cell in (0.25, 3.0, 500.0):
        assert rows(components.touching_boxes(boxes, [], cell=cell, world=360.0), "a", "b") == want
        assert rows(components.touching_boxes(boxes, [], cell=cell, world=360.0, rows_per_salt=1), "a", "b") == want
    assert rows(components.touching_boxes(boxes, [], cell=0.25), "a", "b") == [(5, 6)]
    assert rows(components.box_components(boxes, [], cell=0.25, world=360.0)) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 5), (7, 7), (8, 8)]
