import json
import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import rows
from terrafold.operators import points
from terrafold.plans import dataset_queries

SCHEMA = "key long, lon double, lat double, region string"


def brute_near(pts, radius):
    out = set()
    for i, (k, x, y) in enumerate(pts):
        for k2, x2, y2 in pts[i + 1 :]:
            a = math.sin(math.radians(y2 - y) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x) / 2) ** 2
            if 2 * points.EARTH_RADIUS_M * math.asin(min(1, math.sqrt(a))) <= radius:
                out.add((min(k, k2), max(k, k2)))
    return sorted(out)


def test_near_pairs_match_brute_force_everywhere(spark):
    rng = np.random.default_rng(1)
    pts = []
    for x, y in [(0, 0), (179.9995, 10), (-180, 10), (13, 52), (10, 89.999), (-170, 89.9985), (100, -89.9999), (-20, -90), (30, 90), (359.9, 0.001)]:
        for _ in range(8):
            pts.append((float(x + rng.normal(0, 0.004)), float(min(90, max(-90, y + rng.normal(0, 0.003))))))
    pts += [pts[0]] * 3
    named = [(i, x, y) for i, (x, y) in enumerate(pts)]
    df = spark.createDataFrame([(k, x, y, "x") for k, x, y in named], SCHEMA)
    want = brute_near(named, 500.0)
    assert rows(points.near_pairs(df, 500.0), "key_a", "key_b") == want
    assert rows(points.near_pairs(df, 500.0, block_size=2), "key_a", "key_b") == want
    got = {r.key: r.n_near for r in points.near_counts(df, 500.0).collect()}
    assert got == {k: sum(k in p for p in want) for k, _, _ in named}


def test_near_pairs_of_nulls_empty_and_repeats(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, None), (1, 0.0, 0.0, None), (2, None, 0.0, ""), (3, 0.0, None, ""), (None, 0.0, 0.0, ""), (4, 0.001, 0.0, ""), (5, 0.0, 95.0, "")], SCHEMA)
    assert rows(points.near_pairs(df, 500.0), "key_a", "key_b") == [(1, 4)]
    assert points.near_pairs(df.limit(0), 500.0).collect() == []
    assert points.near_counts(df.where("key = 2"), 500.0).collect()[0].n_near == 0


def region(spark, *shapes):
    return spark.createDataFrame([(i, s if s is None or isinstance(s, str) else json.dumps(s), 1.0) for i, s in enumerate(shapes)], "region long, polygon string, lon double")


def poly(coords, crs="EPSG:4326", kind="Polygon"):
    return {"geojson": {"type": kind, "coordinates": coords}, "polygon_crs": crs}


def test_regions_with_holes_parts_and_the_date_line(spark):
    square = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    hole = [[1, 1], [3, 1], [3, 3], [1, 3], [1, 1]]
    far = [[178, -1], [182, -1], [182, 1], [178, 1], [178, -1]]
    merc = [[x * 1e5, y * 1e5] for x, y in square]
    bow = [[10, 10], [12, 12], [12, 10], [10, 12], [10, 10]]
    regions = region(spark, poly([square, hole]), poly([[square], [far]], "OGC:CRS84", "MultiPolygon"), poly([merc], "EPSG:3857"), None, "{", poly([]), poly([square], "EPSG:9999"), poly([[[0, 0], [1, None]]]), poly([bow]), "[1]", '{"geojson": "x"}')
    pts = spark.createDataFrame([(1, 0.5, 0.5, ""), (2, 2.0, 2.0, ""), (3, -179.0, 0.5, ""), (4, 181.0, 0.0, ""), (5, 5.0, 5.0, ""), (6, 11.0, 10.5, ""), (7, None, 0.0, ""), (8, 10.2, 11.0, ""), (9, 2.0, 95.0, "")], SCHEMA)
    want = [(1, 0), (1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (4, 1), (8, 8)]
    assert rows(points.containing_regions(pts, regions)) == want
    assert rows(points.containing_regions(pts, regions, broadcast_edges=0, rows_per_salt=1)) == want
    assert rows(points.unread_regions(regions)) == [(3,), (4,), (6,), (9,), (10,)]
    assert points.containing_regions(pts, regions.limit(0)).collect() == []
    assert points.containing_regions(pts.limit(0), regions).collect() == []


def even_odd(rings, x, y):
    inside = False
    for r in rings:
        for (xa, ya), (xb, yb) in zip(r, np.roll(r, -1, axis=0)):
            if (xa <= x) != (xb <= x) and ya + (x - xa) * (yb - ya) / (xb - xa) < y:
                inside = not inside
    return inside


def off_edges(rings, x, y):
    e = np.concatenate([np.concatenate([r, np.roll(r, -1, axis=0)], axis=1) for r in rings])
    e = e[(e[:, 0] != e[:, 2]) & (np.minimum(e[:, 0], e[:, 2]) <= x) & (np.maximum(e[:, 0], e[:, 2]) >= x)]
    return abs(x - round(x)) > 1e-9 and (np.abs(e[:, 1] + (x - e[:, 0]) * (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0]) - y) > 1e-9).all()


def locate(cells, x, y, world):
    """Whether a place is inside by the cells of one polygon."""
    hits = []
    for level, i, j, slabs in cells:
        size = world / 4 ** (level + 1)
        if math.floor((x + world / 2) / size) == i and math.floor(y / size) == j:
            for x0, x1, below, edges in slabs:
                if x0 <= x < x1:
                    ys = [e[1] + (x - e[0]) * (e[3] - e[1]) / (e[2] - e[0]) for e in edges]
                    assert all(b - a > -1e-9 for a, b in zip(ys, ys[1:]))
                    hits.append((below + int(np.searchsorted(ys, y))) % 2 == 1)
    assert len(hits) <= 1
    return bool(hits) and hits[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(-9, 12), st.integers(-9, 12)), min_size=3, max_size=14), min_size=1, max_size=3), st.lists(st.tuples(st.floats(-9, 11.99), st.floats(-9, 11.99)), min_size=5, max_size=5), st.sampled_from([3, 64]))
def test_cells_hold_even_odd_for_any_rings(rings, places, most):
    arrays = [np.array(r, float) for r in rings]
    before, points.CELL_EDGES, last, points.LAST_LEVEL = points.CELL_EDGES, most, points.LAST_LEVEL, 6
    try:
        cells = list(points.part_cells(arrays, 360.0))
    finally:
        points.CELL_EDGES, points.LAST_LEVEL = before, last
    for x, y in places:
        if off_edges(arrays, x, y):
            assert locate(cells, x, y, 360.0) == even_odd(arrays, x, y)


def test_a_ring_of_a_hundred_thousand_vertices_stays_small():
    t = np.linspace(0, 2 * math.pi, 100_000, endpoint=False)
    radius = 60 + 5 * np.sin(40 * t) + np.random.default_rng(5).normal(0, 0.0005, len(t))
    ring = np.stack([radius * 2 * np.cos(t), radius * np.sin(t)], axis=1)
    cells = list(points.part_cells([ring], 360.0))
    held = [sum(len(s[3]) for s in slabs) for *_, slabs in cells]
    assert sum(held) < 10 * len(ring) and max(held) < 10_000 and len(cells) < 30_000
    for x, y in np.random.default_rng(6).uniform(-130, 130, (40, 2)):
        assert not off_edges([ring], x, y) or locate(cells, x, y, 360.0) == even_odd([ring], x, y)


def test_regions_in_utm(spark):
    square = [[400000, 5500000], [600000, 5500000], [600000, 5700000], [400000, 5700000], [400000, 5500000]]
    south = [[400000, 5500000], [600000, 5500000], [600000, 9900000], [400000, 9900000], [400000, 5500000]]
    regions = region(spark, poly([square], "EPSG:32633"), poly([south], "urn:ogc:def:crs:EPSG::32701"), poly([square], "EPSG:32661"))
    pts = spark.createDataFrame([(1, 15.0, 50.5, ""), (2, 13.0, 50.5, ""), (3, 16.2, 51.0, ""), (4, -177.0, -30.0, ""), (5, 183.5, -1.5, ""), (6, 105.0, 50.5, "")], SCHEMA)
    assert rows(points.containing_regions(pts, regions)) == [(1, 0), (3, 0), (4, 1), (5, 1)]
    assert rows(points.unread_regions(regions)) == [(2,)]


def test_locations_of_footprints(spark):
    df = spark.createDataFrame(
        [(1, [179.0, 0.0, -179.0, 2.0], None), (2, None, [[350.0, 1.0], [352.0, 3.0]]), (3, None, None), (4, [10.0, 0.0, 12.0, None], [[1.0, 1.0]]), (5, [1.0], [[]]), (6, None, [])],
        "k int, bbox array<double>, coordinates array<array<double>>",
    )
    lon, lat = points.footprint_location(df.bbox, df.coordinates)
    assert rows(df.select("k", lon.alias("x"), lat.alias("y")).where("x IS NOT NULL")) == [(1, -180.0, 1.0), (2, -9.0, 2.0), (4, 1.0, 1.0)]


def test_location_queries_take_footprints_without_a_bbox(spark, tmp_path):
    d, t = str(tmp_path), "timestamp_ntz '2020-03-04 05:00:00'"
    spark.sql(f"""SELECT * FROM VALUES (1L, 'a', array(10.0D, 50.0D, 12.0D, 52.0D), NULL, {t}), (2L, 'b', NULL, array(array(190.0D, -2.0D), array(192.0D, -4.0D)), {t}),
        (3L, 'a', NULL, array(array(-100.0D, 1.0D), array(-98.0D, 3.0D)), {t}), (4L, 'c', NULL, NULL, {t}), (5L, 'd', array(179.0D, 0.0D, -179.0D, 2.0D), array(array(0.0D, 0.0D)), {t})
        AS t(footprint_id, anchor_id, bbox, coordinates, created_at)""").write.parquet(f"{d}/footprints.parquet")
    spark.sql(f"SELECT * FROM VALUES ('a', {t}), ('b', {t}), ('c', {t}) AS t(anchor_id, ts)").write.parquet(f"{d}/scenes.parquet")
    q = lambda name: dataset_queries.QUERIES[name](spark, d)
    assert rows(q("utm_zone"), "footprint_id", "epsg", "lon") == [(1, 32632, 11.0), (2, 32702, -169.0), (3, 32614, -99.0), (5, 32601, -180.0)]
    for name in ("utm_coordinates", "anchor_stem", "coordinate_text", "time_loc_encoding"):
        assert rows(q(name), "footprint_id") == [(1,), (2,), (3,), (5,)]
    # -99 degrees is the least longitude of a, -169 the one of b: both are the day before
    assert [(r.anchor_id, r.day.day, r.n) for r in q("solar_days").orderBy("anchor_id").collect()] == [("a", 3, 1), ("b", 3, 1)]
