"""Points near other points, and the regions that contain them.

Regions are cut by trapezoidal decomposition: the x of every vertex ends a slab, inside a slab the edges
that cross it never meet, so they have one order from below. A point is located by finding its slab and
binary searching its edges; an odd number of edges below it means inside. The decomposition is made within
the cells of a grid that is as fine as a region's size and, where its edges are dense, its edges ask for: a
cell holds the slabs and edges inside it and knows how many edges lie below. Cells are distributed, points
go to the cells they lie in, so locating is one equi-join and meets each part of a region at most once.

Near pairs use latitude slabs of the search radius, each cut into longitude segments several times as wide as the
radius is there. A segment's points are ordered by longitude; a point goes to the one or two segments of its own
slab and of the next that its reach lies in, and finds its partners there by binary search. Segments with many
points are kept in several blocks, so no task has to pair a hot place alone.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafold.functions.geo import utm_forward, wrap_longitude
from terrafold.session import broadcast_if_small, cut, salt_of

EARTH_RADIUS_M = 6371008.8
MERCATOR_RADIUS_M = 6378137.0

#: Width of a plane's world: the root of its cells. In degrees and in web Mercator x and x plus or minus one world are one
#: place; the planes of UTM zones don't repeat and their root is only wide enough.
WORLD = {"deg": 360.0, "merc": 2 * math.pi * MERCATOR_RADIUS_M, "utm": float(1 << 26)}
#: Fixed spellings of the CRS names that are understood, beside EPSG:326zz and EPSG:327zz of the UTM zones.
CRS_KIND = {"EPSG:4326": "deg", "OGC:CRS84": "deg", "CRS84": "deg", "EPSG:3857": "merc"}

#: Points farther from the middle of a UTM zone than this, in degrees of longitude, are in no region of that zone.
UTM_REACH = 30.0

#: A cell is cut into 4 by 4 while it holds more edges than this, down to the last level.
CELL_EDGES, LAST_LEVEL = 64, 12


def plane_of(crs: str | None) -> str | None:
    """'deg', 'merc', the EPSG number of a UTM zone, or None for a CRS that isn't understood; no CRS is EPSG:4326."""
    name = re.sub(r"^URN:OGC:DEF:CRS:(EPSG|OGC):[^:]*:", r"\1:", (crs or "EPSG:4326").strip().upper())
    zone = re.fullmatch(r"EPSG:(32[67])(\d\d)", name)
    return zone[1] + zone[2] if zone and 1 <= int(zone[2]) <= 60 else CRS_KIND.get(name)


def world_of(plane: str) -> float:
    return WORLD[plane if plane in WORLD else "utm"]


def footprint_location(bbox: Column, coordinates: Column) -> tuple[Column, Column]:
    """(lon, lat) of the middle of the bbox, else of the box around the coordinates, else nulls.

    A bbox with west > east crosses the 180 degree line. A bbox without four finite numbers counts as none.
    """
    w, s, e, n = (F.get(bbox, F.lit(i)) for i in range(4))
    whole = bbox.isNotNull() & (w + s + e + n).isNotNull() & ~F.isnan(w + s + e + n)
    bl = F.when(w > e, (w + e + 360.0) / 2).otherwise((w + e) / 2)
    xs = F.filter(F.transform(coordinates, lambda p: F.get(p, F.lit(0))), lambda v: v.isNotNull())
    ys = F.filter(F.transform(coordinates, lambda p: F.get(p, F.lit(1))), lambda v: v.isNotNull())
    lon = F.when(whole, bl).otherwise((F.array_min(xs) + F.array_max(xs)) / 2)
    lat = F.when(whole, (s + n) / 2).otherwise((F.array_min(ys) + F.array_max(ys)) / 2)
    return wrap_longitude(lon), lat


def great_circle_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Haversine distance in metres on the mean sphere."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


# --- near -----------------------------------------------------------------------------------------


#: How many times as wide as the radius a segment is at least.
SEGMENT_REACHES = 8


def _reach(slab: Column, radius_m: float, height: float) -> Column:
    """Degrees of longitude that the radius spans in a slab, at most 360.

    It is taken at the slab's far neighbour edge (one slab nearer to the pole), so it holds for pairs of which one point
    lies in this slab and the other in it or in a slab beside it.
    """
    low, high = slab * height - 90.0 - height, (slab + 1) * height - 90.0 + height
    far = F.least(F.lit(90.0), F.greatest(F.abs(low), F.abs(high)))
    x = F.lit(math.sin(radius_m * 1.000001 / (2 * EARTH_RADIUS_M))) / F.greatest(F.cos(F.radians(far)), F.lit(1e-9))
    return F.when(x >= 1.0, F.lit(360.0)).otherwise(F.degrees(2 * F.asin(F.least(x, F.lit(1.0)))))


def near_pairs(points: DataFrame, radius_m: float, *, key: str = "key", lon: str = "lon", lat: str = "lat", block_size: int = 256) -> DataFrame:
    """Pairs (key_a < key_b, distance_m) of points at most ``radius_m`` apart on the sphere.

    Rows with a null key or coordinate, or a latitude beyond 90, have no place and no pair. Keys are taken as
    unique; a row given twice is dropped once. Longitudes may be in any convention. Other columns are ignored.
    Segments with more than ``block_size`` points are cut into blocks of about that size, each of which every point with
    a partner there meets; nothing is left out.
    """
    height = math.degrees(radius_m * 1.000001 / EARTH_RADIUS_M)
    n_slabs = math.ceil(180.0 / height)
    pts = points.select(F.col(key).alias("k"), wrap_longitude(F.col(lon).cast("double")).alias("x"), F.col(lat).cast("double").alias("y"))
    pts = pts.where(F.col("k").isNotNull() & F.col("x").isNotNull() & F.col("y").between(-90.0, 90.0)).dropDuplicates(["k"])
    pts = pts.withColumn("slab", F.least(F.floor((F.col("y") + 90.0) / height), F.lit(n_slabs - 1)).cast("long"))
    pts = pts.withColumn("reach", _reach(F.col("slab"), radius_m, height)).withColumn("reach_up", _reach(F.col("slab") + 1, radius_m, height))
    count = lambda reach: F.greatest(F.lit(1), F.floor(F.lit(360.0 / SEGMENT_REACHES) / reach)).cast("long")
    pts = pts.withColumn("n", count(F.col("reach"))).withColumn("n_up", count(F.col("reach_up")))
    place = lambda x, n: F.least(F.floor((x + 180.0) / 360.0 * n), n - 1).cast("long")
    # placed once, then read by the count of hot segments, the blocks and the probes
    pts = cut(pts.withColumn("seg", place(F.col("x"), F.col("n"))))

    def targets(slab: Column, n: Column) -> Column:
        """The segments of a slab that the point's reach lies in, with the longitudes between which its partners are there."""
        west, east = F.col("x") - F.col("reach"), F.col("x") + F.col("reach")
        turn_w, turn_e = F.when(west < -180.0, 360.0).otherwise(0.0), F.when(east >= 180.0, -360.0).otherwise(0.0)
        part = lambda g, lo, hi: F.struct(slab.alias("slab"), g.alias("seg"), lo.alias("lo"), hi.alias("hi"))
        a, b = place(west + turn_w, n), place(east + turn_e, n)
        whole = F.array(part(F.lit(0).cast("long"), F.lit(-1e9), F.lit(1e9)))
        one, two = part(a, west + turn_w, east + turn_w), part(b, west + turn_e, east + turn_e)
        return F.when(n == 1, whole).when(a == b, F.array(one)).otherwise(F.array(one, two))

    up = F.col("slab") + 1
    hot = pts.groupBy("slab", "seg").agg(F.count("*").alias("c")).where(F.col("c") > block_size)
    hot = cut(hot.select("slab", "seg", F.ceil(F.col("c") / block_size).cast("int").alias("blocks")))
    blocks = F.coalesce(F.col("blocks"), F.lit(1))
    home = pts.join(hot, ["slab", "seg"], "left").withColumn("block", salt_of(F.col("k"), blocks))
    home = home.groupBy("slab", "seg", "block").agg(F.array_sort(F.collect_list(F.struct("x", "y", "k"))).alias("held"))
    probe = pts.select("k", "x", "y", F.col("slab").alias("own"), F.explode(F.concat(targets(F.col("slab"), F.col("n")), F.when(up < n_slabs, targets(up, F.col("n_up"))).otherwise(F.array()))).alias("t"))
    probe = probe.select("k", "x", "y", "own", "t.*").join(hot, ["slab", "seg"], "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("blocks")
    met = probe.join(home, ["slab", "seg", "block"])
    size = F.size("held")
    met = met.withColumn("first", _search(F.lit(0), size, _steps(size), lambda i: F.get("held", i)["x"] < F.col("lo")))
    met = met.withColumn("end", _search(F.col("first"), size, _steps(size - F.col("first")), lambda i: F.get("held", i)["x"] <= F.col("hi")))
    around = F.filter(F.slice("held", F.col("first") + 1, F.col("end") - F.col("first")), lambda p: ((F.col("own") != F.col("slab")) | (F.col("k") < p["k"])) & (F.abs(p["y"] - F.col("y")) <= height))
    pairs = met.where("end > first").select("k", "x", "y", F.explode(around).alias("p")).select("k", "x", "y", F.col("p.k").alias("kb"), F.col("p.x").alias("xb"), F.col("p.y").alias("yb"))
    pairs = pairs.withColumn("distance_m", great_circle_m(F.col("x"), F.col("y"), F.col("xb"), F.col("yb"))).where(F.col("distance_m") <= radius_m)
    return pairs.select(F.least("k", "kb").alias("key_a"), F.greatest("k", "kb").alias("key_b"), "distance_m")


def near_counts(points: DataFrame, radius_m: float, *, key: str = "key", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One row per point (key, place_key, n_same_place, n_near): the points within the radius, itself excluded.

    Points of one and the same place are joined as one with their number, so copies are never paired up.
    Points without a place get nulls for place_key and 0 for both counts.
    """
    pts = points.select(F.col(key).alias("key"), wrap_longitude(F.col(lon).cast("double")).alias("lon"), F.col(lat).cast("double").alias("lat"))
    placed = F.col("lon").isNotNull() & F.col("lat").between(-90.0, 90.0)
    # + 0.0 makes -0.0 and 0.0 one place
    spots = pts.where(placed).groupBy((F.col("lon") + 0.0).alias("lon"), (F.col("lat") + 0.0).alias("lat")).agg(F.min("key").alias("place_key"), F.count("*").alias("n"))
    pairs = near_pairs(spots, radius_m, key="place_key")
    n = spots.select(F.col("place_key").alias("other"), "n")
    both = pairs.select(F.col("key_a").alias("place_key"), F.col("key_b").alias("other")).unionAll(pairs.select(F.col("key_b").alias("place_key"), F.col("key_a").alias("other")))
    around = both.join(n, "other").groupBy("place_key").agg(F.sum("n").alias("around"))
    spots = spots.join(around, "place_key", "left").select("lon", "lat", "place_key", F.col("n").alias("n_same"), F.coalesce("around", F.lit(0)).alias("around"))
    out = pts.join(spots.withColumnsRenamed({"lon": "slon", "lat": "slat"}), ((F.col("lon") + 0.0) == F.col("slon")) & ((F.col("lat") + 0.0) == F.col("slat")), "left")
    return out.select("key", "place_key", F.coalesce(F.col("n_same") - 1, F.lit(0)).alias("n_same_place"), F.coalesce(F.col("n_same") - 1 + F.col("around"), F.lit(0)).alias("n_near"))


# --- inside ---------------------------------------------------------------------------------------

_CELLS = T.StructType(
    [
        T.StructField("region", T.LongType()),
        T.StructField("plane", T.StringType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("cx", T.LongType()),
        T.StructField("cy", T.LongType()),
        T.StructField("shift", T.DoubleType()),
        T.StructField("xs", T.ArrayType(T.DoubleType())),
        T.StructField("starts", T.ArrayType(T.IntegerType())),
        T.StructField("below", T.ArrayType(T.IntegerType())),
        T.StructField("edges", T.ArrayType(T.ArrayType(T.DoubleType()))),
    ]
)


def _parts(text: str | None) -> tuple[str, list[list[list]]] | None:
    """(plane, polygons as lists of rings) of a polygon's JSON text; None for anything that isn't one."""
    try:
        doc = json.loads(text) if text else None
        shape = doc.get("geojson") if isinstance(doc, dict) else None
        plane = plane_of(str(doc.get("polygon_crs") or "EPSG:4326")) if shape else None
        if not plane or not isinstance(shape, dict):
            return None
        if shape.get("type") == "Polygon":
            return plane, [shape["coordinates"]]
        if shape.get("type") == "MultiPolygon":
            return plane, list(shape["coordinates"])
    except (ValueError, KeyError, TypeError, AttributeError):
        pass
    return None


def _ordered(a: float, b: float, e: np.ndarray) -> Iterator[tuple[float, float, np.ndarray]]:
    """(x0, x1, edges from below) of a slab; it is cut again where edges cross inside it, as those of rings that cross themselves do."""
    todo = [(a, b)]
    slope = (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
    tol = 1e-12 * max(1.0, float(np.abs(e).max())) if len(e) else 0.0
    at = lambda x: e[:, 1] + (x - e[:, 0]) * slope
    while todo:
        a, b = todo.pop()
        order = np.lexsort((slope, at((a + b) / 2)))
        left, right = at(a)[order], at(b)[order]
        if (np.diff(left) < -tol).any() or (np.diff(right) < -tol).any():
            with np.errstate(divide="ignore", invalid="ignore"):
                x = a - (at(a)[:, None] - at(a)[None, :]) / (slope[:, None] - slope[None, :])
            x = np.unique(x[np.isfinite(x) & (x > a) & (x < b)])
            x = x[(x - a > 1e-12 * (b - a)) & (b - x > 1e-12 * (b - a))]
            if len(x):
                stops = [a, *x.tolist(), b]
                todo.extend(reversed(list(zip(stops[:-1], stops[1:]))))
                continue
        yield a, b, e[order]


def cell_slabs(x0: float, x1: float, y0: float, y1: float, e: np.ndarray, upright: np.ndarray, most: int | None = None) -> list[tuple[float, float, int, np.ndarray]] | None:
    """Slabs (x0, x1, edges below the cell, edges from below) of the cell [x0, x1] by [y0, y1]; None if more than ``most`` edges lie in it.

    ``e`` are all edges [xa, ya, xb, yb], xa < xb, of a part that overlap the cell's columns, at any height, ``upright``
    the vertical ones as [x, low, high]. Only the parity of the edges below counts, so it is 0 or 1. From one slab to the
    next it changes where an edge crosses the cell's lower side.
    """
    slope = (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
    at = lambda x, i=slice(None): e[i, 1] + (x - e[i, 0]) * slope[i]
    left, right = np.maximum(e[:, 0], x0), np.minimum(e[:, 2], x1)
    ya, yb = at(left), at(right)
    inside = np.flatnonzero((np.maximum(ya, yb) >= y0) & (np.minimum(ya, yb) <= y1))
    if most is not None and len(inside) > most:
        return None
    stand = upright[(upright[:, 0] > x0) & (upright[:, 0] < x1) & (upright[:, 1] <= y1) & (upright[:, 2] >= y0)]
    over = inside[(e[inside, 1] < y0) != (e[inside, 3] < y0)]
    crossings = np.sort(np.concatenate([e[over, 0] + (y0 - e[over, 1]) / slope[over], stand[(stand[:, 1] < y0) & (stand[:, 2] >= y0), 0]]))
    crossings = crossings[(crossings > x0) & (crossings < x1)]
    xs = np.unique(np.concatenate([[x0, x1], left[inside], right[inside], stand[:, 0], crossings]))
    mids = (xs[:-1] + xs[1:]) / 2
    first = int(((e[:, 0] <= mids[0]) & (e[:, 2] > mids[0]) & (at(mids[0]) < y0)).sum())
    under = first + np.searchsorted(crossings, xs[:-1], side="right")
    out: list[tuple[float, float, int, np.ndarray]] = []
    last = None
    for a, b, m, n in zip(xs[:-1].tolist(), xs[1:].tolist(), mids.tolist(), under.tolist()):
        i = inside[(e[inside, 0] <= a) & (e[inside, 2] >= b)]
        pa, pb = at(a, i), at(b, i)
        i = i[(np.maximum(pa, pb) >= y0) & (np.minimum(pa, pb) <= y1)]
        n = (n - int((at(m, i) < y0).sum())) % 2
        if last is not None and n == last[0] and np.array_equal(i, last[1]) and len(i) < 2:
            out[-1] = (out[-1][0], b, n, out[-1][3])
            continue
        last = (n, i)
        out.extend((u, v, n, edges) for u, v, edges in _ordered(a, b, e[i]))
    return out


def part_cells(rings: list[np.ndarray], world: float) -> Iterator[tuple[int, int, int, list]]:
    """(level, column, row, slabs) of the cells of one polygon that hold edges or lie inside; columns count from the world's west end.

    The first level is the one whose cells are an eighth to a half of the polygon's extent.
    """
    e = [np.concatenate([r, np.roll(r, -1, axis=0)], axis=1) for r in rings if len(r) >= 3]
    if not e:
        return
    e = np.concatenate(e)
    u = e[e[:, 0] == e[:, 2]]
    upright = np.stack([u[:, 0], np.minimum(u[:, 1], u[:, 3]), np.maximum(u[:, 1], u[:, 3])], axis=1)
    e = e[e[:, 0] != e[:, 2]]
    if not len(e):
        return
    swap = e[:, 0] > e[:, 2]
    e[swap] = e[swap][:, [2, 3, 0, 1]]
    w, s, r, n = e[:, 0].min(), e[:, [1, 3]].min(), e[:, 2].max(), e[:, [1, 3]].max()
    start = min(LAST_LEVEL, max(0, math.ceil(math.log(2 * world / max(r - w, n - s), 4)) - 1))
    size = world / 4 ** (start + 1)
    columns = range(math.floor((w + world / 2) / size), math.floor((r + world / 2) / size) + 1)
    lines = range(math.floor(s / size), math.floor(n / size) + 1)
    for i in columns:
        x0 = i * size - world / 2
        over = e[(e[:, 0] < x0 + size) & (e[:, 2] > x0)]
        todo = [(start, i, j, over) for j in lines] if len(over) else []
        while todo:
            level, ci, cj, edges = todo.pop()
            side = world / 4 ** (level + 1)
            a, b = ci * side - world / 2, cj * side
            slabs = cell_slabs(a, a + side, b, b + side, edges, upright, CELL_EDGES if level < LAST_LEVEL else None)
            if slabs is None:
                for k in range(4):
                    x = a + k * side / 4
                    part = edges[(edges[:, 0] < x + side / 4) & (edges[:, 2] > x)]
                    if len(part):
                        todo.extend((level + 1, 4 * ci + k, 4 * cj + m, part) for m in range(4))
            elif any(below or len(found) for _, _, below, found in slabs):
                yield level, ci, cj, slabs


def _cell_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for region, text in zip(pdf["region"], pdf["polygon"]):
            found = _parts(text)
            if found is None or pd.isna(region):
                continue
            plane, polygons = found
            world = world_of(plane)
            out = []
            for rings in polygons:
                try:
                    arrays = [np.array([p[:2] for p in ring], dtype=float) for ring in rings]
                except (ValueError, TypeError, IndexError):
                    continue
                if any(a.ndim != 2 or not np.isfinite(a).all() for a in arrays):
                    continue
                for level, i, j, slabs in part_cells(arrays, world):
                    turn = math.floor(i / 4 ** (level + 1)) if plane in WORLD else 0
                    xs = [s[0] for s in slabs] + [slabs[-1][1]]
                    starts = np.cumsum([0] + [len(s[3]) for s in slabs]).tolist()
                    edges = np.concatenate([s[3] for s in slabs]).tolist()
                    out.append((int(region), plane, level, i - turn * 4 ** (level + 1), j, turn * world, xs, starts, [s[2] for s in slabs], edges))
                    if len(out) == 500:
                        yield pd.DataFrame(out, columns=_CELLS.names)
                        out = []
            if out:
                yield pd.DataFrame(out, columns=_CELLS.names)


def region_cells(regions: DataFrame, *, region: str = "region", polygon: str = "polygon") -> DataFrame:
    """The cells of every region with their slabs; regions are spread over all tasks, and each gives out its cells as they are made."""
    rows = regions.select(F.col(region).cast("long").alias("region"), F.col(polygon).alias("polygon"))
    n_tasks = max(1, regions.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(n_tasks, "region").mapInPandas(_cell_rows, _CELLS)


def unread_regions(regions: DataFrame, *, region: str = "region", polygon: str = "polygon") -> DataFrame:
    """(region) of the rows whose polygon is null, broken or in a CRS that isn't understood, which therefore contain nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.loc[[_parts(t) is None for t in pdf["polygon"]], ["region"]]

    return regions.select(F.col(region).cast("long").alias("region"), F.col(polygon).alias("polygon")).mapInPandas(run, "region long")


def _search(lo: Column, hi: Column, steps: Column, goes_right) -> Column:
    """First place in [lo, hi) where goes_right(place) is false, hi if nowhere, by binary search."""

    def step(acc, _):
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        open_, right = acc["lo"] < acc["hi"], goes_right(mid)
        return F.struct(F.when(open_ & right, mid + 1).otherwise(acc["lo"]).cast("int").alias("lo"), F.when(open_ & ~right, mid).otherwise(acc["hi"]).cast("int").alias("hi"))

    start = F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda acc: acc["lo"])


def _steps(n: Column) -> Column:
    return F.ceil(F.log2(n.cast("double") + 1)).cast("int") + 1


def _edge_below(edges: Column, i: Column, x: Column, y: Column) -> Column:
    e = F.get(edges, i)
    v = lambda k: F.get(e, F.lit(k))
    return v(1) + (x - v(0)) * (v(3) - v(1)) / (v(2) - v(0)) < y


def containing_regions(
    points: DataFrame, regions: DataFrame, *, key: str = "key", lon: str = "lon", lat: str = "lat", region: str = "region", polygon: str = "polygon", broadcast_edges: int = 500_000, rows_per_salt: int = 20_000
) -> DataFrame:
    """(key, region) for every region that contains a point, in the plane of the region's own CRS.

    Regions are JSON texts {"geojson": Polygon or MultiPolygon, "polygon_crs": ...} in degrees, web Mercator or a UTM zone,
    the last for points within UTM_REACH degrees of its middle; null, broken or unknown ones contain nothing and are
    those of ``unread_regions``. A point in any part and outside that part's holes is inside. Points without a place are in no
    region. The cells are broadcast if they hold at most ``broadcast_edges`` edges and slabs, about 60 bytes each, else
    points and cells are shuffled by cell, the points of cells with more than ``rows_per_salt`` spread over several tasks.
    """
    cells = cut(region_cells(regions, region=region, polygon=polygon))
    used = cells.groupBy("plane", "level").agg(F.sum(F.size("edges") + F.size("xs")).alias("n")).collect()  # at most 13 levels of 122 planes
    if not used:
        return points.sparkSession.createDataFrame([], T.StructType([T.StructField("key", points.schema[key].dataType), T.StructField("region", T.LongType())]))
    pts = points.select(F.col(key).alias("key"), wrap_longitude(F.col(lon).cast("double")).alias("lon"), F.col(lat).cast("double").alias("lat"))
    pts = pts.where(F.col("lon").isNotNull() & F.col("lat").between(-90.0, 90.0))
    places = []
    for plane in sorted({r["plane"] for r in used}):
        if plane == "deg":
            px, py = F.col("lon"), F.col("lat")
        elif plane == "merc":
            px, py = F.radians("lon") * MERCATOR_RADIUS_M, F.log(F.tan(F.lit(math.pi / 4) + F.radians("lat") / 2)) * MERCATOR_RADIUS_M
        else:
            middle = int(plane[3:]) * 6 - 183
            off = wrap_longitude(F.col("lon") - middle)
            px, py = (F.when(F.abs(off) <= UTM_REACH, c) for c in utm_forward(off + middle, F.col("lat"), F.lit(int(plane))))
        levels = F.array(*[F.lit(level) for level in sorted(r["level"] for r in used if r["plane"] == plane)])
        places.append(F.struct(F.lit(plane).alias("plane"), F.lit(world_of(plane)).alias("world"), px.alias("px"), py.alias("py"), levels.alias("levels")))
    pts = pts.select("key", F.inline(F.array(*places))).where(F.col("px").isNotNull() & F.col("py").isNotNull() & (F.abs("py") < 1e9))
    pts = pts.select("key", "plane", "world", "px", "py", F.explode("levels").alias("level"))
    n = F.pow(F.lit(4.0), F.col("level") + 1)
    pts = pts.withColumn("cx", F.pmod(F.floor((F.col("px") + F.col("world") / 2) / (F.col("world") / n)), n.cast("long"))).withColumn("cy", F.floor(F.col("py") / (F.col("world") / n)))
    on = ["plane", "level", "cx", "cy"]
    total = sum(r["n"] for r in used)
    if total <= broadcast_edges:
        joined = pts.join(broadcast_if_small(cells, total, broadcast_edges), on)
    else:
        crowd = pts.groupBy(*on).agg(F.count("*").alias("c")).where(F.col("c") > rows_per_salt)
        crowd = cut(crowd.select(*on, F.ceil(F.col("c") / rows_per_salt).cast("int").alias("salts")))
        salts = F.coalesce("salts", F.lit(1))
        spread = cells.join(crowd, on, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
        joined = pts.join(crowd, on, "left").withColumn("salt", salt_of(F.col("key"), salts)).drop("salts").join(spread, [*on, "salt"])
    x, y = F.col("px") + F.col("shift"), F.col("py")
    joined = joined.withColumn("slab", _search(F.lit(0), F.size("xs"), _steps(F.size("xs")), lambda i: F.get("xs", i) <= x) - 1)
    joined = joined.where((F.col("slab") >= 0) & (F.col("slab") < F.size("below")))
    first, end = F.get("starts", F.col("slab")), F.get("starts", F.col("slab") + 1)
    under = F.get("below", F.col("slab")) + _search(first, end, _steps(end - first), lambda i: _edge_below(F.col("edges"), i, x, y)) - first
    return joined.where(under % 2 == 1).select("key", "region").distinct()
