"""Anchors (where and when) from coordinates, polygons and requests, as rows of pixel grids in UTM."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions import dates, geo, strings
from terrafold.operators import grid

#: Default side of an anchor in pixels and their size in metres.
TILE_SIZE, RESOLUTION = 500, 10.0


def _checked(lon: Column, lat: Column) -> Column:
    ok = lat.between(-90.0, 90.0) & lon.isNotNull() & lat.isNotNull()
    return F.when(ok, geo.wrap_longitude(lon)).otherwise(F.raise_error(F.concat(F.lit("bad coordinate "), F.concat_ws(",", lon.cast("string"), lat.cast("string")))).cast("double"))


def from_coordinates(points: DataFrame, *, res: float = RESOLUTION, tile_size: int | None = TILE_SIZE) -> DataFrame:
    """Anchors of (lon, lat, size_m, datetime) rows: a square in metres around the point, in its own UTM zone.

    Adds crs, minx, miny, maxx, maxy, res, width, height, start_ts, end_ts and stem, and, with a tile size, one row for each
    tile of at most that many pixels. A coordinate out of range and a size or resolution that isn't positive raise.
    """
    if res <= 0:
        raise ValueError("the resolution must be positive")
    lon = _checked(F.col("lon").cast("double"), F.col("lat").cast("double"))
    epsg = geo.utm_epsg(F.col("lon"), F.col("lat"))
    e, n = geo.utm_forward(F.col("lon"), F.col("lat"), F.col("epsg"))
    half = F.when(F.col("size_m") > 0, F.col("size_m") / 2).otherwise(F.raise_error(F.lit("size_m must be positive")).cast("double"))
    p = points.withColumn("lon", lon).withColumn("epsg", epsg).withColumn("_e", e).withColumn("_n", n).withColumn("_h", half)
    g = geo.grid_of_box(F.col("_e") - F.col("_h"), F.col("_n") - F.col("_h"), F.col("_e") + F.col("_h"), F.col("_n") + F.col("_h"), res)
    return _finish(p.withColumns(g).drop("_e", "_n", "_h"), res, tile_size)


def from_polygons(regions: DataFrame, *, key: str, ring: str, res: float = RESOLUTION, tile_size: int | None = TILE_SIZE) -> DataFrame:
    """Anchors of (key, ring of [lon, lat], datetime) rows: the grid over the ring in the UTM zone of its middle; the ring is kept."""
    xs, ys = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
    mid = regions.withColumn("lon", (F.array_min(xs) + F.array_max(xs)) / 2).withColumn("lat", (F.array_min(ys) + F.array_max(ys)) / 2)
    mid = mid.where(F.col("lon").isNotNull()).withColumn("epsg", geo.utm_epsg(F.col("lon"), F.col("lat")))
    v = mid.select(key, "epsg", F.explode(ring).alias("p")).select(key, *[c.alias(n) for c, n in zip(geo.utm_forward(F.col("p")[0], F.col("p")[1], F.col("epsg")), ("e", "n"))])
    b = v.groupBy(key).agg(F.min("e").alias("_w"), F.min("n").alias("_s"), F.max("e").alias("_e"), F.max("n").alias("_n"))
    g = geo.grid_of_box(F.col("_w"), F.col("_s"), F.col("_e"), F.col("_n"), res)
    return _finish(mid.join(b, key).withColumns(g).drop("_w", "_s", "_e", "_n"), res, tile_size)


def _finish(anchors: DataFrame, res: float, tile_size: int | None) -> DataFrame:
    a = anchors.withColumn("crs", F.concat(F.lit("EPSG:"), F.col("epsg").cast("string"))).withColumn("res", F.lit(float(res))).drop("epsg")
    a = a.withColumn("start_ts", dates.parse_start(F.col("datetime"))).withColumn("end_ts", dates.parse_end(F.col("datetime")))
    a = a.withColumn("stem", geo.anchor_stem(F.col("lon"), F.col("lat"), strings.compact_range(F.col("start_ts"), F.col("end_ts")), F.col("res")))
    return a if tile_size is None else grid.chunk_cells(a, tile_size)


def vertices(shape: Column, coordinates: Column) -> Column:
    """All positions [lon, lat] of a geometry's JSON coordinates, those of all parts and holes; null for what isn't one."""
    at = lambda t: F.from_json(coordinates, t)
    line, rings, parts = "array<array<double>>", "array<array<array<double>>>", "array<array<array<array<double>>>>"
    return (
        F.when(shape == "Point", F.array(at("array<double>")))
        .when(shape.isin("LineString", "MultiPoint"), at(line))
        .when(shape.isin("Polygon", "MultiLineString"), F.flatten(at(rings)))
        .when(shape == "MultiPolygon", F.flatten(F.flatten(at(parts))))
    )


def from_request(spark: SparkSession, request: dict, *, limit: int | None = None) -> DataFrame:
    """Anchors of a request: {"type": "coordinate", lat, lon, area_m, ...}, {"type": "polygon", "polygon": GeoJSON, ...} or
    {"type": "geojson", "path": file or folder, ...}; datetime, tile_size_px and resolution are common to all. A polygon of
    several parts gives one grid over all of them; its geometry is kept as JSON text. ``limit`` is the most anchors given."""
    if limit is not None:
        return from_request(spark, request).limit(limit)
    kind = request.get("type")
    res, tile, when = float(request.get("resolution", RESOLUTION)), request.get("tile_size_px", TILE_SIZE), request.get("datetime")
    if kind == "coordinate":
        p = spark.createDataFrame([(float(request["lon"]), float(request["lat"]), float(request["area_m"]), when)], "lon double, lat double, size_m double, datetime string")
        return from_coordinates(p, res=res, tile_size=tile)
    if kind in ("polygon", "geojson"):
        from terrafold.sources.geojson import parse_features, read_features

        f = read_features(spark, request["path"]) if kind == "geojson" else parse_features(spark.createDataFrame([(json.dumps(request["polygon"]),)], "value string"))
        f = f.withColumn("ring", vertices(F.col("shape"), F.col("coordinates"))).where("ring IS NOT NULL").withColumn("datetime", F.lit(when)).withColumn("key", F.xxhash64(*[c for c in ("path", "feature_no") if c in f.columns]))
        return from_polygons(f, key="key", ring="ring", res=res, tile_size=tile)
    raise ValueError(f"unknown source type {kind!r}")


def register_cells(spark: SparkSession, name: str = "cells") -> None:
    """A table function for SQL: cells(width, height, size) gives cy, cx, y0, x0, h, w of a grid's tiles."""

    @F.udtf(returnType="cy int, cx int, y0 int, x0 int, h int, w int")
    class Cells:
        def eval(self, width: int, height: int, size: int):
            if size is None or size < 1:
                raise ValueError("size must be at least 1")
            if width is None or height is None:
                return
            for y in range(0, height, size):
                for x in range(0, width, size):
                    yield y // size, x // size, y, x, min(size, height - y), min(size, width - x)

    spark.udtf.register(name, Cells)
