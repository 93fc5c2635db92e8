"""Raster structure: bands, chunks, common windows, mosaics, resampling, flips and shadows.

Pixels are rows with integer row y and column x on a grid shared by all tiles of one resolution, so alignment and
mosaics are equi-joins and groupings on integers.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOSAIC = ("first", "last", "min", "max", "sum", "count")


def bands_to_columns(pixels: DataFrame, bands: list[str], on: list[str]) -> DataFrame:
    """One row per pixel with a column per band. Repeated rows of a band count once: the largest value, nulls last.

    One conditional aggregate per band instead of a pivot: a single shuffle, and bands that nothing reads are pruned.
    """
    return pixels.where(F.col("band").isin(bands)).groupBy(*on).agg(*[F.max(F.when(F.col("band") == b, F.col("value"))).alias(b) for b in bands])


def columns_to_bands(wide: DataFrame, bands: list[str], on: list[str]) -> DataFrame:
    return wide.unpivot(on, bands, "band", "value")


def chunk_cells(extents: DataFrame, size: int) -> DataFrame:
    """Cells of at most size x size pixels over each extent (.., width, height): adds cy, cx, y0, x0, h, w."""
    if size < 1:
        raise ValueError("size must be at least 1")
    rows = F.sequence(F.lit(0), F.ceil(F.col("height") / size).cast("int") - 1)
    cols = F.sequence(F.lit(0), F.ceil(F.col("width") / size).cast("int") - 1)
    out = extents.where("height > 0 AND width > 0").withColumn("cy", F.explode(rows)).withColumn("cx", F.explode(cols))
    out = out.withColumn("y0", F.col("cy") * size).withColumn("x0", F.col("cx") * size)
    return out.withColumn("h", F.least(F.lit(size), F.col("height") - F.col("y0"))).withColumn("w", F.least(F.lit(size), F.col("width") - F.col("x0")))


def chunk_of(y: Column, x: Column, size: int) -> tuple[Column, Column]:
    return F.floor(y / size).cast("int"), F.floor(x / size).cast("int")


def clip_ring(ring: list, minx: float, miny: float, maxx: float, maxy: float) -> list:
    """A polygon ring cut to a rectangle, edge by edge (Sutherland and Hodgman); empty if nothing is left."""
    sides = ((0, minx, 1), (0, maxx, -1), (1, miny, 1), (1, maxy, -1))
    points = [tuple(p[:2]) for p in ring]
    if points and points[0] == points[-1]:
        points = points[:-1]
    for axis, bound, sign in sides:
        kept = []
        for i, p in enumerate(points):
            q = points[i - 1]
            p_in, q_in = sign * (p[axis] - bound) >= 0, sign * (q[axis] - bound) >= 0
            if p_in != q_in:
                t = (bound - q[axis]) / (p[axis] - q[axis])
                cross = [q[0] + t * (p[0] - q[0]), q[1] + t * (p[1] - q[1])]
                cross[axis] = bound
                kept.append(tuple(cross))
            if p_in:
                kept.append(p)
        points = kept
    return [list(p) for p in points] + ([list(points[0])] if points else [])


def common_window(extents: DataFrame, by: list[str]) -> DataFrame:
    """Intersection of the extents (y0, x0, y1, x1 exclusive) of each group; groups without overlap drop out."""
    out = extents.groupBy(*by).agg(F.max("y0").alias("y0"), F.max("x0").alias("x0"), F.min("y1").alias("y1"), F.min("x1").alias("x1"))
    return out.where("y0 < y1 AND x0 < x1")


def align_layers(layers: list[DataFrame], on: list[str], *, names: list[str]) -> DataFrame:
    """Pixels that all layers have, a value column per layer. Repeated names raise."""
    if len(set(names)) != len(names):
        raise ValueError("layer names collide")
    named = [df.select(*on, F.col("value").alias(n)) for df, n in zip(layers, names)]
    return reduce(lambda a, b: a.join(b, on), named)


def mosaic(tiles: DataFrame, on: list[str], *, method: str = "first", order: str = "tile_ord", value: str = "value") -> DataFrame:
    """One value per pixel: of the first or last tile that has one, or the min, max, sum or count of all."""
    if method not in MOSAIC:
        raise ValueError(f"method must be one of {MOSAIC}")
    v = F.col(value)
    # max_by and min_by look at the order only where there is a value
    at = F.when(v.isNotNull(), F.struct(order, value))
    how = {"first": F.min_by(value, at), "last": F.max_by(value, at), "min": F.min(v), "max": F.max(v), "sum": F.sum(v), "count": F.count(v)}[method]
    return tiles.groupBy(*on).agg(how.alias("value"))


def mosaic_with(tiles: DataFrame, on: list[str], merge, *, order: str = "tile_ord", value: str = "value") -> DataFrame:
    """Mosaic by a function of whole arrays: ``merge`` gets the values of many pixels, a row for each with its tiles' in order and NaN
    behind them, and returns one value for each. Null and NaN values are left out; a pixel of none is a row of NaN."""

    @F.pandas_udf(T.DoubleType())
    def merged(values):
        rows = [np.asarray([np.nan if x is None else x for x in v] if v is not None else [], float) for v in values]
        rows = [r[~np.isnan(r)] for r in rows]
        a = np.full((len(rows), max(1, max(map(len, rows), default=0))), np.nan)
        for i, r in enumerate(rows):
            a[i, : len(r)] = r
        return pd.Series(np.asarray(merge(a), float))

    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value])
    return tiles.groupBy(*on).agg(listed.alias("_v")).select(*on, merged("_v").alias("value"))


def resample_nearest(pixels: DataFrame, on: list[str], factor: float) -> DataFrame:
    """Pixels on a grid ``factor`` times as coarse, each with the value of the pixel its centre lies in (finer below 1)."""
    if factor <= 0:
        raise ValueError("factor must be positive")
    if factor >= 1:
        target = lambda c: F.floor((F.col(c) + 0.5) / factor)
        source = lambda t: F.floor((t + 0.5) * factor)
        keep = (F.col("y") == source(target("y"))) & (F.col("x") == source(target("x")))
        return pixels.where(keep).select(*on, target("y").cast("int").alias("y"), target("x").cast("int").alias("x"), "value")
    span = lambda c: F.sequence(F.ceil(F.col(c) / factor - 0.5), F.ceil((F.col(c) + 1) / factor - 0.5) - 1)
    rows = pixels.select(*on, F.explode(span("y")).alias("_y"), "x", "value").select(*on, "_y", F.explode(span("x")).alias("_x"), "value")
    return rows.select(*on, F.col("_y").cast("int").alias("y"), F.col("_x").cast("int").alias("x"), "value")


def resample_mean(pixels: DataFrame, on: list[str], factor: int) -> DataFrame:
    """Mean of each factor x factor block."""
    y, x = chunk_of(F.col("y"), F.col("x"), factor)
    return pixels.groupBy(*on, y.alias("y"), x.alias("x")).agg(F.avg("value").alias("value"))


def flip(y: Column, x: Column, height: Column | int, width: Column | int, *, vertical: bool = False, horizontal: bool = False) -> tuple[Column, Column]:
    return (F.lit(height) - 1 - y if vertical else y), (F.lit(width) - 1 - x if horizontal else x)


def shadow_offsets(azimuth_deg: float, distance: float, res: float) -> list[tuple[int, int]]:
    """Pixel offsets (dy, dx) of a shadow cast away from the sun, one per step of a pixel; halves round to even."""
    a = math.radians(azimuth_deg)
    steps = range(1, round(distance / res) + 1)
    return sorted({(round(math.cos(a) * s), round(-math.sin(a) * s)) for s in steps} - {(0, 0)})


def cast_shadow(clouds: DataFrame, on: list[str], offsets: list[tuple[int, int]], height: int, width: int) -> DataFrame:
    """Distinct shadowed pixels (on, y, x) of cloud pixels; shadows end at the grid's border."""
    arr = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets])
    s = clouds.select(*on, "y", "x", F.explode(arr).alias("o")).select(*on, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    return s.where((F.col("y").between(0, height - 1)) & (F.col("x").between(0, width - 1))).distinct()
