"""Neighbourhood filters on dense grids, one axis after the other.

Borders mirror with the edge repeated (d c b a | a b c d | d c b a): rows near a border are added once more at their
mirrored places, so a plain window frame reads them. A task holds one line of the grid at a time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mirrored(pixels: DataFrame, axis: str, size: Column, radius: int) -> DataFrame:
    """The pixels and, beyond both borders, ``radius`` mirrored lines; ``radius`` must not exceed the axis's size."""
    i = F.col(axis)
    places = F.array(i, F.when(i < radius, -1 - i), F.when(i >= size - radius, 2 * size - 1 - i))
    return pixels.withColumn(axis, F.explode(F.filter(places, lambda p: p.isNotNull())))


def line_filter(pixels: DataFrame, on: list[str], axis: str, size: Column, values: dict[str, list[float]]) -> DataFrame:
    """Weighted sums of neighbours along an axis. values: column -> weights from -radius to +radius."""
    radius = max(len(w) // 2 for w in values.values())
    w = Window.partitionBy(*on).orderBy(axis)
    out = mirrored(pixels, axis, size, radius)
    for c, weights in values.items():
        r = len(weights) // 2
        terms = [F.lit(wt) * (F.lag(c, -k) if k < 0 else F.lead(c, k) if k else F.col(c)).over(w) if k else F.lit(wt) * F.col(c) for k, wt in zip(range(-r, r + 1), weights)]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        out = out.withColumn(f"_{c}", total)
    out = out.where((F.col(axis) >= 0) & (F.col(axis) < size))
    return out.drop(*values).withColumnsRenamed({f"_{c}": c for c in values})


def box_mean(pixels: DataFrame, on: list[str], columns: list[str], height: Column, width: Column, side: int = 7) -> DataFrame:
    """Mean of the side x side neighbourhood of each column. ``on`` names the grid; side is odd."""
    if side % 2 != 1:
        raise ValueError("side must be odd")
    weights = {c: [1.0 / side] * side for c in columns}
    along_x = line_filter(pixels, [*on, "y"], "x", width, weights)
    return line_filter(along_x, [*on, "x"], "y", height, weights)


def box_variance(pixels: DataFrame, on: list[str], column: str, height: Column, width: Column, side: int = 7) -> DataFrame:
    """on, y, x and variance: E[v^2] - E[v]^2 of the neighbourhood."""
    p = pixels.select(*on, "y", "x", F.col(column).cast("double").alias("v"), (F.col(column).cast("double") * F.col(column).cast("double")).alias("vv"))
    m = box_mean(p, on, ["v", "vv"], height, width, side)
    return m.select(*on, "y", "x", (F.col("vv") - F.col("v") * F.col("v")).alias("variance"))


def gaussian_weights(sigma: float = 1.0, truncate: float = 4.0) -> list[float]:
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def gaussian(pixels: DataFrame, on: list[str], columns: list[str], height: Column, width: Column, sigma: float = 1.0) -> DataFrame:
    weights = {c: gaussian_weights(sigma) for c in columns}
    along_y = line_filter(pixels, [*on, "x"], "y", height, weights)
    return line_filter(along_y, [*on, "y"], "x", width, weights)


def cloud_displacement(pixels: DataFrame, on: list[str], height: Column, width: Column, *, threshold: float = -0.5, eps: float = 1e-6) -> DataFrame:
    """on, y, x, cdi and cloud: the cloud displacement index of the bands b07, b08 and b8a."""
    g = gaussian(pixels.select(*on, "y", "x", F.col("b08").cast("double").alias("b08"), F.col("b07").cast("double").alias("b07"), F.col("b8a").cast("double").alias("b8a")), on, ["b08"], height, width)
    r = g.select(*on, "y", "x", F.try_divide("b07", "b8a").alias("a"), F.try_divide("b08", "b8a").alias("b"))
    r = r.withColumn("aa", F.col("a") * F.col("a")).withColumn("bb", F.col("b") * F.col("b"))
    m = box_mean(r, on, ["a", "aa", "b", "bb"], height, width)
    va, vb = F.col("aa") - F.col("a") * F.col("a"), F.col("bb") - F.col("b") * F.col("b")
    cdi = F.try_divide(va - vb, va + vb + F.lit(eps))
    return m.select(*on, "y", "x", cdi.alias("cdi"), (cdi < threshold).alias("cloud"))
