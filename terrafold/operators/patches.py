"""Sliding-window patches and their stitching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions.classes import hann


def grid_size(size: int | tuple[int, int]) -> tuple[int, int]:
    h, w = (size, size) if isinstance(size, int) else size
    if h <= 0 or w <= 0:
        raise ValueError("the grid size must be positive")
    return h, w


def positions(length: int, side: int, overlap: float) -> list[int]:
    """Starts of windows along an axis; the last is moved back to end at the border."""
    step = max(1, int(side * (1 - overlap)))
    return sorted({min(p, length - side) for p in range(0, max(1, length - side + step), step)})


def reflect(i: Column, n: int) -> Column:
    """Index of a mirrored border without repeating the edge (d c b | a b c d | c b a)."""
    j = F.abs(i)
    return F.when(j >= n, F.lit(2 * (n - 1)) - j).otherwise(j)


def split_patches(pixels: DataFrame, on: list[str], *, height: int, width: int, size: int | tuple[int, int], overlap: float, pad: int = 0) -> DataFrame:
    """Pixels of every patch: on, row, col (its place in the padded grid), py, px (within the patch), y, x and the rest.

    The grid is padded by mirrored pixels; y and x stay those of the source pixel. pad must be below height and width.
    """
    gh, gw = grid_size(size)
    rows, cols = positions(height + 2 * pad, gh, overlap), positions(width + 2 * pad, gw, overlap)

    def at(axis: str, n: int) -> Column:
        i = F.col(axis)
        places = F.array(i + pad, F.when((i > 0) & (i <= pad), pad - i), F.when((i >= n - 1 - pad) & (i < n - 1), 2 * (n - 1) - i + pad))
        return F.filter(places, lambda p: p.isNotNull())

    def into(place: str, starts: list[int], side: int) -> Column:
        return F.filter(F.array(*map(F.lit, starts)), lambda s: (s <= F.col(place)) & (F.col(place) < s + side))

    p = pixels.withColumn("_y", F.explode(at("y", height))).withColumn("_x", F.explode(at("x", width)))
    p = p.withColumn("row", F.explode(into("_y", rows, gh))).withColumn("col", F.explode(into("_x", cols, gw)))
    return p.withColumn("py", F.col("_y") - F.col("row")).withColumn("px", F.col("_x") - F.col("col")).drop("_y", "_x")


def stitch_patches(patches: DataFrame, on: list[str], *, height: int, width: int, size: int | tuple[int, int], pad: int = 0, value: str = "value") -> DataFrame:
    """on, y, x, value: Hann-weighted mean of the patches at each pixel of the unpadded grid."""
    gh, gw = grid_size(size)
    w = hann(F.col("py"), gh) * hann(F.col("px"), gw)
    y, x = F.col("row") + F.col("py") - pad, F.col("col") + F.col("px") - pad
    inside = patches.where(y.between(0, height - 1) & x.between(0, width - 1))
    g = inside.groupBy(*on, y.alias("y"), x.alias("x")).agg(F.sum(F.col(value) * w).alias("s"), F.sum(w).alias("w"))
    return g.select(*on, "y", "x", (F.col("s") / F.greatest("w", F.lit(1e-6))).alias("value"))
