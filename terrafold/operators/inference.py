"""Patch-wise prediction: windows, a model per Arrow batch, stitching, and class decisions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.functions import classes
from terrafold.operators import patches


def predict_patches(patch_pixels: DataFrame, on: list[str], model: Callable[[np.ndarray], np.ndarray], *, size: tuple[int, int], n_classes: int) -> DataFrame:
    """Logits per patch pixel: on, row, col, py, px, logits.

    A patch's values are packed into one row, so a batch of rows is a stack of patches for the model: it takes
    patches x height x width and gives patches x classes x height x width.
    """
    h, w = size
    packed = patch_pixels.groupBy(*on, "row", "col").agg(F.array_sort(F.collect_list(F.struct((F.col("py") * w + F.col("px")).cast("int").alias("i"), "value"))).alias("p"))
    packed = packed.select(*on, "row", "col", F.transform("p", lambda s: s["value"]).alias("v"))
    schema = ", ".join(f"`{c}` {t}" for c, t in packed.dtypes if c != "v") + ", out array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack([np.asarray(v, float) for v in pdf["v"]]).reshape(-1, h, w)
            y = np.asarray(model(x), float)
            if y.shape != (len(x), n_classes, h, w):
                raise ValueError(f"the model gave {y.shape}")
            yield pdf.drop(columns="v").assign(out=list(np.moveaxis(y, 1, 3).reshape(len(x), -1)))

    done = packed.mapInPandas(run, schema)
    e = done.select(*on, "row", "col", "out", F.explode(F.sequence(F.lit(0), F.lit(h * w - 1))).alias("i"))
    return e.select(*on, "row", "col", F.floor(F.col("i") / w).cast("int").alias("py"), (F.col("i") % w).alias("px"), F.slice("out", F.col("i") * n_classes + 1, n_classes).alias("logits"))


def segment(pixels: DataFrame, on: list[str], model: Callable[[np.ndarray], np.ndarray], *, height: int, width: int, size: int | tuple[int, int], overlap: float, n_classes: int, pad: int = 0, thresholds: list[float] | None = None, ignore_index: int = 255) -> DataFrame:
    """on, y, x, pred, p: a model's classes for every pixel of grids, decided after stitching its overlapping patches."""
    gh, gw = patches.grid_size(size)
    parts = patches.split_patches(pixels, on, height=height, width=width, size=(gh, gw), overlap=overlap, pad=pad).drop("y", "x")
    logits = predict_patches(parts, on, model, size=(gh, gw), n_classes=n_classes)
    long = logits.select(*on, "row", "col", "py", "px", F.posexplode("logits").alias("k", "value"))
    stitched = patches.stitch_patches(long, [*on, "k"], height=height, width=width, size=(gh, gw), pad=pad)
    per = stitched.groupBy(*on, "y", "x").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda s: s["value"]).alias("z"))
    pred, p = classes.top_class(F.col("prob"))
    out = per.withColumn("prob", classes.softmax(F.col("z"))).withColumn("pred", pred).withColumn("p", p)
    if thresholds is not None:
        if len(thresholds) != n_classes:
            raise ValueError(f"{n_classes} classes need as many thresholds")
        out = out.withColumn("pred", classes.apply_thresholds(F.col("pred"), F.col("p"), thresholds, ignore_index=ignore_index))
    return out.select(*on, "y", "x", "pred", "p")


def resize_bilinear(pixels: DataFrame, on: list[str], *, height: int, width: int, to: tuple[int, int]) -> DataFrame:
    """Grids of height x width resampled to another size, linear between pixel centres, edges held.

    Each pixel adds its weight to the target pixels it is a neighbour of, so one grouping does it.
    """

    def targets(axis: str, n: int, m: int):
        # target t lies at source position (t + 0.5) * n / m - 0.5, held to the grid
        t = F.sequence(F.lit(0), F.lit(m - 1))
        near = F.filter(t, lambda k: F.abs(F.greatest(F.lit(0.0), F.least(F.lit(n - 1.0), (k + 0.5) * (n / m) - 0.5)) - F.col(axis)) < 1)
        return F.transform(near, lambda k: F.struct(k.alias("t"), (1 - F.abs(F.greatest(F.lit(0.0), F.least(F.lit(n - 1.0), (k + 0.5) * (n / m) - 0.5)) - F.col(axis))).alias("w")))

    e = pixels.withColumn("_y", F.explode(targets("y", height, to[0]))).withColumn("_x", F.explode(targets("x", width, to[1])))
    w = F.col("_y.w") * F.col("_x.w")
    return e.groupBy(*on, F.col("_y.t").alias("y"), F.col("_x.t").alias("x")).agg((F.sum(F.col("value") * w) / F.sum(w)).alias("value"))
