"""Tiles on grids of their own: warping to another plane and resolution, alignment and mosaics across tiles.

A grid is a row: epsg, minx (west edge), maxy (north edge), res, height, width, and the columns that name its tile. Pixels
name their tile, row y from the north and column x from the west. Every target pixel works out which source pixel its
centre lies in, so a warp is one equi-join by tile, row and column, whatever the planes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions.planes import box_in, turned
from terrafold.operators import grid

GRID = ("epsg", "minx", "maxy", "res", "height", "width")


def _edges() -> tuple[Column, Column, Column, Column]:
    c = F.col
    return c("minx"), c("maxy") - c("height") * c("res"), c("minx") + c("width") * c("res"), c("maxy")


def with_bounds(grids: DataFrame) -> DataFrame:
    """Adds what follows from a grid: maxx, miny, the middle (x, y), its WGS 84 box (w, s, e, n) and the code as EPSG:n."""
    w, s, e, n = _edges()
    out = grids.withColumn("maxx", e).withColumn("miny", s).withColumn("mid_x", (w + e) / 2).withColumn("mid_y", (s + n) / 2)
    return out.withColumn("wgs84", box_in(w, s, e, n, F.col("epsg"), F.lit(4326))).withColumn("crs", F.concat(F.lit("EPSG:"), F.col("epsg").cast("string")))


def grids_in(grids: DataFrame, epsg: Column | int, res: Column | float) -> DataFrame:
    """The grids that hold the same ground in another plane, their edges on multiples of the resolution."""
    to, r = (v if isinstance(v, Column) else F.lit(v) for v in (epsg, res))
    b = grids.withColumn("_b", box_in(*_edges(), F.col("epsg"), to))
    x0, y1 = F.floor(F.col("_b.w") / r), F.ceil(F.col("_b.n") / r)
    out = b.withColumns({"height": (y1 - F.floor(F.col("_b.s") / r)).cast("int"), "width": (F.ceil(F.col("_b.e") / r) - x0).cast("int"), "minx": x0 * r, "maxy": y1 * r})
    return out.withColumns({"epsg": to.cast("int"), "res": r.cast("double")}).drop("_b").select(*grids.columns)


def warp(pixels: DataFrame, source: DataFrame, target: DataFrame, on: list[str], *, extra: list[str] | None = None, method: str = "nearest") -> DataFrame:
    """(on, extra, y, x, value) on the target grids of the pixels on the source grids, both one row for each ``on``.

    nearest takes the source pixel a target pixel's centre lies in; bilinear the four around it, weighted, those without
    a value left out. ``extra`` are columns, such as band and time, that are kept apart. Target pixels without a source pixel
    that has a value have no row. A tile without a grid on either side, and planes that aren't known, give none.
    """
    if method not in ("nearest", "bilinear"):
        raise ValueError("method must be nearest or bilinear")
    named = lambda df, p: df.select(*on, *[F.col(c).alias(p + c) for c in GRID])
    both = named(source, "s_").join(named(target, "t_"), on)
    span = lambda n: F.sequence(F.lit(0), F.col(n).cast("int") - 1)
    cells = both.where("t_height > 0 AND t_width > 0").withColumn("y", F.explode(span("t_height"))).withColumn("x", F.explode(span("t_width")))
    tx, ty = F.col("t_minx") + (F.col("x") + 0.5) * F.col("t_res"), F.col("t_maxy") - (F.col("y") + 0.5) * F.col("t_res")
    cells = cells.withColumn("_at", turned(tx, ty, F.col("t_epsg"), F.col("s_epsg"))).withColumn("_sx", F.col("_at.x")).withColumn("_sy", F.col("_at.y"))
    col, row = (F.col("_sx") - F.col("s_minx")) / F.col("s_res"), (F.col("s_maxy") - F.col("_sy")) / F.col("s_res")
    inside = col.between(0, F.col("s_width")) & row.between(0, F.col("s_height"))
    cells = cells.withColumn("_c", col).withColumn("_r", row).where(inside)
    p = pixels.where(F.col("value").isNotNull() & ~F.isnan("value")).select(*on, *(extra or []), F.col("y").cast("int").alias("_y"), F.col("x").cast("int").alias("_x"), "value")
    if method == "nearest":
        at = cells.select(*on, "y", "x", F.floor("_r").cast("int").alias("_y"), F.floor("_c").cast("int").alias("_x"))
        return at.join(p, [*on, "_y", "_x"]).select(*on, *(extra or []), "y", "x", "value")
    r0, c0 = F.floor(F.col("_r") - 0.5), F.floor(F.col("_c") - 0.5)
    fr, fc = F.col("_r") - 0.5 - r0, F.col("_c") - 0.5 - c0
    four = F.array(*[F.struct((r0 + i).cast("int").alias("_y"), (c0 + j).cast("int").alias("_x"), ((fr if i else 1 - fr) * (fc if j else 1 - fc)).alias("_w")) for i in (0, 1) for j in (0, 1)])
    at = cells.select(*on, "y", "x", F.inline(four)).where("_w > 0")
    got = at.join(p, [*on, "_y", "_x"]).groupBy(*on, *(extra or []), "y", "x").agg((F.sum(F.col("_w") * F.col("value")) / F.sum("_w")).alias("value"))
    return got.select(*on, *(extra or []), "y", "x", "value")


def grid_problems(grids: DataFrame, by: list[str], *, tolerance: float = 1e-6) -> DataFrame:
    """(by, problem) of the groups whose tiles can't be aligned as they are: planes or resolutions differ, edges lie off each other's pixels, or nothing is shared."""
    w, s, e, n = _edges()
    g = grids.groupBy(*by).agg(
        F.count_distinct("epsg").alias("planes"), F.min("res").alias("r0"), F.max("res").alias("r1"), F.max(w).alias("w"), F.min("minx").alias("w0"), F.max(s).alias("s"), F.min(e).alias("e"), F.min(n).alias("n"),
        F.min_by("maxy", "minx").alias("y0"), F.collect_set(F.struct("minx", "maxy")).alias("corners"),
    )
    off = lambda v, v0: F.abs((v - v0) / F.col("r0") - F.round((v - v0) / F.col("r0"))) > tolerance
    what = (
        F.when(F.col("planes") > 1, "planes differ")
        .when(F.col("r1") - F.col("r0") > tolerance * F.col("r0"), "resolutions differ")
        .when(F.exists("corners", lambda c: off(c["minx"], F.col("w0")) | off(c["maxy"], F.col("y0"))), "off grid")
        .when((F.col("w") >= F.col("e")) | (F.col("s") >= F.col("n")), "no overlap")
    )
    return g.select(*by, what.alias("problem")).where("problem IS NOT NULL")


def _agreeing(grids: DataFrame, by: list[str], overlap: bool) -> DataFrame:
    """The grids, in a plan that raises where those of a group don't agree."""
    bad = grid_problems(grids, by).where("true" if overlap else "problem <> 'no overlap'")
    joined = grids.join(bad, by, "left")
    ok = F.when(F.col("problem").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat_ws(" ", *[F.col(c).cast("string") for c in by], "problem")).cast("boolean"))
    return joined.where(ok).drop("problem")


def _moved(pixels: DataFrame, grids: DataFrame, by: list[str], tile: str, frame: DataFrame) -> DataFrame:
    """Pixels with rows and columns of the group's frame (by, f_minx, f_maxy, f_height, f_width) instead of their tile's."""
    shift = grids.join(frame, by).select(*by, tile, F.round((F.col("f_maxy") - F.col("maxy")) / F.col("res")).cast("int").alias("_dy"), F.round((F.col("minx") - F.col("f_minx")) / F.col("res")).cast("int").alias("_dx"), "f_height", "f_width")
    out = pixels.join(shift, [*by, tile]).withColumn("y", F.col("y") + F.col("_dy")).withColumn("x", F.col("x") + F.col("_dx"))
    return out.where((F.col("y") >= 0) & (F.col("y") < F.col("f_height")) & (F.col("x") >= 0) & (F.col("x") < F.col("f_width"))).drop("_dy", "_dx", "f_height", "f_width")


def _frame(grids: DataFrame, by: list[str], shared: bool) -> DataFrame:
    w, s, e, n = _edges()
    low, high = (F.max, F.min) if shared else (F.min, F.max)
    f = grids.groupBy(*by).agg(low(w).alias("f_minx"), high(n).alias("f_maxy"), low(s).alias("_s"), high(e).alias("_e"), F.min("res").alias("_r"))
    size = lambda lo, hi: F.round((F.col(hi) - F.col(lo)) / F.col("_r")).cast("int")
    return f.select(*by, "f_minx", "f_maxy", size("_s", "f_maxy").alias("f_height"), size("f_minx", "_e").alias("f_width"))


def align_spatial(pixels: DataFrame, grids: DataFrame, by: list[str], *, tile: str = "layer") -> DataFrame:
    """Pixels of all tiles of a group on the rows and columns of the ground they share.

    Tiles whose planes, resolutions or edges don't agree, or that share nothing, raise; warp them first.
    """
    ok = _agreeing(grids, by, overlap=True)
    return _moved(pixels, ok, by, tile, _frame(ok, by, shared=True))


def mosaic_spatial(pixels: DataFrame, grids: DataFrame, by: list[str], *, tile: str = "tile", extra: list[str] | None = None, method: str = "first", epsg: int | None = None, res: float | None = None) -> DataFrame:
    """One value per pixel of the ground all tiles of a group cover: (by, extra, y, x, value), the first by the order of ``tile``.

    Tiles must agree in plane, resolution and edges, or else are warped to ``epsg`` and ``res``, of which both are given.
    """
    if (epsg is None) != (res is None):
        raise ValueError("a target needs both a plane and a resolution")
    if epsg is not None:
        target = grids_in(grids, epsg, res)
        pixels, grids = warp(pixels, grids, target, [*by, tile], extra=extra), target
    ok = _agreeing(grids, by, overlap=False)
    moved = _moved(pixels, ok, by, tile, _frame(ok, by, shared=False))
    return grid.mosaic(moved, [*by, *(extra or []), "y", "x"], method=method, order=tile)


def load_onto(pixels: DataFrame, items: DataFrame, anchors: DataFrame, *, item: str = "item_id", anchor: str = "anchor_id", bands: list[str] | None = None, group: Column | None = None, method: str = "bilinear") -> DataFrame:
    """Pixels of catalog items on the grids of anchors: (anchor, band, group, y, x, value).

    items: (item, anchor, ts and the item's grid), one row for each anchor an item is loaded for; anchors: (anchor and grid).
    Items of one ``group``, each of its own if none is given, are one step: of two with a value for a pixel the earlier
    counts. Bands none asks for are not read.
    """
    p = pixels if bands is None else pixels.where(F.col("band").isin(bands))
    on = [anchor, item]
    source = items.select(*on, *GRID)
    target = items.select(*on).join(anchors.select(anchor, *GRID), anchor)
    got = warp(p.join(items.select(*on), item), source, target, on, extra=["band"], method=method)
    named = items.select(*on, (F.col(item) if group is None else group).alias("group"), F.struct("ts", item).alias("_order"))
    return grid.mosaic(got.join(named, on), [anchor, "band", "group", "y", "x"], method="first", order="_order")
