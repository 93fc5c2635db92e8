"""Connected components, and the touching boxes that link them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.session import cut, salt_of


def _spans(boxes: DataFrame, world: float | None) -> DataFrame:
    """Boxes with w <= e. Where x repeats after ``world``, w lies in its first turn, a box with w > e ends a turn later, and
    one that reaches into the next turn has a copy a turn before, marked by ``turned``."""
    whole = boxes.where("w IS NOT NULL AND s IS NOT NULL AND e IS NOT NULL AND n IS NOT NULL AND s <= n")
    if world is None:
        return whole.where("w <= e").withColumn("turned", F.lit(False))
    half, over = world / 2, F.when(F.col("w") > F.col("e"), F.lit(world)).otherwise(F.lit(0.0))
    shift = F.floor((F.col("w") + half) / world) * world
    placed = whole.withColumn("_e", F.col("e") - shift + over).withColumn("w", F.col("w") - shift).withColumn("e", F.col("_e")).drop("_e")
    placed = placed.withColumn("turned", F.explode(F.when(F.col("e") >= half, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    back = F.when(F.col("turned"), F.lit(world)).otherwise(F.lit(0.0))
    return placed.withColumn("w", F.col("w") - back).withColumn("e", F.col("e") - back)


def touching_boxes(boxes: DataFrame, by: list[str], *, cell: float, key: str = "key", world: float | None = None, rows_per_salt: int = 1000) -> DataFrame:
    """(by, a, b), a < b: pairs of boxes (w, s, e, n) of one group that overlap or touch.

    Boxes lie in the cells of a grid level as coarse as they are large, four at most, and look in the cells of their own
    and all coarser levels that there are; a pair is made only in the cell that holds the lower left corner of what the
    two share. Cells with many boxes are salted. With ``world`` x repeats after that width, so boxes with w > e cross the
    line where it does; without it they touch nothing, as boxes with a null bound do.
    """
    b = _spans(boxes.select(*by, F.col(key).alias("k"), "w", "s", "e", "n"), world)
    b = cut(b.withColumn("level", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("e") - F.col("w"), F.col("n") - F.col("s"), F.lit(cell / 2)) / cell))).cast("int")))
    levels = sorted(r["level"] for r in b.select("level").distinct().collect())  # at most one for each doubling of the size
    size = lambda level: F.lit(cell) * F.pow(F.lit(2.0), level)

    def cells(df: DataFrame) -> DataFrame:
        span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size(F.col("at"))), F.floor(F.col(hi) / size(F.col("at"))))
        return df.withColumn("cx", F.explode(span("w", "e"))).withColumn("cy", F.explode(span("s", "n")))

    on = [*by, "at", "cx", "cy"]
    home = cells(b.withColumn("at", F.col("level")))
    looks = cells(b.withColumn("at", F.explode(F.filter(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"), lambda x: x >= F.col("level")))))
    hot = home.groupBy(*on).agg(F.count("*").alias("c")).where(F.col("c") > rows_per_salt).select(*on, F.ceil(F.col("c") / rows_per_salt).cast("int").alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    home = home.join(hot, on, "left").withColumn("salt", salt_of(F.col("k"), salts)).drop("salts", "level").withColumnsRenamed({x: x + "2" for x in ("k", "w", "s", "e", "n", "turned")})
    looks = looks.join(hot, on, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    both = looks.join(home, [*on, "salt"]).where("NOT (turned AND turned2) AND w <= e2 AND w2 <= e AND s <= n2 AND s2 <= n")
    both = both.where((F.col("level") < F.col("at")) & (F.col("k") != F.col("k2")) | (F.col("k") < F.col("k2")))
    first = (F.floor(F.greatest("w", "w2") / size(F.col("at"))) == F.col("cx")) & (F.floor(F.greatest("s", "s2") / size(F.col("at"))) == F.col("cy"))
    pairs = both.where(first).select(*by, F.least("k", "k2").alias("a"), F.greatest("k", "k2").alias("b"))
    return pairs if world is None else pairs.distinct()


def connected(edges: DataFrame, *, max_rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node that can be reached, for every node of the edges (a, b).

    Large-star and small-star steps in turn: each links a node's neighbours to the smallest node around it, so the
    rounds grow with the logarithm of the size. Steps join with minima, so no task holds a node's neighbours.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).where("node IS NOT NULL").distinct()
    e = cut(e)
    state = None
    for _ in range(max_rounds):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("c")), "node", "left").select("node", F.coalesce("c", "node").alias("component"))


def box_components(boxes: DataFrame, by: list[str], *, cell: float, key: str = "key", world: float | None = None) -> DataFrame:
    """(key, component) of boxes that touch, directly or by way of others, within their group; null boxes are alone.

    Equal boxes of a group are one node, so copies make no pairs. ``world`` is that of touching_boxes.
    """
    same = [*by, "w", "s", "e", "n"]
    ok = boxes.where("w IS NOT NULL AND s IS NOT NULL AND e IS NOT NULL AND n IS NOT NULL AND s <= n").where("w <= e" if world is None else "true")
    spots = cut(ok.groupBy(*same).agg(F.min(key).alias("key")))
    found = connected(touching_boxes(spots, by, cell=cell, world=world).select("a", "b"))
    of = spots.join(found, spots["key"] == found["node"], "left").select(*same, F.coalesce("component", "key").alias("component"))
    hit = ok.select(key, *same).join(of, same).select(key, "component")
    return boxes.select(key).join(hit, key, "left").select(key, F.coalesce("component", key).alias("component"))
