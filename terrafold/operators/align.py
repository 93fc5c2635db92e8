"""Alignment of several sources: interval joins, time axes, and cubes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _days(start: Column, end: Column) -> Column:
    return F.sequence(F.to_date(start), F.to_date(end))


def covering_first(refs: DataFrame, tiles: DataFrame, by: list[str], *, ref_key: str = "ref_id", order: str = "ord") -> DataFrame:
    """For each reference (by, ref_id, at) the first tile, by ``order``, with start <= at <= end; references without one drop out.

    Interval containment becomes an equi-join on the days a tile covers; long tiles are in several days, the reference in one.
    """
    t = tiles.withColumn("_day", F.explode(_days(F.col("start"), F.col("end"))))
    r = refs.withColumn("_day", F.to_date("at"))
    hit = r.join(t, [*by, "_day"]).where("at BETWEEN start AND end")
    pick = F.min_by(F.struct(*[c for c in tiles.columns if c not in by]), order).alias("tile")
    return hit.groupBy(*by, ref_key, "at").agg(pick)


def align_sources(tiles: DataFrame, by: list[str], sources: list[str], *, source: str = "source", order: str = "ord") -> DataFrame:
    """Samples over all sources: by, ref_ord, and one struct column per source.

    tiles: by, source, ord (unique in its source), start, end and more. The source with the most tiles leads, the
    first of ``sources`` among equals; every other one adds its first tile that covers the start of the leader's.
    A sample that misses a source is dropped, and so is every group in which a source has no tile at all.
    """
    position = F.array_position(F.array(*map(F.lit, sources)), F.col(source))
    known = tiles.where(F.col(source).isin(sources))
    counts = known.groupBy(*by, source).agg(F.count("*").alias("n"))
    lead = counts.groupBy(*by).agg(F.max_by(source, F.struct(F.col("n"), -position)).alias("lead"), F.count("*").alias("_k")).where(F.col("_k") == len(sources)).drop("_k")
    known = known.join(lead, by)
    rest = [c for c in tiles.columns if c not in (*by, source)]
    refs = known.where(F.col(source) == F.col("lead")).select(*by, F.col("lead"), F.col(order).alias("ref_ord"), F.col("start").alias("at"), F.struct(*rest).alias("ref"))
    others = known.where(F.col(source) != F.col("lead")).select(*by, source, *rest)
    t = others.withColumn("_day", F.explode(_days(F.col("start"), F.col("end"))))
    hit = refs.withColumn("_day", F.to_date("at")).join(t, [*by, "_day"]).where("at BETWEEN start AND end")
    first = hit.groupBy(*by, "lead", "ref_ord", source).agg(F.first("ref").alias("ref"), F.min_by(F.struct(*rest), order).alias("tile"))
    per = lambda s: F.max(F.when(F.col(source) == s, F.col("tile")))
    wide = first.groupBy(*by, "lead", "ref_ord").agg(F.count("*").alias("_k"), F.first("ref").alias("ref"), *[per(s).alias(f"_{s}") for s in sources]).where(F.col("_k") == len(sources) - 1)
    if len(sources) == 1:
        wide = refs.withColumn(f"_{sources[0]}", F.lit(None).cast(refs.schema["ref"].dataType))
    return wide.select(*by, "lead", "ref_ord", *[F.when(F.col("lead") == s, F.col("ref")).otherwise(F.col(f"_{s}")).alias(s) for s in sources])


def to_cube(layers: dict[str, DataFrame], on: list[str], time: str, *, nodata: float, static: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row per time step of any layer, a column per layer, gaps filled with nodata; static layers on every step.

    Layers are (on, time, value); steps are the union of the layers' times within each ``on``.
    """
    named = [df.select(*on, time, F.col("value").cast("double").alias(name)) for name, df in layers.items()]
    cube = reduce(lambda a, b: a.join(b, [*on, time], "full_outer"), named)
    cube = cube.select(*on, time, *[F.coalesce(n, F.lit(nodata)).alias(n) for n in layers])
    for name, df in (static or {}).items():
        cube = cube.join(df.select(*on, F.col("value").cast("double").alias(name)), on, "left").withColumn(name, F.coalesce(name, F.lit(nodata)))
    return cube


def from_cube(cube: DataFrame, on: list[str], time: str, layers: list[str]) -> DataFrame:
    """The long form of a cube: on, time, layer, value."""
    return cube.unpivot([*on, time], layers, "layer", "value")


def last_duplicate(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows of one key the last by ``order``, as a dictionary built in that order holds it."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
