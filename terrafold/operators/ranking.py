"""Running totals within groups of any size, without putting a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, *, by: list[str], bucket: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the group up to and with this one.

    ``bucket`` must not fall as ``order`` rises. Sums per bucket are added up first, so only the rows of one bucket
    are ordered in a task; a group is cut into as many pieces as it has buckets. ``order`` must be total.
    """
    sums = df.groupBy(*by, bucket).agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(*by, bucket, before.alias("_before"))
    within = F.sum(value).over(Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.join(offsets, [*by, bucket]).withColumn(name, F.col("_before") + within).drop("_before")


def value_bucket(value: Column, parts: int = 64) -> Column:
    """A whole number that doesn't fall as the value rises: ``parts`` for each doubling of its size."""
    return F.floor(F.signum(value) * F.log2(1 + F.abs(value) * 1024) * parts)


def exact_percentiles(df: DataFrame, by: list[str], value: str, shares: list[float], names: list[str]) -> DataFrame:
    """(by, names): the percentiles of the non-null values of each group, by linear interpolation between ranks.

    Equal values are counted first, then ranks run over ranges of values, so no task holds the values of a group.
    """
    v = F.col(value)
    counts = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by, v.alias("_v")).agg(F.count("*").alias("_c"))
    whole = counts.groupBy(*by).agg(F.sum("_c").alias("_whole"))
    ranked = running_total(counts.withColumn("_bucket", value_bucket(F.col("_v"))), by=by, bucket="_bucket", order=[F.col("_v")], value=F.col("_c"), name="_upto")
    at = lambda q: F.lit(float(q)) * (F.col("_whole") - 1)
    holds = lambda rank: (F.col("_upto") - F.col("_c") <= rank) & (rank < F.col("_upto"))
    picks = []
    for i, q in enumerate(shares):
        picks += [F.max(F.when(holds(F.floor(at(q))), F.col("_v"))).alias(f"_lo{i}"), F.max(F.when(holds(F.ceil(at(q))), F.col("_v"))).alias(f"_hi{i}")]
    got = ranked.join(whole, by).groupBy(*by, "_whole").agg(*picks)
    between = [(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (at(q) - F.floor(at(q)))).alias(n) for i, (q, n) in enumerate(zip(shares, names))]
    return got.select(*by, *between)
