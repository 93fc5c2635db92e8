"""Keyed datasets: filters, intersections, manifests, grouped tables and batches."""

from __future__ import annotations

import copy
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.session import cut


def numbered(rows: DataFrame, order: list[str], name: str = "ord") -> DataFrame:
    """Adds the place of each row in the order, from 0. Ranks are counted by range partitions, not in one task.

    Rows are range partitioned by the order; each partition's number of rows comes first, then rows are counted within.
    Ties are broken by nothing else, so the order should be total. The partitions are written once, as their numbers are
    counted and used in two places that must agree.
    """
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    parts = cut(parts.withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(F.col("_p").cast("long"), 33)))
    counts = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return parts.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_i")).drop("_p", "_i", "_before")


def keep_split(rows: DataFrame, wanted: DataFrame | None, key: str) -> DataFrame:
    """Rows whose key is in the split list; None keeps all. Repeated and null keys of the list make no difference."""
    return rows if wanted is None else rows.join(wanted.select(key).where(F.col(key).isNotNull()), key, "left_semi")


def missing_keys(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Keys of the split list that no row has; a warning's content, not an error."""
    return wanted.select(key).where(F.col(key).isNotNull()).distinct().join(rows.select(key), key, "left_anti")


def has_layers(layers: Column, required: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, required)) if required else F.array().cast("array<string>"), layers)) == 0


def intersection(datasets: list[DataFrame], key: str = "sample_id") -> DataFrame:
    """Samples that all datasets have, with the fields of all, in the first one's order if it has a column ``ord``.

    At least two datasets; a field that two of them have raises.
    """
    if len(datasets) < 2:
        raise ValueError("an intersection needs at least two datasets")
    seen: set[str] = set()
    for df in datasets:
        both = seen & (set(df.columns) - {key})
        if both:
            raise ValueError(f"fields collide: {', '.join(sorted(both))}")
        seen |= set(df.columns) - {key}
    return reduce(lambda a, b: a.join(b, key), datasets)


def dropped_keys(datasets: list[DataFrame], key: str = "sample_id") -> DataFrame:
    """Keys that some but not all of the datasets have, with the number that has them."""
    keys = reduce(DataFrame.unionAll, [df.select(key).distinct() for df in datasets])
    return keys.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") < len(datasets))


def _field(packed: str, name: str) -> Column:
    return F.transform(packed, lambda s: s[name]).alias(name)


def grouped_table(rows: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """One row per non-null key: sample_id as text, n_rows, first order, and each column as an array in order.

    Keys that are equal as text are one sample, as a dictionary of texts has them.
    """
    unknown = [c for c in [key, *columns] if c not in rows.columns]
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *columns)))
    g = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("sample_id")).agg(packed.alias("_p"))
    return g.select("sample_id", F.size("_p").alias("n_rows"), F.get("_p", F.lit(0))["_o"].alias("first_order"), *[_field("_p", c) for c in columns])


def grouped_blocks(rows: DataFrame, key: str, columns: list[str], order: str, *, size: int) -> DataFrame:
    """As grouped_table, but a key's rows come as blocks of ``size`` of them: sample_id, block, n_rows, and the arrays.

    For keys of any size: places are counted over ranges of (key, order), and no task holds more than a block.
    """
    if size < 1:
        raise ValueError("size must be at least 1")
    keyed = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("sample_id"), F.col(order).alias("_o"), *columns)
    placed = numbered(keyed, ["sample_id", "_o", *columns], "_at")
    first = placed.groupBy("sample_id").agg(F.min("_at").alias("_first"))
    blocks = placed.join(first, "sample_id").withColumn("block", F.floor((F.col("_at") - F.col("_first")) / size))
    g = blocks.groupBy("sample_id", "block").agg(F.array_sort(F.collect_list(F.struct("_at", *columns))).alias("_p"))
    return g.select("sample_id", "block", F.size("_p").alias("n_rows"), *[_field("_p", c) for c in columns])


def with_provenance(rows: DataFrame, items: DataFrame, key: str, name: str = "n_items") -> DataFrame:
    """Rows with the number of provenance items of their key, 0 if it has none; items without a key belong to no row."""
    per = items.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    return rows.join(per, key, "left").withColumn(name, F.coalesce("_n", F.lit(0))).drop("_n")


class Dataset:
    """Samples of a table by key. Subclasses change what a sample shows (``render``) or keeps in a manifest (``row``).

    Nothing is read before a method that says so: ``keys``, ``len`` and ``get``.
    """

    def __init__(self, rows: DataFrame, *, key: str = "sample_id", order: str | None = None) -> None:
        if key not in rows.columns:
            raise ValueError(f"no column {key}")
        self.rows, self.key, self.order = rows.where(F.col(key).isNotNull()), key, order or key

    def render(self) -> DataFrame:
        """The key and the fields of a sample: numeric columns as double, all others as they are."""
        numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
        cast = lambda c, t: F.col(c).cast("double") if t in numeric or t.startswith("decimal") else F.col(c).cast("array<double>") if t in [f"array<{n}>" for n in numeric] else F.col(c)
        return self.rows.select(self.key, *[cast(c, t).alias(c) for c, t in self.rows.dtypes if c not in (self.key, self.order)])

    def row(self) -> DataFrame:
        """The key and the plain columns: no arrays, maps or structs."""
        return self.rows.select(self.key, *[c for c, t in self.rows.dtypes if c != self.key and t.split("<")[0] not in ("array", "map", "struct", "binary")])

    @property
    def fields(self) -> list[str]:
        return [c for c in self.render().columns if c != self.key]

    def keys(self) -> DataFrame:
        """Keys in the order of discovery, each once, with their place."""
        return numbered(self.rows.groupBy(self.key).agg(F.min(self.order).alias("_at")), ["_at", self.key]).select(self.key, "ord")

    def __len__(self) -> int:
        return self.rows.select(self.key).distinct().count()

    def get(self, key) -> list:
        """The rendered rows of one key, read from their part of the table only where its storage allows."""
        return self.render().where(F.col(self.key) == key).collect()

    def reindex(self, wanted: DataFrame) -> Dataset:
        """The same dataset with the keys of a list only."""
        out = copy.copy(self)
        out.rows = keep_split(self.rows, wanted, self.key)
        return out

    def __and__(self, other: Dataset) -> Dataset:
        """Samples both have, with the fields of both as they render them."""
        return Dataset(intersection([self.render(), other.render().withColumnRenamed(other.key, self.key)], self.key), key=self.key)


def split_datasets(dataset: Dataset, lists: dict[str, DataFrame | None]) -> dict[str, Dataset]:
    """A dataset for each split that is named, as train, val, test and predict; None gives it all samples.

    A key in two of the lists is in both; ``shared_keys`` tells them.
    """
    return {name: dataset if wanted is None else dataset.reindex(wanted) for name, wanted in lists.items()}


def shared_keys(lists: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, splits) of the keys that more than one split list has."""
    every = reduce(DataFrame.unionAll, [df.select(key).distinct().withColumn("split", F.lit(n)) for n, df in lists.items()])
    return every.groupBy(key).agg(F.array_sort(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)


def check_dense(keys, what: str) -> int:
    """The number of keys of a class or band map; raises unless they are 0 to n - 1."""
    have = sorted(keys)
    if have != list(range(len(have))) or not have:
        raise ValueError(f"{what} must have the keys 0 to n - 1, not {have}")
    return len(have)


def manifest(rows: DataFrame, fields: list[str], key: str = "sample_id") -> DataFrame:
    """sample_id and the fields; a field of that name raises."""
    if "sample_id" in fields:
        raise ValueError("a field must not be called sample_id")
    return rows.select(F.col(key).cast("string").alias("sample_id"), *fields)


def write_manifest(rows: DataFrame, path: str) -> None:
    """The manifest as Parquet in one file, as other readers expect it; its size is that of the sample list."""
    rows.coalesce(1).write.mode("overwrite").parquet(path)


def batches(rows: DataFrame, size: int, order: list[str], columns: list[str], *, drop_last: bool = True) -> DataFrame:
    """batch_id and an array per column, ``size`` samples to a batch in the given order."""
    if size < 1:
        raise ValueError("size must be at least 1")
    n = numbered(rows, order).withColumn("batch_id", F.floor(F.col("ord") / size))
    g = n.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("ord", *columns))).alias("_p"))
    if drop_last:
        g = g.where(F.size("_p") == size)
    return g.select("batch_id", *[_field("_p", c) for c in columns])
