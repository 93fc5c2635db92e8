"""The same or nearly the same record in training and in evaluation splits.

A record's footprint is shingled: its shingles are the (column, row) cells of a grid whose centres its box holds, at a
grid level that fits the box's size, so the Jaccard similarity of two shingle sets is that of the boxes. A box is the
product of its columns and rows, so a minwise hash of it is one over its columns joined with one over its rows, which
agrees with the product of both similarities: a few hundredths below that of the boxes where they are alike, and lower
still where they are not. The hashes are banded into buckets together with the period the record starts in; only
buckets with both training and evaluation records give candidates, which are verified by the distance of the starts and
the exact similarity of the boxes. Exact copies are joined as one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafold.functions.dates import parse_start
from terrafold.functions.names import source_name, split_name
from terrafold.session import broadcast_if_small, cut, salt_of

#: A box has at least this many and up to twice as many cells along each side, at its own grid level.
CELLS = 64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache
def _hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and addends of n hashes of either axis."""
    order = np.arange(1, 2 * n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        mult, add = _mix(order * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32) | np.uint32(1), _mix(order + np.uint64(0x51ED270B)).astype(np.uint32)
    return mult.reshape(2, n), add.reshape(2, n)


def _minima(low: np.ndarray, high: np.ndarray, level: np.ndarray, axis: int, n: int) -> np.ndarray:
    """Minimum of each of n hashes over the cells of a grid level whose centres lie between two bounds: one row per hash, one column per side."""
    mult, add = _hash_family(n)
    out = np.empty((n, len(low)), np.uint32)
    scale = np.exp2(level)
    first, last = np.ceil(low / scale - 0.5), np.floor(high / scale - 0.5)
    for at in range(0, len(low), 64):
        f, spare = first[at : at + 64, None], (last - first)[at : at + 64, None]
        # shorter sides repeat their last cell, which changes no minimum
        cells = f + np.minimum(np.arange(spare.max() + 1), spare)
        with np.errstate(over="ignore"):
            h = _mix(cells.astype(np.int64).astype(np.uint64)).astype(np.uint32)
            held = np.empty_like(h)
            for i in range(n):
                np.multiply(h, mult[axis, i], out=held)
                np.add(held, add[axis, i], out=held)
                held.min(axis=1, out=out[i, at : at + 64])
    return out


def side_levels(side: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grid level of each side, another level that a side of the similarity may have as its own, whether there is one)."""
    k = np.floor(np.log2(side / CELLS))
    low, high = CELLS * np.exp2(k), CELLS * np.exp2(k + 1)
    down, up = side * similarity * (1 - 1e-9) < low, side * (1 + 1e-9) >= high * similarity
    return k, np.where(down, k - 1, k + 1), down | up


def _neighbourhood(low: np.ndarray, high: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Level and coarse cell of the middle of a side as one number, one more for the next cell."""
    half = float(1 << 39)
    at = np.clip(np.floor((low + high) / 2 / (4.0 * CELLS * np.exp2(level))), 2 - half, half - 2)
    return ((level.astype(np.int64) + 2048) << 40) + at.astype(np.int64) + (1 << 39)


def box_bands(w: np.ndarray, s: np.ndarray, e: np.ndarray, n: np.ndarray, probe: np.ndarray, *, bands: int, rows: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(box, column and row of its neighbourhood, bucket keys) for each pair of the grid levels of every box.

    A box has one pair of levels, its own; one that probes has those too that a box of the similarity may have. The
    neighbourhood is the cell of a coarse grid the box's middle lies in, as one number for its level and column or row;
    boxes that share a bucket are in the same or adjoining ones. Boxes must have an area and finite bounds.
    """
    hashes = bands * rows
    number = np.arange(bands, dtype=np.uint64)[:, None] * np.uint64(0xA24BAED4963EE407)
    sides = []
    for axis, (low, high) in enumerate(((w, e), (s, n))):
        own, other, more = side_levels(high - low, similarity)
        ways = [(np.arange(len(low)), own)]
        at = np.flatnonzero(more & probe)
        ways.append((at, other[at]))
        sides.append([(i, k, _minima(low[i], high[i], k, axis, hashes)) for i, k in ways])
    found = []
    for ix, kx, x in sides[0]:
        for iy, ky, y in sides[1]:
            both, px, py = np.intersect1d(ix, iy, assume_unique=True, return_indices=True)
            a, b = kx[px], ky[py]
            with np.errstate(over="ignore"):
                keys = number + ((a * 4096 + b).astype(np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF))[None, :]
                for r in range(rows):
                    part = slice(r * bands, (r + 1) * bands)
                    keys = _mix(keys ^ (x[part][:, px].astype(np.uint64) | (y[part][:, py].astype(np.uint64) << np.uint64(32))))
            found.append((both, _neighbourhood(w[both], e[both], a), _neighbourhood(s[both], n[both], b), keys.T.astype(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*found))


_BANDED = T.StructType([T.StructField(n, t) for n, t in (("rep", T.LongType()), ("train", T.BooleanType()), ("at", T.LongType()), ("col", T.LongType()), ("row", T.LongType()), ("bands", T.ArrayType(T.LongType())))])


def cross_split_pairs(records: DataFrame, *, similarity: float = 0.8, within_hours: float = 24.0, bands: int = 28, rows: int = 4, rows_per_salt: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(pairs of representatives, members) of overlaps between train and the other splits.

    records: (key, split, start timestamp_ntz, w, s, e, n double), split one of train, val, test. Rows with a null key,
    split, start or bound, or a box without area or of infinite size, match nothing. Pairs: (rep_train, rep_eval, split,
    similarity, n_train, n_eval); members: (rep, key). Rows of equal split, start and box are copies and have one
    representative, the smallest key. At the given bands and rows a pair at a similarity of 0.8 is missed with a chance
    below 1e-4 whatever its shape, near 1e-6 for most; one at 0.3 becomes a candidate with a chance of about a fifth, or less.
    """
    finite = (F.col("e") - F.col("w") < float("inf")) & (F.col("n") - F.col("s") < float("inf"))
    ok = cut(records.select("key", "split", "start", "w", "s", "e", "n").where("key IS NOT NULL AND split IS NOT NULL AND start IS NOT NULL AND e > w AND n > s").where(finite))
    same = ["split", "start", "w", "s", "e", "n"]
    reps = cut(ok.groupBy(*same).agg(F.min("key").alias("rep"), F.count("*").alias("copies")))
    members = ok.join(reps.select(*same, "rep"), same).select("rep", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            # a box that many records of the batch share is hashed once
            boxes = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("w", "s", "e", "n", "train")], axis=1)
            boxes, of = np.unique(boxes, axis=0, return_inverse=True)
            box, col, row, keys = box_bands(*boxes[:, :4].T, boxes[:, 4] == 0, bands=bands, rows=rows, similarity=similarity)
            order = np.argsort(box, kind="stable")
            begin, end = np.searchsorted(box[order], of.ravel()), np.searchsorted(box[order], of.ravel(), side="right")
            line = np.repeat(np.arange(len(begin)), end - begin)
            pick = order[np.concatenate([np.arange(i, j) for i, j in zip(begin, end)])]
            lists = pa.ListArray.from_arrays(np.arange(0, len(pick) * bands + 1, bands, dtype=np.int32), pa.array(keys[pick].ravel()))
            same_ = [batch.column(c).take(pa.array(line)) for c in ("rep", "train", "at")]
            yield pa.RecordBatch.from_arrays([*same_, pa.array(col[pick]), pa.array(row[pick]), lists], names=_BANDED.names)

    span = int(within_hours * 3600)
    period = 8 * span
    start = F.floor(F.unix_micros(F.col("start").cast("timestamp")) / F.lit(1_000_000))
    sent = reps.select("rep", (F.col("split") == "train").alias("train"), start.alias("at"), "w", "s", "e", "n").mapInArrow(run, _BANDED)
    # a training record is in the period of its start, an evaluation record in each that a partner may start in
    at = F.col("at")
    periods = F.when(F.col("train"), F.array(F.floor(at / period))).otherwise(F.sequence(F.floor((at - span - 1) / period), F.floor((at + span + 1) / period)))
    # hashed once, kept as one row per representative, level and period, and written out as buckets where they are joined
    held = cut(sent.withColumn("period", F.explode(periods)))
    # no bucket holds more training records than the neighbourhoods its records come from; evaluation records meet the salts of all around theirs
    crowd = held.where("train").groupBy("col", "row", "period").agg(F.count("*").alias("c")).where(F.col("c") > rows_per_salt)
    crowd = cut(crowd.select("col", "row", "period", F.ceil(F.col("c") / rows_per_salt).cast("int").alias("salts")))
    n_crowds = crowd.count()
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    around = crowd.withColumn("d", step).groupBy((F.col("col") + F.col("d.i")).alias("col"), (F.col("row") + F.col("d.j")).alias("row"), "period").agg(F.max("salts").alias("salts"))
    salts, here = F.coalesce("salts", F.lit(1)), ["col", "row", "period"]
    left = held.where("train").join(broadcast_if_small(crowd, n_crowds, 100_000), here, "left").withColumn("salt", salt_of(F.col("rep"), salts))
    right = held.where("NOT train").join(broadcast_if_small(around, 9 * n_crowds, 100_000), here, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    bucket = lambda side: side.select("rep", "at", "period", "salt", F.explode("bands").alias("band")).select(F.xxhash64("band", "period", "salt").alias("bucket"), "rep", "at")
    left, right = bucket(left).withColumnsRenamed({"rep": "rep_train", "at": "at1"}), bucket(right).withColumnsRenamed({"rep": "rep_eval", "at": "at2"})
    # the starts tell most pairs of a place apart before any box is looked up
    near = left.join(right, "bucket").where(F.abs(F.col("at1") - F.col("at2")) <= span + 1)
    candidates = near.select("rep_train", "rep_eval").distinct()
    a = reps.select(F.col("rep").alias("rep_train"), F.col("start").alias("t1"), *[F.col(c).alias(c + "1") for c in "wsen"], F.col("copies").alias("n_train"))
    b = reps.select(F.col("rep").alias("rep_eval"), "split", F.col("start").alias("t2"), *[F.col(c).alias(c + "2") for c in "wsen"], F.col("copies").alias("n_eval"))
    both = candidates.join(a, "rep_train").join(b, "rep_eval")
    shared = F.greatest(F.lit(0.0), F.least("e1", "e2") - F.greatest("w1", "w2")) * F.greatest(F.lit(0.0), F.least("n1", "n2") - F.greatest("s1", "s2"))
    area = lambda i: (F.col(f"e{i}") - F.col(f"w{i}")) * (F.col(f"n{i}") - F.col(f"s{i}"))
    gap = F.abs(F.unix_micros(F.col("t1").cast("timestamp")) - F.unix_micros(F.col("t2").cast("timestamp")))
    both = both.withColumn("similarity", shared / (area(1) + area(2) - shared))
    pairs = both.where((F.col("similarity") >= similarity) & (gap <= int(within_hours * 3600e6)))
    return pairs.select("rep_train", "rep_eval", "split", "similarity", "n_train", "n_eval"), members


def stack_records(samples: DataFrame) -> DataFrame:
    """Records of stack_samples: split, start of the first geotag time in UTC, and the bounds of the box."""
    b = lambda i: F.get(F.col("bbox"), F.lit(i))
    start = parse_start(F.get(F.col("geotag_datetime"), F.lit(0)))
    return samples.select(F.col("sample_no").alias("key"), split_name(F.col("split")).alias("split"), start.alias("start"), b(0).alias("w"), b(1).alias("s"), b(2).alias("e"), b(3).alias("n"))


def leaked_pairs(samples: DataFrame, *, rows_per_salt: int = 1000) -> DataFrame:
    """(sample_a, sample_b): the pairs of stack_samples with their copies written out, those of a hot record in parts."""
    pairs, members = cross_split_pairs(stack_records(samples), rows_per_salt=rows_per_salt)
    pairs = cut(pairs)
    parts = lambda n: F.ceil(F.col(n) / rows_per_salt).cast("int")
    part = lambda n: F.explode(F.sequence(F.lit(0), parts(n) - 1))
    sized = lambda side, key, n: pairs.select(F.col(side).alias("rep"), n).distinct().join(members, "rep").select(F.col("rep").alias(side), salt_of(F.col("key"), parts(n)).alias(n + "_part"), F.col("key").alias(key))
    m1, m2 = sized("rep_train", "k1", "n_train"), sized("rep_eval", "k2", "n_eval")
    spread = pairs.withColumn("n_train_part", part("n_train")).withColumn("n_eval_part", part("n_eval"))
    out = spread.join(m1, ["rep_train", "n_train_part"]).join(m2, ["rep_eval", "n_eval_part"])
    return out.select(F.least("k1", "k2").alias("sample_a"), F.greatest("k1", "k2").alias("sample_b"))


def leak_report(samples: DataFrame) -> DataFrame:
    """(split, sample_source, n_samples, n_leaked, n_pairs) of the evaluation splits, a null source as its own."""
    pairs, members = cross_split_pairs(stack_records(samples))
    hits = pairs.groupBy("rep_eval").agg(F.sum("n_train").alias("n"))
    hits = hits.join(members, hits.rep_eval == members.rep).select("key", "n")
    rows = samples.select(F.col("sample_no").alias("key"), split_name(F.col("split")).alias("split"), source_name(F.col("sample_source")).alias("sample_source")).where("split IN ('val', 'test')")
    rows = rows.join(hits, "key", "left")
    return rows.groupBy("split", "sample_source").agg(F.count("*").alias("n_samples"), F.count("n").alias("n_leaked"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"))
