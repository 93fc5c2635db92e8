"""The best representative of each group of duplicate records, by token-level consensus.

Values of a group are split into tokens and aligned progressively: the heaviest value starts a profile, every other
one is aligned with it and adds its weight to the tokens of the columns it meets. Each column votes, and the existing
value with the fewest token edits to the winning sequence is emitted. The columns a record is trusted by vote by trust:
no number of lower tokens outweighs a higher one, and the record nearest to the winning tokens, column by column in
their order, survives. A group of usual size is one row and is voted on in one place; in a large one equal values are
counted and weighed together first and the others are aligned in blocks whose profiles are then aligned with each other,
level by level, so no task holds a whole group.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafold.functions.names import product_parts, tile_code
from terrafold.session import cut, salt_of

_TEXT = r'"(?:[^"\\]|\\.)*"'
_TEXTS, _ELEMENT = re.compile(rf"\[{_TEXT}(?:,{_TEXT})*\]", re.DOTALL), re.compile(rf"{_TEXT}|[\[\],]", re.DOTALL)
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[\W_]", re.UNICODE)

#: Pairs of columns that are compared token by token; longer values are first cut at the tokens both have once.
MOST_CELLS = 25_000_000

Profile = list[dict[str, float]]


def tokens(text: str) -> list[str]:
    """Runs of letters, runs of digits, and every other character on its own; of a JSON array of texts its texts and the signs between."""
    return _ELEMENT.findall(text) if _TEXTS.fullmatch(text) else _TOKEN.findall(text)


def _cost(column: dict[str, float], total: float, other: dict[str, float], other_total: float) -> float:
    """Share of token pairs of two profile columns that differ."""
    return 1.0 - sum(w * other.get(t, 0.0) for t, w in column.items()) / (total * other_total)


def _few_paths(a: Profile, wa: float, b: Profile, wb: float) -> list[tuple[int, int]]:
    """As _paths, for so few columns that single numbers are faster than arrays."""
    unit = 1.0 / (wa * wb)
    gap_b = [1.0 - y.get("", 0.0) * wa * unit for y in b]
    best = [0.0]
    for g in gap_b:
        best.append(best[-1] + g)
    steps = []
    for x in a:
        gap = 1.0 - x.get("", 0.0) * wb * unit
        left = best[0] + gap
        row, step = [left], []
        for j, y in enumerate(b):
            cost = 1.0
            for t, w in x.items():
                if t in y:
                    cost -= w * y[t] * unit
            meet, skip, left = best[j] + cost, best[j + 1] + gap, left + gap_b[j]
            least = meet if meet < skip else skip
            if left < least:
                least = left
            step.append(0 if meet <= least + 1e-9 else 1 if skip <= least + 1e-9 else 2)
            left = least
            row.append(least)
        best = row
        steps.append(step)
    out = []
    i, j = len(a), len(b)
    while i or j:
        s = 1 if not j else 2 if not i else steps[i - 1][j - 1]
        i, j = i - (s != 2), j - (s != 1)
        out.append((int(s != 2), int(s != 1)))
    return out[::-1]


def _paths(a: Profile, wa: float, b: Profile, wb: float) -> list[tuple[int, int]]:
    """Steps of an alignment of least cost, as (columns of a, columns of b) each 0 or 1; columns meet rather than gap."""
    n, m = len(a), len(b)
    if n * m <= 400:
        return _few_paths(a, wa, b, wb)
    gap_a = np.array([_cost(x, wa, {"": wb}, wb) for x in a])
    gap_b = np.array([_cost(y, wb, {"": wa}, wa) for y in b])
    at: dict[str, tuple[list[int], list[float]]] = {}
    for j, y in enumerate(b):
        for t, w in y.items():
            js, ws = at.setdefault(t, ([], []))
            js.append(j)
            ws.append(w / (wa * wb))
    held = {t: (np.array(js), np.array(ws)) for t, (js, ws) in at.items()}
    so_far = np.concatenate([[0.0], np.cumsum(gap_b)])
    best = so_far.copy()
    step = np.empty((n, m), np.uint8)
    for i, x in enumerate(a):
        cost = np.ones(m)
        for t, w in x.items():
            if t in held:
                js, ws = held[t]
                cost[js] -= w * ws
        meet, skip = best[:-1] + cost, best[1:] + gap_a[i]
        row = np.concatenate([[best[0] + gap_a[i]], np.minimum(meet, skip)])
        row = np.minimum.accumulate(row - so_far) + so_far
        step[i] = np.where(meet <= row[1:] + 1e-9, 0, np.where(skip <= row[1:] + 1e-9, 1, 2))
        best = row
    out = []
    i, j = n, m
    while i or j:
        s = 1 if not j else 2 if not i else step[i - 1, j - 1]
        i, j = i - (s != 2), j - (s != 1)
        out.append((int(s != 2), int(s != 1)))
    return out[::-1]


def _anchors(a: Profile, b: Profile) -> list[tuple[int, int]]:
    """Pairs of columns, rising on both sides, whose only token is in no other column of either side."""

    def once(p: Profile) -> dict[str, int]:
        seen: dict[str, int] = {}
        for i, c in enumerate(p):
            for t in c:
                seen[t] = -1 if t in seen else i
        return {t: i for t, i in seen.items() if i >= 0 and len(p[i]) == 1 and t}

    x, y = once(a), once(b)
    ends: list[int] = []
    chain: list[list[tuple[int, int, int]]] = []
    for i, j in sorted((x[t], y[t]) for t in x.keys() & y.keys()):
        at = int(np.searchsorted(ends, j))
        link = (i, j, len(chain[at - 1]) - 1 if at else -1)
        if at == len(ends):
            ends.append(j)
            chain.append([link])
        else:
            ends[at] = j
            chain[at].append(link)
    out = []
    at = -1
    for level in reversed(chain):
        i, j, before = level[at]
        out.append((i, j))
        at = before
    return out[::-1]


def _common_ends(a: list, b: list, same) -> tuple[int, int]:
    """How many entries two sequences begin and, without these, end with alike."""
    short = min(len(a), len(b))
    front = 0
    while front < short and same(a[front], b[front]):
        front += 1
    back = 0
    while back < short - front and same(a[-1 - back], b[-1 - back]):
        back += 1
    return front, back


def _side_by_side(a: Profile, wa: float, b: Profile, wb: float) -> bool:
    """Whether columns paired by place are an alignment of least cost: then no other way can make up for the gap it has on both sides.

    A step costs 1 less the share of tokens that agree. Another way has at least one step more, and in no step can a
    column of b agree with more than it does with the best column of a for each of its tokens, or with a gap.
    """
    if len(a) != len(b):
        return False
    unit = 1.0 / (wa * wb)
    best: dict[str, float] = {}
    for x in a:
        for t, w in x.items():
            if w > best.get(t, 0.0):
                best[t] = w
    met = most = 0.0
    for x, y in zip(a, b):
        some = 0.0
        for t, w in y.items():
            if t in x:
                met += w * x[t] * unit
            if t in best:
                some += w * best[t] * unit
        most += max(some, y.get("", 0.0) / wb)
    return most - met <= 1.0 - best.get("", 0.0) / wa


def _steps(a: Profile, wa: float, b: Profile, wb: float) -> list[tuple[int, int]]:
    """Steps of an alignment. Columns both begin or end with, all of one token, meet: that is never worse than any other way."""
    front, back = _common_ends(a, b, lambda x, y: len(x) == 1 and x.keys() == y.keys())
    x, y = a[front : len(a) - back], b[front : len(b) - back]
    if _side_by_side(x, wa, y, wb):
        return [(1, 1)] * len(a)
    if len(x) * len(y) <= MOST_CELLS:
        inner = _paths(x, wa, y, wb) if x and y else [(1, 0)] * len(x) + [(0, 1)] * len(y)
    else:
        inner = []
        i = j = 0
        for u, v in [*_anchors(x, y), (len(x), len(y))]:
            p, q = x[i:u], y[j:v]
            inner += _paths(p, wa, q, wb) if p and q and len(p) * len(q) <= MOST_CELLS else [(1, 0)] * len(p) + [(0, 1)] * len(q)
            i, j = u, v
            if u < len(x):
                inner.append((1, 1))
                i, j = u + 1, v + 1
    return [(1, 1)] * front + inner + [(1, 1)] * back


def align(a: Profile, wa: float, b: Profile, wb: float) -> Profile:
    """Two profiles with their weights as one, aligned at least cost; '' is the token of a gap.

    Only profiles of more than MOST_CELLS pairs of unlike columns are not compared whole: they meet at the columns that
    both have once, and what lies between two of these is compared if it is below that size, else laid side by side.
    """
    out: Profile = []
    i = j = 0
    for u, v in _steps(a, wa, b, wb):
        x, y = a[i] if u else {"": wa}, b[j] if v else {"": wb}
        column = dict(x)
        for t, w in y.items():
            column[t] = column.get(t, 0.0) + w
        out.append(column)
        i, j = i + u, j + v
    return out


def _content(p: Profile) -> str:
    """A text to order profiles of one weight by: the value itself where all columns have one token."""
    if all(len(c) == 1 for c in p):
        return "".join([t for c in p for t in c])
    return json.dumps(p, sort_keys=True)


def progressive(items: list[tuple[Profile, float]]) -> tuple[Profile, float]:
    """Aligns profiles one after the other, the heaviest first; ties by content, so the order given doesn't matter."""
    items = sorted(items, key=lambda it: (-it[1], _content(it[0])))
    p, w = items[0]
    for q, v in items[1:]:
        p = align(p, w, q, v)
        w += v
    return p, w


def vote(profile: Profile) -> list[str]:
    """The heaviest token of each column, ties to the smaller one; gaps that win are left out."""
    winners = [next(iter(c)) if len(c) == 1 else min(c, key=lambda t: (-c[t], t)) for c in profile]
    return [t for t in winners if t]


def edits(a: list[str], b: list[str]) -> int:
    """Token insertions, deletions and replacements between two sequences; the time grows with length times edits."""
    front, back = _common_ends(a, b, str.__eq__)
    a, b = a[front : len(a) - back], b[front : len(b) - back]
    if not a or not b:
        return len(a) + len(b)
    if len(a) * len(b) <= 2000:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]
    ids: dict[str, int] = {}
    x, y = (np.array([ids.setdefault(t, len(ids)) for t in s]) for s in (a, b))
    n, m = len(x), len(y)
    band = 64
    while True:
        # cells at most ``band`` off the diagonal; a result within the band can't be beaten from outside
        far = n + m
        row = np.where(np.arange(m + 1) <= band, np.arange(m + 1), far)
        for i in range(1, n + 1):
            lo, hi = max(1, i - band), min(m, i + band)
            if lo > hi:
                break
            here = np.minimum(row[lo - 1 : hi] + (y[lo - 1 : hi] != x[i - 1]), row[lo : hi + 1] + 1)
            before = i if lo == 1 else far
            seq = np.arange(lo - 1, hi + 1)
            here = np.minimum.accumulate(np.concatenate([[before], here]) - seq) + seq
            row[lo - 1 : hi + 1] = here
            if lo > 1:
                row[lo - 1] = far
            if hi < m:
                row[hi + 1] = far
        if abs(n - m) <= band and row[m] <= band or band >= max(n, m):
            return int(row[m])
        band *= 2


def consensus(weights: dict[str, float]) -> str:
    """Of values and their weights the one closest to the token consensus; ties to the heavier, then the smaller text.

    A value with more than half of the weight wins every column of any alignment, so it needs none.
    """
    top = min(weights, key=lambda v: (-weights[v], v))
    if 2 * weights[top] > sum(weights.values()):
        return top
    return _voted(tuple(sorted(weights.items())))


@lru_cache(1024)
def _voted(weights: tuple[tuple[str, float], ...]) -> str:
    read = {v: tokens(v) for v, _ in weights}
    profile, _ = progressive([([{t: w} for t in read[v]], w) for v, w in weights])
    won = vote(profile)
    return min(weights, key=lambda it: (edits(read[it[0]], won), -it[1], it[0]))[0]


def _merge_blocks(df: DataFrame, first: bool) -> DataFrame:
    """items (values, or profiles as JSON) of one block -> profile JSON and weight."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            profiles, weights = [], []
            for items in pdf["items"]:
                pairs = [(it["item"], float(it["w"])) for it in items]
                read = [([{t: w} for t in tokens(s)] if first else json.loads(s), w) for s, w in pairs]
                p, w = progressive(read)
                profiles.append(json.dumps(p))
                weights.append(w)
            yield pdf[["g", "col", "block", "blocks"]].assign(item=profiles, w=weights)

    return df.mapInPandas(run, "g string, col string, block int, blocks int, item string, w double")


def consensus_values(votes: DataFrame, *, block_size: int = 128) -> DataFrame:
    """(g, col, value): of each group and column the existing value closest to the token consensus.

    votes: (g, col, value, w) rows, w > 0. Null groups and values have no vote; a column without votes has no row.
    Ties in distance go to the heavier value, then to the smaller text. Values count whole, however long.
    """
    votes = votes.where(F.col("g").isNotNull() & F.col("value").isNotNull() & (F.col("w") > 0))
    distinct = cut(votes.groupBy("g", "col", "value").agg(F.sum("w").alias("w")))
    per = distinct.groupBy("g", "col").agg(F.count("*").alias("n"), F.sum("w").alias("whole"), F.max(F.struct("w", "value")).alias("top"))
    clear = 2 * F.col("top.w") > F.col("whole")
    alone = per.where(clear).select("g", "col", F.col("top.value").alias("value"))
    several = cut(per.where(~clear).select("g", "col", F.ceil(F.col("n") / block_size).cast("int").alias("blocks")))
    rows = distinct.join(several, ["g", "col"]).withColumn("block", salt_of(F.col("value"), F.col("blocks")))
    level = rows.withColumnRenamed("value", "item")
    most = several.agg(F.max("blocks")).first()[0] or 0
    first = True
    while most:
        grouped = level.groupBy("g", "col", "block", "blocks").agg(F.collect_list(F.struct("item", "w")).alias("items"))
        level = _merge_blocks(grouped, first)
        first = False
        if most == 1:
            break
        most = math.ceil(most / block_size)
        level = cut(level).withColumn("block", F.floor(F.col("block") / block_size).cast("int"))
    if first:
        return alone
    profile = level.select("g", "col", F.col("item").alias("profile"), "blocks")
    # the profile goes to every block of its group, so that a large group is compared in as many tasks
    profile = profile.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def distance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        won: dict[str, list[str]] = {}
        for pdf in batches:
            d = []
            for value, profile_ in zip(pdf["value"], pdf["profile"]):
                if profile_ not in won:
                    if len(won) > 1000:
                        won.clear()
                    won[profile_] = vote(json.loads(profile_))
                d.append(edits(tokens(value), won[profile_]))
            yield pdf[["g", "col", "value", "w"]].assign(d=d)

    near = rows.join(profile, ["g", "col", "block"]).select("g", "col", "value", "w", "profile").mapInPandas(distance, "g string, col string, value string, w double, d long")
    best = near.groupBy("g", "col").agg(F.min_by("value", F.struct("d", -F.col("w"), "value")).alias("value"))
    return alone.unionByName(best)


def _vote_groups(packed: DataFrame, n_trust: int, fields: list[str]) -> DataFrame:
    """Groups of whole records, one row each, voted on: survivor and fields."""
    schema = T.StructType([packed.schema["g"], packed.schema["n_records"], packed.schema["first_key"], T.StructField("survivor_key", packed.schema["first_key"].dataType), *[T.StructField(f, T.StringType()) for f in fields]])

    def nearest(keys: list, trust: list[list]) -> object:
        """The smallest key of the records that, column by column, are nearest to the highest token of each column."""
        left = range(len(keys))
        for column in trust:
            top = max((column[i] for i in left if column[i] is not None), default=None)
            left = [i for i in left if column[i] == top]
        return min((keys[i] for i in left if keys[i] is not None), default=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("recs")
            cols = [c.to_pylist() for c in lists.flatten().flatten()]
            keys, weight, trust, values = cols[0], cols[1], cols[2 : 2 + n_trust], cols[2 + n_trust :]
            ends = np.cumsum([len(x) if x is not None else 0 for x in lists]).tolist() if b.num_rows else []
            kept, out = [], [[] for _ in fields]
            start = 0
            for end in ends:
                votes = [w if w is not None and w > 0 else 0.0 for w in weight[start:end]]
                if end == start + 1:
                    kept.append(keys[start])
                    for o, column in zip(out, values):
                        o.append(column[start] if votes[0] else None)
                    start = end
                    continue
                kept.append(nearest(keys[start:end], [t[start:end] for t in trust]))
                for o, column in zip(out, values):
                    own = column[start:end]
                    if own.count(own[0]) == len(own):  # one value, or none
                        o.append(own[0] if any(votes) else None)
                        continue
                    weights: dict[str, float] = {}
                    for v, w in zip(own, votes):
                        if v is not None and w:
                            weights[v] = weights.get(v, 0.0) + w
                    o.append(consensus(weights) if weights else None)
                start = end
            same = [b.column(c) for c in ("g", "n_records", "first_key")]
            arrays = [*same, pa.array(kept, same[2].type), *[pa.array(o, pa.string()) for o in out]]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return packed.mapInArrow(run, schema)


def survivors(records: DataFrame, *, group: Column, key: Column, trust: list[Column], fields: dict[str, Column] | None = None, weight: Column | None = None, least: int = 2, block_size: int = 128) -> DataFrame:
    """One row for each group of at least ``least`` records: g, n_records, first_key, survivor_key and the fields.

    ``trust`` are the columns a record is trusted by, the most important first, higher is better, nulls last. Their votes
    weigh by trust, so a column's consensus is its highest value among the records that agree with the columns before it;
    the survivor is the record with the smallest key among those that have all of them. Every field gets the existing
    value closest to the consensus of the group's values, each record voting with ``weight`` (1 if not given; exact if
    whole numbers); all-null fields are null. Records of a null group belong to no group; null keys don't survive.
    Repeated records vote repeatedly. All values are compared as text. Groups of more than ``block_size`` records are
    voted on by value instead of by record, with the same result up to ``block_size`` values that differ in a column.
    """
    names = [f"f_{n}" for n in fields or {}]
    base = records.select(
        group.cast("string").alias("g"), key.alias("k"), (weight if weight is not None else F.lit(1.0)).cast("double").alias("weight"), *[c.alias(f"t{i}") for i, c in enumerate(trust)],
        *[c.cast("string").alias(f"f_{name}") for name, c in (fields or {}).items()],
    ).where("g IS NOT NULL")
    base = cut(base)
    groups = cut(base.groupBy("g").agg(F.count("*").alias("n_records"), F.min("k").alias("first_key")).where(F.col("n_records") >= least))
    cells = F.struct("k", "weight", *[f"t{i}" for i in range(len(trust))], *names)
    packed = base.join(groups.where(F.col("n_records") <= block_size), "g").groupBy("g", "n_records", "first_key").agg(F.collect_list(cells).alias("recs"))
    out = _vote_groups(packed, len(trust), names).withColumnsRenamed({f"f_{n}": n for n in fields or {}})
    large = groups.where(F.col("n_records") > block_size)
    if large.isEmpty():
        return out
    rows = base.join(large.select("g"), "g")
    rank = F.struct(*[F.struct(F.col(f"t{i}").isNotNull().alias("has"), F.col(f"t{i}").alias("v")).alias(f"t{i}") for i in range(len(trust))])
    who = rows.groupBy("g", rank.alias("rank")).agg(F.min("k").alias("k")).groupBy("g").agg(F.max_by("k", "rank").alias("survivor_key"))
    rest = large.join(who, "g")
    if fields:
        stack = F.inline(F.array(*[F.struct(F.lit(n).alias("col"), F.col(f"f_{n}").alias("value")) for n in fields]))
        chosen = consensus_values(rows.select("g", stack, F.col("weight").alias("w")), block_size=block_size)
        wide = chosen.groupBy("g").agg(*[F.max(F.when(F.col("col") == n, F.col("value"))).alias(n) for n in fields])
        rest = rest.join(wide, "g", "left")
    return out.unionByName(rest)


def acquisition_parts(items: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Catalog records with the parts of their identifiers, and group, baseline, generation time and completeness read from whichever has them."""
    read = items.withColumn("_own", product_parts(F.col("item_id"), F.col("product_uri"))).withColumn("_uri", product_parts(F.col("product_uri")))
    part = lambda c, i: F.when(F.get(c, F.lit(i - 1)) != "", F.get(c, F.lit(i - 1)))
    stated = F.round(F.expr("try_cast(processing_baseline AS double)") * 100).cast("int")
    present = lambda c: F.col(c).isNotNull().cast("int")
    return read, {
        "group": F.when(F.col("_own").isNotNull(), F.concat_ws("_", *[part("_own", i) for i in (1, 2, 3, 6)])),
        "baseline": F.coalesce(part("_uri", 4).cast("int"), stated),
        "generation": F.coalesce(part("_uri", 7), part("_own", 7)),
        "complete": present("mgrs_tile") + present("cloud_cover") + present("product_uri") + present("generation_time"),
    }


def item_survivors(items: DataFrame, *, least: int = 1) -> DataFrame:
    """Survivors of stac_items records by acquisition: the best record and, field by field, the best values.

    The fields are all columns of stac_items but rec_id, as text, arrays as JSON text. A column the table lacks is left
    out; those that name the acquisition or its trust must be there.
    """
    read, p = acquisition_parts(items)
    cols = {
        "item_id": F.col("item_id"),
        "collection": F.col("collection"),
        "ts": F.col("ts"),
        "platform": F.initcap(F.col("platform")),
        "mgrs_tile": tile_code(F.col("mgrs_tile"), F.coalesce("product_uri", "item_id")),
        "cloud_cover": F.col("cloud_cover"),
        "product_uri": F.col("product_uri"),
        "processing_baseline": F.col("processing_baseline"),
        "generation_time": F.col("generation_time"),
        "relative_orbit": F.col("relative_orbit"),
        "stac_version": F.col("stac_version"),
        "stac_extensions": F.to_json("stac_extensions"),
        "instruments": F.to_json("instruments"),
        "bbox": F.to_json("bbox"),
        "catalog": F.col("catalog"),
        "ingested_at": F.col("ingested_at"),
    }
    cols = {name: c for name, c in cols.items() if name in items.columns}
    weight = (1 + p["complete"]) * (1000 + F.coalesce(p["baseline"], F.lit(0)))
    return survivors(read, group=p["group"], key=F.col("rec_id"), trust=[p["baseline"], p["generation"], p["complete"]], fields=cols, weight=weight, least=least)
