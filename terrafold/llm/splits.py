"""Train, validation and test splits that keep related records together.

Records of one group form a component. Components of equal size and label profile are interchangeable, so they are
bundled, and a min-cost flow decides how many rows of each bundle go to each split: a bundle gives every split its
whole components for free and more at a small cost, a profile its share at a higher, a split its quota at the highest.
Bundles are rounded to whole components from the largest sizes down, one octave of sizes at a time; what rounding
leaves over in rows and labels changes the quotas of the next flow. The components of a bundle take their places in
the order of their hash.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions.names import split_name, tile_code
from terrafold.operators.ranking import running_total
from terrafold.session import cut

#: Cost of a row beyond the whole components of its bundle, the share of its profile, and the quota of its split.
BUNDLE_COST, PROFILE_COST, SPLIT_COST = 1, 4, 16

#: Label shares of a profile are rounded to this many parts.
PROFILE_PARTS = 4


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost) of a maximum flow of least cost.

    All shortest paths of one length are filled before distances are computed again, so the number of passes over the
    arcs is that of distinct path costs, not of paths.
    """
    to, cap, cost, out = [], [], [], [[] for _ in range(n)]
    for u, v, c, w in arcs:
        for a, b, c_, w_ in ((u, v, c, w), (v, u, 0, -w)):
            out[a].append(len(to))
            to.append(b)
            cap.append(c_)
            cost.append(w_)
    while True:
        dist, queued = [math.inf] * n, [False] * n
        dist[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            queued[u] = False
            for e in out[u]:
                if cap[e] > 0 and dist[u] + cost[e] < dist[to[e]]:
                    dist[to[e]] = dist[u] + cost[e]
                    if not queued[to[e]]:
                        queued[to[e]] = True
                        queue.append(to[e])
        if dist[sink] == math.inf:
            return [cap[2 * i + 1] for i in range(len(arcs))]
        # fill the shortest paths, depth first; a node without a way on isn't entered again in this pass
        dead, next_ = [False] * n, [0] * n
        path: list[int] = []
        on_path = [False] * n
        u = source
        while True:
            if u == sink:
                push = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= push
                    cap[e ^ 1] += push
                full = next(i for i, e in enumerate(path) if cap[e] == 0)
                for e in path[full:]:
                    on_path[to[e]] = False
                u = to[path[full] ^ 1]
                del path[full:]
                continue
            on_path[u] = True
            arcs_u = out[u]
            while next_[u] < len(arcs_u):
                e = arcs_u[next_[u]]
                v = to[e]
                if cap[e] > 0 and dist[v] == dist[u] + cost[e] and not dead[v] and not on_path[v]:
                    break
                next_[u] += 1
            if next_[u] < len(arcs_u):
                path.append(arcs_u[next_[u]])
                u = to[path[-1]]
                continue
            dead[u] = True
            on_path[u] = False
            if u == source:
                break
            u = to[path.pop() ^ 1]


def whole_parts(total: int, shares: list[float]) -> list[int]:
    """total in integers by shares, the largest remainders first."""
    exact = [total * s for s in shares]
    parts = [math.floor(x) for x in exact]
    for i in sorted(range(len(shares)), key=lambda i: (parts[i] - exact[i], i))[: total - sum(parts)]:
        parts[i] += 1
    return parts


def profile_weights(profile: str) -> dict[str, float]:
    """Label -> share of a profile written as label:parts, with commas between; '' stands for no label."""
    parts = [p.rsplit(":", 1) for p in profile.split(",")] if profile else [["", "1"]]
    whole = sum(int(n) for _, n in parts)
    return {label: int(n) / whole for label, n in parts}


def _flow_of(bundles: list[tuple[int, str, int]], fluid: dict[str, int], want: dict[str, list[float]], quota: list[int]) -> list[list[int]]:
    """Rows of each bundle (size, profile, number) for each split; ``fluid`` are rows of profiles that may be cut anywhere."""
    k = len(quota)
    supply: dict[str, int] = defaultdict(int, fluid)
    for size, p, n in bundles:
        supply[p] += size * n
    profiles = sorted(supply)
    # nodes: source, bundles, fluid profiles, (profile, split), splits, sink
    f0 = 1 + len(bundles)
    ps0 = f0 + len(profiles)
    s0 = ps0 + len(profiles) * k
    sink = s0 + k
    at = {p: i for i, p in enumerate(profiles)}
    arcs = []
    for i, (size, p, n) in enumerate(bundles):
        for s in range(k):
            free = int(n * want[p][s] + 1e-9) * size
            arcs.append((1 + i, ps0 + at[p] * k + s, free, 0))
            arcs.append((1 + i, ps0 + at[p] * k + s, size * n, BUNDLE_COST))
    for i, (size, _, n) in enumerate(bundles):
        arcs.append((0, 1 + i, size * n, 0))
    for p, j in at.items():
        if fluid.get(p):
            arcs.append((0, f0 + j, fluid[p], 0))
            arcs.extend((f0 + j, ps0 + j * k + s, fluid[p], 0) for s in range(k))
        own = whole_parts(supply[p], want[p])
        for s in range(k):
            arcs.append((ps0 + j * k + s, s0 + s, own[s], 0))
            arcs.append((ps0 + j * k + s, s0 + s, supply[p], PROFILE_COST))
    for s in range(k):
        arcs.append((s0 + s, sink, max(0, quota[s]), 0))
        arcs.append((s0 + s, sink, sum(supply.values()), SPLIT_COST))
    flow = min_cost_flow(sink + 1, arcs, 0, sink)
    return [[flow[2 * (i * k + s)] + flow[2 * (i * k + s) + 1] for s in range(k)] for i in range(len(bundles))]


def allocate_bundles(bundles: list[tuple[int, str, int]], shares: list[float]) -> list[list[int]]:
    """Components of each bundle (size, profile, number) for each split.

    Octaves of sizes are placed from the largest down. In each, the flow runs over its bundles and, as one fluid supply
    per profile, all smaller ones; then its bundles are rounded to whole components, what is lost in one being carried
    to the next, by split and by label. A profile's share of a split is that of its labels' rows which the split still
    lacks. No component is treated otherwise for its size.
    """
    k = len(shares)
    plan = [[0] * k for _ in bundles]
    left = sum(s * n for s, _, n in bundles)
    quota = whole_parts(left, shares)
    weights = {p: profile_weights(p) for _, p, _ in bundles}
    lacks: dict[str, list[float]] = defaultdict(lambda: [0.0] * k)
    for size, p, n in bundles:
        for label, w in weights[p].items():
            for s in range(k):
                lacks[label][s] += w * size * n * shares[s]
    octaves: dict[int, list[int]] = defaultdict(list)
    for i, (size, _, _) in enumerate(bundles):
        octaves[size.bit_length()].append(i)
    fluid: dict[str, int] = defaultdict(int)
    for size, p, n in bundles:
        fluid[p] += size * n
    for octave in sorted(octaves, reverse=True):
        now = sorted(octaves[octave], key=lambda i: (-bundles[i][0], bundles[i][1]))
        want = {}
        for p in fluid:
            got = [0.0] * k
            for label, w in weights[p].items():
                room = [max(0.0, x) for x in lacks[label]]
                for s in range(k):
                    got[s] += w * (room[s] / sum(room) if sum(room) > 0 else shares[s])
            want[p] = [g / sum(got) for g in got]
        for i in now:
            fluid[bundles[i][1]] -= bundles[i][0] * bundles[i][2]
        flow = _flow_of([bundles[i] for i in now], {p: n for p, n in fluid.items() if n}, want, quota)
        carry = [0.0] * k
        own: dict[str, list[float]] = defaultdict(lambda: [0.0] * k)
        for i, rows in zip(now, flow):
            size, p, n = bundles[i]
            placed = [r // size for r in rows]
            for s in range(k):
                carry[s] += rows[s] - placed[s] * size
                for label, w in weights[p].items():
                    own[label][s] += w * (rows[s] - placed[s] * size)
            for _ in range(n - sum(placed)):
                s = max(range(k), key=lambda s: (carry[s] + 2 * sum(w * own[label][s] for label, w in weights[p].items()), -s))
                placed[s] += 1
                carry[s] -= size
                for label, w in weights[p].items():
                    own[label][s] -= w * size
            for s in range(k):
                plan[i][s] = placed[s]
                quota[s] -= placed[s] * size
                for label, w in weights[p].items():
                    lacks[label][s] -= w * size * placed[s]
        left = sum(fluid.values())
        room = [max(0, q) for q in quota]
        quota = whole_parts(left, [r / sum(room) for r in room]) if sum(room) else whole_parts(left, shares)
    return plan


def group_splits(records: DataFrame, targets: DataFrame, *, group: Column, label: Column, old_split: Column, seed: int = 17) -> DataFrame:
    """(g, n_rows, profile, old_splits, split): one row per group with the split all of its records get.

    ``label`` is an array of a record's labels (or null); a group's profile are the shares of its labels in quarters, as
    label:quarters in the order of the labels, those below an eighth left out, '' for none. ``old_splits`` are the distinct
    non-null splits its records had. Records of a null group form one group with g null. targets: (split, target_share)
    with shares that are scaled to sum 1; null or negative shares count as 0. No records give no rows. The driver gets
    the distinct (size, profile) pairs with their numbers only: at most sqrt(2 N P) for N rows and P profiles.
    """
    goals = sorted((r["split"], max(0.0, r["target_share"] or 0.0)) for r in targets.groupBy("split").agg(F.max("target_share").alias("target_share")).where("split IS NOT NULL").collect())
    if not goals or not sum(s for _, s in goals):
        raise ValueError("split targets need at least one split with a positive share")
    names, shares = [g for g, _ in goals], [s / sum(x for _, x in goals) for _, s in goals]
    base = records.select(F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("gk"), label.alias("labels"), old_split.alias("old"))
    sizes = base.groupBy("gk").agg(F.count("*").alias("n_rows"), F.array_sort(F.collect_set("old")).alias("old_splits"))
    counts = cut(base.select("gk", F.explode("labels").alias("l")).where("l IS NOT NULL").groupBy("gk", "l").agg(F.count("*").alias("c")))
    whole = counts.groupBy("gk").agg(F.sum("c").alias("whole"))
    parts = counts.join(whole, "gk").select("gk", "l", F.round(PROFILE_PARTS * F.col("c") / F.col("whole")).cast("int").alias("n")).where("n > 0")
    # of labels with an eighth of a group or more there are at most eight
    named = F.transform(F.array_sort(F.collect_list(F.struct("l", "n"))), lambda e: F.concat_ws(":", e["l"].cast("string"), e["n"].cast("string")))
    profiles = parts.groupBy("gk").agg(F.concat_ws(",", named).alias("profile"))
    comps = cut(sizes.join(profiles, "gk", "left").withColumn("profile", F.coalesce("profile", F.lit(""))))
    bundles = [(r["n_rows"], r["profile"], r["n"]) for r in comps.groupBy("n_rows", "profile").agg(F.count("*").alias("n")).collect()]
    plan = allocate_bundles(bundles, shares)
    ends = []
    for (size, profile, _), counts in zip(bundles, plan):
        end = 0
        for name, c in zip(names, counts):
            if c:
                ends.append((size, profile, end, end + c, name))
                end += c
    spark = records.sparkSession
    places = spark.createDataFrame(ends, "n_rows long, profile string, from_ long, to_ long, split string")
    h = F.xxhash64("gk", F.lit(seed))
    comps = comps.withColumn("h", h).withColumn("bucket", F.shiftright("h", 54))
    ranked = running_total(comps, by=["n_rows", "profile"], bucket="bucket", order=[F.col("h"), F.col("gk")], value=F.lit(1), name="place")
    out = ranked.join(places, ["n_rows", "profile"]).where((F.col("place") > F.col("from_")) & (F.col("place") <= F.col("to_")))
    return out.select(F.when(F.col("gk") != "", F.expr("substring(gk, 2)")).alias("g"), "n_rows", "profile", "old_splits", "split")


def box_classes(body: Column) -> Column:
    """Class ids of the well-formed lines of a label file's text; malformed lines have none."""
    line = r"^\s*\d{1,9}(\s+[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?){4}\s*$"
    good = F.filter(F.split(body, r"\r?\n"), lambda s: s.rlike(line))
    return F.transform(good, lambda s: F.regexp_extract(s, r"(\d+)", 1).cast("int"))


def label_tile() -> Column:
    return tile_code(F.col("mgrs_tile"), F.col("product_uri"))


def tile_splits(labels: DataFrame, targets: DataFrame, *, seed: int = 17) -> DataFrame:
    """Splits of yolo_labels by MGRS tile."""
    return group_splits(labels, targets, group=label_tile(), label=box_classes(F.col("body")), old_split=split_name(F.col("split")), seed=seed)


def assign_splits(labels: DataFrame, targets: DataFrame, *, seed: int = 17) -> DataFrame:
    """(label_no, mgrs_tile, split) of every row of yolo_labels; the split is the tile's."""
    tiles = tile_splits(labels, targets, seed=seed).select("g", "split")
    rows = labels.select("label_no", label_tile().alias("mgrs_tile"))
    return rows.join(tiles, rows["mgrs_tile"].eqNullSafe(tiles["g"]), "left").select("label_no", "mgrs_tile", tiles["split"])
