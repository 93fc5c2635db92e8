"""Schemas that drift between files: one table of changes, and one consistent table of all rows.

Each file's schema is a graph of member names, types and nesting, of any depth. Members that vanish from one file to the
next are matched with members that appear by similarity flooding: scores start from the likeness of names, flow along
the nesting and type edges of both graphs until they settle, and mutually best pairs that can be cast are taken as
renames or moves, if their names are alike or most of what they hold is. Correspondences that hold over all files give every field its canonical name and type, to which
the values are cast.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafold.functions.jsonwalk import features_of, load_json
from terrafold.session import cut

_SEEN = T.StructType(
    [
        T.StructField("feed", T.StringType()),
        T.StructField("file_seq", T.IntegerType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("n", T.LongType()),
    ]
)


def is_field(path: Column) -> Column:
    """Whether a path is a field: a member of the Feature, or of its properties. Deeper paths serve matching and are reported too.

    Paths are JSON arrays of member names, so a name may hold any character; "[]" stands for the objects of an array.
    """
    depth = F.size(F.from_json(path, "array<string>"))
    return (depth == 1) | ((depth == 2) & (F.get_json_object(path, "$[0]") == "properties"))


_KINDS = {str: "string", int: "number", float: "number", bool: "boolean", list: "array", dict: "object"}


def _members(feature: dict, counts: dict) -> None:
    """Counts (path, type) of all members of a Feature that aren't null, those of the objects of arrays under "[]"."""
    todo: list[tuple[dict, tuple]] = [(feature, ())]
    while todo:
        v, at = todo.pop()
        for k, x in v.items():
            if x is None:
                continue
            kind = type(x)
            path = (*at, k)
            key = (path, _KINDS[kind])
            counts[key] = counts.get(key, 0) + 1
            if kind is dict:
                todo.append((x, path))
            elif kind is list:
                todo.extend((e, (*path, "[]")) for e in x if type(e) is dict)


def schema_entries(raw: DataFrame) -> DataFrame:
    """(feed, file_seq, file_name, path, type, n): how often each member has each JSON type in each file.

    A file also has one row with a null path, so that a file without any valid payload is still a file. Counts are
    summed within each batch before they are shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            files: dict[tuple, dict] = {}
            for feed, seq, name, text in zip(pdf["feed"], pdf["file_seq"], pdf["file_name"], pdf["payload"]):
                if pd.isna(seq) or name is None:
                    continue
                counts = files.setdefault((feed, int(seq), name), {(None, None): 0})
                counts[None, None] += 1
                ok, doc = load_json(text)
                for _, feature in features_of(doc) if ok else ():
                    _members(feature, counts)
            if files:
                yield pd.DataFrame(((*to, None if p is None else json.dumps(p), t, n) for to, counts in files.items() for (p, t), n in counts.items()), columns=_SEEN.names)

    seen = raw.select("feed", "file_seq", "file_name", "payload").mapInPandas(run, _SEEN)
    return seen.groupBy("feed", "file_seq", "file_name", "path", "type").agg(F.sum("n").alias("n"))


def file_schemas(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files with their number in the feed, fields with their sorted types per file)."""
    # fk stands for the feed, so that null joins with null
    e = cut(schema_entries(raw)).withColumn("fk", F.coalesce(F.concat(F.lit("="), F.col("feed")), F.lit("")))
    files = e.where("path IS NULL").select("fk", "feed", "file_seq", "file_name")
    files = files.withColumn("at", F.row_number().over(Window.partitionBy("fk").orderBy("file_seq", "file_name")))
    fields = e.where("path IS NOT NULL").groupBy("fk", "file_seq", "file_name", "path").agg(F.array_sort(F.collect_set("type")).alias("types"), F.sum("n").alias("n"))
    return files, cut(fields.join(files, ["fk", "file_seq", "file_name"]))


# --- similarity flooding ----------------------------------------------------------------------------


def _tokens(name: str) -> set[str]:
    words = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name.split(":", 1)[-1] if ":" in name else name)
    return {w.lower() for w in words}


def _grams(name: str) -> set[str]:
    s = "".join(sorted(_tokens(name))) or name.lower()
    s = f"#{s}#"
    return {s[i : i + 3] for i in range(max(1, len(s) - 2))}


@lru_cache(1 << 16)
def name_likeness(a: str, b: str) -> float:
    """Likeness of two member names in [0, 1]: prefix and letter case aside, the better of shared words and shared trigrams."""
    if a == b:
        return 1.0
    (ta, tb), (ga, gb) = (_tokens(a), _tokens(b)), (_grams(a), _grams(b))
    words = len(ta & tb) / len(ta | tb) if ta | tb else 0.0
    grams = 2 * len(ga & gb) / (len(ga) + len(gb))
    return max(words, grams)


def castable(old: dict[tuple, list[str]], x: tuple, new: dict[tuple, list[str]], y: tuple) -> bool:
    """Whether values of y can be read as those of x: equal types, plain values as each other, and an object as the plain value it wraps."""
    plain = {"number", "string", "boolean"}

    def kinds(schema: dict[tuple, list[str]], p: tuple) -> set[str]:
        found = set(schema[p])
        inner = set(schema.get((*p, "value"), ())) & plain
        return found | inner if "object" in found else found

    a, b = kinds(old, x), kinds(new, y)
    same = a & b
    return bool(same) or bool(a & plain and b & plain)


def _structure(a: list[tuple], b: list[tuple], start: np.ndarray, threshold: float) -> np.ndarray:
    """For each two members that hold members themselves the share of those that have one alike in the other, if there are two or more."""
    kids_a, kids_b = defaultdict(list), defaultdict(list)
    for paths, kids in ((a, kids_a), (b, kids_b)):
        for i, p in enumerate(paths):
            kids[p[:-1]].append(i)
    out = np.zeros_like(start)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            p, q = kids_a.get(x), kids_b.get(y)
            if p and q:
                alike = start[np.ix_(p, q)] >= threshold
                met = min(int(alike.any(1).sum()), int(alike.any(0).sum()))
                if met >= 2:
                    out[i, j] = met / max(len(p), len(q))
    return out


def flood(old: dict[tuple, list[str]], new: dict[tuple, list[str]], *, threshold: float = 0.5, rounds: int = 60, eps: float = 1e-4) -> list[tuple[tuple, tuple, float]]:
    """Correspondences (old path, new path, score) between two schemas given as path -> types.

    Scores start from name likeness and flow between pairs of members along equal edges of the two graphs, from
    parents to children, back, and between members of a like type, until no score moves by more than ``eps``.
    Paths in both schemas correspond to themselves. Of the others those pairs correspond that can be cast, whose settled
    score is at least 0.6 of the best of either, and whose evidence reaches the threshold and is the best for both sides:
    the settled score times the likeness of the names, or the share of members inside that are alike.
    """
    a, b = sorted(old), sorted(new)
    found = [(x, x, 1.0) for x in a if x in new]
    free_a, free_b = [i for i, x in enumerate(a) if x not in new], [j for j, y in enumerate(b) if y not in old]
    if not free_a or not free_b:
        return found
    types = ("number", "string", "boolean", "array", "object")
    ta, tb = (np.array([[t in schema[x] for t in types] for x in paths], float) for schema, paths in ((old, a), (new, b)))
    both = ta @ tb.T
    same_type = both / np.maximum(1, ta.sum(1)[:, None] + tb.sum(1)[None, :] - both)
    names_a, names_b = sorted({x[-1] for x in a}), sorted({y[-1] for y in b})
    like = np.array([[name_likeness(x, y) for y in names_b] for x in names_a])
    ia, ib = {x: i for i, x in enumerate(names_a)}, {y: j for j, y in enumerate(names_b)}
    named = like[np.ix_([ia[x[-1]] for x in a], [ib[y[-1]] for y in b])]
    start = named * (0.75 + 0.25 * same_type)
    at_b = {y: j for j, y in enumerate(b)}
    for i, x in enumerate(a):
        if x in new:
            start[i, :] = 0
            start[:, at_b[x]] = 0
            start[i, at_b[x]] = 1

    def parents(paths: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(members with a parent, their parents, how many members each parent has)."""
        at = {p: i for i, p in enumerate(paths)}
        kids = np.array([i for i, p in enumerate(paths) if p[:-1] in at], int)
        up = np.array([at[paths[i][:-1]] for i in kids], int)
        return kids, up, np.maximum(1, np.bincount(up, minlength=len(paths)))

    (kids_a, up_a, n_a), (kids_b, up_b, n_b) = parents(a), parents(b)
    s = start.copy()
    for _ in range(rounds):
        x = start + s
        flowed = x + 0.25 * x * same_type
        if len(kids_a) and len(kids_b):
            shared = x / n_a[:, None] / n_b[None, :]
            flowed[np.ix_(kids_a, kids_b)] += shared[np.ix_(up_a, up_b)]
            rows = np.zeros((len(a), len(kids_b)))
            np.add.at(rows, up_a, x[np.ix_(kids_a, kids_b)])
            whole = np.zeros((len(b), len(a)))
            np.add.at(whole, up_b, rows.T)
            flowed += whole.T
        flowed /= max(flowed.max(), 1e-12)
        moved = np.abs(flowed - s).max()
        s = flowed
        if moved < eps:
            break
    # settled scores against the best of either side, so that a member is judged among its rivals
    rivals = s[np.ix_(free_a, free_b)]
    relative = rivals / np.maximum(np.maximum(rivals.max(1, keepdims=True), rivals.max(0, keepdims=True)), 1e-12)
    inside = _structure(a, b, named, threshold)[np.ix_(free_a, free_b)]
    evidence = np.maximum(relative * start[np.ix_(free_a, free_b)], inside)
    for i, u in enumerate(free_a):
        for j, v in enumerate(free_b):
            if evidence[i, j] and (relative[i, j] < 0.6 and not inside[i, j] or not castable(old, a[u], new, b[v])):
                evidence[i, j] = 0
    used_a, used_b = set(), set()
    for i, j in sorted(zip(*np.nonzero(evidence >= threshold)), key=lambda t: (-evidence[t], -relative[t], a[free_a[t[0]]], b[free_b[t[1]]])):
        best = evidence[i, j] >= max(evidence[i].max(), evidence[:, j].max())
        if best and i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            found.append((a[free_a[i]], b[free_b[j]], float(evidence[i, j])))
    return found


def _signature(entries: Column) -> Column:
    return F.sha2(F.concat_ws("\n", entries), 256)


def schema_changes(raw: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """Every change of a file against the one before it in its feed.

    (feed, file_seq, file_name, change, old_path, new_path, old_types, new_types, score); change is added, removed,
    type, renamed or moved; paths are JSON arrays of names, of any depth. What came or went with its parent isn't a
    change of its own. A null feed is a feed of its own; rows without file_seq or file_name are left out; broken
    payloads are left out, but their file counts. The first file has no changes. Flooding runs once per distinct pair of
    schemas that has members on both sides, each in a task of its own.
    """
    return _changes(*file_schemas(raw), threshold)


def _changes(files: DataFrame, fields: DataFrame, threshold: float) -> DataFrame:
    entry = F.concat_ws("\t", "path", F.concat_ws(",", "types"))
    per_file = fields.groupBy("fk", "at").agg(F.array_sort(F.collect_list(entry)).alias("entries")).withColumn("sig", _signature(F.col("entries")))
    per_file = cut(per_file)
    schemas = per_file.groupBy("sig").agg(F.first("entries").alias("entries"))
    # files carry signatures only; a file without fields has that of the empty schema, which is in no table
    nothing = F.array().cast("array<string>")
    chain = files.join(per_file.select("fk", "at", "sig"), ["fk", "at"], "left").withColumn("sig", F.coalesce("sig", _signature(nothing)))
    chain = chain.withColumn("sig_before", F.lag("sig").over(Window.partitionBy("fk").orderBy("at"))).where("sig_before <> sig")
    chain = cut(chain.withColumn("pair", F.concat("sig_before", "sig")))
    pairs = chain.select("pair", "sig_before", "sig").distinct().join(schemas, "sig", "left").withColumnRenamed("entries", "new_entries")
    pairs = pairs.join(schemas.select(F.col("sig").alias("sig_before"), F.col("entries").alias("old_entries")), "sig_before", "left")
    pairs = pairs.select("pair", F.coalesce("old_entries", nothing).alias("before"), F.coalesce("new_entries", nothing).alias("entries"))
    out = "pair string, change string, old_path string, new_path string, old_types array<string>, new_types array<string>, score double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def read(entries) -> dict[tuple, list[str]]:
            return {tuple(json.loads(p)): t.split(",") for p, t in (e.split("\t", 1) for e in entries)}

        for pdf in batches:
            rows = []
            for pair, before_, entries in zip(pdf["pair"], pdf["before"], pdf["entries"]):
                old, new = read(before_), read(entries)
                put = lambda change, o, n, score: rows.append((pair, change, json.dumps(o) if o else None, json.dumps(n) if n else None, old.get(o), new.get(n), score))  # noqa: B023, E731
                to = {o: (n, score) for o, n, score in flood(old, new, threshold=threshold)}
                met = {n for n, _ in to.values()}
                # a parent is there as long as it is matched; the parent of a field always is
                stays = lambda p, known: len(p) == 1 or p[:-1] in known or (len(p) == 2 and p[0] == "properties") or (p[-1] == "[]" and p[:-1] in known)
                for o, (n, score) in to.items():
                    if o == n:
                        if old[o] != new[n]:
                            put("type", o, n, None)
                    elif to.get(o[:-1], (None,))[0] == n[:-1] and o[-1] == n[-1]:
                        pass  # went with its parent
                    else:
                        put("renamed" if to.get(o[:-1], (o[:-1],))[0] == n[:-1] else "moved", o, n, score)
                for o in old:
                    if o not in to and stays(o, to):
                        put("removed", o, None, None)
                for n in new:
                    if n not in met and stays(n, met):
                        put("added", None, n, None)
            if rows:
                yield pd.DataFrame(rows, columns=["pair", "change", "old_path", "new_path", "old_types", "new_types", "score"])

    n_tasks = max(1, fields.sparkSession.sparkContext.defaultParallelism)
    found = pairs.repartition(n_tasks, "pair").mapInPandas(run, out)
    return chain.select("feed", "file_seq", "file_name", "pair").join(found, "pair").drop("pair")


def dotted(path: Column) -> Column:
    """A path in the form properties.NAME."""
    return F.concat_ws(".", F.from_json(path, "array<string>"))


def found_changes(raw: DataFrame) -> DataFrame:
    """(file_name, field_path, change) of fields, with change added, removed or type; a rename or move is one removed and one added."""
    c = schema_changes(raw)
    moved = F.col("change").isin("renamed", "moved")
    each = F.when(moved, F.array(F.struct(F.col("old_path").alias("p"), F.lit("removed").alias("c")), F.struct(F.col("new_path").alias("p"), F.lit("added").alias("c")))).otherwise(
        F.array(F.struct(F.coalesce("new_path", "old_path").alias("p"), F.col("change").alias("c")))
    )
    e = c.select("file_name", F.explode(each).alias("e")).where(is_field(F.col("e.p")))
    return e.select("file_name", dotted(F.col("e.p")).alias("field_path"), F.col("e.c").alias("change"))


# --- one consistent table ----------------------------------------------------------------------------


def canonical_fields(raw: DataFrame, *, threshold: float = 0.5, max_fields: int = 20_000) -> dict[str, tuple[str, str]]:
    """field path -> (canonical path, type), decided over all files.

    Correspondences are added up over all pairs of files. Two fields are merged unless more than half of the files that hold the rarer one hold both.
    The most frequent name of a group is canonical; its type is the most frequent one that is not an object or array,
    if there is any. The result is as large as the vocabulary of member names, which is checked against ``max_fields``.
    """
    files, fields = file_schemas(raw)
    changes = _changes(files, fields, threshold)
    fields = fields.where(is_field(F.col("path")))
    seen = fields.select("path", F.explode("types").alias("type"), "n").groupBy("path", "type").agg(F.sum("n").alias("n"))
    links = changes.where(F.col("change").isin("renamed", "moved") & is_field(F.col("old_path")) & is_field(F.col("new_path"))).groupBy("old_path", "new_path").agg(F.count("*").alias("n"))
    one = fields.select("fk", "at", F.col("path").alias("old_path"))
    two = fields.select("fk", "at", F.col("path").alias("new_path"))
    both = links.join(one, "old_path").join(two, ["fk", "at", "new_path"]).groupBy("old_path", "new_path").agg(F.count("*").alias("both"))
    held = fields.groupBy("path").agg(F.count("*").alias("held"))
    links = links.join(both, ["old_path", "new_path"], "left").join(held.select(F.col("path").alias("old_path"), F.col("held").alias("o")), "old_path").join(held.select(F.col("path").alias("new_path"), F.col("held").alias("w")), "new_path")
    links = links.where(2 * F.coalesce("both", F.lit(0)) <= F.least("o", "w")).select("old_path", "new_path", "n")
    got, pairs = seen.limit(max_fields + 1).collect(), links.limit(max_fields + 1).collect()
    if max(len(got), len(pairs)) > max_fields:
        raise ValueError(f"more than {max_fields} distinct fields or correspondences; raise max_fields if this is meant")
    count: Counter = Counter()
    kinds: dict[str, Counter] = defaultdict(Counter)
    for r in got:
        count[r["path"]] += r["n"]
        kinds[r["path"]][r["type"]] += r["n"]
    parent = {p: p for p in count}

    def root(p: str) -> str:
        while parent[p] != p:
            p = parent[p]
        return p

    for r in sorted(pairs, key=lambda r: (-r["n"], r["old_path"], r["new_path"])):
        x, y = root(r["old_path"]), root(r["new_path"])
        if x != y:
            keep, drop = (x, y) if (count[x], y) >= (count[y], x) else (y, x)
            parent[drop] = keep
            kinds[keep] += kinds[drop]
    out = {}
    for p in count:
        r = root(p)
        flat = {t: n for t, n in kinds[r].items() if t not in ("object", "array")} or kinds[r]
        out[p] = (r, max(sorted(flat), key=lambda t: flat[t]))
    return out


def column_name(path: str) -> str:
    """A column name for a canonical path: letters, digits and underscores, its parents' names in front."""
    return re.sub(r"\W+", "_", "__".join(json.loads(path))).lower()


def unified_table(raw: DataFrame, *, threshold: float = 0.5, max_fields: int = 20_000) -> DataFrame:
    """All Features as rows of one table: raw_id, feature_ord, feed, file_name, file_seq and one column per canonical field.

    Numbers are double, booleans boolean, all else text (objects and arrays as JSON). A number written as text, or
    wrapped as {"value": ...}, is read; what cannot be cast is null in its column and kept whole in ``uncast``, a JSON
    object, or null. Null and broken payloads give no rows. More than ``max_fields`` distinct fields are an error, as they
    would be so many columns.
    """
    canon = canonical_fields(raw, threshold=threshold, max_fields=max_fields)
    names, taken = {}, {"raw_id", "feature_ord", "feed", "file_name", "file_seq", "uncast"}
    for path in sorted({c for c, _ in canon.values()}):
        name = column_name(path)
        while name in taken:
            name += "_"
        taken.add(name)
        names[path] = name
    kind = {c: t for c, t in canon.values()}
    schema = T.StructType(
        [T.StructField("raw_id", T.LongType()), T.StructField("feature_ord", T.IntegerType()), T.StructField("feed", T.StringType()), T.StructField("file_name", T.StringType()), T.StructField("file_seq", T.IntegerType())]
        + [T.StructField(names[p], {"number": T.DoubleType(), "boolean": T.BooleanType()}.get(kind[p], T.StringType())) for p in names]
        + [T.StructField("uncast", T.StringType())]
    )

    def cast(v, t):
        if isinstance(v, dict) and "value" in v and t not in ("object", "array"):
            v = v["value"]
        if t == "number":
            if isinstance(v, bool):
                return float(v)
            if isinstance(v, (int, float)):
                return float(v)
            m = re.fullmatch(r"\s*([-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)\s*%?\s*", v) if isinstance(v, str) else None
            return float(m[1]) if m else None
        if t == "boolean":
            return v if isinstance(v, bool) else {"true": True, "false": False}.get(v.strip().lower()) if isinstance(v, str) else None
        return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = {tuple(json.loads(p)): (c, t) for p, (c, t) in canon.items()}
        for pdf in batches:
            rows = []
            for raw_id, feed, name, seq, text in zip(pdf["raw_id"], pdf["feed"], pdf["file_name"], pdf["file_seq"], pdf["payload"]):
                ok, doc = load_json(text)
                for ord_, f in features_of(doc) if ok else ():
                    row, left = {}, {}
                    props = f.get("properties")
                    members = [((k,), v) for k, v in f.items()] + ([(("properties", k), v) for k, v in props.items()] if isinstance(props, dict) else [])
                    for p, v in members:
                        if v is None or p not in keys:
                            continue
                        c, t = keys[p]
                        value = cast(v, t)
                        if value is None or row.get(names[c]) is not None:
                            left[".".join(p)] = v
                        else:
                            row[names[c]] = value
                    rows.append({"raw_id": raw_id, "feature_ord": ord_, "feed": feed, "file_name": name, "file_seq": seq, **row, "uncast": json.dumps(left) if left else None})
            if rows:
                out = pd.DataFrame(rows, columns=schema.names)
                yield out.where(out.notna(), None)

    return raw.select("raw_id", "feed", "file_name", "file_seq", "payload").mapInPandas(run, schema)
