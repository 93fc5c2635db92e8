"""Deeply nested records as flat node tables.

Every node of a record gets its pre-order and post-order number by a depth-first walk. A node lies under
another exactly if its interval lies inside the other's, so tables of any two node types are linked by
interval containment on the record's key, whatever lies between them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafold.functions.jsonwalk import features_of, load_json, number_nodes

NODES = T.StructType(
    [
        T.StructField("rec", T.LongType()),
        T.StructField("ord", T.IntegerType()),
        T.StructField("pre", T.IntegerType()),
        T.StructField("post", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("path", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("idx", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("child_type", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)


def label_nodes(records: DataFrame, *, key: str, payload: str, keep: str | None = None, values: bool = True, features: bool = True, vectors: bool = True) -> DataFrame:
    """One row per node of every Feature in the payload: record key, feature ordinal, interval labels, place and value.

    Null, empty or broken payloads and those that hold no Feature give no rows; rows with a null key neither. A
    payload given twice under two keys counts twice. With ``features`` False the payload itself, whatever it is, is the one
    root. Arrays of numbers are one node, or with ``vectors`` False a node and one for each number. ``keep`` is a pattern
    of depth:path, as 2:assets.B04, of the nodes to give out (labels count all nodes); ``values`` False leaves the values null.
    Other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = re.compile(keep, re.DOTALL) if keep else None
        known: dict[tuple[int, str], bool] = {}
        for pdf in batches:
            out = []
            for rec, text in zip(pdf["rec"], pdf["payload"]):
                ok, doc = load_json(text)
                if not ok or pd.isna(rec):
                    continue
                for ord_, root in features_of(doc) if features else [(0, doc)]:
                    for n in number_nodes(root, vectors):
                        if wanted is not None:
                            hit = known.get((n[2], n[3]))
                            if hit is None:
                                if len(known) > 100_000:
                                    known.clear()
                                hit = known[n[2], n[3]] = wanted.search(f"{n[2]}:{n[3]}") is not None
                            if not hit:
                                continue
                        v = n[8]
                        text_value = None
                        if values and n[6] not in ("object", "array", "null"):
                            text_value = v if n[6] == "string" else json.dumps(v, separators=(",", ":"))
                        out.append((rec, ord_, *n[:8], text_value))
            if out:
                yield pd.DataFrame(out, columns=NODES.names).astype({"idx": "Int32"})

    return records.select(F.col(key).cast("long").alias("rec"), F.col(payload).alias("payload")).mapInPandas(run, NODES)


def link(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Child rows with parent_pre and parent_path of the given parent whose interval contains theirs; others are left out.

    Parents must not contain each other, so one sort of both within the record tells each child's only candidate, and the
    interval decides. For parents that do, ``ancestors`` gives all.
    """
    p = parents.select("rec", "ord", "pre", "post", F.lit(True).alias("_parent"), F.col("path").alias("_path"))
    c = children.withColumn("_parent", F.lit(False))
    w = Window.partitionBy("rec", "ord").orderBy("pre", F.desc("_parent")).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("_parent"), F.struct("pre", "post", "_path")), ignorenulls=True).over(w)
    both = c.unionByName(p, allowMissingColumns=True).withColumn("_last", last).where(~F.col("_parent") & (F.col("_last.post") > F.col("post")))
    return both.select(*children.columns, F.col("_last.pre").alias("parent_pre"), F.col("_last._path").alias("parent_path"))


def ancestors(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Child rows with parent_pre and parent_path for every given parent whose interval contains theirs, nested ones too."""
    p = parents.select("rec", "ord", F.col("pre").alias("parent_pre"), F.col("post").alias("parent_post"), F.col("path").alias("parent_path"))
    inside = (F.col("parent_pre") < F.col("pre")) & (F.col("parent_post") > F.col("post"))
    return children.join(p, ["rec", "ord"]).where(inside).drop("parent_post")


def with_ancestor(nodes: DataFrame, name: str, is_parent: Column, what: Column) -> DataFrame:
    """Adds ``name``: ``what`` of the nearest node that satisfies ``is_parent`` and contains this one, else null.

    Such nodes must not contain each other. In pre-order the last one before a node is then the only one that can
    contain it, and the interval decides; one sort within the record does the join for any number of types.
    """
    w = Window.partitionBy("rec", "ord").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(is_parent, F.struct(F.col("post").alias("post"), what.alias("what"))), ignorenulls=True).over(w)
    return nodes.withColumn(name, last).withColumn(name, F.when(F.col(f"{name}.post") > F.col("post"), F.col(f"{name}.what")))


#: Paths of a Feature that its child tables come from.
_CHILD_PATHS = r"^(\d+:properties\.instruments(\[\])?|\d+:geometry\.coordinates(\[\])*|2:assets\..*|3:assets\..*\.eo:bands|4:assets\..*\.eo:bands\[\])\Z"


def feature_nodes(raw: DataFrame, *, key: str = "raw_id", payload: str = "payload", values: bool = True) -> DataFrame:
    """Nodes of the Features' instruments, geometry and assets, with their kind and the place of their parents.

    kind is instrument, polygon, ring, vertex, asset, band, or null for what lies in between. The member names of
    assets may hold any character, so assets are told by depth, not by path.
    """
    n = label_nodes(raw, key=key, payload=payload, keep=_CHILD_PATHS, values=values)
    coords = F.col("path").startswith("geometry.coordinates")
    level = F.when(coords, F.col("depth") - 2)
    ring = coords & (F.col("type") == "array") & (F.col("child_type") == "vector")
    asset = F.col("path").startswith("assets.") & (F.col("depth") == 2)
    n = n.withColumn("level", level)
    n = with_ancestor(n, "asset", asset, F.col("key"))
    n = with_ancestor(n, "bands", F.col("path").startswith("assets.") & (F.col("depth") == 3) & (F.col("key") == "eo:bands"), F.col("depth"))
    # of a vertex at level 3 the polygon is the entry at level 1, at level 2 the coordinates themselves
    n = with_ancestor(n, "first", coords & (F.col("depth") == 3) & (F.col("type") == "array"), F.col("idx"))
    n = with_ancestor(n, "ring", ring, F.struct(F.col("idx"), F.col("level")))
    kind = (
        F.when((F.col("path") == "properties.instruments[]") & (F.col("depth") == 3), "instrument")
        .when((F.col("path") == "properties.instruments") & (F.col("type") == "string"), "instrument")
        .when(coords & (F.col("type") == "vector"), "vertex")
        .when(ring, "ring")
        .when(asset, "asset")
        .when((F.col("bands") == 3) & (F.col("depth") == 4) & F.col("idx").isNotNull(), "band")
    )
    return n.withColumn("kind", kind)


def feature_children(raw: DataFrame, *, key: str = "raw_id", payload: str = "payload", values: bool = True) -> DataFrame:
    """(raw_id, feature_ord, child, parent_path, child_ord, value) of the instruments, vertices, assets and bands.

    parent_path is '' for an instrument, 'polygon/ring' for a vertex, the asset's name for an asset and a band. A
    bare string is one instrument; null and [] give none; ``values`` False leaves the values null. A lone position is '0/0', as is one of a line.
    """
    n = feature_nodes(raw, key=key, payload=payload, values=values)
    polygon = F.when(F.col("level") >= 3, F.col("first")).otherwise(0)
    ring = F.when(F.col("level") >= 2, F.col("ring.idx")).otherwise(0)
    parent = F.when(F.col("kind") == "vertex", F.concat_ws("/", polygon, ring)).when(F.col("kind") == "asset", F.col("key")).when(F.col("kind") == "band", F.col("asset")).otherwise("")
    ord_ = F.when(F.col("kind") == "asset", 0).otherwise(F.coalesce("idx", F.lit(0)))
    n = n.where(F.col("kind").isin("instrument", "vertex", "asset", "band"))
    return n.select(F.col("rec").alias("raw_id"), F.col("ord").alias("feature_ord"), F.col("kind").alias("child"), parent.alias("parent_path"), ord_.cast("int").alias("child_ord"), "value", "pre", "post")
