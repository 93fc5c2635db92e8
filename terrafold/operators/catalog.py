"""Declarative catalog searches compiled to filters, projections, sorting and limits on an items table."""

from __future__ import annotations

from collections.abc import Iterator

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def parse_sort(spec: str) -> tuple[str, bool]:
    """'-field' is descending, '+field' and 'field' ascending."""
    name = spec.strip()
    down = name.startswith("-")
    name = name.lstrip("+-").strip()
    if not name:
        raise ValueError(f"no field in sort key {spec!r}")
    return name, down


_NAME = r'[A-Za-z_][A-Za-z0-9_:.]*'
_TOKENS = re.compile(rf"\s*(?:(?P<text>'(?:[^']|'')*')|(?P<num>-?\d+(?:\.\d+)?)|(?P<op><=|>=|<>|!=|=|<|>|\(|\)|,)|(?P<name>\"[^\"]+\"|{_NAME}))")
_WORDS = {"and", "or", "not", "in", "between", "is", "null", "like", "true", "false"}


def filter_expression(text: str, properties: dict[str, str]) -> str:
    """A CQL2 text filter as SQL. ``properties`` maps its names to columns; an unknown name or character raises."""
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKENS.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"can't read the filter at {text[at:at + 20]!r}")
        at = m.end()
        if m["name"]:
            name = m["name"].strip('"')
            if name.lower() in _WORDS:
                out.append(name.upper())
            elif name in properties:
                out.append(f"`{properties[name]}`")
            else:
                raise ValueError(f"unknown property {name!r}")
        elif m["text"]:
            out.append("'" + m["text"][1:-1].replace("''", "\\'") + "'")
        else:
            out.append(m["num"] or m["op"])
    return " ".join(out)


@dataclass(frozen=True)
class Search:
    """What to look for; None means no condition. bbox is (west, south, east, north), the range inclusive."""

    collections: tuple[str, ...] | None = None
    ids: tuple[str, ...] | None = None
    bbox: tuple[float, float, float, float] | None = None
    start: str | None = None
    end: str | None = None
    filter: str | None = None
    fields: tuple[str, ...] | None = None
    exclude: tuple[str, ...] | None = None
    sortby: tuple[str, ...] = ()
    max_items: int | None = None

    def with_filter(self, text: str | None) -> Search:
        """A search with this filter in place of the one before."""
        return replace(self, filter=text)

    def with_sortby(self, *specs: str | dict | list) -> Search:
        """Adds sort keys: '-f', {'field': f, 'direction': 'desc'}, or lists of them."""
        flat: list[str] = []
        for s in specs:
            if isinstance(s, dict):
                flat.append(("-" if s.get("direction", "asc").lower() == "desc" else "") + s["field"])
            elif isinstance(s, str):
                flat.extend(x for x in s.split(",") if x.strip()) if "," in s else flat.append(s)
            else:
                flat.extend(self.with_sortby(*s).sortby[len(self.sortby) :])
        for s in flat:
            parse_sort(s)
        return replace(self, sortby=(*self.sortby, *flat))


def box_meets(box: Column, bbox: tuple[float, float, float, float]) -> Column:
    """Whether an array [west, south, east, north] meets the box; either may cross the 180 degree line (west > east)."""
    w, s, e, n = (F.get(box, F.lit(i)) for i in range(4))
    W, S, E, N = bbox
    lat = (s <= N) & (n >= S)
    if W <= E:
        lon = F.when(w <= e, (w <= E) & (e >= W)).otherwise((w <= E) | (e >= W))
    else:
        lon = F.when(w <= e, (w <= E) | (e >= W)).otherwise(F.lit(True))
    return lat & lon


def search(items: DataFrame, q: Search, *, collection: str = "collection", id: str = "item_id", ts: str = "ts", bbox: str = "bbox", properties: dict[str, str] | None = None, tie: str | None = None) -> DataFrame:
    """Items that satisfy all conditions of a search. Conditions on plain columns reach the scan.

    With a limit the order should be total: ``tie`` is added as the last sort key.
    """
    df = items
    if q.collections is not None:
        df = df.where(F.col(collection).isin(*q.collections))
    if q.ids is not None:
        df = df.where(F.col(id).isin(*q.ids))
    if q.start is not None:
        df = df.where(F.col(ts) >= F.lit(q.start).cast("timestamp_ntz"))
    if q.end is not None:
        df = df.where(F.col(ts) <= F.lit(q.end).cast("timestamp_ntz"))
    if q.bbox is not None:
        df = df.where(box_meets(F.col(bbox), q.bbox))
    if q.filter:
        df = df.where(filter_expression(q.filter, {c: c for c in items.columns} | (properties or {})))
    if q.sortby or (q.max_items is not None and tie):
        keys = [(properties or {}).get(f, f) for f, _ in map(parse_sort, q.sortby)]
        downs = [d for _, d in map(parse_sort, q.sortby)]
        order = [F.col(k).desc_nulls_last() if d else F.col(k).asc_nulls_last() for k, d in zip(keys, downs)]
        df = df.orderBy(*order, *([F.col(tie).asc()] if tie else []))
    if q.max_items is not None:
        df = df.limit(q.max_items)
    if q.fields is not None:
        df = df.select(*q.fields)
    if q.exclude is not None:
        df = df.drop(*q.exclude)
    return df


def collections_of(items: DataFrame, collection: str = "collection") -> DataFrame:
    return items.select(collection).where(F.col(collection).isNotNull()).distinct()


def require_collection(items: DataFrame, name: str, collection: str = "collection") -> None:
    """Raises if the catalog has no such collection."""
    if not items.where(F.col(collection) == name).select(collection).limit(1).collect():
        raise ValueError(f"no collection {name!r}")


def search_iter(items: DataFrame, q: Search, *, page: int = 100, **names) -> Iterator[list[Row]]:
    """Pages of a search's results, worked out partition by partition as they are asked for."""
    if page < 1:
        raise ValueError("page must be at least 1")
    rows = []
    for r in search(items, q, **names).toLocalIterator():
        rows.append(r)
        if len(rows) == page:
            yield rows
            rows = []
    if rows:
        yield rows


def peek_item(items: DataFrame, name: str, collection: str = "collection") -> DataFrame:
    """One row (item): a whole item of the collection as JSON text, or no row if there is none."""
    return items.where(F.col(collection) == name).limit(1).select(F.to_json(F.struct("*")).alias("item"))


def peek_bands(items: DataFrame, name: str, *, collection: str = "collection", assets: str = "assets") -> DataFrame:
    """(band, fields) of one item's assets, a map of JSON texts: what each asset says beside its address. No rows if there is no item."""
    one = items.where((F.col(collection) == name) & F.col(assets).isNotNull()).limit(1)
    e = one.select(F.explode(assets).alias("band", "asset"))
    kept = F.map_filter(F.from_json("asset", "map<string,string>"), lambda k, _: ~k.isin("href", "type", "title", "roles"))
    return e.select("band", kept.alias("fields"))


def nodata_within(pixels: DataFrame, on: list[str], most: float, value: str = "value") -> DataFrame:
    """Groups whose share of null values is at most ``most``: on, null_share."""
    g = pixels.groupBy(*on).agg(F.avg(F.col(value).isNull().cast("double")).alias("null_share"))
    return g.where(F.col("null_share") <= most)


def append_items(existing: DataFrame, added: DataFrame, on: list[str], id: str = "item_id") -> DataFrame:
    """Provenance items of tiles with those added whose ids a tile does not have yet; repeats within the added stay."""
    return existing.unionByName(added.join(existing.select(*on, id).distinct(), [*on, id], "left_anti"))
