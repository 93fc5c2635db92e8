"""Catalog items from pages of search results, as a Python data source: one partition per page.

Pages are JSON texts with a list of features, files below a folder or addresses given one by one. Equality filters on
the collection and the id are taken over by the source.
"""

from __future__ import annotations

import glob
import json
import os
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

SCHEMA = "item_id string, collection string, ts string, bbox array<double>, properties map<string,string>, assets map<string,string>"

#: Answers that are worth another try, and how often.
RETRY_STATUS, RETRIES = (502, 503, 504), 5


#: Fixed addresses of public catalogs by name.
CATALOGS = {
    "cdse": "https://stac.dataspace.copernicus.eu/v1/",
    "planetary_computer": "https://planetarycomputer.microsoft.com/api/stac/v1/",
    "element84": "https://earth-search.aws.element84.com/v1/",
}


def page_address(catalog: str, collection: str, *, limit: int = 100, **query: str) -> str:
    """Address of the first page of a collection's items in a named catalog, for ``spark.read.format("catalog_pages")``."""
    if catalog not in CATALOGS:
        raise ValueError(f"unknown catalog {catalog!r}; one of {', '.join(sorted(CATALOGS))}")
    return f"{CATALOGS[catalog]}collections/{urllib.parse.quote(collection)}/items?{urllib.parse.urlencode({'limit': limit, **query})}"


def signed(items: DataFrame, tokens: dict[str, str], *, assets: str = "assets", collection: str = "collection") -> DataFrame:
    """Items whose asset addresses carry their collection's access token; collections without one stay as they are.

    Tokens are asked for once per collection by the caller, as they hold for all of its assets.
    """
    token = F.create_map(*[F.lit(v) for kv in tokens.items() for v in kv]) if tokens else F.create_map().cast("map<string,string>")
    add = F.element_at(token, F.col(collection)) if tokens else F.lit(None).cast("string")

    def with_token(_, asset):
        href = F.get_json_object(asset, "$.href")
        return F.when(add.isNotNull() & href.isNotNull(), F.replace(asset, href, F.concat(href, F.when(href.contains("?"), "&").otherwise("?"), add))).otherwise(asset)

    return items.withColumn(assets, F.transform_values(assets, with_token))


class Page(InputPartition):
    def __init__(self, place: str) -> None:
        self.place = place


def fetch(place: str) -> dict:
    """A page's JSON, from a file or with retries from an address."""
    if "://" not in place:
        with open(place, encoding="utf-8") as f:
            return json.load(f)
    for attempt in range(RETRIES + 1):
        try:
            with urllib.request.urlopen(place, timeout=30) as r:
                return json.load(r)
        except urllib.error.HTTPError as x:
            if x.code not in RETRY_STATUS or attempt == RETRIES:
                raise
        time.sleep(2**attempt)
    raise RuntimeError("unreachable")


class PageReader(DataSourceReader):
    def __init__(self, places: list[str]) -> None:
        self.places, self.equal = places, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("collection",), ("item_id",)) and f.attribute[0] not in self.equal:
                self.equal[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [Page(p) for p in self.places]

    def read(self, partition: Page) -> Iterator[tuple]:
        text = lambda v: v if isinstance(v, str) else json.dumps(v)
        for f in fetch(partition.place).get("features", []):
            if "collection" in self.equal and f.get("collection") != self.equal["collection"] or "item_id" in self.equal and f.get("id") != self.equal["item_id"]:
                continue
            p = f.get("properties") or {}
            bbox = [float(x) for x in f["bbox"]] if f.get("bbox") else None
            yield f.get("id"), f.get("collection"), p.get("datetime"), bbox, {k: text(v) for k, v in p.items() if v is not None}, {k: text(v) for k, v in (f.get("assets") or {}).items()}


class CatalogPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "catalog_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        path = self.options.get("path", "")
        places = sorted(glob.glob(os.path.join(path, "**", "*.json"), recursive=True)) if os.path.isdir(path) else [p for p in path.split(",") if p]
        if not places:
            raise ValueError(f"no pages at {path!r}")
        return PageReader(places)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CatalogPages)
