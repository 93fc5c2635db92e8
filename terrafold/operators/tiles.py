"""Tiles and anchors as rows: identity, tags, provenance, storage by chunk, and what a mosaic keeps of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions.classes import panel_kind
from terrafold.operators.ranking import exact_percentiles

PIXEL_COLUMNS = {"anchor_id": "string", "layer": "string", "ts": "timestamp_ntz", "band": "string", "y": "int", "x": "int", "value": "double"}
ANCHOR_COLUMNS = ("crs", "minx", "miny", "maxx", "maxy", "res", "width", "height")

#: Fixed name of a lone band that may not be used for others.
RESERVED_BAND = "data"


def validate_pixels(pixels: DataFrame) -> DataFrame:
    """The pixel columns in canonical order; missing columns and columns of another type raise."""
    types = dict(pixels.dtypes)
    missing = [c for c in PIXEL_COLUMNS if c not in types]
    wrong = [f"{c} is {types[c]}, not {t}" for c, t in PIXEL_COLUMNS.items() if c in types and types[c] != t]
    if missing or wrong:
        raise ValueError("; ".join([f"missing {c}" for c in missing] + wrong))
    return pixels.select(*PIXEL_COLUMNS)


def band_problems(pixels: DataFrame) -> DataFrame:
    """(anchor_id, layer, problem) of layers that mix a band with none, or use the reserved name beside others."""
    g = pixels.groupBy("anchor_id", "layer").agg(F.count_if(F.col("band").isNull()).alias("bare"), F.count("band").alias("named"), F.bool_or(F.col("band") == RESERVED_BAND).alias("reserved"), F.count_distinct("band").alias("n"))
    what = F.when((F.col("bare") > 0) & (F.col("named") > 0), "mixes bands with none").when(F.coalesce("reserved", F.lit(False)) & (F.col("n") > 1), "uses the reserved band name")
    return g.select("anchor_id", "layer", what.alias("problem")).where("problem IS NOT NULL")


def layer_summary(pixels: DataFrame) -> DataFrame:
    """(anchor_id, layer, n_bands, bands, n_times, has_time); times count by the second, a layer without bands has one."""
    p = pixels.groupBy("anchor_id", "layer", "band", F.date_trunc("second", F.col("ts")).alias("t")).agg(F.lit(1).alias("one"))
    g = p.groupBy("anchor_id", "layer").agg(F.array_sort(F.collect_set("band")).alias("b"), F.count_distinct("t").alias("n_times"))
    return g.select("anchor_id", "layer", F.greatest(F.size("b"), F.lit(1)).alias("n_bands"), F.concat_ws(",", "b").alias("bands"), "n_times", (F.col("n_times") > 0).alias("has_time"))


def cast_layers(pixels: DataFrame, types: dict[str, str], value: str = "value") -> DataFrame:
    """Pixels whose values went through the type of their layer, as int16 or float32; layers not named stay. What a type can't hold is null."""
    names = {"uint8": ("int", 0, 255), "int8": ("tinyint",), "int16": ("smallint",), "uint16": ("int", 0, 65535), "int32": ("int",), "float32": ("float",), "float64": ("double",)}
    out = F.col(value).cast("double")
    for layer, t in types.items():
        kind, *bounds = names[t]
        v = F.when(F.isnan(value), None).otherwise(F.col(value)) if not t.startswith("float") else F.col(value)
        cast = v.try_cast(kind)
        cast = F.when(cast.between(*bounds), cast).otherwise(None) if bounds else cast
        out = F.when(F.col("layer") == layer, cast.cast("double")).otherwise(out)
    return pixels.withColumn(value, out)


def declared_nodata(layers: DataFrame, on: list[str], nodata: str = "nodata") -> DataFrame:
    """(on, nodata): the one nodata value a layer's files declare, or null where they declare none or several."""
    g = layers.groupBy(*on).agg(F.count_distinct(nodata).alias("_n"), F.min(nodata).alias("_v"))
    return g.select(*on, F.when(F.col("_n") == 1, F.col("_v")).alias(nodata))


def tile_range(given: tuple[Column, Column], times: tuple[Column, Column], tag: tuple[Column, Column]) -> tuple[Column, Column]:
    """(start, end) of a stored tile: those given, else the first and last of its times, else its tag's; none of them raises."""
    missing = F.raise_error(F.lit("a tile without a time")).cast("timestamp_ntz")
    chosen = F.when(given[0].isNotNull(), F.struct(given[0].alias("a"), F.coalesce(given[1], given[0]).alias("b"))).when(times[0].isNotNull(), F.struct(times[0].alias("a"), times[1].alias("b"))).when(tag[0].isNotNull(), F.struct(tag[0].alias("a"), F.coalesce(tag[1], tag[0]).alias("b")))
    return F.coalesce(chosen["a"], missing), F.coalesce(chosen["b"], missing)


def panel_summary(pixels: DataFrame) -> DataFrame:
    """(layer, n_bands, n_values, is_float, kind): what decides how a layer is shown, and how.

    Distinct values come first, so the wide aggregation sees few rows.
    """
    v = pixels.groupBy("layer", "band", "value").agg(F.lit(1).alias("one"))
    g = v.groupBy("layer").agg(F.greatest(F.count_distinct("band"), F.lit(1)).alias("n_bands"), F.count_distinct("value").alias("n_values"), F.bool_or(F.col("value") != F.floor("value")).alias("is_float"))
    return g.withColumn("kind", panel_kind(F.col("n_bands"), F.col("is_float"), F.col("n_values")))


def classes_present(pixels: DataFrame) -> DataFrame:
    """(layer, classes): the class codes of each layer in order, as text with commas between; null is none."""
    p = pixels.where(F.col("value").isNotNull()).groupBy("layer", F.col("value").cast("int").alias("c")).agg(F.lit(1).alias("one"))
    return p.groupBy("layer").agg(F.array_sort(F.collect_list("c")).alias("c")).select("layer", F.concat_ws(",", F.col("c").cast("array<string>")).alias("classes"))


def stretch_limits(pixels: DataFrame, by: list[str], *, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """(by, lo, hi): exact percentiles to stretch between; the least and the greatest value where both are the same."""
    q = exact_percentiles(pixels, by, "value", [low, high, 0.0, 1.0], ["lo", "hi", "_min", "_max"])
    flat = F.col("hi") <= F.col("lo")
    return q.select(*by, F.when(flat, F.col("_min")).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("_max")).otherwise(F.col("hi")).alias("hi"))


def area_total(pixels: DataFrame, by: list[str], *, res: float, per: float = 10_000.0) -> DataFrame:
    """(by, total): the sum of a value given per ``per`` square metres over pixels of ``res`` metres; null values count nothing."""
    return pixels.groupBy(*by).agg((F.sum("value") * res * res / per).alias("total"))


def rgb_subset(bands: Column, rgb: list[str]) -> Column:
    """The rgb bands in their order if the layer has all of them, else null."""
    want = F.array(*map(F.lit, rgb))
    return F.when(F.size(F.array_except(want, bands)) == 0, want)


def resolve_rgb(bands: list[str], rgb: list[str] | None) -> list[str]:
    """Bands to show: those asked for, or the layer's own three; anything else is ambiguous and raises."""
    chosen = rgb or bands
    if len(chosen) != 3 or not set(chosen) <= set(bands):
        raise ValueError(f"can't choose three of {', '.join(bands)}")
    return chosen


def merge_metadata(older: Column, newer: Column) -> Column:
    """Two maps as one; of a key in both the newer value counts. A null map is empty."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(older, empty), F.coalesce(newer, empty)
    kept = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    return F.map_concat(kept, b)


def rebase(anchors: DataFrame, **changes: Column) -> DataFrame:
    """Anchors with changed columns: metadata and plot_meta are merged into what is there, all others replace it."""
    out = {}
    for name, value in changes.items():
        if name not in anchors.columns:
            raise ValueError(f"anchors have no {name}")
        out[name] = merge_metadata(F.col(name), value) if name in ("metadata", "plot_meta") else value
    return anchors.withColumns(out)


def tag_json(start: Column, end: Column, **parts: Column) -> Column:
    """The tag as JSON text: the range in ISO form with microseconds, and the parts that are not null."""
    iso = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.to_json(F.struct(F.array(iso(start), iso(end)).alias("datetime"), *[c.alias(n) for n, c in parts.items()]))


def read_tag(tag: Column, schema: str = "struct<datetime:array<string>,metadata:map<string,string>>") -> tuple[Column, Column, Column]:
    """(start, end, the whole tag) of a tag's JSON text; nulls if it can't be read."""
    t = F.from_json(tag, schema)
    at = lambda i: F.expr("NULL").cast("timestamp_ntz") if i is None else F.try_to_timestamp(F.get(t["datetime"], F.lit(i)), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).cast("timestamp_ntz")
    return at(0), at(1), t


def anchors_of(tiles: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Anchors without pixels, each grid once."""
    return tiles.select(*ANCHOR_COLUMNS, *(extra or [])).distinct()


def solar_day(ts: Column, lon: Column) -> Column:
    """Date by the sun at a longitude, which groups the scenes of one overpass."""
    return F.to_date(ts + F.make_dt_interval(secs=F.round(lon / 15 * 3600).cast("decimal(18,6)")))


def mosaic_tags(tiles: DataFrame, by: list[str], *, order: str = "tile_ord") -> DataFrame:
    """What a mosaic keeps: first start, last end, metadata of which later tiles win, plot_meta of the first, and all
    provenance items in order, repeats too. Tiles of one mosaic are few; each list has the size of their tags."""
    g = tiles.groupBy(*by).agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("plot_meta", order).alias("plot_meta"), F.array_sort(F.collect_list(F.struct(order, F.map_entries("metadata").alias("m"), "items"))).alias("_t")
    )
    empty = F.create_map().cast("map<string,string>")
    meta = F.aggregate("_t", empty, lambda acc, t: merge_metadata(acc, F.map_from_entries(F.coalesce(t["m"], F.array().cast("array<struct<key:string,value:string>>")))))
    items = F.flatten(F.transform("_t", lambda t: F.coalesce(t["items"], F.array().cast("array<string>"))))
    return g.select(*by, "start", "end", meta.alias("metadata"), "plot_meta", items.alias("items"))


def arrays_to_pixels(arrays: DataFrame, on: list[str], *, values: str = "values", bands: list[str] | None = None) -> DataFrame:
    """Rows of 2-D (y, x) or, with band names, 3-D (band, y, x) nested arrays as pixels; a wrong number of bands raises."""
    if bands is None:
        rows = arrays.select(*on, F.lit(None).cast("string").alias("band"), F.posexplode(values).alias("y", "_row"))
    else:
        names = F.array(*map(F.lit, bands))
        checked = F.when(F.size(values) == len(bands), F.col(values)).otherwise(F.raise_error(F.lit(f"expected {len(bands)} bands")).cast("array<array<array<double>>>"))
        planes = arrays.select(*on, F.posexplode(checked).alias("_b", "_plane")).select(*on, F.get(names, F.col("_b")).alias("band"), "_plane")
        rows = planes.select(*on, "band", F.posexplode("_plane").alias("y", "_row"))
    return rows.select(*on, "band", "y", F.posexplode("_row").alias("x", "value"))


def pixels_to_chunks(pixels: DataFrame, on: list[str], size: int = 512) -> DataFrame:
    """Pixels packed as one row per chunk: on, cy, cx, and entries of (place in the chunk, value) in order."""
    y, x = F.col("y"), F.col("x")
    place = ((y % size) * size + x % size).cast("int")
    g = pixels.groupBy(*on, F.floor(y / size).cast("int").alias("cy"), F.floor(x / size).cast("int").alias("cx"))
    return g.agg(F.array_sort(F.collect_list(F.struct(place.alias("i"), F.col("value").alias("v")))).alias("entries"))


def chunks_to_pixels(chunks: DataFrame, on: list[str], size: int = 512) -> DataFrame:
    e = chunks.select(*on, "cy", "cx", F.explode("entries").alias("e"))
    return e.select(*on, (F.col("cy") * size + F.floor(F.col("e.i") / size)).cast("int").alias("y"), (F.col("cx") * size + F.col("e.i") % size).cast("int").alias("x"), F.col("e.v").alias("value"))


def place_names(points: DataFrame, gazetteer: DataFrame, *, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Points with the gazetteer's columns for their place rounded to two decimals; null where it has none."""
    key = [F.round(F.col(lat), 2).alias("_la"), F.round(F.col(lon), 2).alias("_lo")]
    rest = [c for c in gazetteer.columns if c not in (lon, lat)]
    g = gazetteer.select(*key, *rest).dropDuplicates(["_la", "_lo"])
    return points.withColumn("_la", key[0]).withColumn("_lo", key[1]).join(g, ["_la", "_lo"], "left").drop("_la", "_lo")
