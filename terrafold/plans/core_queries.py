"""Queries of the raster, scene and dataset operators over the whole tables, each with its SQL.

The pixel table has four reflectance bands. Where an index needs a band it lacks, another takes its place: the green
one that of the red edge and of the second shortwave infrared, the blue one that of the first. The order table serves
as a dense grid of 100 columns, the embeddings as 8 x 8 tiles and as logits of ten classes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions import classes, indices
from terrafold.operators import align, catalog, components, focal, grid, temporal, tiles
from terrafold.session import table
from terrafold.sources import sensors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return put


# --- band math ---------------------------------------------------------------------------------------

BANDS = ["B02", "B03", "B04", "B08"]
ROLES = {"blue": "B02", "green": "B03", "red": "B04", "nir": "B08", "rededge": "B03", "swir1": "B02", "swir2": "B03"}
PIXEL = ["anchor_id", "ts", "y", "x"]
NODATA = (-9999.0, 65535.0)


def reflectance(spark: SparkSession, d: str) -> DataFrame:
    """Wide reflectance pixels in [0, 1], with stray fill values as null."""
    p = table(spark, d, "pixels").where("layer = 'sentinel_2_l2a'")
    p = p.withColumn("value", classes.nodata_to_null(F.col("value"), *NODATA) / 10000.0)
    return grid.bands_to_columns(p, BANDS, PIXEL)


_WIDE = """
px AS (SELECT anchor_id, ts, y, x, band, CASE WHEN value NOT IN (-9999, 65535) THEN value / 10000.0 END AS v FROM pixels WHERE layer = 'sentinel_2_l2a'),
w AS (SELECT anchor_id, ts, y, x, max(v) FILTER (band = 'B02') AS blue, max(v) FILTER (band = 'B03') AS green, max(v) FILTER (band = 'B04') AS red, max(v) FILTER (band = 'B08') AS nir FROM px WHERE band IS NOT NULL GROUP BY ALL),
b AS (SELECT *, green AS rededge, blue AS swir1, green AS swir2 FROM w)
"""
_EPS = "CAST(1e-6 AS DOUBLE)"


def _nd(a: str, b: str) -> str:
    return f"({a} - {b}) / nullif({a} + {b} + {_EPS}, 0)"


_INDEX_SQL = {
    "ndvi": _nd("nir", "red"),
    "evi": f"CAST(2.5 AS DOUBLE) * (nir - red) / nullif(nir + CAST(6 AS DOUBLE) * red - CAST(7.5 AS DOUBLE) * blue + CAST(1 AS DOUBLE) + {_EPS}, 0)",
    "evi2": f"CAST(2.5 AS DOUBLE) * (nir - red) / nullif(nir + CAST(2.4 AS DOUBLE) * red + CAST(1 AS DOUBLE) + {_EPS}, 0)",
    "savi": f"(nir - red) / nullif(nir + red + CAST(0.5 AS DOUBLE) + {_EPS}, 0) * CAST(1.5 AS DOUBLE)",
    "msavi2": "(CAST(2 AS DOUBLE) * nir + 1 - sqrt(greatest((CAST(2 AS DOUBLE) * nir + 1) * (CAST(2 AS DOUBLE) * nir + 1) - CAST(8 AS DOUBLE) * (nir - red), 0))) / 2",
    "ndre": _nd("nir", "rededge"),
    "bsi": f"((swir1 + red) - (nir + blue)) / nullif((swir1 + red) + (nir + blue) + {_EPS}, 0)",
    "ndbi": _nd("swir1", "nir"),
    "ndwi": _nd("green", "nir"),
    "mndwi": _nd("green", "swir1"),
    "ndci": _nd("rededge", "red"),
    "ndmi": _nd("nir", "swir1"),
    "nbr": _nd("nir", "swir2"),
    "ndsi": _nd("green", "swir1"),
}


def _index_query(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return reflectance(spark, d).select(*PIXEL, F.round(indices.index(name, ROLES), 6).alias("value"))

    query(f"WITH {_WIDE} SELECT anchor_id, ts, y, x, round({_INDEX_SQL[name]}, 6) AS value FROM b", f"idx_{name}")(run)


for _name in indices.INDICES:
    _index_query(_name)


@query(f"WITH {_WIDE} SELECT anchor_id, ts, y, x, blue AS B02, green AS B03, red AS B04, nir AS B08 FROM w")
def pivot_bands(spark, d):
    return reflectance(spark, d)


@query(f"WITH {_WIDE} SELECT anchor_id, ts, y, x, unnest(['B02', 'B03', 'B04', 'B08']) AS band, unnest([blue, green, red, nir]) AS value FROM w")
def unpivot_bands(spark, d):
    return grid.columns_to_bands(reflectance(spark, d), BANDS, PIXEL)


@query("""SELECT anchor_id, count(*) AS n, count(*) FILTER (value IN (0, 1, 3, 8, 9, 10)) AS n_masked, round(CAST(count(*) FILTER (value IN (0, 1, 3, 8, 9, 10)) AS DOUBLE) / count(*), 9) AS share
FROM pixels WHERE layer = 'scl' AND value IS NOT NULL GROUP BY anchor_id""")
def mask_scl(spark, d):
    p = table(spark, d, "pixels").where("layer = 'scl' AND value IS NOT NULL")
    m = F.count_if(classes.scl_mask(F.col("value")))
    return p.groupBy("anchor_id").agg(F.count("*").alias("n"), m.alias("n_masked"), F.round(m / F.count("*"), 9).alias("share"))


@query(f"WITH {_WIDE} SELECT anchor_id, ts, y, x, blue > 0.01 AS cirrus FROM w")
def mask_cirrus(spark, d):
    return reflectance(spark, d).select(*PIXEL, classes.cirrus_mask(F.col("B02")).alias("cirrus"))


@query("""WITH m AS (SELECT * FROM (VALUES ('B02', CAST(1105 AS DOUBLE), CAST(1809 AS DOUBLE)), ('B03', 1355, 1757), ('B04', 1552, 1888), ('B08', 2743, 1742)) t(band, mean, std))
SELECT anchor_id, ts, band, y, x, round((value - mean) / std, 6) AS value FROM pixels JOIN m USING (band) WHERE layer = 'sentinel_2_l2a'""")
def normalize_bands(spark, d):
    role = F.when(F.col("band") == "blue", "B02").when(F.col("band") == "green", "B03").when(F.col("band") == "red", "B04").when(F.col("band") == "nir", "B08")
    stats = sensors.bands(spark).where("sensor = 'sentinel-2-l2a'").withColumn("band", role).where("band IS NOT NULL")
    p = table(spark, d, "pixels").where(F.col("layer") == "sentinel_2_l2a").where(F.col("band").isin(BANDS))
    return sensors.normalize(p, stats).select("anchor_id", "ts", "band", "y", "x", F.round("value", 6).alias("value"))


@query("""WITH p AS (SELECT band, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM pixels WHERE layer = 'sentinel_2_l2a' AND value NOT IN (-9999, 65535) GROUP BY band)
SELECT band, round(lo, 6) AS lo, round(hi, 6) AS hi, round(avg(greatest(0, least(1, (value - lo) / (hi - lo + CAST(1e-8 AS DOUBLE))))), 6) AS mean_stretched, count(*) AS n
FROM pixels JOIN p USING (band) WHERE layer = 'sentinel_2_l2a' AND value NOT IN (-9999, 65535) GROUP BY band, lo, hi""")
def stretch_p2_p98(spark, d):
    p = table(spark, d, "pixels").where(F.col("layer") == "sentinel_2_l2a").where(~F.col("value").isin(*NODATA) & F.col("band").isNotNull())
    q = tiles.stretch_limits(p, ["band"])
    s = p.join(q, "band").withColumn("s", classes.stretch(F.col("value"), F.col("lo"), F.col("hi")))
    return s.groupBy("band", "lo", "hi").agg(F.round(F.avg("s"), 6).alias("mean_stretched"), F.count("*").alias("n")).select("band", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "mean_stretched", "n")


@query("""SELECT layer, greatest(count(DISTINCT band), 1) AS n_bands, count(DISTINCT value) AS n_values, bool_or(value <> floor(value)) AS is_float,
CASE WHEN greatest(count(DISTINCT band), 1) >= 3 THEN 'rgb' WHEN greatest(count(DISTINCT band), 1) = 2 THEN 'fallback' WHEN bool_or(value <> floor(value)) THEN 'continuous' WHEN count(DISTINCT value) <= 32 THEN 'categorical' ELSE 'continuous' END AS kind
FROM pixels GROUP BY layer""")
def panel_kind(spark, d):
    return tiles.panel_summary(table(spark, d, "pixels"))


@query("SELECT layer, string_agg(CAST(CAST(value AS INTEGER) AS VARCHAR), ',' ORDER BY value) AS classes FROM (SELECT DISTINCT layer, value FROM pixels WHERE layer IN ('scl', 'dynamicworld') AND value IS NOT NULL) GROUP BY layer")
def classes_present(spark, d):
    return tiles.classes_present(table(spark, d, "pixels").where(F.col("layer").isin("scl", "dynamicworld")))


PALETTE = {0: "#419bdf", 1: "#397d49", 2: "#88b053", 3: "#7a87c6", 4: "#e49635"}


@query("""SELECT color, CAST(('0x' || substr(color, 2, 2)) AS INTEGER) AS red, count(*) AS n FROM (
SELECT CASE CAST(value AS INTEGER) WHEN 0 THEN '#419bdf' WHEN 1 THEN '#397d49' WHEN 2 THEN '#88b053' WHEN 3 THEN '#7a87c6' WHEN 4 THEN '#e49635' ELSE '#000000' END AS color FROM pixels WHERE layer = 'dynamicworld') GROUP BY color""")
def colorize(spark, d):
    p = table(spark, d, "pixels").where("layer = 'dynamicworld'")
    c = p.select(classes.colorize(F.col("value"), PALETTE).alias("color"))
    return c.groupBy("color", classes.hex_channel(F.col("color"), 0).alias("red")).agg(F.count("*").alias("n"))


@query("SELECT anchor_id, layer, CAST(CASE WHEN value = 2 THEN 3 WHEN value = 1 THEN 3 WHEN value = 3 THEN 3 WHEN value = 5 THEN 0 ELSE value END AS DOUBLE) AS value, count(*) AS n FROM pixels WHERE layer IN ('scl', 'dynamicworld') GROUP BY ALL")
def remap_chain(spark, d):
    p = table(spark, d, "pixels").where(F.col("layer").isin("scl", "dynamicworld"))
    return p.groupBy("anchor_id", "layer", classes.remap(F.col("value"), {1: 2, 2: 3, 5: 0}).cast("double").alias("value")).agg(F.count("*").alias("n"))


@query("SELECT anchor_id, layer, band, avg(CAST(value IS NULL AS DOUBLE)) AS null_share FROM pixels GROUP BY ALL HAVING avg(CAST(value IS NULL AS DOUBLE)) <= 0.02")
def nodata_within(spark, d):
    return catalog.nodata_within(table(spark, d, "pixels"), ["anchor_id", "layer", "band"], 0.02)


# --- grids -------------------------------------------------------------------------------------------


@query("SELECT anchor_id, layer, CAST(y // 128 AS INTEGER) AS cy, CAST(x // 128 AS INTEGER) AS cx, count(*) AS n, round(sum(value), 3) AS total FROM pixels GROUP BY ALL")
def grid_chunk(spark, d):
    cy, cx = grid.chunk_of(F.col("y"), F.col("x"), 128)
    return table(spark, d, "pixels").groupBy("anchor_id", "layer", cy.alias("cy"), cx.alias("cx")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("""WITH e AS (SELECT anchor_id, max(y) + 1 AS height, max(x) + 1 AS width FROM pixels GROUP BY anchor_id),
c AS (SELECT *, unnest(range((height + 99) // 100)) AS cy FROM e), g AS (SELECT *, unnest(range((width + 99) // 100)) AS cx FROM c)
SELECT anchor_id, CAST(cy AS INTEGER) AS cy, CAST(cx AS INTEGER) AS cx, CAST(least(100, height - cy * 100) AS INTEGER) AS h, CAST(least(100, width - cx * 100) AS INTEGER) AS w FROM g""")
def grid_cells(spark, d):
    e = table(spark, d, "pixels").groupBy("anchor_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    return grid.chunk_cells(e, 100).select("anchor_id", "cy", "cx", "h", "w")


def _layer(spark, d, layer):
    return table(spark, d, "pixels").where((F.col("layer") == layer) & F.col("value").isNotNull()).groupBy("anchor_id", "y", "x").agg(F.max("value").alias("value"))


@query("""WITH a AS (SELECT anchor_id, y, x, max(value) AS ndvi FROM pixels WHERE layer = 'ndvi' AND value IS NOT NULL GROUP BY ALL), b AS (SELECT anchor_id, y, x, max(value) AS scl FROM pixels WHERE layer = 'scl' AND value IS NOT NULL GROUP BY ALL)
SELECT anchor_id, y, x, ndvi, scl FROM a JOIN b USING (anchor_id, y, x)""")
def grid_align(spark, d):
    return grid.align_layers([_layer(spark, d, "ndvi"), _layer(spark, d, "scl")], ["anchor_id", "y", "x"], names=["ndvi", "scl"])


@query("""WITH e AS (SELECT anchor_id, layer, min(y) AS y0, min(x) AS x0, max(y) + 1 AS y1, max(x) + 1 AS x1 FROM pixels GROUP BY ALL)
SELECT anchor_id, max(y0) AS y0, max(x0) AS x0, min(y1) AS y1, min(x1) AS x1 FROM e GROUP BY anchor_id HAVING max(y0) < min(y1) AND max(x0) < min(x1)""")
def grid_window(spark, d):
    e = table(spark, d, "pixels").groupBy("anchor_id", "layer").agg(F.min("y").alias("y0"), F.min("x").alias("x0"), (F.max("y") + 1).alias("y1"), (F.max("x") + 1).alias("x1"))
    return grid.common_window(e, ["anchor_id"])


def _mosaic_query(method: str, sql: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        p = table(spark, d, "pixels").where("layer = 'sentinel_2_l2a' AND ts IS NOT NULL").select("anchor_id", "band", "y", "x", "ts", "value")
        if method in ("sum", "count"):  # repeated rows change nothing else
            p = p.distinct()
        return grid.mosaic(p, ["anchor_id", "band", "y", "x"], method=method, order="ts").withColumn("value", F.col("value").cast("double"))

    base = "WITH p AS (SELECT DISTINCT anchor_id, band, y, x, ts, value FROM pixels WHERE layer = 'sentinel_2_l2a' AND ts IS NOT NULL)"
    query(f"{base} SELECT anchor_id, band, y, x, CAST({sql} AS DOUBLE) AS value FROM p GROUP BY ALL", f"mosaic_{method}")(run)


for _m, _s in {"first": "arg_min(value, {'t': ts, 'v': value}) FILTER (value IS NOT NULL)", "last": "arg_max(value, {'t': ts, 'v': value}) FILTER (value IS NOT NULL)", "min": "min(value)", "max": "max(value)", "sum": "sum(value)", "count": "count(value)"}.items():
    _mosaic_query(_m, _s)


@query("SELECT anchor_id, layer, band, ts, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, value FROM pixels WHERE y % 2 = 1 AND x % 2 = 1")
def resample_nearest(spark, d):
    return grid.resample_nearest(table(spark, d, "pixels"), ["anchor_id", "layer", "band", "ts"], 2.0)


@query("SELECT anchor_id, layer, CAST(y // 4 AS INTEGER) AS y, CAST(x // 4 AS INTEGER) AS x, round(avg(value), 6) AS value FROM pixels GROUP BY ALL")
def resample_mean(spark, d):
    return grid.resample_mean(table(spark, d, "pixels"), ["anchor_id", "layer"], 4).withColumn("value", F.round("value", 6))


@query("SELECT anchor_id, layer, band, ts, 511 - y AS y, 511 - x AS x, value FROM pixels")
def flip_pixels(spark, d):
    y, x = grid.flip(F.col("y"), F.col("x"), 512, 512, vertical=True, horizontal=True)
    return table(spark, d, "pixels").select("anchor_id", "layer", "band", "ts", y.alias("y"), x.alias("x"), "value")


def order_grid(spark, d):
    """orders as a dense grid, with its height as a column of every row."""
    o = table(spark, d, "orders")
    height = o.agg(F.coalesce(F.max(F.floor(F.col("o_orderkey") / 100)).cast("int") + 1, F.lit(1))).first()[0]
    o = o.select(F.lit(1).alias("g"), F.floor(F.col("o_orderkey") / 100).cast("int").alias("y"), (F.col("o_orderkey") % 100).cast("int").alias("x"), "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    return o, height


_GRID = "g AS (SELECT CAST(o_orderkey // 100 AS INTEGER) AS y, CAST(o_orderkey % 100 AS INTEGER) AS x, o_totalprice AS v, o_custkey, o_orderkey, o_orderstatus FROM orders), hh AS (SELECT max(y) + 1 AS h FROM g)"


def _mirror(src: str, axis: str, size: str, r: int) -> str:
    other = "x" if axis == "y" else "y"
    return f"(SELECT {axis}, {other}, * EXCLUDE ({axis}, {other}) FROM {src} UNION ALL SELECT -1 - {axis}, {other}, * EXCLUDE ({axis}, {other}) FROM {src} WHERE {axis} < {r} UNION ALL SELECT 2 * {size} - 1 - {axis}, {other}, * EXCLUDE ({axis}, {other}) FROM {src} WHERE {axis} >= {size} - {r})"


@query(f"""WITH {_GRID}, s AS (SELECT y, x, v, v * v AS vv FROM g),
a AS (SELECT y, x, avg(v) OVER q AS v, avg(vv) OVER q AS vv FROM {_mirror("s", "x", "100", 3)} WINDOW q AS (PARTITION BY y ORDER BY x ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
a2 AS (SELECT * FROM a WHERE x BETWEEN 0 AND 99),
b AS (SELECT y, x, avg(v) OVER q AS v, avg(vv) OVER q AS vv FROM {_mirror("a2", "y", "(SELECT h FROM hh)", 3)} WINDOW q AS (PARTITION BY x ORDER BY y ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT y, x, round(sqrt(greatest(vv - v * v, 0)), 1) AS deviation FROM b WHERE y BETWEEN 0 AND (SELECT h FROM hh) - 1""")
def box_variance_7(spark, d):
    o, h = order_grid(spark, d)
    v = focal.box_variance(o, ["g"], "o_totalprice", F.lit(h), F.lit(100))
    return v.select("y", "x", F.round(F.sqrt(F.greatest("variance", F.lit(0.0))), 1).alias("deviation"))


def _weighted(column: str, axis: str) -> str:
    """The Gaussian of one axis as a weighted sum of neighbours."""
    w = focal.gaussian_weights(1.0)
    r = len(w) // 2
    at = lambda k: f"lag({column}, {-k}) OVER q" if k < 0 else f"lead({column}, {k}) OVER q" if k else column
    return " + ".join(f"CAST({v!r} AS DOUBLE) * {at(k)}" for k, v in zip(range(-r, r + 1), w)) + f" AS {column}"


_MEANS = ", ".join(f"avg({c}) OVER q AS {c}" for c in ("a", "aa", "b", "bb"))
_ROWS7 = "ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING"


@query(f"""WITH {_GRID}, s AS (SELECT y, x, v / 1e5 AS b07, (o_custkey % 1000 + 500) / CAST(1000 AS DOUBLE) AS b08, (o_orderkey % 97 + 50) / CAST(100 AS DOUBLE) AS b8a FROM g),
g1 AS (SELECT y, x, b07, b8a, {_weighted("b08", "y")} FROM {_mirror("s", "y", "(SELECT h FROM hh)", 4)} WINDOW q AS (PARTITION BY x ORDER BY y)),
g2 AS (SELECT * FROM g1 WHERE y BETWEEN 0 AND (SELECT h FROM hh) - 1),
g3 AS (SELECT y, x, b07, b8a, {_weighted("b08", "x")} FROM {_mirror("g2", "x", "100", 4)} WINDOW q AS (PARTITION BY y ORDER BY x)),
r0 AS (SELECT y, x, b07 / b8a AS a, b08 / b8a AS b FROM g3 WHERE x BETWEEN 0 AND 99),
r AS (SELECT y, x, a, a * a AS aa, b, b * b AS bb FROM r0),
m1 AS (SELECT y, x, {_MEANS} FROM {_mirror("r", "x", "100", 3)} WINDOW q AS (PARTITION BY y ORDER BY x {_ROWS7})),
m2 AS (SELECT * FROM m1 WHERE x BETWEEN 0 AND 99),
m3 AS (SELECT y, x, {_MEANS} FROM {_mirror("m2", "y", "(SELECT h FROM hh)", 3)} WINDOW q AS (PARTITION BY x ORDER BY y {_ROWS7})),
c AS (SELECT y, x, ((aa - a * a) - (bb - b * b)) / ((aa - a * a) + (bb - b * b) + {_EPS}) AS cdi FROM m3 WHERE y BETWEEN 0 AND (SELECT h FROM hh) - 1)
SELECT y, x, round(cdi, 6) AS cdi, cdi < -0.5 AS cloud FROM c""")
def cdi_mask(spark, d):
    o, h = order_grid(spark, d)
    bands = o.select("g", "y", "x", (F.col("o_totalprice") / 1e5).alias("b07"), ((F.col("o_custkey") % 1000 + 500) / 1000.0).alias("b08"), ((F.col("o_orderkey") % 97 + 50) / 100.0).alias("b8a"))
    c = focal.cloud_displacement(bands, ["g"], F.lit(h), F.lit(100))
    return c.select("y", "x", F.round("cdi", 6).alias("cdi"), "cloud")


@query(f"""WITH {_GRID}, o AS (SELECT unnest([-1, -1, -2, -3, -4]) AS dy, unnest([-1, -1, -2, -3, -4]) AS dx)
SELECT DISTINCT y + dy AS y, x + dx AS x FROM g, (VALUES {{offsets}}) t(dy, dx), hh WHERE o_orderstatus = 'F' AND y + dy BETWEEN 0 AND h - 1 AND x + dx BETWEEN 0 AND 99""".replace("{offsets}", ", ".join(str(o) for o in grid.shadow_offsets(135.0, 50.0, 10.0))))
def shadow_project(spark, d):
    o, h = order_grid(spark, d)
    return grid.cast_shadow(o.where("o_orderstatus = 'F'"), [], grid.shadow_offsets(135.0, 50.0, 10.0), h, 100)


def _boxes(spark, d):
    b = [F.get("bbox", F.lit(i)) for i in range(4)]
    return table(spark, d, "footprints").select(F.col("footprint_id").alias("key"), *[c.alias(n) for c, n in zip(b, ("w", "s", "e", "n"))], F.coalesce("geometry_type", F.lit("")).alias("kind"))


_BOX = """b0 AS (SELECT footprint_id AS k, bbox[1] AS w, bbox[2] AS s, bbox[3] AS e, bbox[4] AS n, coalesce(geometry_type, '') AS kind, floor((bbox[1] + 180.0) / 360.0) * 360.0 AS turn FROM footprints WHERE bbox IS NOT NULL),
b1 AS (SELECT k, kind, s, n, w - turn AS w, e - turn + CASE WHEN w > e THEN 360.0 ELSE 0.0 END AS e FROM b0),
b AS (SELECT k, kind, s, n, w, e, FALSE AS t FROM b1 UNION ALL SELECT k, kind, s, n, w - 360.0, e - 360.0, TRUE FROM b1 WHERE e >= 180)"""


@query(f"WITH {_BOX} SELECT DISTINCT p.kind AS kind, p.k AS a, q.k AS b FROM b p JOIN b q ON p.kind = q.kind AND p.k < q.k AND NOT (p.t AND q.t) AND p.w <= q.e AND q.w <= p.e AND p.s <= q.n AND q.s <= p.n")
def touching_boxes(spark, d):
    return components.touching_boxes(_boxes(spark, d), ["kind"], cell=0.25, world=360.0).select("kind", "a", "b")


@query(f"""WITH RECURSIVE {_BOX}, edge AS (SELECT DISTINCT p.k AS a, q.k AS b FROM b p JOIN b q ON p.kind = q.kind AND p.k <> q.k AND NOT (p.t AND q.t) AND p.w <= q.e AND q.w <= p.e AND p.s <= q.n AND q.s <= p.n),
reach(k, c) AS (SELECT footprint_id, footprint_id FROM footprints UNION SELECT e.b, r.c FROM reach r JOIN edge e ON e.a = r.k)
SELECT k AS key, min(c) AS component FROM reach GROUP BY k""")
def box_components(spark, d):
    return components.box_components(_boxes(spark, d), ["kind"], cell=0.25, world=360.0)


# --- scenes ------------------------------------------------------------------------------------------

SERIES = ["anchor_id", "collection"]


def scenes(spark, d):
    """Scenes, each once."""
    return table(spark, d, "scenes").select(*SERIES, "item_id", "ts", "value").distinct()


_SCENES = """
sc AS (SELECT DISTINCT anchor_id, collection, item_id, ts, value FROM scenes WHERE ts IS NOT NULL),
rg AS (SELECT anchor_id, collection, min(ts) AS s, max(ts) AS e FROM sc GROUP BY ALL),
sb AS (SELECT sc.*, s, e, greatest(s, date_trunc('month', ts)) AS month, s + to_days(CAST((epoch_us(ts) - epoch_us(s)) // 86400000000 AS INTEGER)) AS day, greatest(s, date_trunc('year', ts)) AS year, ts AS scene FROM sc JOIN rg USING (anchor_id, collection))
"""
_KEY = "{'t': ts, 'i': coalesce(item_id, ''), 'v': coalesce(value, CAST('-infinity' AS DOUBLE))}"


def _reduce_query(name: str, frequency: str, reducer: str):
    value = {"first": f"arg_min(value, {_KEY})", "last": f"arg_max(value, {_KEY})", "median": "median(value)", "mean": "avg(value)"}[reducer]
    if reducer in ("first", "last"):
        f = {"first": "min", "last": "max"}[reducer]
        # arg_min leaves out null values, which a scene may have
        value = f"(list(value ORDER BY ts, coalesce(item_id, ''), coalesce(value, CAST('-infinity' AS DOUBLE))))[{1 if f == 'min' else -1}]"
    label = {"first": "min(ts)", "last": "max(ts)"}.get(reducer, f"CASE WHEN min(ts) = max(ts) THEN min(ts) ELSE {frequency} END")

    def run(spark: SparkSession, d: str) -> DataFrame:
        return temporal.reduce_scenes(scenes(spark, d), SERIES, frequency=frequency, reducer=reducer).withColumn("value", F.round("value", 6))

    query(f"WITH {_SCENES} SELECT anchor_id, collection, {frequency} AS bucket, {label} AS label_ts, count(*) AS n_scenes, round({value}, 6) AS value FROM sb GROUP BY anchor_id, collection, {frequency}", name)(run)


for _n, _f, _r in (("reduce_first", "month", "first"), ("reduce_last", "month", "last"), ("reduce_median", "month", "median"), ("reduce_mean", "month", "mean"), ("bucket_scene", "scene", "median"), ("bucket_day", "day", "median"), ("bucket_year", "year", "mean")):
    _reduce_query(_n, _f, _r)

_ALL = f"""{_SCENES}, bk0 AS (SELECT anchor_id, collection, s, e, unnest(generate_series(date_trunc('month', s), e, INTERVAL 1 MONTH)) AS m FROM rg),
bk AS (SELECT anchor_id, collection, greatest(s, m) AS bucket, least(e, m + INTERVAL 1 MONTH - INTERVAL 1 MICROSECOND) AS bucket_end FROM bk0)"""


@query(f"WITH {_ALL} SELECT * FROM bk")
def bucket_all(spark, d):
    return temporal.all_buckets(scenes(spark, d), SERIES, frequency="month")


@query(f"""WITH {_ALL}, mid AS (SELECT *, bucket + to_microseconds((epoch_us(bucket_end) - epoch_us(bucket)) // 2) AS m FROM bk),
f AS (SELECT anchor_id, collection, ts, arg_min({{'i': coalesce(item_id, ''), 'v': value}}, {{'i': coalesce(item_id, ''), 'v': coalesce(value, CAST('-infinity' AS DOUBLE))}}) AS c FROM sc GROUP BY ALL),
o AS (SELECT b.anchor_id, b.collection, b.bucket, arg_min({{'t': f.ts, 'c': f.c}}, f.ts) AS own FROM mid b JOIN f ON f.anchor_id = b.anchor_id AND f.collection = b.collection AND f.ts BETWEEN b.bucket AND b.bucket_end GROUP BY ALL),
n AS (SELECT b.anchor_id, b.collection, b.bucket, arg_min({{'t': f.ts, 'c': f.c}}, {{'d': abs(epoch_us(f.ts) - epoch_us(b.m)), 't': f.ts}}) AS near FROM mid b JOIN f ON f.anchor_id = b.anchor_id AND f.collection = b.collection GROUP BY ALL)
SELECT n.anchor_id, n.collection, n.bucket, coalesce(o.own, n.near).t AS scene_ts, coalesce(o.own, n.near).c.v AS value, o.own IS NULL AS filled FROM n LEFT JOIN o ON o.anchor_id = n.anchor_id AND o.collection = n.collection AND o.bucket = n.bucket""")
def bucket_empty_fill(spark, d):
    s = scenes(spark, d)
    return temporal.fill_nearest(temporal.all_buckets(s, SERIES, frequency="month"), s, SERIES)


def _slots_query(name: str, n: int, stride: int):
    def run(spark: SparkSession, d: str) -> DataFrame:
        steps = temporal.reduce_scenes(scenes(spark, d), SERIES, frequency="month", reducer="median")
        return temporal.slots(steps, SERIES, slots=n, strides=stride).select(*SERIES, "sample", "slot", "label_ts", F.round("value", 6).alias("value"))

    query(f"""WITH {_SCENES}, st AS (SELECT anchor_id, collection, month, CASE WHEN min(ts) = max(ts) THEN min(ts) ELSE month END AS label_ts, round(median(value), 6) AS value FROM sb GROUP BY anchor_id, collection, month),
r AS (SELECT *, row_number() OVER (PARTITION BY anchor_id, collection ORDER BY month) - 1 AS r, count(*) OVER (PARTITION BY anchor_id, collection) AS n FROM st),
x AS (SELECT *, unnest(range(CASE WHEN n >= {n} THEN (n - {n}) // {stride} + 1 ELSE 0 END)) AS sample FROM r)
SELECT anchor_id, collection, CAST(sample AS INTEGER) AS sample, CAST(r - sample * {stride} AS INTEGER) AS slot, label_ts, value FROM x WHERE r - sample * {stride} BETWEEN 0 AND {n - 1}""", name)(run)


_slots_query("slots_tumbling", 2, 2)
_slots_query("slots_sliding", 3, 1)
SOURCES = ["sentinel-2-l2a", "landsat-c2-l2", "dynamicworld"]


@query(f"""WITH {_SCENES}, t0 AS (SELECT anchor_id, collection, month AS start, max(least(e, date_trunc('month', month) + INTERVAL 1 MONTH - INTERVAL 1 MICROSECOND)) AS stop, count(*) AS n FROM sb WHERE collection IN ('sentinel-2-l2a', 'landsat-c2-l2', 'dynamicworld') GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY anchor_id, collection ORDER BY start) AS ord FROM t0),
c AS (SELECT anchor_id, collection, count(*) AS k FROM t GROUP BY ALL),
l AS (SELECT anchor_id, arg_max(collection, {{'k': k, 'p': -list_position(['sentinel-2-l2a', 'landsat-c2-l2', 'dynamicworld'], collection)}}) AS lead FROM c GROUP BY anchor_id HAVING count(*) = 3),
r AS (SELECT t.*, l.lead FROM t JOIN l USING (anchor_id) WHERE t.collection = l.lead),
h AS (SELECT r.anchor_id, r.lead, r.ord AS ref_ord, r.n AS ref_n, o.collection, arg_min(o.n, o.ord) AS n FROM r JOIN t o ON o.anchor_id = r.anchor_id AND o.collection <> r.lead AND r.start BETWEEN o.start AND o.stop GROUP BY ALL)
SELECT anchor_id, lead, ref_ord,
  CASE WHEN lead = 'sentinel-2-l2a' THEN ref_n ELSE max(n) FILTER (collection = 'sentinel-2-l2a') END AS n_s2, CASE WHEN lead = 'landsat-c2-l2' THEN ref_n ELSE max(n) FILTER (collection = 'landsat-c2-l2') END AS n_ls, CASE WHEN lead = 'dynamicworld' THEN ref_n ELSE max(n) FILTER (collection = 'dynamicworld') END AS n_dw
FROM h GROUP BY anchor_id, lead, ref_ord, ref_n HAVING count(*) = 2""")
def align_sources(spark, d):
    s = temporal.series_range(scenes(spark, d).where(F.col("ts").isNotNull() & F.col("collection").isin(SOURCES)), SERIES)
    s = s.withColumn("bucket", temporal.bucket_start(F.col("ts"), F.col("start"), "month"))
    t = s.groupBy(*SERIES, "bucket").agg(F.max(temporal.bucket_end(F.col("bucket"), F.col("end"), "month")).alias("end"), F.count("*").alias("n")).withColumnRenamed("bucket", "start")
    from pyspark.sql import Window

    t = t.withColumn("ord", F.row_number().over(Window.partitionBy(*SERIES).orderBy("start")).cast("long")).withColumnRenamed("collection", "source")
    a = align.align_sources(t, ["anchor_id"], SOURCES)
    return a.select("anchor_id", "lead", "ref_ord", *[F.col(f"`{s}`.n").alias(n) for s, n in zip(SOURCES, ("n_s2", "n_ls", "n_dw"))])


@query("""WITH b AS (SELECT DISTINCT anchor_id, collection, item_id, ts, value FROM scenes WHERE ts IS NOT NULL), a AS (SELECT anchor_id, date_trunc('day', ts) AS day, collection, round(avg(value), 6) AS v FROM b GROUP BY ALL),
m AS (SELECT anchor_id, day, max(v) FILTER (collection = 'sentinel-2-l2a') AS s2, max(v) FILTER (collection = 'sentinel-1-rtc') AS s1 FROM a WHERE collection IN ('sentinel-2-l2a', 'sentinel-1-rtc') GROUP BY ALL),
st AS (SELECT anchor_id, max(value) AS label FROM pixels WHERE layer = 'dynamicworld' GROUP BY anchor_id)
SELECT anchor_id, CAST(day AS TIMESTAMP) AS day, coalesce(s2, -9999) AS s2, coalesce(s1, -9999) AS s1, coalesce(label, -9999) AS label FROM m LEFT JOIN st USING (anchor_id)""")
def cube_outer_join(spark, d):
    s = scenes(spark, d).where("ts IS NOT NULL").withColumn("day", temporal.floor_time(F.col("ts"), "D"))
    per = lambda c: s.where(F.col("collection") == c).groupBy("anchor_id", "day").agg(F.round(F.avg("value"), 6).alias("value"))
    label = table(spark, d, "pixels").where("layer = 'dynamicworld'").groupBy("anchor_id").agg(F.max("value").alias("value"))
    return align.to_cube({"s2": per("sentinel-2-l2a"), "s1": per("sentinel-1-rtc")}, ["anchor_id"], "day", nodata=-9999.0, static={"label": label})


@query("""WITH b AS (SELECT DISTINCT anchor_id, collection, item_id, ts, value FROM scenes WHERE ts IS NOT NULL), a AS (SELECT anchor_id, date_trunc('day', ts) AS day, collection, round(avg(value), 6) AS v FROM b GROUP BY ALL),
m AS (SELECT anchor_id, day, max(v) FILTER (collection = 'sentinel-2-l2a') AS s2, max(v) FILTER (collection = 'sentinel-1-rtc') AS s1 FROM a WHERE collection IN ('sentinel-2-l2a', 'sentinel-1-rtc') GROUP BY ALL)
SELECT anchor_id, CAST(day AS TIMESTAMP) AS day, unnest(['s2', 's1']) AS layer, unnest([coalesce(s2, -9999), coalesce(s1, -9999)]) AS value FROM m""")
def cube_split(spark, d):
    s = scenes(spark, d).where("ts IS NOT NULL").withColumn("day", temporal.floor_time(F.col("ts"), "D"))
    per = lambda c: s.where(F.col("collection") == c).groupBy("anchor_id", "day").agg(F.round(F.avg("value"), 6).alias("value"))
    return align.from_cube(align.to_cube({"s2": per("sentinel-2-l2a"), "s1": per("sentinel-1-rtc")}, ["anchor_id"], "day", nodata=-9999.0), ["anchor_id"], "day", ["s2", "s1"])


@query("SELECT collection, CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, count(*) AS n FROM scenes WHERE ts IS NOT NULL GROUP BY ALL")
def floor_time(spark, d):
    s = table(spark, d, "scenes").where("ts IS NOT NULL")
    return s.groupBy("collection", temporal.floor_time(F.col("ts"), "W").alias("week"), temporal.floor_time(F.col("ts"), "M").alias("month")).agg(F.count("*").alias("n"))


# --- from scenes to samples --------------------------------------------------------------------------


@query(f"""WITH {_WIDE}, i AS (SELECT anchor_id, ts, y, x, {_nd("nir", "red")} AS ndvi FROM b),
m AS (SELECT DISTINCT anchor_id, y, x FROM pixels WHERE layer = 'scl' AND value IN (0, 1, 3, 8, 9, 10)),
c AS (SELECT i.anchor_id, i.y, i.x, date_trunc('month', ts) AS month, ndvi FROM i LEFT JOIN m USING (anchor_id, y, x) WHERE m.y IS NULL AND ts IS NOT NULL),
p AS (SELECT anchor_id, y, x, month, median(ndvi) AS ndvi FROM c GROUP BY ALL)
SELECT anchor_id, CAST(month AS TIMESTAMP) AS month, count(*) AS n_pixels, round(avg(ndvi), 6) AS mean_ndvi FROM p GROUP BY ALL""")
def ingest_end_to_end(spark, d):
    """Bands, index, cloud mask, monthly composite and statistics in one plan."""
    r = reflectance(spark, d).where("ts IS NOT NULL")
    cloudy = table(spark, d, "pixels").where("layer = 'scl'").where(classes.scl_mask(F.col("value"))).select("anchor_id", "y", "x")
    i = r.select(*PIXEL, indices.index("ndvi", ROLES).alias("ndvi")).join(cloudy.distinct(), ["anchor_id", "y", "x"], "left_anti")
    p = i.groupBy("anchor_id", "y", "x", temporal.floor_time(F.col("ts"), "M").alias("month")).agg(F.median("ndvi").alias("ndvi"))
    return p.groupBy("anchor_id", "month").agg(F.count("*").alias("n_pixels"), F.round(F.avg("ndvi"), 6).alias("mean_ndvi"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
