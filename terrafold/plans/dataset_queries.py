"""Queries of the dataset, metric, catalog, geometry and date operators over the whole tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions import classes, dates, geo, strings
from terrafold.operators import catalog, datasets, inference, metrics, patches, points, tiles, warp
from terrafold.plans import pipeline
from terrafold.session import table
from terrafold.sources import anchors, sensors, yolo

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return put


# --- dates, keys, names ------------------------------------------------------------------------------

_STAMP = r"^(\d{4})-?(\d{2})-?(\d{2})(?:T(\d{2}):?(\d{2}):?(\d{2})?(?:\.(\d+))?)?(Z|[+-]\d{2}:?\d{2})?$"
_STARTS = f"""p0 AS (SELECT sample_no, geotag_datetime[1] AS g, regexp_extract(geotag_datetime[1], '{_STAMP}', ['y', 'm', 'd', 'h', 'mi', 's', 'f', 'z']) AS p FROM stack_samples),
p1 AS (SELECT sample_no, g, p, make_timestamp(CAST(p.y AS BIGINT), CAST(p.m AS BIGINT), CAST(p.d AS BIGINT), coalesce(TRY_CAST(p.h AS BIGINT), 0), coalesce(TRY_CAST(p.mi AS BIGINT), 0), coalesce(TRY_CAST(p.s || '.' || CASE WHEN p.f = '' THEN '0' ELSE p.f END AS DOUBLE), 0))
  - to_minutes(CASE WHEN p.z IN ('', 'Z') THEN 0 ELSE (CASE WHEN p.z[1] = '-' THEN -1 ELSE 1 END) * (CAST(p.z[2:3] AS BIGINT) * 60 + CAST(p.z[-2:] AS BIGINT)) END) AS t FROM p0 WHERE p.y <> '')"""


@query(f"""WITH {_STARTS} SELECT sample_no, t AS start_ts, CASE WHEN p.f <> '' THEN t WHEN p.s <> '' THEN t + INTERVAL 1 SECOND - INTERVAL 1 MICROSECOND WHEN p.mi <> '' THEN t + INTERVAL 1 MINUTE - INTERVAL 1 MICROSECOND ELSE t + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND END AS end_ts FROM p1""")
def date_parse(spark, d):
    g = F.get("geotag_datetime", F.lit(0))
    return table(spark, d, "stack_samples").select("sample_no", dates.parse_start(g).alias("start_ts"), dates.parse_end(g).alias("end_ts")).where("start_ts IS NOT NULL")


@query(f"""WITH {_STARTS.replace("geotag_datetime[1]", "geotag_datetime[len(geotag_datetime)]")}, s AS ({f"WITH {_STARTS} SELECT sample_no, t FROM p1"})
SELECT s.sample_no, s.t AS start_ts, CASE WHEN p.f <> '' THEN p1.t WHEN p.s <> '' THEN p1.t + INTERVAL 1 SECOND - INTERVAL 1 MICROSECOND WHEN p.mi <> '' THEN p1.t + INTERVAL 1 MINUTE - INTERVAL 1 MICROSECOND ELSE p1.t + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND END AS end_ts FROM s JOIN p1 USING (sample_no)""")
def date_range(spark, d):
    """All entries of geotag_datetime as one range, written with / between where there are two."""
    start, end = dates.parse_range(F.concat_ws("/", "geotag_datetime"))
    return table(spark, d, "stack_samples").where(F.size("geotag_datetime") > 0).select("sample_no", start.alias("start_ts"), end.alias("end_ts")).where("start_ts IS NOT NULL AND end_ts IS NOT NULL")


@query(f"""WITH {_STARTS}, e AS (SELECT sample_no, p, t FROM p1)
SELECT sample_no, CASE WHEN p.h = '' AND p.z = '' THEN strftime(t, '%Y%m%d') WHEN p.f <> '' THEN strftime(t, '%Y%m%dT%H%M%S.%f') WHEN p.s <> '' THEN strftime(t, '%Y%m%dT%H%M%S') ELSE strftime(t, '%Y%m%dT%H%M') END AS token FROM e WHERE p.mi = '' OR p.s <> '' OR p.f <> '' OR p.mi <> ''""")
def date_format(spark, d):
    g = F.get("geotag_datetime", F.lit(0))
    s = table(spark, d, "stack_samples").select("sample_no", dates.parse_start(g).alias("s"), dates.parse_end(g).alias("e")).where("s IS NOT NULL")
    return s.select("sample_no", strings.compact_range(F.col("s"), F.col("e")).alias("token"))


@query(r"""WITH k AS (SELECT sample_no, regexp_replace(regexp_extract(regexp_replace(root, '/+$', ''), '[^/]*$'), '(.)\.[^.]*$', '\1') AS key FROM stack_samples)
SELECT sample_no, key, regexp_extract(key, '[-_](\d{8}(?:T\d{6})?)(?:[-_](\d{8}(?:T\d{6})?))?[^/]*$', 1) AS dates FROM k WHERE regexp_matches(key, '[-_]\d{8}')""")
def stem_dates(spark, d):
    key = strings.extract_key(F.col("root"))
    s = table(spark, d, "stack_samples").select("sample_no", key.alias("key"))
    return s.select("sample_no", "key", strings.stem_dates(F.col("key")).alias("dates")).where("dates IS NOT NULL")


@query(r"SELECT label_no, regexp_extract(file_name, '(\d+)\.txt$', 1) AS key FROM yolo_labels WHERE regexp_matches(file_name, '(\d+)\.txt$')")
def extract_key(spark, d):
    return table(spark, d, "yolo_labels").select("label_no", strings.extract_key(F.col("file_name"), r"(\d+)\.txt$").alias("key")).where("key IS NOT NULL")


_LOC = """loc AS (SELECT footprint_id, CASE WHEN x >= -180 AND x < 180 THEN x ELSE x + 180 - floor((x + 180) / 360) * 360 - 180 END AS lon, y AS lat FROM (
SELECT footprint_id, CASE WHEN bbox IS NOT NULL THEN (CASE WHEN bbox[1] > bbox[3] THEN (bbox[1] + bbox[3] + 360) / 2 ELSE (bbox[1] + bbox[3]) / 2 END)
  ELSE (list_min(list_transform(coordinates, lambda p: p[1])) + list_max(list_transform(coordinates, lambda p: p[1]))) / 2 END AS x,
CASE WHEN bbox IS NOT NULL THEN (bbox[2] + bbox[4]) / 2 ELSE (list_min(list_transform(coordinates, lambda p: p[2])) + list_max(list_transform(coordinates, lambda p: p[2]))) / 2 END AS y FROM footprints) WHERE x IS NOT NULL AND y IS NOT NULL)"""


def _locations(spark, d):
    """Every footprint that has a location."""
    lon, lat = points.footprint_location(F.col("bbox"), F.col("coordinates"))
    return table(spark, d, "footprints").select("footprint_id", lon.alias("lon"), lat.alias("lat"), "created_at", "bbox").where("lon IS NOT NULL AND lat IS NOT NULL")


@query(f"WITH {_LOC} SELECT footprint_id, printf('%.6f_%.6f_%s_10m', lon, lat, strftime(created_at, '%Y%m%d')) AS stem FROM loc JOIN footprints USING (footprint_id)")
def anchor_stem(spark, d):
    return _locations(spark, d).select("footprint_id", geo.anchor_stem(F.col("lon"), F.col("lat"), F.date_format("created_at", "yyyyMMdd"), F.lit(10.0)).alias("stem"))


@query(f"WITH {_LOC} SELECT footprint_id, CAST(CASE WHEN lat > 84 THEN 5041 WHEN lat < -80 THEN 5042 WHEN lat >= 0 THEN 32600 + least(floor((lon + 180) / 6) + 1, 60) ELSE 32700 + least(floor((lon + 180) / 6) + 1, 60) END AS INTEGER) AS epsg, round(lon, 7) AS lon FROM loc")
def utm_zone(spark, d):
    return _locations(spark, d).select("footprint_id", geo.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"), F.round("lon", 7).alias("lon"))


def _utm_sql(rows: str, lon: str, lat: str, epsg: str) -> str:
    """CTEs that add easting and northing to ``rows``, written out from the series of the ellipsoid WGS 84."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    e = 2 * n**0.5 / (1 + n)
    r = 0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    d = lambda v: f"CAST({v!r} AS DOUBLE)"
    x = "eta" + "".join(f" + {d(a)} * cos({2 * j} * xi) * sh{j}" for j, a in enumerate(alpha, 1))
    y = "xi" + "".join(f" + {d(a)} * sin({2 * j} * xi) * ch{j}" for j, a in enumerate(alpha, 1))
    hyper = ", ".join(f"(exp({2 * j} * eta) - exp(-{2 * j} * eta)) / 2 AS sh{j}, (exp({2 * j} * eta) + exp(-{2 * j} * eta)) / 2 AS ch{j}" for j in (1, 2, 3))
    return f"""u1 AS (SELECT *, radians({lon} - ({epsg} % 100 * 6 - 183)) AS dl, sin(radians({lat})) AS s FROM {rows}),
u2 AS (SELECT *, 0.5 * ln((1 + s) / (1 - s)) - {d(e)} * 0.5 * ln((1 + {d(e)} * s) / (1 - {d(e)} * s)) AS q FROM u1),
u3 AS (SELECT *, (exp(q) - exp(-q)) / 2 AS t FROM u2),
u4 AS (SELECT *, atan2(t, cos(dl)) AS xi, 0.5 * ln((1 + sin(dl) / sqrt(1 + t * t)) / (1 - sin(dl) / sqrt(1 + t * t))) AS eta FROM u3),
u5 AS (SELECT *, {hyper} FROM u4),
utm AS (SELECT *, 500000 + {d(r)} * ({x}) AS easting, CASE WHEN {epsg} >= 32700 THEN 1e7 ELSE 0 END + {d(r)} * ({y}) AS northing FROM u5)"""


_ZONE = "CAST(CASE WHEN lat > 84 THEN 5041 WHEN lat < -80 THEN 5042 WHEN lat >= 0 THEN 32600 + least(floor((lon + 180) / 6) + 1, 60) ELSE 32700 + least(floor((lon + 180) / 6) + 1, 60) END AS INTEGER)"
_ZONED = f"{_LOC}, z AS (SELECT footprint_id, lon, lat, {_ZONE} AS epsg FROM loc)"


@query(f"WITH {_ZONED}, zz AS (SELECT * FROM z WHERE epsg > 5042), {_utm_sql('zz', 'lon', 'lat', 'epsg')} SELECT footprint_id, epsg, round(easting, 3) AS easting, round(northing, 3) AS northing FROM utm")
def utm_coordinates(spark, d):
    """Places in their UTM zones; the polar ones have none."""
    p = _locations(spark, d).withColumn("epsg", geo.utm_epsg(F.col("lon"), F.col("lat"))).where("epsg > 5042")
    e, n = geo.utm_forward(F.col("lon"), F.col("lat"))
    return p.select("footprint_id", "epsg", F.round(e, 3).alias("easting"), F.round(n, 3).alias("northing"))


@query(f"WITH {_ZONED} SELECT footprint_id, epsg, TRUE AS same_lon, TRUE AS same_lat FROM z WHERE epsg > 5042")
def utm_inverse(spark, d):
    """Whether places come back from their zones to a hundred-millionth of a degree; utm_coordinates compares the zones' own numbers."""
    p = _locations(spark, d).withColumn("epsg", geo.utm_epsg(F.col("lon"), F.col("lat"))).where("epsg > 5042")
    e, n = geo.utm_forward(F.col("lon"), F.col("lat"))
    p = p.withColumn("e", e).withColumn("n", n)
    lon, lat = geo.utm_inverse(F.col("e"), F.col("n"), F.col("epsg"))
    near = lambda a, b: (F.abs(a - b) < 1e-8)
    return p.select("footprint_id", "epsg", near(lon, F.col("lon")).alias("same_lon"), near(lat, F.col("lat")).alias("same_lat"))


@query(f"""WITH {_ZONED}, zz AS (SELECT * FROM z WHERE epsg > 5042), {_utm_sql('zz', 'lon', 'lat', 'epsg')}
SELECT footprint_id, 'EPSG:' || epsg AS crs, floor((easting - 1000) / 10) * 10 AS minx, ceil((northing + 1000) / 10) * 10 AS maxy, CAST(ceil((easting + 1000) / 10) - floor((easting - 1000) / 10) AS INTEGER) AS width, CAST(ceil((northing + 1000) / 10) - floor((northing - 1000) / 10) AS INTEGER) AS height,
  CAST(date_trunc('day', created_at) AS TIMESTAMP) AS start_ts, CAST(date_trunc('day', created_at) AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS end_ts FROM utm JOIN footprints USING (footprint_id)""")
def anchor_grids(spark, d):
    """A square of two kilometres around every place, on the pixels of its zone."""
    p = _locations(spark, d).where(geo.utm_epsg(F.col("lon"), F.col("lat")) > 5042)
    p = p.select("footprint_id", "lon", "lat", F.lit(2000.0).alias("size_m"), F.date_format("created_at", "yyyy-MM-dd").alias("datetime"))
    return anchors.from_coordinates(p, tile_size=None).select("footprint_id", "crs", "minx", "maxy", "width", "height", "start_ts", "end_ts")


@query("""WITH e AS (SELECT anchor_id, max(y) + 1 AS height, max(x) + 1 AS width FROM pixels GROUP BY anchor_id), c AS (SELECT *, unnest(range((height + 99) // 100)) AS cy FROM e), g AS (SELECT *, unnest(range((width + 99) // 100)) AS cx FROM c)
SELECT anchor_id, CAST(cy AS INTEGER) AS cy, CAST(cx AS INTEGER) AS cx, CAST(cy * 100 AS INTEGER) AS y0, CAST(cx * 100 AS INTEGER) AS x0, CAST(least(100, height - cy * 100) AS INTEGER) AS h, CAST(least(100, width - cx * 100) AS INTEGER) AS w FROM g""")
def cells_in_sql(spark, d):
    """Cells of every anchor by the table function."""
    anchors.register_cells(spark)
    e = table(spark, d, "pixels").groupBy("anchor_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    e.createOrReplaceTempView("anchor_extents")
    return spark.sql("SELECT anchor_id, cy, cx, y0, x0, h, w FROM anchor_extents, LATERAL cells(width, height, 100)")


@pipeline.step("fill", "spread")
def _fill(first, last):
    return F.coalesce(first, last), F.abs(last - first)


@pipeline.step("grade")
def _grade(fill, bound):
    return F.when(fill > bound, "high").when(fill <= bound, "low")


@pipeline.step("never")
def _never(missing):
    return missing


REGISTRY = pipeline.Registry()


@REGISTRY.register("bound", "Share")
class _Share:
    def __init__(self, percent: float = 50.0) -> None:
        self.value = percent


@REGISTRY.register("steps", "Graded")
class _Graded:
    def __init__(self, bound_value: float) -> None:
        self.run = lambda df: pipeline.run_steps(df.withColumn("bound", F.lit(bound_value)), [_grade, _never, _fill], {"grade", "spread"})


@query("""WITH s AS (SELECT rec_id, cloud_cover AS first, CAST(relative_orbit AS DOUBLE) AS last FROM stac_items)
SELECT rec_id, abs(last - first) AS spread, CASE WHEN coalesce(first, last) > 20 THEN 'high' WHEN coalesce(first, last) <= 20 THEN 'low' END AS grade FROM s""")
def wired_steps(spark, d):
    """Steps in the order of what they take, built by name from stages that take each other's attributes; the one nothing needs isn't run."""
    t = table(spark, d, "stac_items").select("rec_id", F.col("cloud_cover").alias("first"), F.col("relative_orbit").cast("double").alias("last"))
    built = REGISTRY.build_all({"bound": ("share", {"percent": 20.0, "unknown": 1}), "steps": ("GRADED", {})})
    return built["steps"].run(t).select("rec_id", "spread", "grade")


def _anchor_grids(spark, d):
    """A UTM grid of 512 by 512 pixels of 10 m around the least footprint of each anchor, and one of 40 by 40 in degrees over its middle."""
    f = table(spark, d, "footprints").select("footprint_id", "anchor_id")
    one = _locations(spark, d).join(f, "footprint_id").where("anchor_id IS NOT NULL").groupBy("anchor_id").agg(F.min_by(F.struct("lon", "lat"), "footprint_id").alias("p")).select("anchor_id", "p.lon", "p.lat")
    z = one.withColumn("epsg", geo.utm_epsg(F.col("lon"), F.col("lat"))).where("epsg > 5042 AND abs(lon) < 179")
    e, n = geo.utm_forward(F.col("lon"), F.col("lat"))
    z = z.withColumn("e", e).withColumn("n", n)
    source = z.select("anchor_id", "epsg", (F.floor(F.col("e") / 10) * 10.0 - 2560).alias("minx"), (F.floor(F.col("n") / 10) * 10.0 + 2560).alias("maxy"), F.lit(10.0).alias("res"), F.lit(512).alias("height"), F.lit(512).alias("width"))
    target = z.select("anchor_id", F.lit(4326).alias("epsg"), (F.round("lon", 3) - 0.01).alias("minx"), (F.round("lat", 3) + 0.01).alias("maxy"), F.lit(0.0005).alias("res"), F.lit(40).alias("height"), F.lit(40).alias("width"))
    return source, target


@query(f"""WITH {_ZONED}, a0 AS (SELECT anchor_id, arg_min({{'lon': lon, 'lat': lat, 'epsg': epsg}}, footprint_id) AS p FROM z JOIN footprints USING (footprint_id) WHERE anchor_id IS NOT NULL GROUP BY 1),
a1 AS (SELECT anchor_id, p.lon AS lon, p.lat AS lat, p.epsg AS epsg, 'm' AS part, 0 AS y, 0 AS x FROM a0 WHERE p.epsg > 5042 AND abs(p.lon) < 179),
px AS (SELECT anchor_id, y, x, max(value) AS value FROM pixels WHERE layer = 'scl' AND value IS NOT NULL GROUP BY ALL),
c AS (SELECT anchor_id, round(lon, 3) - 0.01 + (x.i + 0.5) * 0.0005 AS lon, round(lat, 3) + 0.01 - (y.i + 0.5) * 0.0005 AS lat, epsg, 'c' AS part, y.i AS y, x.i AS x FROM a1, (SELECT unnest(range(40)) AS i) y, (SELECT unnest(range(40)) AS i) x WHERE anchor_id IN (SELECT anchor_id FROM px)),
every AS (SELECT * FROM a1 UNION ALL SELECT * FROM c), {_utm_sql('every', 'lon', 'lat', 'epsg')},
m AS (SELECT anchor_id, floor(easting / 10) * 10 - 2560 AS minx, floor(northing / 10) * 10 + 2560 AS maxy FROM utm WHERE part = 'm'),
t AS (SELECT u.anchor_id, u.y, u.x, floor((m.maxy - u.northing) / 10) AS sy, floor((u.easting - m.minx) / 10) AS sx FROM utm u JOIN m USING (anchor_id) WHERE u.part = 'c')
SELECT t.anchor_id, CAST(t.y AS INTEGER) AS y, CAST(t.x AS INTEGER) AS x, px.value FROM t JOIN px ON px.anchor_id = t.anchor_id AND px.y = t.sy AND px.x = t.sx WHERE sy BETWEEN 0 AND 511 AND sx BETWEEN 0 AND 511""")
def warp_nearest(spark, d):
    """Class pixels of every anchor from its UTM grid to a grid in degrees."""
    source, target = _anchor_grids(spark, d)
    p = table(spark, d, "pixels").where("layer = 'scl' AND value IS NOT NULL").groupBy("anchor_id", "y", "x").agg(F.max("value").alias("value"))
    wanted = p.select("anchor_id").distinct()
    return warp.warp(p, source.join(wanted, "anchor_id", "left_semi"), target, ["anchor_id"])


@query(f"WITH {_LOC} SELECT footprint_id, printf('%.4f°%s, %.4f°%s', abs(lat), CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END, abs(lon), CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END) AS place FROM loc")
def coordinate_text(spark, d):
    return _locations(spark, d).select("footprint_id", geo.coordinate_text(F.col("lon"), F.col("lat")).alias("place"))


@query("""WITH f AS (SELECT footprint_id, [bbox[1], bbox[2], CASE WHEN bbox[1] > bbox[3] THEN bbox[3] + 360 ELSE bbox[3] END, bbox[4]] AS bbox FROM footprints WHERE bbox IS NOT NULL)
SELECT footprint_id, CAST(ceil(bbox[3] / 0.01) - floor(bbox[1] / 0.01) AS INTEGER) AS width, CAST(ceil(bbox[4] / 0.01) - floor(bbox[2] / 0.01) AS INTEGER) AS height, round(floor(bbox[1] / 0.01) * 0.01, 6) AS minx, round(ceil(bbox[4] / 0.01) * 0.01, 6) AS maxy
FROM f""")
def grid_of_box(spark, d):
    """Grids of all boxes; one over the 180 degree line goes on beyond it."""
    w, s, e, n = (F.get("bbox", F.lit(i)) for i in range(4))
    g = geo.grid_of_box(w, s, F.when(w > e, e + 360.0).otherwise(e), n, 0.01)
    return table(spark, d, "footprints").where("bbox IS NOT NULL").select("footprint_id", g["width"].alias("width"), g["height"].alias("height"), F.round(g["minx"], 6).alias("minx"), F.round(g["maxy"], 6).alias("maxy"))


@query("""WITH r AS (SELECT footprint_id, coordinates AS c FROM footprints WHERE len(coordinates) >= 3)
SELECT footprint_id, round(abs(list_sum(list_transform(range(1, len(c) + 1), lambda i: c[i][1] * c[CASE WHEN i = len(c) THEN 1 ELSE i + 1 END][2] - c[CASE WHEN i = len(c) THEN 1 ELSE i + 1 END][1] * c[i][2]))) / 2, 6) AS area FROM r""")
def ring_area(spark, d):
    return table(spark, d, "footprints").where(F.size("coordinates") >= 3).select("footprint_id", F.round(geo.ring_area(F.col("coordinates")), 6).alias("area"))


@query(f"""WITH {_LOC}, s AS (SELECT footprint_id, lon, lat, created_at AS t FROM loc JOIN footprints USING (footprint_id))
SELECT footprint_id, round(sin(week(t) * (2 * pi() / 52)), 9) AS week_sin, round(cos(week(t) * (2 * pi() / 52)), 9) AS week_cos, round(sin(hour(t) * (2 * pi() / 24)), 9) AS hour_sin, round(sin(radians(lat)), 9) AS lat_sin, round(cos(radians(lon)), 9) AS lon_cos, CAST(year(t) AS INTEGER) AS year, CAST(dayofyear(t) - 1 AS INTEGER) AS day FROM s""")
def time_loc_encoding(spark, d):
    p = _locations(spark, d)
    t, l = classes.time_encoding(F.col("created_at")), classes.location_encoding(F.col("lat"), F.col("lon"))
    r = lambda c, n: F.round(c, 9).alias(n)
    return p.select("footprint_id", r(t[0], "week_sin"), r(t[1], "week_cos"), r(t[2], "hour_sin"), r(l[0], "lat_sin"), r(l[3], "lon_cos"), F.year("created_at").alias("year"), (F.dayofyear("created_at") - 1).alias("day"))


@query(r"SELECT p_partkey, nullif(trim(regexp_replace(p_name || ' Province', '\s+(Province|State)$', '')), '') AS place FROM part")
def strip_admin_suffix(spark, d):
    return table(spark, d, "part").select("p_partkey", strings.strip_admin_suffix(F.concat("p_name", F.lit(" Province"))).alias("place"))


# --- keyed datasets ----------------------------------------------------------------------------------


def _samples(spark, d):
    return table(spark, d, "stack_samples").select("anchor_id", "sample_no", "split", "layers").where("anchor_id IS NOT NULL")


@query("SELECT anchor_id, sample_no FROM stack_samples WHERE anchor_id IN (SELECT anchor_id FROM footprints WHERE bbox IS NOT NULL)")
def split_filter(spark, d):
    wanted = table(spark, d, "footprints").where("bbox IS NOT NULL").select("anchor_id")
    return datasets.keep_split(_samples(spark, d).select("anchor_id", "sample_no"), wanted, "anchor_id")


@query("SELECT DISTINCT anchor_id FROM footprints WHERE anchor_id IS NOT NULL AND anchor_id NOT IN (SELECT anchor_id FROM stack_samples WHERE anchor_id IS NOT NULL)")
def missing_keys(spark, d):
    return datasets.missing_keys(_samples(spark, d), table(spark, d, "footprints").select("anchor_id"), "anchor_id")


_THREE = """a AS (SELECT anchor_id, count(*) AS n_samples FROM stack_samples WHERE anchor_id IS NOT NULL GROUP BY 1), b AS (SELECT anchor_id, count(*) AS n_scenes FROM scenes WHERE anchor_id IS NOT NULL GROUP BY 1), c AS (SELECT anchor_id, count(*) AS n_footprints FROM footprints WHERE anchor_id IS NOT NULL GROUP BY 1)"""


def _three(spark, d):
    one = lambda t, n: table(spark, d, t).where("anchor_id IS NOT NULL").groupBy("anchor_id").agg(F.count("*").alias(n))
    return [one("stack_samples", "n_samples"), one("scenes", "n_scenes"), one("footprints", "n_footprints")]


@query(f"WITH {_THREE} SELECT * FROM a JOIN b USING (anchor_id) JOIN c USING (anchor_id)")
def ds_intersection(spark, d):
    return datasets.intersection(_three(spark, d), "anchor_id")


@query(f"WITH {_THREE}, k AS (SELECT anchor_id FROM a UNION ALL SELECT anchor_id FROM b UNION ALL SELECT anchor_id FROM c) SELECT anchor_id, count(*) AS n FROM k GROUP BY 1 HAVING count(*) < 3")
def ds_dropped_keys(spark, d):
    return datasets.dropped_keys(_three(spark, d), "anchor_id")


@query("SELECT sample_no FROM stack_samples WHERE list_has_all(layers, ['sentinel_2_l2a', 'scl', 'ndvi'])")
def required_layers(spark, d):
    return table(spark, d, "stack_samples").where(datasets.has_layers(F.col("layers"), ["sentinel_2_l2a", "scl", "ndvi"])).select("sample_no")


@query("SELECT mgrs_tile AS sample_id, CAST(count(*) AS INTEGER) AS n_rows, min(label_no) AS first_order, string_agg(file_name, ',' ORDER BY label_no) AS files FROM yolo_labels WHERE mgrs_tile IS NOT NULL GROUP BY 1")
def table_group(spark, d):
    g = datasets.grouped_table(table(spark, d, "yolo_labels"), "mgrs_tile", ["file_name"], "label_no")
    return g.select("sample_id", "n_rows", "first_order", F.concat_ws(",", "file_name").alias("files"))


@query("""WITH r AS (SELECT mgrs_tile AS sample_id, file_name, (row_number() OVER (PARTITION BY mgrs_tile ORDER BY label_no) - 1) // 16 AS block, label_no FROM yolo_labels WHERE mgrs_tile IS NOT NULL)
SELECT sample_id, block, CAST(count(*) AS INTEGER) AS n_rows, string_agg(file_name, ',' ORDER BY label_no) AS files FROM r GROUP BY 1, 2""")
def table_blocks(spark, d):
    g = datasets.grouped_blocks(table(spark, d, "yolo_labels"), "mgrs_tile", ["file_name"], "label_no", size=16)
    return g.select("sample_id", "block", "n_rows", F.concat_ws(",", "file_name").alias("files"))


@query("SELECT vec_id AS sample_id, label FROM embeddings")
def manifest(spark, d):
    return datasets.manifest(table(spark, d, "embeddings"), ["label"], "vec_id").withColumn("sample_id", F.col("sample_id").cast("long"))


@query("WITH n AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1) // 16 AS batch_id, vec_id, label FROM embeddings) SELECT batch_id, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id) AS ids, CAST(sum(label) AS BIGINT) AS labels FROM n GROUP BY 1 HAVING count(*) = 16")
def batches(spark, d):
    b = datasets.batches(table(spark, d, "embeddings"), 16, ["vec_id"], ["vec_id", "label"])
    return b.select("batch_id", F.concat_ws(",", F.col("vec_id").cast("array<string>")).alias("ids"), F.aggregate("label", F.lit(0).cast("long"), lambda a, x: a + x).alias("labels"))


@query("SELECT file_name, label_no FROM (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY label_no DESC) AS r FROM yolo_labels) WHERE r = 1")
def duplicate_last_wins(spark, d):
    from terrafold.operators.align import last_duplicate

    return last_duplicate(table(spark, d, "yolo_labels"), "file_name", "label_no").select("file_name", "label_no")


_LINE = r"^\s*\d{1,9}(\s+[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?){4}\s*$"
_LINES = rf"""l AS (SELECT label_no, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS line_no FROM yolo_labels WHERE body IS NOT NULL),
f AS (SELECT label_no, line_no, regexp_matches(line, '{_LINE}') AS ok, regexp_split_to_array(trim(line, E' \t\r'), '\s+') AS v FROM l WHERE trim(line, E' \t\r') <> '')"""


@query(f"WITH {_LINES} SELECT label_no, CAST(line_no AS INTEGER) AS line_no, CAST(v[1] AS INTEGER) AS class_id, CAST(v[2] AS DOUBLE) AS cx, CAST(v[3] AS DOUBLE) AS cy, CAST(v[4] AS DOUBLE) AS w, CAST(v[5] AS DOUBLE) AS h FROM f WHERE ok")
def yolo_boxes(spark, d):
    return yolo.boxes(table(spark, d, "yolo_labels"), key="label_no", body="body").select("label_no", "line_no", "class_id", "cx", "cy", "w", "h")


@query(f"WITH {_LINES} SELECT label_no, CAST(line_no AS INTEGER) AS line_no FROM f WHERE NOT ok")
def yolo_malformed(spark, d):
    return yolo.malformed(table(spark, d, "yolo_labels"), key="label_no", body="body").select("label_no", "line_no")


@query(f"WITH {_LINES} SELECT label_no, CAST(line_no AS INTEGER) AS line_no, round((CAST(v[2] AS DOUBLE) - CAST(v[4] AS DOUBLE) / 2) * 640, 6) AS x0, round((CAST(v[3] AS DOUBLE) - CAST(v[5] AS DOUBLE) / 2) * 480, 6) AS y0, round((CAST(v[2] AS DOUBLE) + CAST(v[4] AS DOUBLE) / 2) * 640, 6) AS x1, round((CAST(v[3] AS DOUBLE) + CAST(v[5] AS DOUBLE) / 2) * 480, 6) AS y1 FROM f WHERE ok")
def yolo_xyxy(spark, d):
    b = yolo.boxes(table(spark, d, "yolo_labels"), key="label_no", body="body")
    c = classes.yolo_to_corners(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), 640.0, 480.0)
    return b.select("label_no", "line_no", *[F.round(x, 6).alias(n) for x, n in zip(c, ("x0", "y0", "x1", "y1"))])


# --- inference and metrics ---------------------------------------------------------------------------

_PROB = """e AS (SELECT vec_id, label, list_transform(embedding[1:10], lambda v: exp(CAST(v AS DOUBLE) - CAST(list_max(embedding[1:10]) AS DOUBLE))) AS x FROM embeddings),
p AS (SELECT vec_id, label, list_transform(x, lambda v: v / list_reduce(x, lambda a, b: a + b)) AS p FROM e),
t AS (SELECT vec_id, label, p, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS pred, list_max(p) AS conf FROM p)"""


def predictions(spark, d):
    p = table(spark, d, "embeddings").select("vec_id", "label", classes.softmax(F.slice("embedding", 1, 10)).alias("p"))
    pred, conf = classes.top_class(F.col("p"))
    return p.withColumn("pred", pred).withColumn("conf", conf)


@query(f"WITH {_PROB} SELECT vec_id, pred, round(conf, 9) AS conf FROM t")
def softmax_argmax(spark, d):
    return predictions(spark, d).select("vec_id", "pred", F.round("conf", 9).alias("conf"))


@query(f"WITH {_PROB} SELECT vec_id, CASE WHEN conf >= [0.1, 0.2, 0.3, 0.1, 0.2, 0.3, 0.1, 0.2, 0.3, 0.15][pred + 1] AND label <> 7 THEN pred ELSE 255 END AS kept FROM t")
def apply_thresholds(spark, d):
    th = [0.1, 0.2, 0.3, 0.1, 0.2, 0.3, 0.1, 0.2, 0.3, 0.15]
    return predictions(spark, d).select("vec_id", classes.apply_thresholds(F.col("pred"), F.col("conf"), th, mask=F.col("label") == 7).alias("kept"))


_CONF = f"{_PROB}, c AS (SELECT label, pred, count(*) AS n FROM t GROUP BY ALL)"
_COUNTS = f"{_CONF}, k AS (SELECT class, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (SELECT label AS class, CASE WHEN label = pred THEN n ELSE 0 END AS tp, 0 AS fp, CASE WHEN label <> pred THEN n ELSE 0 END AS fn FROM c UNION ALL SELECT pred, 0, CASE WHEN label <> pred THEN n ELSE 0 END, 0 FROM c) GROUP BY class)"
_PER = f"{_COUNTS}, m AS (SELECT class, CAST(tp + fn AS BIGINT) AS support, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0 END AS iou FROM k)"


@query(f"WITH {_CONF} SELECT * FROM c")
def confusion(spark, d):
    return metrics.confusion(predictions(spark, d))


@query(f"WITH {_PER} SELECT class, support, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, round(iou, 9) AS iou FROM m")
def metrics_per_class(spark, d):
    m = metrics.class_metrics(metrics.confusion(predictions(spark, d)))
    return m.select("class", "support", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "iou")])


@query(f"""WITH {_PER}, a AS (SELECT 'macro' AS mode, avg(recall) AS accuracy, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1, avg(iou) AS iou FROM m
UNION ALL SELECT 'micro', sum(tp) / sum(tp + fn), sum(tp) / sum(tp + fp), sum(tp) / sum(tp + fn), 2 * sum(tp) / sum(2 * tp + fp + fn), sum(tp) / sum(tp + fp + fn) FROM k)
SELECT mode, unnest(['accuracy', 'precision', 'recall', 'f1', 'iou']) AS metric, round(unnest([accuracy, precision, recall, f1, iou]), 9) AS value FROM a""")
def metrics_summary(spark, d):
    return metrics.summary_metrics(metrics.confusion(predictions(spark, d))).withColumn("value", F.round("value", 9))


@query(f"""WITH {_COUNTS}, s AS (SELECT CAST(sum(tp + fn) AS DOUBLE) AS s, CAST(sum(tp) AS DOUBLE) AS c, CAST(sum((tp + fn) * (tp + fp)) AS DOUBLE) AS pt, CAST(sum((tp + fn) * (tp + fn)) AS DOUBLE) AS tt, CAST(sum((tp + fp) * (tp + fp)) AS DOUBLE) AS pp FROM k)
SELECT round((c * s - pt) / sqrt((s * s - pp) * (s * s - tt)), 9) AS mcc, round((c / s - pt / (s * s)) / (1 - pt / (s * s)), 9) AS kappa FROM s""")
def mcc_kappa(spark, d):
    return metrics.agreement(metrics.confusion(predictions(spark, d))).select(F.round("mcc", 9).alias("mcc"), F.round("kappa", 9).alias("kappa"))


@query(f"""WITH {_PROB}, s AS (SELECT label, unnest(range(10)) AS class, unnest(p) AS score FROM t), r AS (SELECT class, CAST(label = class AS INTEGER) AS pos, rank() OVER (PARTITION BY class ORDER BY score) + (count(*) OVER (PARTITION BY class, score) - 1) / 2.0 AS rk FROM s)
SELECT CAST(class AS INTEGER) AS class, round((sum(rk) FILTER (pos = 1) - sum(pos) * (sum(pos) + 1) / 2.0) / nullif(sum(pos) * (count(*) - sum(pos)), 0), 9) AS auroc FROM r GROUP BY class""")
def auroc_ovr(spark, d):
    s = predictions(spark, d).select("label", F.posexplode("p").alias("class", "score")).select("class", "score", (F.col("label") == F.col("class")).alias("positive"))
    return metrics.auroc(s).withColumn("auroc", F.round("auroc", 9))


@query(f"""WITH {_PROB}, s AS (SELECT label, unnest(range(10)) AS class, unnest(p) AS score FROM t), m AS (SELECT 'micro' AS class, CAST(label = class AS INTEGER) AS pos, score FROM s UNION ALL SELECT CAST(class AS VARCHAR), CAST(label = class AS INTEGER), score FROM s),
r AS (SELECT class, pos, rank() OVER (PARTITION BY class ORDER BY score) + (count(*) OVER (PARTITION BY class, score) - 1) / 2.0 AS rk FROM m),
a AS (SELECT class, (sum(rk) FILTER (pos = 1) - sum(pos) * (sum(pos) + 1) / 2.0) / nullif(sum(pos) * (count(*) - sum(pos)), 0) AS auroc FROM r GROUP BY class)
SELECT 'macro' AS mode, round(avg(auroc), 9) AS auroc FROM a WHERE class <> 'micro' UNION ALL SELECT 'micro', round(auroc, 9) FROM a WHERE class = 'micro'""")
def auroc_macro_micro(spark, d):
    s = predictions(spark, d).select("label", F.posexplode("p").alias("class", "score")).select("class", "score", (F.col("label") == F.col("class")).alias("positive"))
    return metrics.auroc_summary(s).withColumn("auroc", F.round("auroc", 9))


@query(f"""WITH {_PROB}, g AS (SELECT unnest(range(10)) AS c), h AS (SELECT c, unnest(range(0, 11)) / 10.0 AS t FROM g),
x AS (SELECT c, h.t AS t, label, pred, pred <> c OR conf >= h.t AS shown FROM t, h),
k AS (SELECT c, t, class, sum(tp) AS tp, sum(w) AS w FROM (SELECT c, t, label AS class, CASE WHEN shown AND label = pred THEN 1 ELSE 0 END AS tp, CASE WHEN shown AND label = pred THEN 0 ELSE 1 END AS w FROM x UNION ALL SELECT c, t, pred, 0, CASE WHEN shown AND label <> pred THEN 1 ELSE 0 END FROM x) GROUP BY ALL),
m AS (SELECT c, t, round(avg(CASE WHEN 2 * tp + w > 0 THEN 2 * tp / (2 * tp + w) ELSE 0 END), 12) AS score FROM k GROUP BY ALL)
SELECT CAST(c AS INTEGER) AS class, CAST(arg_max(t, {{'s': score, 't': -t}}) AS DOUBLE) AS threshold, round(max(score), 9) AS score FROM m GROUP BY c""")
def threshold_sweep(spark, d):
    s = metrics.threshold_sweep(predictions(spark, d), n_classes=10, candidates=[i / 10 for i in range(11)], p="conf")
    return s.withColumn("score", F.round("score", 9))


@query(f"WITH {_PROB}, q AS (SELECT vec_id, p[label + 1] AS pt FROM t), b AS (SELECT greatest(0.02, max(pt)) AS b FROM (SELECT pt FROM q ORDER BY pt LIMIT 64)) SELECT vec_id, round(-ln(pt), 6) AS loss FROM q, b WHERE pt <= b.b")
def ohem_keep(spark, d):
    q = predictions(spark, d).select("vec_id", F.get("p", F.col("label")).alias("pt"))
    return metrics.hard_examples(q, p_true="pt", min_kept=64, thresh=0.02).select("vec_id", F.round(-F.log("pt"), 6).alias("loss"))


@query(f"WITH {_PROB} SELECT round(avg(-ln(p[label + 1])), 6) AS loss FROM t")
def cross_entropy(spark, d):
    return predictions(spark, d).agg(F.round(metrics.cross_entropy(F.get("p", F.col("label"))), 6).alias("loss"))


@query("SELECT anchor_id, round(sum(value) * 10 * 10 / 10000.0, 6) AS total FROM pixels WHERE layer = 'ndvi' GROUP BY anchor_id")
def area_weighted_total(spark, d):
    return tiles.area_total(table(spark, d, "pixels").where("layer = 'ndvi'"), ["anchor_id"], res=10.0).withColumn("total", F.round("total", 6))


def _tiles(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "value"))
    return e.select("vec_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), F.col("value").cast("double").alias("value"))


_TILE = "px AS (SELECT vec_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, CAST(v AS DOUBLE) AS value FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings))"
_MIRROR8 = "(SELECT unnest(range(12)) AS p)"


@query(f"""WITH {_TILE}, pos AS (SELECT p, CASE WHEN p < 2 THEN 2 - p WHEN p > 9 THEN 16 - p ELSE p - 2 END AS i FROM {_MIRROR8}), st AS (SELECT unnest([0, 2, 4, 6, 8]) AS s)
SELECT vec_id, CAST(a.s AS INTEGER) AS row, CAST(b.s AS INTEGER) AS col, CAST(ry.p - a.s AS INTEGER) AS py, CAST(rx.p - b.s AS INTEGER) AS px, value
FROM px JOIN pos ry ON ry.i = y JOIN pos rx ON rx.i = x JOIN st a ON ry.p BETWEEN a.s AND a.s + 3 JOIN st b ON rx.p BETWEEN b.s AND b.s + 3""")
def patches_split(spark, d):
    p = patches.split_patches(_tiles(spark, d), ["vec_id"], height=8, width=8, size=4, overlap=0.5, pad=2)
    return p.select("vec_id", "row", "col", "py", "px", "value")


@query(f"WITH {_TILE} SELECT vec_id, y, x, round(value, 4) + 0.0 AS value FROM px")
def stitch_identity(spark, d):
    p = patches.split_patches(_tiles(spark, d), ["vec_id"], height=8, width=8, size=4, overlap=0.5, pad=2).drop("y", "x")
    s = patches.stitch_patches(p, ["vec_id"], height=8, width=8, size=4, pad=2)
    return s.select("vec_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), (F.round("value", 4) + 0.0).alias("value"))


_HANN = "(0.5 - 0.5 * cos(2 * pi() * {0} / 3.0))"


@query(f"""WITH {_TILE}, pos AS (SELECT p, CASE WHEN p < 2 THEN 2 - p WHEN p > 9 THEN 16 - p ELSE p - 2 END AS i FROM {_MIRROR8}), st AS (SELECT unnest([0, 2, 4, 6, 8]) AS s),
e AS (SELECT vec_id, ry.p - 2 AS y, rx.p - 2 AS x, ry.p - a.s AS py, rx.p - b.s AS px, value + 10 * (ry.p - a.s) + (rx.p - b.s) AS v FROM px JOIN pos ry ON ry.i = y JOIN pos rx ON rx.i = x JOIN st a ON ry.p BETWEEN a.s AND a.s + 3 JOIN st b ON rx.p BETWEEN b.s AND b.s + 3),
w AS (SELECT vec_id, y, x, v, {_HANN.format("py")} * {_HANN.format("px")} AS w FROM e WHERE y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7)
SELECT vec_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(sum(v * w) / greatest(sum(w), CAST(1e-6 AS DOUBLE)), 5) AS value FROM w GROUP BY ALL""")
def stitch_weighted(spark, d):
    """Stitching of patches that differ where they overlap: each pixel's value also tells its place in the patch."""
    p = patches.split_patches(_tiles(spark, d), ["vec_id"], height=8, width=8, size=4, overlap=0.5, pad=2).drop("y", "x")
    p = p.withColumn("value", F.col("value") + 10 * F.col("py") + F.col("px"))
    s = patches.stitch_patches(p, ["vec_id"], height=8, width=8, size=4, pad=2)
    return s.select("vec_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.round("value", 5).alias("value"))


# --- catalog -----------------------------------------------------------------------------------------


@query("""SELECT rec_id, item_id, cloud_cover FROM stac_items WHERE collection = 'sentinel-2-l2a' AND ts >= TIMESTAMP '2019-01-01' AND ts <= TIMESTAMP '2022-12-31 23:59:59.999999' AND cloud_cover <= 20 AND platform IS NOT NULL
AND bbox[2] <= 60 AND bbox[4] >= -60 AND (CASE WHEN bbox[1] <= bbox[3] THEN bbox[1] <= 60 AND bbox[3] >= -100 ELSE bbox[1] <= 60 OR bbox[3] >= -100 END) ORDER BY cloud_cover DESC, item_id, rec_id LIMIT 100""")
def catalog_search(spark, d):
    q = catalog.Search(collections=("sentinel-2-l2a",), start="2019-01-01", end="2022-12-31 23:59:59.999999", bbox=(-100.0, -60.0, 60.0, 60.0), filter="eo:cloud_cover > 1").with_filter("eo:cloud_cover <= 20 AND platform IS NOT NULL")
    q = q.with_sortby("-eo:cloud_cover", {"field": "item_id", "direction": "asc"})
    q = catalog.Search(**{**q.__dict__, "max_items": 100, "fields": ("rec_id", "item_id", "cloud_cover")})
    return catalog.search(table(spark, d, "stac_items"), q, properties={"eo:cloud_cover": "cloud_cover"}, tie="rec_id")


@query("SELECT DISTINCT collection FROM scenes WHERE collection IS NOT NULL")
def catalog_collections(spark, d):
    return catalog.collections_of(table(spark, d, "scenes"))


@query("SELECT rec_id, item_id FROM stac_items WHERE bbox[2] <= 70 AND bbox[4] >= -70 AND (CASE WHEN bbox[1] <= bbox[3] THEN bbox[1] <= -170 OR bbox[3] >= 170 ELSE TRUE END)")
def catalog_antimeridian(spark, d):
    return catalog.search(table(spark, d, "stac_items"), catalog.Search(bbox=(170.0, -70.0, -170.0, 70.0), fields=("rec_id", "item_id")))


@query("""WITH o AS (SELECT anchor_id, item_id FROM scenes WHERE item_id IS NOT NULL AND ts < TIMESTAMP '2020-01-01'), a AS (SELECT anchor_id, item_id FROM scenes WHERE item_id IS NOT NULL AND ts >= TIMESTAMP '2019-01-01')
SELECT * FROM o UNION ALL SELECT * FROM a WHERE (anchor_id, item_id) NOT IN (SELECT (anchor_id, item_id) FROM o WHERE anchor_id IS NOT NULL)""")
def provenance_append(spark, d):
    s = table(spark, d, "scenes").where("item_id IS NOT NULL")
    old, new = s.where("ts < TIMESTAMP_NTZ '2020-01-01'").select("anchor_id", "item_id"), s.where("ts >= TIMESTAMP_NTZ '2019-01-01'").select("anchor_id", "item_id")
    return catalog.append_items(old, new, ["anchor_id"])


@query("""SELECT i.rec_id, coalesce(s.n, 0) AS n_scenes FROM stac_items i LEFT JOIN (SELECT item_id, count(*) AS n FROM scenes WHERE item_id IS NOT NULL GROUP BY 1) s USING (item_id)""")
def sidecar_join(spark, d):
    return datasets.with_provenance(table(spark, d, "stac_items"), table(spark, d, "scenes"), "item_id", "n_scenes").select("rec_id", "n_scenes")


@query("""SELECT p.band, count(*) AS n, max(g.gsd) AS gsd FROM pixels p JOIN (SELECT * FROM (VALUES ('B02', CAST(10 AS DOUBLE)), ('B03', 10), ('B04', 10), ('B08', 10)) t(band, gsd)) g USING (band) GROUP BY 1""")
def sensor_gsd(spark, d):
    b = sensors.lookup(spark, "sentinel-2-l2a", ["blue", "green", "red", "nir"])
    role = F.when(F.col("band") == "blue", "B02").when(F.col("band") == "green", "B03").when(F.col("band") == "red", "B04").otherwise("B08")
    return table(spark, d, "pixels").join(b.select(role.alias("band"), "gsd"), "band").groupBy("band").agg(F.count("*").alias("n"), F.max("gsd").alias("gsd"))


@query("""WITH t AS (SELECT tag_id, polygon FROM geo_tags WHERE polygon IS NOT NULL) SELECT tag_id, polygon ->> '$.geojson.type' AS shape, polygon ->> '$.polygon_crs' AS crs, CAST(json_array_length(polygon, '$.geojson.coordinates') AS INTEGER) AS n FROM t""")
def geojson_shapes(spark, d):
    from terrafold.sources.geojson import shape_summary

    return shape_summary(table(spark, d, "geo_tags"), key="tag_id", polygon="polygon")


# --- tiles -------------------------------------------------------------------------------------------


@query("""SELECT anchor_id, layer, CAST(greatest(count(DISTINCT band), 1) AS INTEGER) AS n_bands, coalesce(string_agg(DISTINCT band, ',' ORDER BY band), '') AS bands, count(DISTINCT date_trunc('second', ts)) AS n_times, count(ts) > 0 AS has_time FROM pixels GROUP BY ALL""")
def layer_summary(spark, d):
    return tiles.layer_summary(table(spark, d, "pixels"))


@query("""SELECT anchor_id, layer, 'mixes bands with none' AS problem FROM pixels GROUP BY ALL HAVING count(*) FILTER (band IS NULL) > 0 AND count(band) > 0""")
def band_problems(spark, d):
    return tiles.band_problems(tiles.validate_pixels(table(spark, d, "pixels")))


@query(f"""WITH {_LOC}, a AS (SELECT anchor_id, min(lon) AS lon FROM loc JOIN footprints USING (footprint_id) WHERE anchor_id IS NOT NULL GROUP BY 1)
SELECT anchor_id, CAST(ts + to_microseconds(CAST(round(lon / 15 * 3600) AS BIGINT) * 1000000) AS DATE) AS day, count(*) AS n FROM scenes JOIN a USING (anchor_id) WHERE ts IS NOT NULL GROUP BY ALL""")
def solar_days(spark, d):
    a = _locations(spark, d).join(table(spark, d, "footprints").select("footprint_id", "anchor_id"), "footprint_id").where("anchor_id IS NOT NULL").groupBy("anchor_id").agg(F.min("lon").alias("lon"))
    s = table(spark, d, "scenes").where("ts IS NOT NULL").join(a, "anchor_id")
    return s.groupBy("anchor_id", tiles.solar_day(F.col("ts"), F.col("lon")).alias("day")).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT mgrs_tile, rec_id, ts, platform, item_id FROM stac_items WHERE mgrs_tile IS NOT NULL AND ts IS NOT NULL)
SELECT mgrs_tile, min(ts) AS start, max(ts) AS "end", arg_max(platform, rec_id) FILTER (platform IS NOT NULL) AS platform, CAST(count(item_id) AS INTEGER) AS n_items, md5(string_agg(item_id, ',' ORDER BY rec_id)) AS items FROM t GROUP BY 1""")
def mosaic_tags(spark, d):
    t = table(spark, d, "stac_items").where("mgrs_tile IS NOT NULL AND ts IS NOT NULL")
    meta = F.when(F.col("platform").isNotNull(), F.create_map(F.lit("platform"), F.col("platform")))
    t = t.select("mgrs_tile", F.col("rec_id").alias("tile_ord"), F.col("ts").alias("start"), F.col("ts").alias("end"), meta.alias("metadata"), F.lit(None).cast("string").alias("plot_meta"), F.when(F.col("item_id").isNotNull(), F.array("item_id")).otherwise(F.array().cast("array<string>")).alias("items"))
    m = tiles.mosaic_tags(t, ["mgrs_tile"])
    return m.select("mgrs_tile", "start", "end", F.try_element_at("metadata", F.lit("platform")).alias("platform"), F.size("items").alias("n_items"), F.md5(F.concat_ws(",", "items")).alias("items"))


@query("SELECT anchor_id, layer, band, ts, y, x, value FROM pixels")
def chunk_round_trip(spark, d):
    on = ["anchor_id", "layer", "band", "ts"]
    return tiles.chunks_to_pixels(tiles.pixels_to_chunks(table(spark, d, "pixels"), on, 128), on, 128)


@query("""SELECT rec_id, '{"datetime":["' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '","' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '"]' || CASE WHEN platform IS NULL THEN '' ELSE ',"platform":"' || platform || '"' END || '}' AS tag, ts AS start FROM stac_items WHERE ts IS NOT NULL""")
def tag_json(spark, d):
    t = table(spark, d, "stac_items").where("ts IS NOT NULL").select("rec_id", tiles.tag_json(F.col("ts"), F.col("ts"), platform=F.col("platform")).alias("tag"))
    return t.select("rec_id", "tag", tiles.read_tag(F.col("tag"))[0].alias("start"))


@query("""WITH e AS (SELECT anchor_id, layer, band, ts, y // 128 AS cy, x // 128 AS cx, (y % 128) * 128 + x % 128 AS i, value FROM pixels)
SELECT anchor_id, layer, band, ts, CAST(cy AS INTEGER) AS cy, CAST(cx AS INTEGER) AS cx, CAST(count(*) AS INTEGER) AS n, CAST(min(i) AS INTEGER) AS first, CAST(max(i) AS INTEGER) AS last, count(value) AS n_values, round(sum(value), 4) AS total FROM e GROUP BY ALL""")
def chunk_entries(spark, d):
    """What the chunks of pixels hold: their number, first and last place, and sum."""
    c = tiles.pixels_to_chunks(table(spark, d, "pixels"), ["anchor_id", "layer", "band", "ts"], 128)
    values = F.filter(F.transform("entries", lambda e: e["v"]), lambda v: v.isNotNull())
    total = F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v))
    return c.select("anchor_id", "layer", "band", "ts", "cy", "cx", F.size("entries").alias("n"), F.get("entries", F.lit(0))["i"].alias("first"), F.get("entries", F.size("entries") - 1)["i"].alias("last"), F.size(values).cast("long").alias("n_values"), F.round(total, 4).alias("total"))


@query("""SELECT vec_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, CAST(v AS DOUBLE) AS value FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings)""")
def nested_arrays(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.transform(F.slice("embedding", r * 8 + 1, 8), lambda v: v.cast("double"))).alias("values"))
    return tiles.arrays_to_pixels(e, ["vec_id"]).select("vec_id", "y", "x", "value")


@query(f"""WITH {_TILE}, t AS (SELECT unnest(range(4)) AS k), p AS (SELECT k, greatest(0, least(7, (k + 0.5) * 2 - 0.5)) AS s FROM t)
SELECT vec_id, CAST(a.k AS INTEGER) AS y, CAST(b.k AS INTEGER) AS x, round(sum(value * (1 - abs(a.s - y)) * (1 - abs(b.s - x))), 6) + 0.0 AS value FROM px JOIN p a ON abs(a.s - y) < 1 JOIN p b ON abs(b.s - x) < 1 GROUP BY ALL""")
def resize_bilinear(spark, d):
    r = inference.resize_bilinear(_tiles(spark, d), ["vec_id"], height=8, width=8, to=(4, 4))
    return r.select("vec_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), (F.round("value", 6) + 0.0).alias("value"))


@query(f"""WITH {_TILE} SELECT vec_id, y, x, CAST(CASE WHEN value >= 0 THEN 0 ELSE 1 END AS INTEGER) AS pred FROM px""")
def segment_tiles(spark, d):
    """A model of two classes, the value and its negative, run over overlapping patches."""
    import numpy as np

    s = inference.segment(_tiles(spark, d), ["vec_id"], lambda x: np.stack([x, -x], axis=1), height=8, width=8, size=4, overlap=0.5, n_classes=2, pad=2)
    return s.select("vec_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "pred")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
