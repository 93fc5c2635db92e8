"""Queries of the general training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.operators import drift, nested, points
from terrafold.session import cut, table


def _located(spark: SparkSession, d: str) -> DataFrame:
    lon, lat = points.footprint_location(F.col("bbox"), F.col("coordinates"))
    return table(spark, d, "footprints").select(F.col("footprint_id").alias("key"), lon.alias("lon"), lat.alias("lat"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pts = _located(spark, d)
    near = points.near_pairs(pts, 500.0).select(F.lit("near").alias("relation"), "key_a", "key_b")
    inside = points.containing_regions(pts, table(spark, d, "geo_tags"), region="tag_id")
    return near.unionAll(inside.select(F.lit("inside"), "key", "region"))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours within 500 m and containing regions of every footprint."""
    pts = cut(_located(spark, d))
    regions = points.containing_regions(pts, table(spark, d, "geo_tags"), region="tag_id").groupBy("key").agg(F.count("*").alias("n_regions"))
    near = points.near_counts(pts, 500.0)
    return near.join(regions, "key", "left").select(F.col("key").alias("footprint_id"), "n_same_place", "n_near", F.coalesce("n_regions", F.lit(0)).alias("n_regions"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.found_changes(table(spark, d, "raw_stac"))


def p4_changes(spark: SparkSession, d: str) -> DataFrame:
    """Every change with renames and moves told apart from fields that came or went."""
    c = drift.schema_changes(table(spark, d, "raw_stac"))
    return c.select(
        "feed", "file_seq", "file_name", "change", drift.dotted(F.col("old_path")).alias("old_path"), drift.dotted(F.col("new_path")).alias("new_path"), F.concat_ws(",", "old_types").alias("old_types"),
        F.concat_ws(",", "new_types").alias("new_types"), F.round("score", 6).alias("score"),
    )


def p4_unified(spark: SparkSession, d: str) -> DataFrame:
    return drift.unified_table(table(spark, d, "raw_stac"))


def p4_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the consistent table by file, and how many of their members had no place in it."""
    u = drift.unified_table(table(spark, d, "raw_stac"))
    return u.groupBy("feed", "file_name").agg(F.count("*").alias("n_features"), F.count_distinct("raw_id").alias("n_payloads"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.feature_children(table(spark, d, "raw_stac"), values=False).drop("value", "pre", "post")


def p6_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The node table itself: every node of every Feature with its interval labels."""
    return nested.label_nodes(table(spark, d, "raw_stac"), key="raw_id", payload="payload")


def p6_asset_bands(spark: SparkSession, d: str) -> DataFrame:
    """Bands with the name and href of their asset, all three node tables linked by interval containment."""
    n = cut(nested.label_nodes(table(spark, d, "raw_stac"), key="raw_id", payload="payload", keep=r"^\d+:assets\."))
    assets = n.where("depth = 2")
    hrefs = nested.link(n.where("depth = 3 AND key = 'href'"), assets).select("rec", "ord", "parent_pre", F.col("value").alias("href"))
    bands = nested.link(n.where("depth = 5 AND key = 'name'"), assets).select("rec", "ord", "parent_pre", F.col("value").alias("band"))
    named = assets.select("rec", "ord", F.col("pre").alias("parent_pre"), F.col("key").alias("asset"))
    out = named.join(bands, ["rec", "ord", "parent_pre"]).join(hrefs, ["rec", "ord", "parent_pre"], "left")
    return out.select(F.col("rec").alias("raw_id"), F.col("ord").alias("feature_ord"), "asset", "band", "href")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_counts, p4_found, p4_changes, p4_unified, p4_rows, p6_found, p6_nodes, p6_asset_bands)}


_POINTS = """
pts0 AS (
  SELECT footprint_id AS k,
    CASE WHEN bbox IS NOT NULL THEN (CASE WHEN bbox[1] > bbox[3] THEN (bbox[1] + bbox[3] + 360) / 2 ELSE (bbox[1] + bbox[3]) / 2 END)
         ELSE (list_min(list_transform(coordinates, lambda p: p[1])) + list_max(list_transform(coordinates, lambda p: p[1]))) / 2 END AS x0,
    CASE WHEN bbox IS NOT NULL THEN (bbox[2] + bbox[4]) / 2
         ELSE (list_min(list_transform(coordinates, lambda p: p[2])) + list_max(list_transform(coordinates, lambda p: p[2]))) / 2 END AS y
  FROM footprints),
pts AS (SELECT k, CASE WHEN x0 >= -180 AND x0 < 180 THEN x0 ELSE x0 + 180 - floor((x0 + 180) / 360) * 360 - 180 END AS x, y FROM pts0 WHERE x0 IS NOT NULL),
near AS (
  SELECT a.k AS key_a, b.k AS key_b FROM pts a JOIN pts b ON a.k < b.k AND b.y BETWEEN a.y - 0.0046 AND a.y + 0.0046
  WHERE 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2)))) <= 500),
tags AS (
  SELECT tag_id, polygon ->> '$.polygon_crs' AS crs,
    CASE WHEN polygon ->> '$.geojson.type' = 'Polygon' THEN [CAST(polygon -> '$.geojson.coordinates' AS DOUBLE[][][])] ELSE CAST(polygon -> '$.geojson.coordinates' AS DOUBLE[][][][]) END AS parts
  FROM geo_tags WHERE polygon IS NOT NULL),
part AS (SELECT tag_id, crs, unnest(parts) AS rings, generate_subscripts(parts, 1) AS part FROM tags),
ring AS (SELECT tag_id, crs, part, unnest(rings) AS r FROM part),
edge AS (SELECT tag_id, crs, part, unnest(list_transform(range(1, len(r)), lambda i: {'x0': r[i][1], 'y0': r[i][2], 'x1': r[i + 1][1], 'y1': r[i + 1][2]})) AS e FROM ring),
turned AS (SELECT k, x + s AS x, y FROM pts, (VALUES (-360), (0), (360)) t(s)),
plane AS (
  SELECT k, x, y, FALSE AS merc FROM turned
  UNION ALL SELECT k, radians(x) * 6378137.0, ln(tan(pi() / 4 + radians(y) / 2)) * 6378137.0, TRUE FROM turned),
hits AS (
  SELECT p.k, e.tag_id, e.part, p.x FROM edge e JOIN plane p ON p.merc = (e.crs = 'EPSG:3857') AND (e.e.y0 > p.y) <> (e.e.y1 > p.y)
  WHERE p.x < (e.e.x1 - e.e.x0) * (p.y - e.e.y0) / (e.e.y1 - e.e.y0) + e.e.x0),
inside AS (SELECT DISTINCT k, tag_id FROM (SELECT k, tag_id, part, x FROM hits GROUP BY ALL HAVING count(*) % 2 = 1))
"""

_FEATURES = """
valid AS (SELECT raw_id, feed, file_seq, file_name, CAST(payload AS JSON) AS j FROM raw_stac WHERE json_valid(payload)),
feature AS (
  SELECT raw_id, feed, file_seq, file_name, CAST(0 AS INTEGER) AS feature_ord, j AS f FROM valid WHERE j ->> '$.type' = 'Feature'
  UNION ALL
  SELECT raw_id, feed, file_seq, file_name, CAST(o AS INTEGER), json_extract(j, '$.features[' || o || ']')
  FROM (SELECT *, unnest(range(CAST(json_array_length(j, '$.features') AS BIGINT))) AS o FROM valid WHERE j ->> '$.type' = 'FeatureCollection'))
"""


_NUMBERS = r"^\[[-+0-9.eE,]+\]$"
_KIND = "CASE json_type({0}) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN CASE WHEN regexp_matches(CAST({0} AS VARCHAR), '" + _NUMBERS + "') THEN 'vector' ELSE 'array' END WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_POINTS} SELECT 'near' AS relation, key_a, key_b FROM near UNION ALL SELECT 'inside', k, tag_id FROM inside",
        "p1_counts": f"""WITH {_POINTS},
both_ AS (SELECT key_a AS k, key_b AS o FROM near UNION ALL SELECT key_b, key_a FROM near),
n AS (SELECT k, count(*) AS n_near FROM both_ GROUP BY k),
s AS (SELECT a.k, count(*) - 1 AS n_same_place FROM pts a JOIN pts b ON a.x = b.x AND a.y = b.y GROUP BY a.k),
r AS (SELECT k, count(*) AS n_regions FROM inside GROUP BY k)
SELECT footprint_id, coalesce(n_same_place, 0) AS n_same_place, coalesce(n_near, 0) AS n_near, coalesce(n_regions, 0) AS n_regions
FROM footprints f LEFT JOIN n ON n.k = footprint_id LEFT JOIN s ON s.k = footprint_id LEFT JOIN r ON r.k = footprint_id""",
        "p4_found": f"""WITH {_FEATURES},
member AS (
  SELECT file_name, k AS path, json_type(json_extract(f, '$."' || k || '"')) AS t FROM (SELECT file_name, f, unnest(json_keys(f)) AS k FROM feature)
  UNION ALL
  SELECT file_name, 'properties.' || k, json_type(json_extract(p, '$."' || k || '"')) FROM (SELECT file_name, f -> '$.properties' AS p, unnest(json_keys(f -> '$.properties')) AS k FROM feature WHERE json_type(f -> '$.properties') = 'OBJECT')),
typed AS (
  SELECT file_name, path, string_agg(DISTINCT t, ',' ORDER BY t) AS types FROM (
    SELECT file_name, path, CASE WHEN t IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'UHUGEINT', 'DOUBLE') THEN 'number' ELSE t END AS t FROM member WHERE t <> 'NULL') GROUP BY ALL),
file AS (SELECT file_name, lag(file_name) OVER (PARTITION BY feed ORDER BY file_seq) AS before FROM (SELECT DISTINCT feed, file_seq, file_name FROM raw_stac)),
step AS (SELECT * FROM file WHERE before IS NOT NULL),
new AS (SELECT s.file_name, path, types FROM step s JOIN typed t ON t.file_name = s.file_name),
old AS (SELECT s.file_name, path, types FROM step s JOIN typed t ON t.file_name = s.before)
SELECT coalesce(new.file_name, old.file_name) AS file_name, coalesce(new.path, old.path) AS field_path,
  CASE WHEN old.path IS NULL THEN 'added' WHEN new.path IS NULL THEN 'removed' ELSE 'type' END AS change
FROM new FULL JOIN old ON new.file_name = old.file_name AND new.path = old.path
WHERE new.path IS NULL OR old.path IS NULL OR new.types <> old.types""",
        "p4_rows": f"WITH {_FEATURES} SELECT feed, file_name, count(*) AS n_features, count(DISTINCT raw_id) AS n_payloads FROM feature GROUP BY ALL",
        "p6_nodes": f"""WITH RECURSIVE {_FEATURES},
n(raw_id, feature_ord, place, depth, path, key, idx, v) AS (
  SELECT raw_id, feature_ord, CAST([] AS BIGINT[]), 0, '', CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), json_extract(f, '$') FROM feature
  UNION ALL
  SELECT raw_id, feature_ord, list_append(place, c.i), depth + 1, CASE WHEN c.key IS NULL THEN path || '[]' WHEN path = '' THEN c.key ELSE path || '.' || c.key END, c.key, c.idx, c.v FROM (
    SELECT raw_id, feature_ord, place, depth, path, unnest(CASE WHEN json_type(v) = 'OBJECT' THEN list_transform(range(len(json_keys(v))), lambda i: {{'i': i, 'key': json_keys(v)[i + 1], 'idx': CAST(NULL AS BIGINT), 'v': json_extract(v, '$."' || json_keys(v)[i + 1] || '"')}})
      WHEN json_type(v) = 'ARRAY' AND NOT regexp_matches(CAST(v AS VARCHAR), '{_NUMBERS}') THEN list_transform(range(CAST(json_array_length(v) AS BIGINT)), lambda i: {{'i': i, 'key': CAST(NULL AS VARCHAR), 'idx': i, 'v': json_extract(v, '$[' || i || ']')}}) END) AS c FROM n)),
t AS (SELECT *, {_KIND.format("v")} AS type, CASE WHEN json_type(v) = 'ARRAY' AND NOT regexp_matches(CAST(v AS VARCHAR), '{_NUMBERS}') AND json_array_length(v) > 0 THEN {_KIND.format("json_extract(v, '$[0]')")} END AS child_type, row_number() OVER (PARTITION BY raw_id, feature_ord ORDER BY place) - 1 AS pre FROM n),
s AS (SELECT a.raw_id, a.feature_ord, a.pre, count(*) - 1 AS held FROM t a JOIN t b ON a.raw_id = b.raw_id AND a.feature_ord = b.feature_ord AND b.place[:len(a.place)] = a.place GROUP BY ALL)
SELECT raw_id AS rec, feature_ord AS ord, CAST(pre AS INTEGER) AS pre, CAST(pre + held - depth AS INTEGER) AS post, CAST(depth AS INTEGER) AS depth, path, key, CAST(idx AS INTEGER) AS idx, type, child_type,
  CASE WHEN type = 'string' THEN v ->> '$' WHEN type IN ('number', 'boolean', 'vector') THEN CAST(v AS VARCHAR) END AS value FROM t JOIN s USING (raw_id, feature_ord, pre)""",
        "p6_found": f"""WITH {_FEATURES},
inst AS (SELECT raw_id, feature_ord, f -> '$.properties.instruments' AS v FROM feature),
geo AS (SELECT raw_id, feature_ord, f ->> '$.geometry.type' AS t, f -> '$.geometry.coordinates' AS c FROM feature),
poly AS (SELECT raw_id, feature_ord, CASE t WHEN 'Point' THEN [[[CAST(c AS DOUBLE[])]]] WHEN 'Polygon' THEN [CAST(c AS DOUBLE[][][])] WHEN 'MultiPolygon' THEN CAST(c AS DOUBLE[][][][]) END AS p FROM geo WHERE c IS NOT NULL),
ring AS (SELECT raw_id, feature_ord, unnest(p) AS r, generate_subscripts(p, 1) - 1 AS a FROM poly),
vert AS (SELECT raw_id, feature_ord, a, unnest(r) AS v, generate_subscripts(r, 1) - 1 AS b FROM ring),
asset AS (SELECT raw_id, feature_ord, f -> '$.assets' AS s, unnest(json_keys(f -> '$.assets')) AS k FROM feature WHERE json_type(f -> '$.assets') = 'OBJECT')
SELECT raw_id, feature_ord, 'instrument' AS child, '' AS parent_path, CAST(unnest(range(CAST(json_array_length(v) AS BIGINT))) AS INTEGER) AS child_ord FROM inst WHERE json_type(v) = 'ARRAY'
UNION ALL SELECT raw_id, feature_ord, 'instrument', '', 0 FROM inst WHERE json_type(v) = 'VARCHAR'
UNION ALL SELECT raw_id, feature_ord, 'vertex', a || '/' || b, CAST(unnest(range(len(v))) AS INTEGER) FROM vert
UNION ALL SELECT raw_id, feature_ord, 'asset', k, 0 FROM asset
UNION ALL SELECT raw_id, feature_ord, 'band', k, CAST(unnest(range(CAST(json_array_length(json_extract(s, '$."' || k || '"."eo:bands"')) AS BIGINT))) AS INTEGER) FROM asset""",
        "p6_asset_bands": f"""WITH {_FEATURES},
asset AS (SELECT raw_id, feature_ord, f -> '$.assets' AS s, unnest(json_keys(f -> '$.assets')) AS k FROM feature WHERE json_type(f -> '$.assets') = 'OBJECT'),
band AS (SELECT raw_id, feature_ord, k, json_extract(s, '$."' || k || '"') AS a, unnest(range(CAST(json_array_length(json_extract(s, '$."' || k || '"."eo:bands"')) AS BIGINT))) AS i FROM asset)
SELECT raw_id, feature_ord, k AS asset, a ->> ('$."eo:bands"[' || i || '].name') AS band, a ->> '$.href' AS href FROM band WHERE a ->> ('$."eo:bands"[' || i || '].name') IS NOT NULL""",
    }
