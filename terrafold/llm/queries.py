"""Queries of the operators for model training data, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrafold.llm import chunking, leakage, mixing, overlap, splits, survivors
from terrafold.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The survivors of acquisitions with several records; all their fields are voted on too, as in p2_survivors."""
    got = survivors.item_survivors(table(spark, d, "stac_items"), least=2)
    return got.select(F.col("first_key").alias("first_rec_id"), F.col("survivor_key").alias("survivor_rec_id"))


def p2_survivors(spark: SparkSession, d: str) -> DataFrame:
    """One record per acquisition, with the best value of each field."""
    got = survivors.item_survivors(table(spark, d, "stac_items"))
    return got.withColumnsRenamed({"g": "acquisition", "first_key": "first_rec_id", "survivor_key": "survivor_rec_id"})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Tiles whose rows lay in several splits and now get one."""
    got = splits.tile_splits(table(spark, d, "yolo_labels"), table(spark, d, "split_targets"))
    return got.where((F.size("old_splits") >= 2) & F.col("g").isNotNull()).select(F.col("g").alias("mgrs_tile"))


def p3_assignment(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(table(spark, d, "yolo_labels"), table(spark, d, "split_targets"))


def p3_shares(spark: SparkSession, d: str) -> DataFrame:
    """Rows, tiles and share of each split after the allocation."""
    got = splits.tile_splits(table(spark, d, "yolo_labels"), table(spark, d, "split_targets"))
    per = got.groupBy("split").agg(F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_tiles"))
    whole = F.sum("n_rows").over(Window.partitionBy(F.lit(0)))  # over as many rows as there are splits
    return per.select("split", "n_rows", "n_tiles", (F.col("n_rows") / whole).alias("share"))


def p3_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Rows and splits of every tile after the allocation, the rows without a tile as one: always one split."""
    got = splits.assign_splits(table(spark, d, "yolo_labels"), table(spark, d, "split_targets"))
    return got.groupBy("mgrs_tile").agg(F.count("*").alias("n_rows"), F.countDistinct("split").alias("n_splits"))


def p3_balance(spark: SparkSession, d: str) -> DataFrame:
    """Rows of all splits together, and whether each split is within the largest tile of its share."""
    got = splits.tile_splits(table(spark, d, "yolo_labels"), table(spark, d, "split_targets"))
    per = got.groupBy("split").agg(F.sum("n_rows").alias("n_rows"), F.max("n_rows").alias("largest"))
    per = table(spark, d, "split_targets").join(per, "split", "left")
    over = Window.partitionBy(F.lit(0))  # over as many rows as there are splits
    all_rows = F.coalesce(F.sum("n_rows").over(over), F.lit(0))
    near = F.abs(F.coalesce("n_rows", F.lit(0)) - F.col("target_share") * all_rows) <= F.coalesce(F.max("largest").over(over), F.lit(0))
    return per.select("split", all_rows.alias("all_rows"), near.alias("within_one_tile"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.leaked_pairs(table(spark, d, "stack_samples"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.leak_report(table(spark, d, "stack_samples"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    got = leakage.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return got.where("kind = 'exact'").select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Exact and re-parameterised leaks, with the number of windows of each kind."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture_report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_balance(spark: SparkSession, d: str) -> DataFrame:
    """Whether each source is within one document a source of its share, and no document is repeated too often."""
    t = table(spark, d, "mix_targets")
    got = mixing.mixture(table(spark, d, "documents"), t)
    per = got.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n"), F.max("n_tokens").alias("largest"), F.max("copies").alias("most"))
    rows = t.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats").join(per, "source", "left")
    over = Window.partitionBy(F.lit(0))  # over as many rows as there are sources
    near = F.abs(F.col("n") - F.col("target_share") * F.sum("n").over(over)) <= F.sum("largest").over(over)
    return rows.select("source", F.coalesce(near, F.lit(False)).alias("share_reached"), F.coalesce(F.col("most") <= F.col("max_repeats"), F.lit(False)).alias("repeats_kept"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return chunking.oversized_items(table(spark, d, "documents"))


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunking.oversized_pieces(table(spark, d, "documents"))


def p9_joined(spark: SparkSession, d: str) -> DataFrame:
    """What the pieces of every item are when joined without their overlaps, and whether all are within the limit."""
    got = chunking.oversized_pieces(table(spark, d, "documents"))
    own = F.decode(F.expr("substring(encode(text, 'utf-8'), n_overlap + 1)"), "utf-8")
    per = got.groupBy("doc_id", "cell_no").agg(F.array_sort(F.collect_list(F.struct("piece_no", own.alias("t")))).alias("parts"), F.max("n_tokens").alias("most"))
    return per.select("doc_id", "cell_no", (F.col("most") <= 8192).alias("fits"), F.md5(F.array_join(F.transform("parts", lambda p: p["t"]), "")).alias("joined"))


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_survivors, p3_found, p3_assignment, p3_shares, p3_tiles, p3_balance, p5_found, p5_report, p7_found, p7_leaks, p8_mixture, p8_shares, p8_balance, p9_found, p9_pieces, p9_joined)}


_PRODUCT = r"(S2[ABC])_MSIL?(1C|2A)_(\d{8}T\d{6})(?:_N(\d{4}))?_R(\d{3})_T(\d{2}[A-Z]{3})_(\d{8}T\d{6})"


def _split(c: str) -> str:
    return f"CASE WHEN lower(trim({c})) LIKE 'tr%' THEN 'train' WHEN lower(trim({c})) LIKE 'v%' THEN 'val' WHEN lower(trim({c})) LIKE 'te%' THEN 'test' END"


_ACQUIRED = f"""
part AS (SELECT *, regexp_extract(upper(coalesce(product_uri, '')), '{_PRODUCT}', ['s', 'l', 't', 'n', 'o', 'm', 'g']) AS u, regexp_extract(upper(coalesce(item_id, '')), '{_PRODUCT}', ['s', 'l', 't', 'n', 'o', 'm', 'g']) AS i FROM stac_items),
rec AS (
  SELECT rec_id, CASE WHEN i.t <> '' THEN concat_ws('_', i.s, i.l, i.t, i.m) WHEN u.t <> '' THEN concat_ws('_', u.s, u.l, u.t, u.m) END AS acquisition,
    coalesce(TRY_CAST(nullif(u.n, '') AS INTEGER), CAST(round(TRY_CAST(processing_baseline AS DOUBLE) * 100) AS INTEGER)) AS base, coalesce(nullif(u.g, ''), nullif(i.g, '')) AS gen,
    CAST(mgrs_tile IS NOT NULL AS INTEGER) + CAST(cloud_cover IS NOT NULL AS INTEGER) + CAST(product_uri IS NOT NULL AS INTEGER) + CAST(generation_time IS NOT NULL AS INTEGER) AS complete
  FROM part),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY acquisition ORDER BY base DESC NULLS LAST, gen DESC NULLS LAST, complete DESC, rec_id) AS r, min(rec_id) OVER (PARTITION BY acquisition) AS first_id, count(*) OVER (PARTITION BY acquisition) AS n
  FROM rec WHERE acquisition IS NOT NULL)
"""

_TILE = """CASE WHEN mgrs_tile IS NULL THEN nullif(regexp_extract(upper(product_uri), '_T(\\d{2}[A-Z]{3})_', 1), '')
  ELSE lpad(regexp_extract(regexp_replace(upper(mgrs_tile), '[^0-9A-Z]', '', 'g'), '(\\d{1,2})[A-Z]{3}$', 1), 2, '0') || regexp_extract(regexp_replace(upper(mgrs_tile), '[^0-9A-Z]', '', 'g'), '\\d([A-Z]{3})$', 1) END"""

_STARTS = f"""
s0 AS (
  SELECT sample_no, {_split("split")} AS sp, lower(trim(sample_source)) AS src, bbox, geotag_datetime[1] AS g FROM stack_samples),
s1 AS (
  SELECT *, regexp_extract(g, '^(\\d{{4}})-?(\\d{{2}})-?(\\d{{2}})(?:T(\\d{{2}}):?(\\d{{2}}):?(\\d{{2}})?(?:\\.(\\d+))?)?(Z|[+-]\\d{{2}}:?\\d{{2}})?$', ['y', 'm', 'd', 'h', 'mi', 's', 'f', 'z']) AS p FROM s0 WHERE g IS NOT NULL),
s AS (
  SELECT sample_no, sp, src, bbox[1] AS w, bbox[2] AS so, bbox[3] AS e, bbox[4] AS n,
    make_timestamp(CAST(p.y AS BIGINT), CAST(p.m AS BIGINT), CAST(p.d AS BIGINT), coalesce(TRY_CAST(p.h AS BIGINT), 0), coalesce(TRY_CAST(p.mi AS BIGINT), 0), coalesce(TRY_CAST(p.s || '.' || CASE WHEN p.f = '' THEN '0' ELSE p.f END AS DOUBLE), 0))
    - to_minutes(CASE WHEN p.z IN ('', 'Z') THEN 0 ELSE (CASE WHEN p.z[1] = '-' THEN -1 ELSE 1 END) * (CAST(p.z[2:3] AS BIGINT) * 60 + CAST(p.z[-2:] AS BIGINT)) END) AS t
  FROM s1 WHERE sp IS NOT NULL AND bbox IS NOT NULL AND p.y <> ''),
pair AS (
  SELECT a.sample_no AS ta, b.sample_no AS eb, b.sp, b.src, (least(a.e, b.e) - greatest(a.w, b.w)) * (least(a.n, b.n) - greatest(a.so, b.so)) AS shared, (a.e - a.w) * (a.n - a.so) + (b.e - b.w) * (b.n - b.so) AS areas
  FROM s a JOIN s b ON a.sp = 'train' AND b.sp <> 'train' AND a.w < b.e AND b.w < a.e AND a.so < b.n AND b.so < a.n AND abs(epoch_us(a.t) - epoch_us(b.t)) <= 86400000000),
leak AS (SELECT * FROM pair WHERE shared / (areas - shared) >= 0.8)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"WITH {_ACQUIRED} SELECT first_id AS first_rec_id, rec_id AS survivor_rec_id FROM ranked WHERE r = 1 AND n >= 2",
        "p3_found": f"""SELECT mgrs_tile FROM (
SELECT {_TILE} AS mgrs_tile,
  {_split("split")} AS sp FROM yolo_labels) GROUP BY mgrs_tile HAVING count(DISTINCT sp) >= 2""",
        "p3_tiles": f"SELECT {_TILE} AS mgrs_tile, count(*) AS n_rows, 1 AS n_splits FROM yolo_labels GROUP BY ALL",
        "p3_balance": "SELECT split, (SELECT count(*) FROM yolo_labels) AS all_rows, TRUE AS within_one_tile FROM split_targets",
        "p5_found": f"WITH {_STARTS} SELECT least(ta, eb) AS sample_a, greatest(ta, eb) AS sample_b FROM leak",
        "p5_report": f"""WITH {_STARTS},
hit AS (SELECT eb, count(*) AS n FROM leak GROUP BY eb)
SELECT sp AS split, nullif(src, '') AS sample_source, count(*) AS n_samples, count(n) AS n_leaked, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_pairs
FROM s0 LEFT JOIN hit ON hit.eb = s0.sample_no WHERE sp IN ('val', 'test') GROUP BY ALL""",
        "p7_found": """WITH
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
d AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 10, 1)), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM dw),
b AS (SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 10, 1)), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM bw)
SELECT DISTINCT doc_id, item_id FROM d JOIN b USING (g)""",
        "p8_balance": "SELECT lower(trim(source)) AS source, TRUE AS share_reached, TRUE AS repeats_kept FROM mix_targets",
        "p9_joined": """SELECT doc_id, 0 AS cell_no, TRUE AS fits, md5(text) AS joined FROM documents WHERE strlen(text) > 8192
UNION ALL SELECT doc_id, c.cell_no, TRUE, md5(substring(text, c.char_start + 1, c.char_len)) FROM (SELECT doc_id, text, unnest(cells) AS c FROM documents) WHERE strlen(substring(text, c.char_start + 1, c.char_len)) > 8192""",
        "p9_found": """SELECT doc_id, 0 AS cell_no FROM documents WHERE strlen(text) > 8192
UNION ALL SELECT doc_id, c.cell_no FROM (SELECT doc_id, text, unnest(cells) AS c FROM documents) WHERE strlen(substring(text, c.char_start + 1, c.char_len)) > 8192""",
    }
