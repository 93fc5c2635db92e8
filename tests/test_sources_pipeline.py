import json
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from terrafold.plans import pipeline as pl
from terrafold.sources import anchors, catalog_pages, geojson, tables, tiff, yolo, zarr
from terrafold.streaming import windows


def test_tiff_round_trips(tmp_path, spark):
    rng = np.random.default_rng(1)
    for dtype in ("uint8", "int16", "uint16", "float32", "float64"):
        a = (rng.random((3, 70, 41)) * 200).astype(dtype)
        b, meta = tiff.decode(tiff.encode(a, scale=10.0, origin=(5.0, 6.0), nodata=3.0, tags={"bands": ["x", "y", "z"]}, rows_per_strip=32))
        assert (a == b).all() and meta == {"scale": (10.0, 10.0), "origin": (5.0, 6.0), "nodata": 3.0, "tags": {"bands": ["x", "y", "z"]}}
    one, _ = tiff.decode(tiff.encode(np.ones((1, 2, 2), "float32")))
    assert one.shape == (1, 2, 2)
    with pytest.raises(ValueError):
        tiff.decode(b"nonsense")
    p = spark.createDataFrame([("s1", "B02", 0, 0, 1.5), ("s1", "B02", 1, 1, None), ("s1", "B03", 2, 1, 4.0), ("s2", "B02", 0, 1, 2.0)], "sample string, band string, y int, x int, value double")
    assert tiff.write_rasters(p, str(tmp_path), key="sample", height=3, width=2).count() == 2
    got = tiff.read_pixels(spark, str(tmp_path)).where("value IS NOT NULL")
    assert rows(got, "band", "y", "x", "value") == [("B02", 0, 0, 1.5), ("B02", 0, 1, 2.0), ("B03", 2, 1, 4.0)]
    assert tiff.read_pixels(spark, str(tmp_path), bands=["B03"]).where("value IS NOT NULL").count() == 1


def test_zarr_round_trip(tmp_path, spark):
    store = str(tmp_path / "s.zarr")
    p = spark.createDataFrame([("ndvi", y, x, float(y * 10 + x)) for y in range(7) for x in range(5) if (y, x) != (3, 3)] + [("b", 0, 0, 9.0)], "variable string, y int, x int, value double")
    zarr.write_arrays(p, store, height=7, width=5, chunk=4, attrs={"tag": "t"})
    assert zarr.variables(store) == ["b", "ndvi"] and zarr.attributes(store) == {"tag": "t"}
    c = zarr.read_chunks(spark, store, ["ndvi"])
    assert c.count() == 4
    got = rows(zarr.chunk_pixels(c).where("value IS NOT NULL"), "y", "x", "value")
    assert got == sorted((y, x, float(y * 10 + x)) for y in range(7) for x in range(5) if (y, x) != (3, 3))
    assert zarr.chunk_pixels(zarr.read_chunks(spark, store)).where("variable = 'b' AND value IS NOT NULL").count() == 1
    with pytest.raises(ValueError):
        zarr.read_chunks(spark, store, ["nope"])
    with pytest.raises(ValueError):
        zarr.write_arrays(p, str(tmp_path / "s"), height=7, width=5)
    s = tables.list_stores(spark, str(tmp_path), required=["ndvi"]).collect()
    assert [(r.sample_id, r.layers) for r in s] == [("s", ["b", "ndvi"])]
    assert tables.list_stores(spark, str(tmp_path), required=["x"]).count() == 0


def test_label_files(tmp_path, spark):
    (tmp_path / "in").mkdir()
    (tmp_path / "labels_1.txt").write_text("0 0.5 0.5 0.2 0.2\n\n1 0.1 0.1 0.05 0.05\r\n")
    (tmp_path / "labels_2.txt").write_text("")
    (tmp_path / "in" / "labels_2.txt").write_text("0 0.5 0.5")
    f = yolo.read_labels(spark, str(tmp_path), pattern=r"(\d+)\.txt$")
    a = {r.sample_id: (r.class_ids, r.boxes) for r in yolo.as_arrays(f, key="sample_id", body="body").collect()}
    assert a == {"1": ([0, 1], [[0.5, 0.5, 0.2, 0.2], [0.1, 0.1, 0.05, 0.05]]), "2": ([], [])}
    bad = spark.createDataFrame([(3, "0 0.5 0.5")], "k int, body string")
    assert rows(yolo.malformed(bad, key="k", body="body"), "k", "line_no") == [(3, 1)]
    with pytest.raises(Exception, match="five fields"):
        yolo.boxes(bad, key="k", body="body", strict=True).collect()


def test_tables_splits_provenance_archives(tmp_path, spark):
    (tmp_path / "t.csv").write_text("id,score\na,1\n")
    assert rows(tables.read_table(spark, str(tmp_path / "t.csv"))) == [("a", 1)]
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.json")
    (tmp_path / "split.txt").write_text(" a \n\nb\n")
    assert rows(tables.read_split(spark, str(tmp_path / "split.txt"))) == [("a",), ("b",)]
    (tmp_path / "s1.stac.json").write_text(json.dumps([{"id": 1}, {"id": 2}]))
    assert rows(tables.read_provenance(spark, str(tmp_path))) == [("s1", 0, '{"id":1}'), ("s1", 1, '{"id":2}')]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for n in ("a/b.txt", "__MACOSX/x", "a/._b"):
            z.writestr(n, "1")
    out = tables.extract_archive(str(tmp_path / "z.zip"), str(tmp_path / "out"))
    assert sorted(f for _, _, fs in os.walk(out) for f in fs) == ["b.txt"]


def test_geojson_and_anchors(tmp_path, spark):
    point = {"type": "Point", "coordinates": [13.0, 52.0]}
    square = {"type": "Polygon", "coordinates": [[[13.0, 52.0], [13.02, 52.0], [13.02, 52.02], [13.0, 52.02], [13.0, 52.0]]]}
    texts = [json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": point, "properties": {"id": "1"}}, {"type": "Feature", "geometry": square, "properties": None}]}), json.dumps({"type": "Feature", "geometry": point, "properties": {}}), json.dumps(square), "broken", "{}"]
    got = geojson.parse_features(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string"))
    assert rows(got, "i", "feature_no", "shape") == [(0, 0, "Point"), (0, 1, "Polygon"), (1, 0, "Point"), (2, 0, "Polygon")]
    a = anchors.from_request(spark, {"type": "coordinate", "lat": -6.2, "lon": 106.8, "datetime": "2024-01-01", "area_m": 5120}).collect()
    assert {(r.crs, r.width) for r in a} == {("EPSG:32748", 513)} and len(a) == 4 and a[0].stem == "106.800000_-6.200000_20240101_10m"
    p = anchors.from_request(spark, {"type": "polygon", "polygon": square, "datetime": "2024-01", "tile_size_px": 50})
    assert p.first().crs == "EPSG:32633" and p.count() == 15
    with pytest.raises(ValueError):
        anchors.from_request(spark, {"type": "moon"})
    with pytest.raises(Exception, match="bad coordinate"):
        anchors.from_coordinates(spark.createDataFrame([(0.0, 91.0, 10.0, None)], "lon double, lat double, size_m double, datetime string")).collect()


def test_catalog_pages(tmp_path, spark):
    for i in range(3):
        (tmp_path / f"p{i}.json").write_text(json.dumps({"features": [{"id": f"x{i}", "collection": "a" if i else "b", "bbox": [0, 0, 1, 1], "properties": {"datetime": "2020", "n": i}, "assets": {"B": {"href": "h"}}}]}))
    catalog_pages.register(spark)
    df = spark.read.format("catalog_pages").load(str(tmp_path))
    assert df.count() == 3 and df.rdd.getNumPartitions() == 3
    assert rows(df.where("collection = 'a'").select("item_id", F.col("properties")["n"].alias("n"))) == [("x1", "1"), ("x2", "2")]


def test_steps_wire_by_name(spark):
    @pl.step("ndvi")
    def index(nir, red):
        return (nir - red) / (nir + red)

    @pl.step("high", "low")
    def levels(ndvi):
        return ndvi > 0.5, ndvi < 0.1

    @pl.step("unused")
    def other(missing):
        return missing

    df = spark.createDataFrame([(0.9, 0.1)], "nir double, red double")
    assert pl.run_steps(df, [levels, other, index], {"high"}).first().high is True
    with pytest.raises(TypeError, match="nothing gives"):
        pl.plan_steps([levels], {"nir"}, {"high"})
    with pytest.raises(TypeError, match="given by"):
        pl.plan_steps([index, pl.step("ndvi")(lambda nir: nir)], {"nir", "red"}, {"ndvi"})
    a, b = pl.step("x")(lambda y: y), pl.Step("b", ("x",), ("y",), lambda x: x)
    with pytest.raises(TypeError, match="circle"):
        pl.plan_steps([a, b], set(), {"x"})
    for bad in (lambda: pl.step(), lambda: pl.step("a", "a"), lambda: pl.step("a")(lambda *x: x), lambda: pl.step("a")(lambda a: a)):
        with pytest.raises(TypeError):
            bad()


def test_registry_and_pipeline(spark):
    r = pl.Registry()

    @r.register("mask", "Scl")
    def scl(threshold=1):
        return threshold

    assert r.build("MASK", "scl", threshold=3, extra=1) == 3 and r.names("mask") == ["scl"]
    with pytest.raises(ValueError):
        r.register("mask", "SCL")(scl)
    with pytest.raises(ValueError):
        r.build("mask", "nope")

    class Two(pl.Pipeline):
        def sources(self):
            t = lambda n: spark.sql(f"SELECT 'a' AS k, 1 AS ord, TIMESTAMP_NTZ '2020-01-01' AS start, TIMESTAMP_NTZ '2020-01-31' AS end, {n} AS v")
            return {"x": t(1).unionAll(t(1).withColumn("ord", F.lit(2))), "y": t(2)}

        def preprocess(self, samples):
            return samples.withColumn("error", F.when(F.col("ref_ord") == 2, "no data"))

        def context(self, samples):
            return samples.withColumn("total", F.col("x.v") + F.col("y.v"))

    assert rows(Two().ingest(["k"]), "k", "ref_ord", "total") == [("a", 1, 3)]


def test_streams_agree_with_the_batch(spark, data):
    s = windows.window_stats(windows.scene_stream(spark, data), ["collection"], size="1 day", late="3650 days")
    got = windows.run_to_end(s)
    b = spark.read.parquet(f"{data}/scenes.parquet").where("ts IS NOT NULL")
    assert got.agg(F.sum("n")).first()[0] == b.count() and got.count() == b.select("collection", F.to_date("ts")).distinct().count()


def test_sequences_in_state(spark, tmp_path):
    import datetime as dt

    t = [("a", dt.datetime(2020, 1, d), float(d)) for d in range(1, 6)] + [("b", dt.datetime(2020, 1, 1), 1.0)]
    spark.createDataFrame(t, "anchor_id string, start timestamp, mean double").coalesce(1).write.parquet(str(tmp_path / "in"))
    st = spark.readStream.schema("anchor_id string, start timestamp, mean double").parquet(str(tmp_path / "in"))
    out = windows.run_to_end(windows.slot_sequences(st, "anchor_id", slots=3, strides=1), mode="append")
    assert rows(out, "anchor_id", "sample", "values") == [("a", 0, [1.0, 2.0, 3.0]), ("a", 1, [2.0, 3.0, 4.0]), ("a", 2, [3.0, 4.0, 5.0])]


def test_cells_in_sql(spark):
    anchors.register_cells(spark)
    assert rows(spark.sql("SELECT cy, cx, h, w FROM cells(70, 33, 32)")) == [(0, 0, 32, 32), (0, 1, 32, 32), (0, 2, 32, 6), (1, 0, 1, 32), (1, 1, 1, 32), (1, 2, 1, 6)]
