import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from terrafold.operators import inference, tiles
from terrafold.sources import layers

PIXELS = "anchor_id string, layer string, ts timestamp_ntz, band string, y int, x int, value double"


def test_pixel_schema(spark):
    p = spark.createDataFrame([("a", "l", None, None, 0, 0, 1.0)], PIXELS)
    assert tiles.validate_pixels(p.withColumn("more", F.lit(1)).select("more", *reversed(p.columns))).columns == p.columns
    with pytest.raises(ValueError, match="missing band"):
        tiles.validate_pixels(p.drop("band"))
    with pytest.raises(ValueError, match="y is string"):
        tiles.validate_pixels(p.withColumn("y", F.lit("0")))
    q = spark.createDataFrame([("a", "l", None, None, 0, 0, 1.0), ("a", "l", None, "b", 0, 0, 1.0), ("a", "m", None, "data", 0, 0, 1.0), ("a", "m", None, "b", 0, 0, 1.0), ("a", "n", None, "b", 0, 0, 1.0)], PIXELS)
    assert [r[1] for r in rows(tiles.band_problems(q))] == ["l", "m"]


def test_bands_to_show(spark):
    df = spark.createDataFrame([(["r", "g", "b", "n"],), (["r", "g"],)], "bands array<string>")
    assert [r[0] for r in df.select(tiles.rgb_subset(df.bands, ["b", "g", "r"])).collect()] == [["b", "g", "r"], None]
    assert tiles.resolve_rgb(["a", "b", "c"], None) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        tiles.resolve_rgb(["a", "b"], None)


def test_rebase_merges_maps_and_replaces_the_rest(spark):
    df = spark.sql("SELECT map('a', '1', 'b', '2') AS metadata, CAST(NULL AS MAP<STRING, STRING>) AS plot_meta, 'p' AS polygon")
    r = tiles.rebase(df, metadata=F.create_map(F.lit("b"), F.lit("3")), plot_meta=F.create_map(F.lit("x"), F.lit("y")), polygon=F.lit("q")).first()
    assert (r.metadata, r.plot_meta, r.polygon) == ({"a": "1", "b": "3"}, {"x": "y"}, "q")
    with pytest.raises(ValueError):
        tiles.rebase(df, nope=F.lit(1))


def test_tags_and_solar_days(spark):
    t = dt.datetime(2019, 5, 7, 23, 30, 0, 5)
    df = spark.createDataFrame([(t, 30.0, "x"), (t, -120.0, None)], "t timestamp_ntz, lon double, m string")
    got = df.select(tiles.tag_json(df.t, df.t, note=df.m).alias("tag"), tiles.solar_day(df.t, df.lon).alias("day")).collect()
    assert got[0].tag == '{"datetime":["2019-05-07T23:30:00.000005","2019-05-07T23:30:00.000005"],"note":"x"}' and "note" not in got[1].tag
    assert [r.day.day for r in got] == [8, 7]
    back = spark.createDataFrame([(got[0].tag,), ("{",), (None,)], "tag string")
    assert [r[0] for r in back.select(tiles.read_tag(back.tag)[0]).collect()] == [t, None, None]


def test_mosaics_keep_tags(spark):
    df = spark.sql("""SELECT * FROM VALUES ('m', 2, TIMESTAMP_NTZ '2020-01-02', TIMESTAMP_NTZ '2020-01-09', map('k', 'new'), 'p2', array('i1')),
        ('m', 1, TIMESTAMP_NTZ '2020-01-01', TIMESTAMP_NTZ '2020-01-05', map('k', 'old', 'o', '1'), 'p1', array('i1', 'i2')), ('m', 3, TIMESTAMP_NTZ '2020-01-03', TIMESTAMP_NTZ '2020-01-04', NULL, NULL, NULL) t(g, tile_ord, start, end, metadata, plot_meta, items)""")
    r = tiles.mosaic_tags(df, ["g"]).first()
    assert (r.start.day, r.end.day, r.metadata, r.plot_meta, r["items"]) == (1, 9, {"k": "new", "o": "1"}, "p1", ["i1", "i2", "i1"])


def test_arrays_chunks_and_places(spark):
    a = spark.createDataFrame([("s", [[[1.0, 2.0]], [[3.0, None]]])], "k string, values array<array<array<double>>>")
    p = tiles.arrays_to_pixels(a, ["k"], bands=["u", "v"])
    assert [tuple(r) for r in p.orderBy("band", "x").collect()] == [("s", "u", 0, 0, 1.0), ("s", "u", 0, 1, 2.0), ("s", "v", 0, 0, 3.0), ("s", "v", 0, 1, None)]
    with pytest.raises(Exception, match="expected 3 bands"):
        tiles.arrays_to_pixels(a, ["k"], bands=["u", "v", "w"]).collect()
    c = tiles.pixels_to_chunks(p, ["k", "band"], 1)
    assert c.count() == 4 and c.count() == tiles.chunks_to_pixels(c, ["k", "band"], 1).count()
    g = spark.createDataFrame([(10.0, 50.0, "town"), (10.0, 50.0, "town"), (1.0, 1.0, "x")], "lon double, lat double, name string")
    pts = spark.createDataFrame([(1, 10.001, 49.999), (2, 0.0, 0.0), (3, None, None)], "k int, lon double, lat double")
    assert sorted((r.k, r.name) for r in tiles.place_names(pts, g).collect()) == [(1, "town"), (2, None), (3, None)]


def test_segmentation_by_patches(spark):
    a = np.random.default_rng(4).normal(size=(6, 6))
    p = spark.createDataFrame([(1, int(y), int(x), float(v)) for (y, x), v in np.ndenumerate(a)], "g int, y int, x int, value double")
    model = lambda x: np.stack([x, -x], axis=1)
    s = inference.segment(p, ["g"], model, height=6, width=6, size=4, overlap=0.5, n_classes=2, pad=2, thresholds=[0.0, 1.1])
    got = {(r.y, r.x): (r.pred, r.p) for r in s.collect()}
    assert len(got) == 36
    for k, v in np.ndenumerate(a):
        assert got[k][0] == (0 if v > 0 else 255) and abs(got[k][1] - 1 / (1 + np.exp(-2 * abs(v)))) < 1e-2
    with pytest.raises(ValueError):
        inference.segment(p, ["g"], model, height=6, width=6, size=4, overlap=0.5, n_classes=2, thresholds=[0.0])
    up = {(r.y, r.x): r.value for r in inference.resize_bilinear(p, ["g"], height=6, width=6, to=(12, 12)).collect()}
    assert len(up) == 144 and abs(up[0, 0] - a[0, 0]) < 1e-12 and abs(up[1, 0] - (0.75 * a[0, 0] + 0.25 * a[1, 0])) < 1e-12


def test_layer_stores(spark, tmp_path):
    path = str(tmp_path / "store")
    p = lambda layer, v: spark.createDataFrame([("a", layer, None, None, 0, 0, v)], PIXELS)
    layers.save_layers(p("x", 1.0).unionAll(p("y", 2.0)), path)
    layers.save_layers(p("x", 3.0), path)
    assert layers.layers_of(spark, path) == ["x", "y"]
    assert rows(layers.load_layers(spark, path), "layer", "value") == [("x", 3.0), ("y", 2.0)]
    assert rows(layers.load_layers(spark, path, required=["y"]), "value") == [(2.0,)]
    with pytest.raises(ValueError, match="already has x"):
        layers.save_layers(p("x", 1.0), path, overwrite=False)
    layers.save_layers(p("z", 1.0), path, overwrite=False)
    with pytest.raises(KeyError):
        layers.load_layers(spark, path, required=["nope"])
    out = str(tmp_path / "pred")
    q = spark.createDataFrame([("s1", "m", 1), ("s2", "m", 2)], "stem string, layer string, v int")
    assert (layers.write_new(q.where("v = 1"), out), layers.write_new(q, out), layers.write_new(q, out)) == (1, 1, 0)
    assert spark.read.parquet(out).count() == 2
    assert layers.write_provenance(spark.createDataFrame([], "sample_id string, item_no int, item string"), str(tmp_path / "none")) == 0
