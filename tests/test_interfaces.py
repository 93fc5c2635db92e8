import datetime as dt
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from terrafold.functions import dates
from terrafold.operators import augment, catalog, datasets, tiles
from terrafold.plans import pipeline
from terrafold.sources import anchors, catalog_pages, coco, images, tiff


def test_ranges_in_one_text_or_two(spark):
    df = spark.createDataFrame([("2020-01", None), ("2020/2021-03", None), ("20200101/..", None), ("/2020", None), ("x/2020", None), ("2020-01-02", "2020-01-03T04"), ("..", "2020"), (None, None)], "a string, b string")
    one, two = dates.parse_range(F.col("a")), dates.parse_range(F.col("a"), F.col("b"))
    both = F.when(F.col("b").isNull(), one[0]).otherwise(two[0]), F.when(F.col("b").isNull(), one[1]).otherwise(two[1])
    got = [(str(r.s) if r.s else None, str(r.e) if r.e else None) for r in df.select(both[0].alias("s"), both[1].alias("e")).collect()]
    assert got == [
        ("2020-01-01 00:00:00", "2020-01-31 23:59:59.999999"), ("2020-01-01 00:00:00", "2021-03-31 23:59:59.999999"), ("2020-01-01 00:00:00", None), (None, "2020-12-31 23:59:59.999999"), (None, "2020-12-31 23:59:59.999999"),
        ("2020-01-02 00:00:00", "2020-01-03 04:59:59.999999"), (None, "2020-12-31 23:59:59.999999"), (None, None),
    ]


def test_pages_and_peeks(spark):
    items = spark.createDataFrame([(f"i{i}", "c" if i % 2 else "d", {"B1": json.dumps({"href": "x", "gsd": 10, "roles": ["data"]}), "B2": "{}"}) for i in range(7)], "item_id string, collection string, assets map<string,string>")
    pages = list(catalog.search_iter(items, catalog.Search(collections=("c",), sortby=("item_id",)), page=2))
    assert [[r.item_id for r in p] for p in pages] == [["i1", "i3"], ["i5"]]
    assert list(catalog.search_iter(items.limit(0), catalog.Search())) == []
    assert json.loads(catalog.peek_item(items, "c").first().item)["collection"] == "c"
    assert catalog.peek_item(items, "none").collect() == []
    assert {r.band: r.fields for r in catalog.peek_bands(items, "d").collect()} == {"B1": {"gsd": "10"}, "B2": {}}


def test_named_catalogs_and_signed_assets(spark):
    assert catalog_pages.page_address("element84", "sentinel-2-l2a", limit=5).endswith("/collections/sentinel-2-l2a/items?limit=5")
    with pytest.raises(ValueError):
        catalog_pages.page_address("nowhere", "c")
    items = spark.createDataFrame([("a", {"x": '{"href":"https://h/x?q=1","gsd":2}', "y": '{"href":"https://h/y"}', "z": "{}"}), ("b", {"x": '{"href":"https://h/x"}'})], "collection string, assets map<string,string>")
    got = {r.collection: r.assets for r in catalog_pages.signed(items, {"a": "sig=t"}).collect()}
    assert got["a"] == {"x": '{"href":"https://h/x?q=1&sig=t","gsd":2}', "y": '{"href":"https://h/y?sig=t"}', "z": "{}"} and got["b"] == {"x": '{"href":"https://h/x"}'}
    assert catalog_pages.signed(items, {}).count() == 2


class Named(datasets.Dataset):
    def render(self):
        return super().render().withColumn("title", F.upper("name"))


def test_datasets_by_key(spark):
    df = spark.createDataFrame([("b", 1, "x", [1, 2]), ("a", 2, "y", [3]), ("c", 3, None, None), (None, 4, "z", [])], "sample_id string, n int, name string, v array<int>")
    d = Named(df, order="n")
    assert len(d) == 3 and rows(d.keys()) == [("a", 1), ("b", 0), ("c", 2)] and d.fields == ["name", "v", "title"]
    assert dict(d.render().dtypes)["v"] == "array<double>" and d.row().columns == ["sample_id", "n", "name"]
    assert [r.title for r in d.get("a")] == ["Y"]
    lists = {"train": spark.createDataFrame([("a",), ("b",), (None,)], "sample_id string"), "val": spark.createDataFrame([("b",), ("q",)], "sample_id string")}
    parts = datasets.split_datasets(d, {**lists, "predict": None})
    assert [len(parts[s]) for s in ("train", "val", "predict")] == [2, 1, 3] and isinstance(parts["val"], Named)
    assert rows(datasets.shared_keys(lists, "sample_id")) == [("b", ["train", "val"])]
    other = datasets.Dataset(spark.createDataFrame([("a", 5), ("z", 6)], "sample_id string, m int"))
    assert rows((d & other).rows, "sample_id", "m", "title") == [("a", 5.0, "Y")]
    assert datasets.check_dense({0: "a", 1: "b"}, "class_map") == 2
    for bad in ({}, {1: "a"}, {0: "a", 2: "b"}):
        with pytest.raises(ValueError):
            datasets.check_dense(bad, "class_map")
    with pytest.raises(ValueError):
        datasets.Dataset(df, key="none")


def test_stages_take_attributes_of_stages_before():
    reg = pipeline.Registry()

    @reg.register("encoder", "Wide")
    class Wide:
        def __init__(self, width: int = 4) -> None:
            self.out_width = width * 2

    @reg.register("head", "Dense")
    class Dense:
        def __init__(self, encoder_out_width: int, classes: int) -> None:
            self.shape = (encoder_out_width, classes)

    @reg.register("head", "Asks")
    class Asks:
        def __init__(self, encoder_depth: int) -> None:
            pass

    built = reg.build_all({"encoder": ("wide", {"width": 3, "unknown": 1}), "head": ("dense", {"classes": 5})})
    assert built["head"].shape == (6, 5)
    assert reg.build_all({"encoder": ("wide", {}), "head": ("dense", {"classes": 5, "encoder_out_width": 1})})["head"].shape == (1, 5)
    with pytest.raises(AttributeError, match="depth"):
        reg.build_all({"encoder": ("wide", {}), "head": ("asks", {})})


def test_source_options_and_the_scene_pipeline(spark):
    o = pipeline.SourceOptions("c", slots=2)
    assert (o.resampling, o.group, o.dtype, o.frequency, o.reducer, o.fallback, o.max_nodata) == ("bilinear", "solar_day", "int16", "scene", "median", False, 0.0)
    for bad in ({"slots": 0}, {"strides": 0}, {"group": "week"}, {"max_nodata": 2.0}):
        with pytest.raises(ValueError):
            pipeline.SourceOptions("c", **bad)
    s = spark.sql("SELECT * FROM VALUES ('a', timestamp_ntz '2020-01-01 23:00:00', 'i', 1.0D), ('a', timestamp_ntz '2020-01-02', 'j', 3.0D), ('a', timestamp_ntz '2020-01-03', 'k', 4.0D) AS t(anchor_id, ts, item_id, value)")
    assert rows(o.steps(s, ["anchor_id"]), "sample", "slot", "value") == [(0, 0, 1.0), (0, 1, 3.0)]
    days = s.select(o.group_of(F.col("ts"), F.col("item_id"), F.lit(30.0)).alias("g")).distinct().count()
    assert days == 2
    scenes = spark.sql("SELECT * FROM VALUES ('a', 'sentinel-2-l1c', timestamp_ntz '2020-01-01', 0.05D, 'x'), ('a', 'sentinel-2-l1c', timestamp_ntz '2020-01-02', 0.5D, 'y'), ('a', 'other', timestamp_ntz '2020-01-01', 0.0D, 'z') AS t(anchor_id, collection, ts, null_share, tile)")
    p = pipeline.ScenePipeline(scenes, ["anchor_id"])
    got = list(p.stream(["anchor_id"], render=lambda df: df.select("anchor_id", F.col("`sentinel-2-l1c`.tile").alias("tile"))))
    assert [(r.anchor_id, r.tile) for r in got] == [("a", "x")] and len(p.options.bands) == 13


def test_layer_types_nodata_and_ranges(spark):
    p = spark.createDataFrame([("a", 1.7), ("a", -40000.0), ("a", float("nan")), ("b", 300.0), ("b", 7.9), ("c", 0.1), ("d", 0.5), ("a", None)], "layer string, value double")
    got = [r.value for r in tiles.cast_layers(p, {"a": "int16", "b": "uint8", "c": "float32"}).collect()]
    assert got == [1.0, None, None, None, 7.0, float(np.float32(0.1)), 0.5, None]
    n = spark.createDataFrame([("a", -1.0), ("a", -1.0), ("b", 1.0), ("b", 2.0), ("c", None)], "layer string, nodata double")
    assert rows(tiles.declared_nodata(n, ["layer"])) == [("a", -1.0), ("b", None), ("c", None)]
    t = spark.sql("SELECT timestamp_ntz '2020-01-01' AS a, timestamp_ntz '2021-01-01' AS b, CAST(NULL AS timestamp_ntz) AS z")
    pair = lambda x, y: (F.col(x), F.col(y))
    pick = lambda *ps: tuple(t.select(*tiles.tile_range(*ps)).first())
    y20, y21 = dt.datetime(2020, 1, 1), dt.datetime(2021, 1, 1)
    assert pick(pair("b", "z"), pair("a", "b"), pair("a", "a")) == (y21, y21)
    assert pick(pair("z", "z"), pair("a", "b"), pair("b", "b")) == (y20, y21)
    assert pick(pair("z", "z"), pair("z", "z"), pair("a", "z")) == (y20, y20)
    with pytest.raises(Exception, match="without a time"):
        pick(pair("z", "z"), pair("z", "z"), pair("z", "z"))


def test_pixels_and_boxes_are_moved_alike(spark):
    n = 8
    steps = ["hflip", ["rot90", ("vflip", 0.5), [("transpose", 0.5)]], ("rot270", 0.3), ("rot180", 0.0)]
    # a box of whole pixels, and the pixels it holds
    df = spark.range(30).select(F.col("id").alias("key"), F.lit((1 + 2.5) / n).alias("cx"), F.lit((2 + 1.0) / n).alias("cy"), F.lit(5 / n).alias("w"), F.lit(2 / n).alias("h"))
    box = df.select("key", *[c.alias(k) for k, c in zip(("cx", "cy", "w", "h"), augment.move_boxes(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), F.col("key"), steps))])
    px = spark.range(30).select(F.col("id").alias("key"), F.explode(F.sequence(F.lit(2), F.lit(3))).alias("y")).withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(5))))
    moved = px.select("key", *[c.alias(k) for k, c in zip("yx", augment.move_pixels(F.col("y"), F.col("x"), F.col("key"), steps, size=n))])
    span = {r.key: (r.x0, r.y0, r.x1 + 1, r.y1 + 1, r.n) for r in moved.groupBy("key").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("n")).collect()}
    kinds = set()
    for r in box.collect():
        want = ((r.cx - r.w / 2) * n, (r.cy - r.h / 2) * n, (r.cx + r.w / 2) * n, (r.cy + r.h / 2) * n)
        assert np.allclose(want, span[r.key][:4]) and span[r.key][4] == 10
        kinds.add(tuple(np.round(want)))
    assert len(kinds) > 3
    # four quarter turns and two flips of each kind change nothing
    same = augment.move_pixels(F.col("y"), F.col("x"), F.col("key"), ["rot90"] * 4 + [["hflip", "hflip"], "rot90", "rot270", "transpose", "transpose"], size=n)
    assert px.where((same[0] != F.col("y")) | (same[1] != F.col("x"))).count() == 0
    for bad in (["spin"], [("hflip", 1.5)]):
        with pytest.raises(ValueError):
            augment.flat(bad)


def png(a):
    h, w, n = a.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + a[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[n], 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def test_samples_in_files_of_any_format(spark, tmp_path):
    a = np.random.default_rng(2).integers(0, 255, (5, 7, 3), dtype=np.uint8)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "one.png").write_bytes(png(a))
    (tmp_path / "two.PNG").write_bytes(png(a[:, :, :1].copy()))
    (tmp_path / "bad.png").write_bytes(b"no picture")
    big = np.random.default_rng(3).normal(0, 1, (2, 37, 50)).astype("float32")
    (tmp_path / "three.tif").write_bytes(tiff.encode(big, tags={"bands": ["x", "y"]}, tile=16))
    (tmp_path / "note.txt").write_text("x")
    listed = rows(images.list_samples(spark, str(tmp_path), georeferenced=False), "sample_id", "kind")
    assert listed == [("bad", "png"), ("one", "png"), ("three", "tif"), ("two", "png")]
    assert rows(images.list_samples(spark, str(tmp_path)), "sample_id") == [("three",)]
    got = {(r.sample_id, r.band, r.y, r.x): r.value for r in images.read_samples(spark, str(tmp_path), georeferenced=False).collect()}
    for i, band in enumerate(("red", "green", "blue")):
        assert all(got["one", band, y, x] == a[y, x, i] for y in range(5) for x in range(7))
    assert all(got["two", "gray", y, x] == a[y, x, 0] for y in range(5) for x in range(7))
    assert all(got["three", "y", y, x] == float(big[1, y, x]) for y in range(37) for x in range(50))
    assert len(got) == 5 * 7 * 4 + 2 * 37 * 50
    assert images.read_samples(spark, str(tmp_path), bands=["x"]).count() == 37 * 50
    with pytest.raises(ValueError):
        tiff.encode(big, tile=20)


def test_one_file_for_each_time_step(spark, tmp_path):
    p = spark.sql("SELECT * FROM VALUES ('a', 'b1', 0, 0, 1.0D, timestamp_ntz '2020-01-01'), ('a', 'b1', 0, 1, 2.0D, timestamp_ntz '2020-01-01 10:30:00'), ('c', 'b1', 1, 1, 3.0D, NULL) AS t(stem, band, y, x, value, ts)")
    got = rows(tiff.write_rasters(p, str(tmp_path), key="stem", height=2, width=2, tile=16, step="ts"), "key")
    assert got == [("a_20200101",), ("a_20200101T103000",), ("c",)]
    a, _ = tiff.decode((tmp_path / "a_20200101T103000.tif").read_bytes())
    assert a.shape == (1, 2, 2) and a[0, 0, 1] == 2.0 and np.isnan(a[0, 0, 0])


def test_anchors_of_many_parts(spark):
    square = lambda x: [[x, 50.0], [x + 0.01, 50.0], [x + 0.01, 50.01], [x, 50.0]]
    multi = {"type": "MultiPolygon", "coordinates": [[square(13.0)], [square(13.05), square(13.051)]]}
    one = anchors.from_request(spark, {"type": "polygon", "polygon": {"type": "Polygon", "coordinates": [square(13.0)]}, "tile_size_px": None}).first()
    both = anchors.from_request(spark, {"type": "polygon", "polygon": multi, "tile_size_px": None}).first()
    assert both.width > 4 * one.width and json.loads(both.coordinates) == multi["coordinates"]
    tiled = anchors.from_request(spark, {"type": "polygon", "polygon": multi, "tile_size_px": 50})
    assert tiled.count() > 3 and anchors.from_request(spark, {"type": "polygon", "polygon": multi, "tile_size_px": 50}, limit=2).count() == 2


def pack_lzw(data):
    """The plainest writer of the codes, to test the reader."""
    bits, out, width = [], bytearray(), 9

    def put(code):
        bits.extend((code >> i) & 1 for i in range(width - 1, -1, -1))

    put(256)
    table, word = {bytes([i]): i for i in range(256)}, b""
    n = 258
    for b in data:
        if word + bytes([b]) in table:
            word += bytes([b])
            continue
        put(table[word])
        table[word + bytes([b])] = n
        n += 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        if n == 4094:
            put(256)
            table, n, width = {bytes([i]): i for i in range(256)}, 258, 9
        word = bytes([b])
    if word:
        put(table[word])
        n += 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    put(257)
    bits.extend([0] * (-len(bits) % 8))
    for i in range(0, len(bits), 8):
        out.append(int("".join(map(str, bits[i : i + 8])), 2))
    return bytes(out)


@pytest.mark.parametrize("size", [0, 1, 7, 300, 20_000])
def test_variable_length_codes(size):
    r = np.random.default_rng(size)
    for data in (r.integers(0, 256, size, dtype=np.uint8).tobytes(), b"ab" * (size // 2), b"\0" * size):
        assert tiff.unpack_lzw(pack_lzw(data)) == data
    with pytest.raises(ValueError):
        tiff.unpack_lzw(b"\0\0\0")


def test_annotations_of_a_split(spark, tmp_path):
    doc = {
        "images": [{"id": 1, "file_name": "a/one.jpg", "width": 100, "height": 50}, {"id": 2, "file_name": "two.png", "width": 10, "height": 10}],
        "annotations": [{"id": 5, "image_id": 1, "category_id": 3, "bbox": [10, 5, 20, 10], "iscrowd": 0}, {"id": 6, "image_id": 9, "category_id": 3, "bbox": [0, 0, 1, 1]}, {"id": 7, "image_id": 1, "category_id": 4, "bbox": [1, 2]}, {"id": 8, "image_id": 1, "category_id": 8, "bbox": [0.0, 0.0, 100, 50]}],
        "categories": [{"id": 3, "name": "house"}],
    }
    (tmp_path / "split.json").write_text(json.dumps(doc, indent=1))
    got = rows(coco.read_annotations(spark, str(tmp_path / "split.json")).where("annotation_id IS NOT NULL"), "sample_id", "annotation_id", "class", "cx", "cy", "sw", "sh")
    assert got == [("one", 5, "house", 0.2, 0.2, 0.2, 0.2), ("one", 8, None, 0.5, 0.5, 1.0, 1.0)]
    assert coco.read_annotations(spark, str(tmp_path / "split.json")).where("annotation_id IS NULL").first().sample_id == "two"
    (tmp_path / "none.json").write_text("{}")
    assert coco.read_annotations(spark, str(tmp_path / "none.json")).collect() == []
