import json

import pytest

from tests.conftest import rows
from terrafold.operators import drift

SCHEMA = "raw_id long, feed string, file_name string, file_seq int, payload string, types int, path string"


def f(props=None, **members):
    return json.dumps({"type": "Feature", "properties": props or {}, **members})


def frame(spark, entries):
    return spark.createDataFrame([(i, *e, 1, "clash") for i, e in enumerate(entries)], SCHEMA)


def test_changes_by_file(spark):
    both = json.dumps({"type": "FeatureCollection", "features": [json.loads(f({"a": 1})), json.loads(f({"a": "x", "b": None}))]})
    raw = frame(
        spark,
        [
            ("f", "f/1", 1, f({"a": 1, "eo:cloud_cover": 3.5})), ("f", "f/1", 1, f({"a": 1, "eo:cloud_cover": 3.5})), ("f", "f/2", 2, both), ("f", "f/2", 2, f({"eo:cloudCover": 4})), ("f", "f/3", 3, "{broken"), ("f", "f/3", 3, None),
            (None, "g/1", 1, f({"b": True})), (None, "g/2", 5, f({"b": 1.5}, extra=[1])), ("h", "h/1", 1, f({"z": 1})), ("f", None, 4, f({})), ("f", "f/4", None, f({})),
        ],
    )
    want = [
        ("f/2", "properties.a", "type"), ("f/2", "properties.eo:cloudCover", "added"), ("f/2", "properties.eo:cloud_cover", "removed"),
        ("f/3", "properties", "removed"), ("f/3", "properties.a", "removed"), ("f/3", "properties.eo:cloudCover", "removed"), ("f/3", "type", "removed"),
        ("g/2", "extra", "added"), ("g/2", "properties.b", "type"),
    ]
    assert rows(drift.found_changes(raw)) == sorted(want)
    named = rows(drift.schema_changes(raw).where("change IN ('renamed', 'moved')"), "change", "old_path", "new_path")
    assert named == [("renamed", '["properties", "eo:cloud_cover"]', '["properties", "eo:cloudCover"]')]
    assert drift.found_changes(raw.limit(0)).collect() == []


def test_flooding_pairs_names_and_prefers_the_same_parent():
    old = {("p",): ["object"], ("p", "eo:cloud_cover"): ["number"], ("p", "tile"): ["string"], ("q",): ["object"]}
    new = {("p",): ["object"], ("p", "cloudCover"): ["number"], ("p", "zone"): ["string"], ("q",): ["object"]}
    got = {(a, b) for a, b, _ in drift.flood(old, new)}
    assert (("p", "eo:cloud_cover"), ("p", "cloudCover")) in got
    assert (("p", "tile"), ("p", "zone")) not in got
    assert drift.flood({}, new) == [] and drift.flood(old, {}) == []


def test_flooding_takes_only_what_can_be_cast_and_carries_structure():
    pair = lambda x, kx, y, ky: {(a, b) for a, b, _ in drift.flood({("p",): ["object"], ("p", x): kx}, {("p",): ["object"], ("p", y): ky}) if a != b}
    assert pair("cloud_cover", ["number"], "eo:cloud_cover", ["object"]) == set()
    assert pair("proj:shape", ["array"], "shape", ["boolean"]) == set()
    assert len(pair("cloud_cover", ["number"], "eo:cloud_cover", ["string"])) == 1
    wrapped = drift.flood({("cloud_cover",): ["number"]}, {("eo:cloud_cover",): ["object"], ("eo:cloud_cover", "value"): ["number"]})
    assert [(a, b) for a, b, _ in wrapped] == [(("cloud_cover",), ("eo:cloud_cover",))]
    old = {("view",): ["object"], ("view", "azimuth"): ["number"], ("view", "off_nadir"): ["number"]}
    new = {("acq",): ["object"], ("acq", "azimuth"): ["number"], ("acq", "off_nadir"): ["number"]}
    assert {(a[-1], b[-1]) for a, b, _ in drift.flood(old, new)} == {("view", "acq"), ("azimuth", "azimuth"), ("off_nadir", "off_nadir")}
    # one partner each, the best for both
    got = drift.flood({("cloud_cover",): ["number"], ("cloud_cover_b",): ["number"]}, {("eo:cloud_cover",): ["number"]})
    assert [(a, b) for a, b, _ in got] == [(("cloud_cover",), ("eo:cloud_cover",))]


def test_changes_at_any_depth(spark):
    band = lambda name: {"B1": {"href": "x", "eo:bands": [{name: "b", "gsd": 1}, 5]}}
    raw = frame(spark, [("f", "1", 1, f(assets=band("common_name"), view={"azimuth": 1, "off_nadir": 2})), ("f", "2", 2, f(assets=band("commonName"), acq={"azimuth": 1, "off_nadir": 2})), ("f", "3", 3, f(assets={}, acq=None))])
    got = rows(drift.schema_changes(raw), "file_name", "change", "old_path", "new_path")
    b = '["assets", "B1", "eo:bands", "[]", "{}"]'
    assert got == [("2", "renamed", b.replace("{}", "common_name"), b.replace("{}", "commonName")), ("2", "renamed", '["view"]', '["acq"]'), ("3", "removed", '["acq"]', None), ("3", "removed", '["assets", "B1"]', None)]
    assert rows(drift.found_changes(raw)) == [("2", "acq", "added"), ("2", "view", "removed"), ("3", "acq", "removed")]
    with pytest.raises(ValueError, match="more than 2 distinct"):
        drift.unified_table(raw, max_fields=2)


def test_unified_table_casts_and_keeps_what_it_cannot(spark):
    raw = frame(
        spark,
        [
            ("f", "1", 1, f({"eo:cloud_cover": 3.5, "n": True})), ("f", "1", 1, f({"eo:cloud_cover": 1, "n": False})), ("f", "2", 2, f({"eo:cloudCover": {"value": 7, "unit": "percent"}, "n": True})),
            ("f", "3", 3, f({"eo:cloud_cover": "45.5 %", "n": "maybe"})), ("f", "3", 3, "broken"),
        ],
    )
    u = drift.unified_table(raw)
    assert "properties__eo_cloudcover" not in u.columns
    got = [(r.raw_id, r.properties__eo_cloud_cover, r.properties__n) for r in u.orderBy("raw_id").collect()]
    assert got == [(0, 3.5, True), (1, 1.0, False), (2, 7.0, True), (3, 45.5, None)]
    assert json.loads(u.where("raw_id = 3").first().uncast) == {"properties.n": "maybe"}
    assert drift.unified_table(raw.limit(0)).collect() == []
