import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import rows
from terrafold.functions.jsonwalk import load_json, number_nodes
from terrafold.operators import nested

VALUES = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text(max_size=3), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(max_size=3), c, max_size=4), max_leaves=20)


@settings(max_examples=80, deadline=None)
@given(VALUES)
def test_intervals_tell_ancestors(value):
    n = number_nodes(value)
    assert [x[0] for x in n] == list(range(len(n))) and sorted(x[1] for x in n) == list(range(len(n)))

    def paths(v, at=()):
        yield at
        kids = v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) and not (v and all(isinstance(x, int) and not isinstance(x, bool) for x in v)) else ()
        for k, c in kids:
            yield from paths(c, (*at, k))

    order = list(paths(value))
    assert len(order) == len(n)
    for i, a in enumerate(order):
        for j, b in enumerate(order):
            under = len(b) > len(a) and b[: len(a)] == a
            assert under == (n[i][0] < n[j][0] and n[i][1] > n[j][1])


def test_deep_nesting_needs_no_stack():
    deep = "[" * 900 + "]" * 900
    ok, v = load_json(deep)
    assert ok and len(number_nodes(v)) == 900


@pytest.mark.parametrize("text", ["", "{", "NaN", '{"a": Infinity}', None, "{'a': 1}", '{"a": 1} x'])
def test_what_is_no_json(text):
    assert load_json(text) == (False, None)


FEATURE = {
    "type": "Feature",
    "properties": {"instruments": ["msi", "aux"]},
    "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [0, 0]]], [[[5, 5], [6, 5], [5, 5]], [[5.1, 5.1], [5.2, 5.1]]]]},
    "assets": {"a.b": {"href": "x", "eo:bands": [{"name": "B1"}, {"name": "B2"}]}, "eo:bands": {"eo:bands": []}, "n": None},
}


def test_children_keep_their_parents(spark):
    lone = {"type": "Feature", "properties": {"instruments": "msi"}, "geometry": {"type": "Point", "coordinates": [1, 2]}, "assets": {}}
    line = {"type": "Feature", "properties": None, "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}}
    bare = {"type": "Feature", "properties": {"instruments": []}, "geometry": None, "assets": None}
    raw = spark.createDataFrame(
        [(1, json.dumps(FEATURE), 9), (2, json.dumps({"type": "FeatureCollection", "features": [lone, 7, line, bare]}), 9), (3, None, 9), (4, "", 9), (5, '{"type": "Feature"', 9), (None, json.dumps(lone), 9), (6, json.dumps(FEATURE), 9), (7, "[]", 9), (8, '{"type": "FeatureCollection", "features": null}', 9)],
        "raw_id long, payload string, pre int",
    )
    got = rows(nested.feature_children(raw), "raw_id", "feature_ord", "child", "parent_path", "child_ord")
    one = [("asset", "a.b", 0), ("asset", "eo:bands", 0), ("asset", "n", 0), ("band", "a.b", 0), ("band", "a.b", 1), ("instrument", "", 0), ("instrument", "", 1)]
    one += [("vertex", "0/0", i) for i in range(3)] + [("vertex", "1/0", i) for i in range(3)] + [("vertex", "1/1", i) for i in range(2)]
    want = [(i, 0, *c) for i in (1, 6) for c in one] + [(2, 0, "instrument", "", 0), (2, 0, "vertex", "0/0", 0), (2, 2, "vertex", "0/0", 0), (2, 2, "vertex", "0/0", 1)]
    assert got == sorted(want)
    assert nested.feature_children(raw.limit(0)).collect() == []


def test_linked_tables_agree_with_the_ordered_pass(spark, data):
    raw = spark.read.parquet(f"{data}/raw_stac.parquet")
    n = nested.label_nodes(raw, key="raw_id", payload="payload", keep=r"^\d+:assets\.")
    linked = nested.link(n.where("depth = 4 AND idx IS NOT NULL AND path LIKE '%.eo:bands[]'"), n.where("depth = 2"))
    every = nested.ancestors(n.where("depth = 4 AND idx IS NOT NULL AND path LIKE '%.eo:bands[]'"), n.where("depth = 2"))
    assert rows(every, "rec", "ord", "pre", "parent_pre") == rows(linked, "rec", "ord", "pre", "parent_pre")
    assert linked.count() == nested.feature_children(raw).where("child = 'band'").count() > 0


def test_any_document_and_numbers_as_nodes(spark):
    raw = spark.createDataFrame([(1, '{"a": {"b": [1, 2]}, "c": null}'), (2, "7"), (3, "x")], "k long, text string")
    n = nested.label_nodes(raw, key="k", payload="text", features=False, vectors=False)
    assert rows(n, "rec", "pre", "post", "path", "type") == [(1, 0, 5, "", "object"), (1, 1, 3, "a", "object"), (1, 2, 2, "a.b", "array"), (1, 3, 0, "a.b[]", "number"), (1, 4, 1, "a.b[]", "number"), (1, 5, 4, "c", "null"), (2, 0, 0, "", "number")]
    inner = nested.ancestors(n.where("path = 'a.b[]'"), n.where("type = 'object'"))
    assert inner.count() == 4
    assert nested.link(n.where("path = 'c'"), n.where("path = 'a'")).collect() == []
