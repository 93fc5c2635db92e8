import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows
from terrafold.llm import splits as sp

SCHEMA = "label_no long, mgrs_tile string, product_uri string, body string, split string, g string, profile string"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.sampled_from(["a:4", "a:1,b:3"]), st.integers(1, 9)), min_size=1, max_size=12, unique_by=lambda b: b[:2]))
def test_allocation_is_whole_and_close(bundles):
    shares = [0.7, 0.15, 0.15]
    plan = sp.allocate_bundles(bundles, shares)
    assert all(sum(p) == n and min(p) >= 0 for p, (_, _, n) in zip(plan, bundles))
    total = sum(s * n for s, _, n in bundles)
    largest = max(s for s, _, _ in bundles)
    for k, share in enumerate(shares):
        assert abs(sum(p[k] * s for p, (s, _, _) in zip(plan, bundles)) - share * total) <= 2 * largest + 1


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([5, 40, 300, 900, 1000]), st.sampled_from(["a:4", "b:4", "a:2,b:2", "c:4"])), min_size=40, max_size=60))
def test_labels_of_large_components_are_balanced_too(comps):
    bundles = [(s, p, comps.count((s, p))) for s, p in sorted(set(comps))]
    shares = [0.6, 0.2, 0.2]
    plan = sp.allocate_bundles(bundles, shares)
    largest = max(s for s, _ in comps)
    for label in "abc":
        rows = [sum(n[k] * size * sp.profile_weights(p).get(label, 0) for n, (size, p, _) in zip(plan, bundles)) for k in range(3)]
        assert all(abs(r - share * sum(rows)) <= 3 * largest for r, share in zip(rows, shares))


def test_rare_profile_of_large_components_goes_by_the_flow():
    assert sp.allocate_bundles([(10, "rare:4", 10), (10, "common:4", 20)], [0.8, 0.1, 0.1]) == [[8, 1, 1], [16, 2, 2]]
    # a third of all rows in one component is placed whole and the rest makes up for it
    plan = sp.allocate_bundles([(100, "a:4", 1), (1, "a:4", 200)], [0.7, 0.15, 0.15])
    assert plan[0] == [1, 0, 0] and plan[1] == [110, 45, 45]


def test_flow_is_of_least_cost():
    arcs = [(0, 1, 4, 0), (1, 2, 2, 1), (1, 3, 9, 3), (2, 3, 9, 0)]
    assert sp.min_cost_flow(4, arcs, 0, 3) == [4, 2, 2, 2]


def label_rows():
    out = []
    for t in range(40):
        for i in range(1 + t % 7):
            out.append((len(out), f"{t % 60 + 1:02d}ABC", None, f"{t % 3} 0.5 0.5 0.1 0.1\nbad line\n\n", "train" if i % 2 else " VALID ", "x", "y"))
    out += [(len(out) + i, "31TPS", None, None, "test", "x", "y") for i in range(150)]
    out += [(900, None, "a/s2a_msil2a_20190101t000000_r001_t31tps_20190101t000000.safe", "", None, "x", "y"), (901, "31 tps ", None, "9 1 1 1 1", "unassigned", "x", "y"), (902, None, None, "", "train", "x", "y")]
    return out


def test_related_rows_stay_together_in_about_the_shares(spark):
    df = spark.createDataFrame(label_rows(), SCHEMA)
    targets = spark.createDataFrame([("train", 0.7), ("val", 0.15), ("test", 0.15), ("none", None)], "split string, target_share double")
    a = sp.assign_splits(df, targets).collect()
    assert len(a) == df.count() and all(r.split for r in a)
    of = {}
    for r in a:
        assert of.setdefault(r.mgrs_tile, r.split) == r.split
    assert {r.label_no for r in a if r.mgrs_tile == "31TPS"} >= {900, 901}
    n = len(a)
    for s, share in (("train", 0.7), ("val", 0.15), ("test", 0.15)):
        assert abs(sum(r.split == s for r in a) / n - share) < 0.02
    g = sp.tile_splits(df, targets)
    mixed = rows(g.where(F.size("old_splits") >= 2), "g")
    assert ("02ABC",) in mixed and ("01ABC",) not in mixed
    assert rows(sp.assign_splits(df, targets)) == rows(sp.assign_splits(df.repartition(7), targets))


def test_empty_and_senseless_targets(spark):
    df = spark.createDataFrame(label_rows()[:3], SCHEMA)
    targets = spark.createDataFrame([("train", 1.0)], "split string, target_share double")
    assert sp.assign_splits(df.limit(0), targets).collect() == []
    assert {r.split for r in sp.assign_splits(df, targets).collect()} == {"train"}
    with pytest.raises(ValueError):
        sp.tile_splits(df, targets.limit(0))
