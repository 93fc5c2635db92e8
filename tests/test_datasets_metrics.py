import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from terrafold.operators import catalog, datasets, metrics, ranking, tiles
from terrafold.sources import sensors


def ds(spark, keys, col):
    return spark.createDataFrame([(k, i) for i, k in enumerate(keys)], f"sample_id string, {col} int")


def test_intersections_and_collisions(spark):
    a, b = ds(spark, "ab", "x"), ds(spark, "bc", "y")
    assert rows(datasets.intersection([a, b])) == [("b", 1, 0)]
    assert rows(datasets.dropped_keys([a, b])) == [("a", 1), ("c", 1)]
    with pytest.raises(ValueError, match="collide"):
        datasets.intersection([a, a])
    with pytest.raises(ValueError):
        datasets.intersection([a])


def test_split_lists(spark):
    a = ds(spark, "abb", "x")
    wanted = spark.createDataFrame([("b",), ("b",), ("z",), (None,)], "sample_id string")
    assert rows(datasets.keep_split(a, wanted, "sample_id")) == [("b", 1), ("b", 2)]
    assert rows(datasets.missing_keys(a, wanted, "sample_id")) == [("z",)]
    assert datasets.keep_split(a, None, "sample_id").count() == 3


def test_groups_batches_numbers(spark):
    df = spark.createDataFrame([(1, "a", 1.0, "cat"), (2, "a", 2.0, "dog"), (3, "b", None, None), (4, None, 1.0, "x")], "ord int, id string, score double, label string")
    g = datasets.grouped_table(df, "id", ["score", "label"], "ord").orderBy("sample_id").collect()
    assert [(r.sample_id, r.n_rows, r.score, r.label) for r in g] == [("a", 2, [1.0, 2.0], ["cat", "dog"]), ("b", 1, [None], [None])]
    with pytest.raises(ValueError):
        datasets.grouped_table(df, "id", ["nope"], "ord")
    n = datasets.numbered(spark.range(101).repartition(7), ["id"])
    assert all(r.id == r.ord for r in n.collect())
    b = datasets.batches(spark.range(10), 4, ["id"], ["id"]).orderBy("batch_id").collect()
    assert [r.id for r in b] == [[0, 1, 2, 3], [4, 5, 6, 7]]
    assert datasets.batches(spark.range(10), 4, ["id"], ["id"], drop_last=False).count() == 3
    with pytest.raises(ValueError):
        datasets.manifest(df, ["sample_id"], "id")
    layers = spark.createDataFrame([(["a", "b"],), (["a"],), (None,)], "l array<string>")
    assert layers.where(datasets.has_layers(F.col("l"), ["a", "b"])).count() == 1


def test_metrics_match_direct_counts(spark):
    rng = np.random.default_rng(2)
    label, pred, p = rng.integers(0, 4, 300), rng.integers(0, 4, 300), rng.random(300).round(2)
    df = spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(label, pred, p)] + [(None, 1, 0.5), (255, 1, 0.5)], "label int, pred int, p double")
    conf = metrics.confusion(df, ignore_index=255)
    per = {r["class"]: r for r in metrics.class_metrics(conf).collect()}
    for c in range(4):
        tp, fp, fn = ((label == c) & (pred == c)).sum(), ((label != c) & (pred == c)).sum(), ((label == c) & (pred != c)).sum()
        assert abs(per[c].f1 - 2 * tp / (2 * tp + fp + fn)) < 1e-12 and abs(per[c].iou - tp / (tp + fp + fn)) < 1e-12
    s = {(r.metric, r["mode"]): r.value for r in metrics.summary_metrics(conf).collect()}
    assert abs(s["accuracy", "micro"] - (label == pred).mean()) < 1e-12
    po, pe = (label == pred).mean(), sum((label == c).mean() * (pred == c).mean() for c in range(4))
    assert abs(metrics.agreement(conf).first().kappa - (po - pe) / (1 - pe)) < 1e-9

    def macro(c, t):
        shown = (pred != c) | (p >= t)
        out = []
        for k in range(4):
            tp = (shown & (label == k) & (pred == k)).sum()
            wrong = (shown & (label != k) & (pred == k)).sum() + ((label == k) & ~(shown & (pred == k))).sum()
            out.append(2 * tp / (2 * tp + wrong) if tp + wrong else 0)
        return round(float(np.mean(out)), 12)

    grid = [i / 20 for i in range(21)]
    got = {r["class"]: r for r in metrics.threshold_sweep(df.where("label < 4"), n_classes=4, candidates=grid).collect()}
    for c in range(4):
        best = max(macro(c, t) for t in grid)
        assert got[c].score == best and got[c].threshold == min(t for t in grid if macro(c, t) == best)
    sc = df.where("label < 4").select(F.lit(0).alias("class"), F.col("p").alias("score"), (F.col("label") == 0).alias("positive"))
    pos, neg = p[label == 0], p[label != 0]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert abs(metrics.auroc(sc).first().auroc - want) < 1e-9


def test_metric_names_and_hard_examples(spark):
    assert metrics.parse_metric("f1.macro.per_class") == ("f1", ("macro", "per_class"))
    assert metrics.parse_metric("mcc") == ("mcc", ())
    for bad in ("f2", "f1.best", "mcc.macro", "accuracy.per_class"):
        with pytest.raises(ValueError):
            metrics.parse_metric(bad)
    df = spark.createDataFrame([(i / 10,) for i in range(10)] + [(None,)], "p double")
    assert metrics.hard_examples(df, p_true="p", min_kept=3, thresh=0.0).count() == 3
    assert metrics.hard_examples(df, p_true="p", min_kept=3, thresh=0.5).count() == 6
    assert metrics.hard_examples(df, p_true="p", min_kept=0, thresh=0.0).count() == 10 == metrics.hard_examples(df, p_true="p", min_kept=99, thresh=0.0).count()


def test_searches(spark):
    items = spark.createDataFrame([(1, "a", "s2", 5.0, [170.0, 0.0, -170.0, 1.0]), (2, "b", "s2", 50.0, [0.0, 0.0, 1.0, 1.0]), (3, "c", "ls", None, None)], "n int, item_id string, collection string, cloud double, bbox array<double>")
    go = lambda **k: rows(catalog.search(items, catalog.Search(**k), properties={"eo:cloud_cover": "cloud"}, tie="n").select("n"))
    assert go(collections=("s2",)) == [(1,), (2,)] and go(ids=("c",)) == [(3,)]
    assert go(bbox=(175.0, 0.0, -175.0, 1.0)) == [(1,)] and go(bbox=(-1.0, -1.0, 0.0, 0.5)) == [(2,)]
    assert go(filter="eo:cloud_cover <= 10 or item_id = 'c'") == [(1,), (3,)]
    assert go(sortby=("-eo:cloud_cover",), max_items=1) == [(2,)]
    q = catalog.Search().with_filter("x = 1").with_filter("y = 2").with_sortby("-a", {"field": "b", "direction": "desc"}, ["c", "+d"])
    assert q.filter == "y = 2" and q.sortby == ("-a", "-b", "c", "+d")
    assert catalog.filter_expression("a:b between 1 and 'o''c'", {"a:b": "c"}) == "`c` BETWEEN 1 AND 'o\\'c'"
    for bad in ("nope = 1", "a; drop", "a = ?"):
        with pytest.raises(ValueError):
            catalog.filter_expression(bad, {"a": "a"})
    with pytest.raises(ValueError):
        catalog.parse_sort("-")
    with pytest.raises(ValueError):
        catalog.require_collection(items, "nope")
    old, new = items.where("n = 1").select("collection", "item_id"), items.select("collection", "item_id")
    assert rows(catalog.append_items(old, new.unionAll(new), ["collection"])) == sorted([("s2", "a")] + [("s2", "b"), ("ls", "c")] * 2)


def test_sensor_tables(spark):
    got = sensors.lookup(spark, "sentinel-2-l2a", ["nir", "rededge1"]).collect()
    assert [(r.band, r.gsd, r["mean"]) for r in got] == [("nir", 10.0, 2743.0), ("rededge1", 20.0, 1887.0)]
    for bad in (("nope", None), ("naip", ["swir"])):
        with pytest.raises(ValueError):
            sensors.lookup(spark, *bad)
    p = spark.createDataFrame([("vv", -12.113), ("x", 1.0), ("vh", None)], "band string, value double")
    assert sorted(map(str, sensors.normalize(p, sensors.bands(spark).where("sensor = 'sentinel-1-rtc'")).select("value").collect())) == ["Row(value=0.0)", "Row(value=1.0)", "Row(value=None)"]


def test_exact_percentiles_of_any_values(spark):
    rng = np.random.default_rng(8)
    data = {"a": rng.normal(0, 1e4, 501).tolist(), "b": [3.0] * 7, "c": rng.integers(-3, 3, 60).astype(float).tolist(), "d": [0.25]}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs] + [("a", None), ("e", None), ("a", float("nan"))], "g string, value double")
    got = ranking.exact_percentiles(df, ["g"], "value", [0.02, 0.5, 1.0], ["p", "q", "r"])
    assert sorted(got.columns) == ["g", "p", "q", "r"]
    for r in got.collect():
        assert np.allclose([r.p, r.q, r.r], np.quantile(data[r.g], [0.02, 0.5, 1.0]))
    assert got.count() == 4
    flat = tiles.stretch_limits(df.where("g IN ('b', 'd')"), ["g"])
    assert rows(flat) == [("b", 3.0, 3.0), ("d", 0.25, 0.25)]


def test_blocks_of_a_large_key(spark):
    df = spark.createDataFrame([(1, "x", i) for i in range(10)] + [(2, "y", 0), (None, "z", 1)], "k int, v string, o int")
    g = datasets.grouped_blocks(df, "k", ["v"], "o", size=4)
    assert rows(g, "sample_id", "block", "n_rows") == [("1", 0, 4), ("1", 1, 4), ("1", 2, 2), ("2", 0, 1)]
