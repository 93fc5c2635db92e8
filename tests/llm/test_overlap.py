import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import rows
from terrafold.llm import overlap as ov

SCHEMA = "key long, split string, start timestamp_ntz, w double, s double, e double, n double, rep string, band string"


def brute(data):
    out = []
    for a in data:
        for b in data:
            if a[1] == "train" and b[1] in ("val", "test") and None not in a[:7] and None not in b[:7]:
                shared = max(0, min(a[5], b[5]) - max(a[3], b[3])) * max(0, min(a[6], b[6]) - max(a[4], b[4]))
                area = lambda r: (r[5] - r[3]) * (r[6] - r[4])
                if shared and shared / (area(a) + area(b) - shared) >= 0.8 and abs(a[2] - b[2]) <= dt.timedelta(hours=24):
                    out.append((min(a[0], b[0]), max(a[0], b[0])))
    return sorted(out)


def pairs(spark, data, **kw):
    p, m = ov.cross_split_pairs(spark.createDataFrame(data, SCHEMA), **kw)
    m1, m2 = m.select(F.col("rep").alias("rep_train"), F.col("key").alias("a")), m.select(F.col("rep").alias("rep_eval"), F.col("key").alias("b"))
    return rows(p.join(m1, "rep_train").join(m2, "rep_eval").select(F.least("a", "b"), F.greatest("a", "b")))


def test_near_and_exact_copies_match_brute_force(spark):
    rng = np.random.default_rng(3)
    data, t0 = [], dt.datetime(2020, 1, 9, 0, 0)
    for i in range(120):
        x, y = rng.uniform(-170, 170), rng.uniform(-60, 60)
        w, h = rng.uniform(0.01, 0.13), rng.uniform(0.01, 0.05)
        t = t0 + dt.timedelta(hours=float(rng.uniform(0, 900)))
        data.append((len(data), "train", t, x, y, x + w, y + h, "r", "b"))
        for split in ("val", "test"):
            d = rng.uniform(0, 0.13)
            t2 = t + dt.timedelta(hours=float(rng.choice([-24, 0, 24, 24.01, -5])))
            data.append((len(data), split, t2, x + d * w, y, x + w + d * w * rng.uniform(0, 1), y + h, "r", "b"))
    data += [(1000 + i, s, t0, 5.0, 5.0, 6.0, 6.0, "r", "b") for i, s in enumerate(["train", "train", "val", "val", "test"])]
    want = brute(data)
    assert len(want) > 60
    assert pairs(spark, data) == want
    assert pairs(spark, data, rows_per_salt=1) == want


def bands_meet(a, b, probe=(False, True)):
    found = []
    for box, p in zip((a, b), probe):
        _, _, _, keys = ov.box_bands(*[np.array([v]) for v in box], np.array([p]), bands=28, rows=4, similarity=0.8)
        found.append({(i, k) for line in keys.tolist() for i, k in enumerate(line)})
    return bool(found[0] & found[1])


def test_bands_find_the_worst_shapes_and_spare_the_unlike():
    rng = np.random.default_rng(11)
    found = {0.8: 0, 0.3: 0}
    n = 400
    for likeness in found:
        for i in range(n):
            x, y = rng.uniform(-170, 170), rng.uniform(-60, 60)
            # sides at and near the least number of cells, and anywhere else
            w, h = (float(ov.CELLS * 2.0**-14 * rng.choice([1.0, 1.001, 1.24, 1.26, 1.999])) if i % 2 else rng.uniform(0.01, 1.3) for _ in "wh")
            kind = i % 4
            if kind == 0:  # shifted along one side
                d = w * (1 - likeness) / (1 + likeness)
                other = (x + d, y, x + w + d, y + h)
            elif kind == 1:  # shifted along both
                z = 1 - (2 * likeness / (1 + likeness)) ** 0.5
                other = (x + z * w, y + z * h, x + w + z * w, y + h + z * h)
            elif kind == 2:  # inside the other
                z = likeness**0.5
                other = (x, y, x + z * w, y + z * h)
            else:  # a wide and a tall one
                z = (1 / likeness - 1) / 2
                other = (x, y, x + w, y + h + z * h)
                w += z * w
            found[likeness] += bands_meet((x, y, x + w, y + h), other)
    assert found[0.8] == n
    assert found[0.3] < 0.2 * n


def test_nulls_points_and_empty(spark):
    t = dt.datetime(2020, 1, 1)
    box = (1.0, 1.0, 2.0, 2.0, "r", "b")
    data = [(1, "train", t, *box), (2, "val", None, *box), (3, None, t, *box), (4, "val", t, None, 1.0, 2.0, 2.0, "r", "b"), (5, "val", t, 1.0, 1.0, 1.0, 2.0, "r", "b"), (6, "val", t, 2.0, 1.0, 1.0, 2.0, "r", "b"), (None, "test", t, *box), (7, "test", t, *box)]
    assert pairs(spark, data) == [(1, 7)]
    assert pairs(spark, data[:1]) == []


def test_report_counts_samples_without_expanding_copies(spark):
    samples = spark.createDataFrame(
        [(1, "Train", " A", ["2020-01-01"], [0.0, 0.0, 1.0, 1.0]), (2, "trn", "b", ["20200101T000000"], [0.0, 0.0, 1.0, 1.0]), (3, "valid", "A ", ["2020-01-01T23:00:00-01:00", "x"], [0.0, 0.0, 1.0, 0.9]), (4, "val", None, [], None), (5, "test", "a", None, [0.0, 0.0, 1.0, 1.0]), (6, "testing", "a", ["2020-01-01"], [0.0, 0.0, 1.0])],
        "sample_no long, split string, sample_source string, geotag_datetime array<string>, bbox array<double>",
    )
    assert rows(ov.leaked_pairs(samples)) == rows(ov.leaked_pairs(samples, rows_per_salt=1)) == [(1, 3), (2, 3)]
    assert sorted(map(tuple, ov.leak_report(samples).collect()), key=str) == [("test", "a", 2, 0, 0), ("val", "a", 1, 1, 2), ("val", None, 1, 0, 0)]
