from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows
from terrafold.llm import survivors as sv


def test_tokens_alignment_and_vote():
    assert sv.tokens("S2A_02.07 é") == ["S", "2", "A", "_", "02", ".", "07", " ", "é"]
    assert sv.tokens('["a,b","c\\"]"]') == ["[", '"a,b"', ",", '"c\\"]"', "]"] and sv.tokens('["a') == ["[", '"', "a"]
    items = [([{t: w} for t in sv.tokens(s)], w) for s, w in (("a-b-c", 2.0), ("a-c", 1.0), ("a-b-d", 1.5))]
    p, w = sv.progressive(items)
    assert w == 4.5 and sv.vote(p) == ["a", "-", "b", "-", "c"]
    assert sv.progressive(items[::-1]) == (p, w)
    assert sv.edits(list("kitten"), list("sitting")) == 3


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text("ab-1", max_size=8), min_size=1, max_size=6))
def test_every_column_holds_the_whole_weight(texts):
    items = [([{t: 1.0} for t in sv.tokens(s)], 1.0) for s in texts]
    p, w = sv.progressive(items)
    assert w == len(texts) and all(abs(sum(c.values()) - w) < 1e-9 for c in p)


def plain_align(a, wa, b, wb):
    """The whole table of an alignment, nothing trimmed."""
    cost = lambda x, y: 1 - sum(w * y.get(t, 0) for t, w in x.items()) / (wa * wb)
    best = {(0, 0): 0.0}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            ways = [best[i - 1, j - 1] + cost(a[i - 1], b[j - 1])] if i and j else []
            ways += [best[i - 1, j] + cost(a[i - 1], {"": wb})] if i else []
            ways += [best[i, j - 1] + cost({"": wa}, b[j - 1])] if j else []
            if ways:
                best[i, j] = min(ways)
    return best[len(a), len(b)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab-1 ", max_size=9), min_size=2, max_size=5), st.one_of(st.text("ab-1 ", max_size=9), st.text("ab-1 ", min_size=60, max_size=70)))
def test_alignments_cost_no_more_than_the_whole_table(texts, last):
    p, wa = sv.progressive([([{t: 1.0} for t in sv.tokens(s)], 1.0) for s in texts])
    q, wb = [{t: 2.0} for t in sv.tokens(last)], 2.0
    cost = lambda x, y: 1 - sum(w * y.get(t, 0) for t, w in x.items()) / (wa * wb)
    i = j = 0
    spent = 0.0
    for u, v in sv._steps(p, wa, q, wb):
        spent += cost(p[i] if u else {"": wa}, q[j] if v else {"": wb})
        i, j = i + u, j + v
    assert (i, j) == (len(p), len(q)) and abs(spent - plain_align(p, wa, q, wb)) < 1e-6


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text("ab-1", max_size=7), st.integers(1, 4), min_size=1, max_size=6))
def test_a_majority_needs_no_alignment(weights):
    profile, _ = sv.progressive([([{t: float(w)} for t in sv.tokens(v)], float(w)) for v, w in weights.items()])
    won = sv.vote(profile)
    assert sv.consensus(weights) == min(weights, key=lambda v: (sv.edits(sv.tokens(v), won), -weights[v], v))


def test_long_values_are_compared_whole():
    import random

    r = random.Random(5)
    a = [r.choice("abcd") for _ in range(700)]
    b = a[:100] + ["x"] * 90 + a[100:350] + a[420:]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    assert sv.edits(a, b) == row[-1] and sv.edits(b, a) == row[-1] and sv.edits(a, ["q"] * 3) == 700
    words = [f"w{i}" for i in range(8000)]
    long = {" ".join(words): 1.0, " ".join(["new", *words[50:], "end"]): 1.0, " ".join(words[:4000] + words[4100:]): 1.0}
    assert sv.consensus(long) in long


def test_large_groups_give_the_same_as_small_ones(spark):
    data = [(i, f"g{i % 3}", i % 4, None if i % 5 else i % 7, f"a {i % 6} b" if i % 2 else f"a {i % 3} c") for i in range(90)]
    df = spark.createDataFrame(data, "k int, sig string, base int, gen int, value string")
    get = lambda n: rows(sv.survivors(df, group=F.col("sig"), key=F.col("k"), trust=[F.col("base"), F.col("gen")], fields={"value": F.col("value")}, block_size=n))
    assert get(128) == get(20) and len(get(20)) == 3


def test_consensus_picks_an_existing_value_in_blocks_too(spark):
    votes = [("g", "c", f"red {i} fox", 1.0) for i in range(40)] + [("g", "c", "red 7 fox", 3.0), ("g", "c", "blue", 1.0), ("g", "d", None, 1.0), (None, "c", "x", 1.0), ("h", "c", "one", 1.0), ("h", "c", "one", 1.0), ("k", "c", "", 1.0), ("k", "c", "z" * 50_000, 0.5), ("k", "c", "zero", 0.0)]
    df = spark.createDataFrame(votes, "g string, col string, value string, w double")
    want = [("g", "c", "red 7 fox"), ("h", "c", "one"), ("k", "c", "")]
    assert rows(sv.consensus_values(df)) == want
    assert rows(sv.consensus_values(df, block_size=4)) == want
    assert sv.consensus_values(df.limit(0)).collect() == []


def test_survivor_rule_with_ties_nulls_and_clashing_names(spark):
    df = spark.createDataFrame(
        [(5, "a", 1, None, "x"), (3, "a", 1, None, "x"), (1, "a", None, 9, "y"), (2, "b", 4, 1, None), (7, "b", 4, 2, None), (8, None, 1, 1, "q"), (9, "c", None, None, None), (9, "c", None, None, None)],
        "k int, sig string, base int, gen int, value string",
    )
    got = sv.survivors(df, group=F.col("sig"), key=F.col("k"), trust=[F.col("base"), F.col("gen")], fields={"value": F.col("value")})
    assert rows(got, "g", "n_records", "first_key", "survivor_key", "value") == [("a", 3, 1, 3, "x"), ("b", 2, 2, 7, None), ("c", 2, 9, 9, None)]
    assert sv.survivors(df.limit(0), group=F.col("sig"), key=F.col("k"), trust=[F.col("base")]).collect() == []


def test_items_with_every_spelling(spark):
    df = spark.createDataFrame(
        [
            (1, "S2B_MSIL2A_20190224T225640_R037_T37UHU_20190225T085833", None, "37UHU", 2.0, "03.01", None),
            (2, "S2B_37UHU_x", "s3://a/s2b_msil2a_20190224t225640_n0301_r037_t37uhu_20190225t085834.safe/", None, None, None, None),
            (3, None, "S2B_MSIL2A_20190224T225640_N0300_R037_T37UHU_20200101T000000.SAFE", "T37UHU", 2.0, "09.99", None),
            (4, "nothing", None, None, None, None, None),
        ],
        "rec_id long, item_id string, product_uri string, mgrs_tile string, cloud_cover double, processing_baseline string, generation_time timestamp_ntz",
    )
    for c in ("platform", "stac_version"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    df = df.withColumn("relative_orbit", F.lit(None).cast("int"))
    got = sv.item_survivors(df).collect()
    assert [(r.g, r.n_records, r.first_key, r.survivor_key, r.mgrs_tile) for r in got] == [("S2B_2A_20190224T225640_37UHU", 3, 1, 2, "37UHU")]


def test_survivors_have_every_field_of_the_items(spark):
    uri = "S2B_MSIL2A_20190224T225640_N030{}_R037_T37UHU_20190225T085833"
    t = "timestamp_ntz '2019-02-24 22:56:40'"
    df = spark.sql(f"""SELECT * FROM VALUES
        (1L, '{uri.format(1)}', 'c', {t}, 'Sentinel-2B', '37UHU', 2.0D, '{uri.format(1)}', '03.01', {t}, 37, '1.0.0', array('eo', 'sat'), array('msi'), array(1.5D, 2.0D, 3.0D, 4.0D), 'north', {t}),
        (2L, '{uri.format(1)}', 'c', {t}, NULL, NULL, NULL, '{uri.format(1)}', NULL, NULL, 37, NULL, array('eo', 'sat'), NULL, NULL, 'north', {t}),
        (3L, '{uri.format(2)}', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, array('eo'), NULL, NULL, 'mirror', NULL)
        AS t(rec_id, item_id, collection, ts, platform, mgrs_tile, cloud_cover, product_uri, processing_baseline, generation_time, relative_orbit, stac_version, stac_extensions, instruments, bbox, catalog, ingested_at)""")
    got = sv.item_survivors(df)
    assert set(df.columns) - {"rec_id"} <= set(got.columns)
    (r,) = got.collect()
    assert (r.item_id, r.collection, r.ts, r.stac_extensions) == (uri.format(1), "c", "2019-02-24 22:56:40", '["eo","sat"]')
    assert (r.instruments, r.bbox, r.catalog, r.ingested_at, r.stac_version) == ('["msi"]', "[1.5,2.0,3.0,4.0]", "north", "2019-02-24 22:56:40", "1.0.0")
