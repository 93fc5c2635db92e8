import os

import pytest

from tests.conftest import rows
from terrafold.llm import mixing as mx
from terrafold.llm import tokenizers as tk

SCHEMA = "doc_id long, source string, text string, cells array<struct<cell_no:int,cell_type:string,exec_count:int,char_start:int,char_len:int>>, key double, upto int"


def docs(spark):
    out = [(i, " Big" if i % 2 else "BIG", "word " * (5 + i % 11), None, 1.0, 1) for i in range(300)]
    out += [(1000 + i, "small", "text " * 20, [(1, "code", 1, 0, 50), (2, "output", 1, 50, 50)], 1.0, 1) for i in range(20)]
    out += [(2000, None, "lost", None, 1.0, 1), (2001, "other", "lost", None, 1.0, 1), (2002, "small", None, None, 1.0, 1), (2003, "small", "", [], 1.0, 1), (None, "small", "x", None, 1.0, 1)]
    return spark.createDataFrame(out, SCHEMA)


def test_shares_caps_and_epochs(spark):
    targets = spark.createDataFrame([("big", 0.5, 1), ("SMALL ", 0.5, 3), ("gone", None, 2), (None, 0.3, 1)], "source string, target_share double, max_repeats int")
    got = mx.mixture(docs(spark), targets, tokenizer=None).collect()
    total = {s: sum(r.n_tokens * r.copies for r in got if r.source == s) for s in ("big", "small")}
    assert abs(total["big"] / sum(total.values()) - 0.5) < 0.01
    assert {r.copies for r in got if r.source == "big"} == {1} and {r.copies for r in got if r.source == "small"} == {3}
    assert len({r.doc_id for r in got}) == len(got) and not {2000, 2001, 2002, 2003} & {r.doc_id for r in got}
    assert sorted(got) == sorted(mx.mixture(docs(spark).repartition(5), targets, tokenizer=None).collect())
    fine = mx.mixture(docs(spark), targets, tokenizer=None, cells_per_octave=1).collect()
    assert sorted(fine) == sorted(got)


def test_total_and_brute_force(spark):
    targets = spark.createDataFrame([("big", 0.25, 1), ("small", 0.75, 4)], "source string, target_share double, max_repeats int")
    got = mx.mixture(docs(spark), targets, tokenizer=None, total_tokens=4000).collect()
    small = [r for r in got if r.source == "small"]
    assert {r.copies for r in small} <= {1, 2} and len(small) == 20  # one whole epoch of 2000, half of another
    assert abs(sum(r.n_tokens * r.copies for r in small) - 3000) <= 50
    report = {r.source: r for r in mx.mixture_report(docs(spark), targets, tokenizer=None, total_tokens=4000).collect()}
    assert report["big"].n_docs == sum(r.source == "big" for r in got)
    assert abs(report["small"].actual_share - 0.75) < 0.02


def test_empty(spark):
    targets = spark.createDataFrame([("big", 0.25, 1)], "source string, target_share double, max_repeats int")
    assert mx.mixture(docs(spark).limit(0), targets, tokenizer=None).collect() == []
    assert mx.mixture(docs(spark), targets.limit(0), tokenizer=None).collect() == []
    assert mx.budgets({"a": 10}, {"a": (0.5, 1), "b": (0.5, 2)}) == {"a": (0, 0, 0), "b": (0, 0, 0)}


def test_heavier_documents_come_first_more_often(spark):
    from pyspark.sql import functions as F

    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("abcde").alias("text"))
    targets = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    got = mx.mixture(d, targets, tokenizer=None, weight=F.when(F.col("doc_id") < 2000, 4.0).otherwise(1.0), total_tokens=5000)
    n = got.where("doc_id < 2000").count()
    # P(heavy in the smallest quarter): the heavy ones are drawn about 3.5 times as often
    assert got.count() == 1000 and 700 < n < 850


@pytest.mark.skipif(not os.path.exists(tk.vocabulary()), reason="no vocabulary file")
def test_public_tokenizer_counts():
    path = tk.vocabulary()
    text = "naïve tokens 🙂 of <|endoftext|> text"
    assert sum(tk.token_lengths(path, text)) == len(text.encode())
    assert tk.count_tokens(path, text) == len(tk.token_lengths(path, text)) < len(text)


def test_a_source_without_documents_leaves_the_others(spark):
    targets = spark.createDataFrame([("big", 0.4, 1), ("small", 0.4, 3), ("absent", 0.2, 2)], "source string, target_share double, max_repeats int")
    report = {r.source: r for r in mx.mixture_report(docs(spark), targets, tokenizer=None).collect()}
    assert (report["absent"].actual_share, report["absent"].n_docs) == (0.0, 0)
    assert abs(report["big"].actual_share - 0.5) < 0.01 and abs(report["small"].actual_share - 0.5) < 0.01
