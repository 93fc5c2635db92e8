"""A mixture in which every source has its share of the tokens.

Each document gets an exponential key scaled by its quality weight (Efraimidis-Spirakis): the smallest keys form a
weighted sample without replacement. A source first gives as many complete epochs as its budget holds, then the
documents in the order of their keys until the rest of the budget is filled. Prefix sums of tokens run over ranges of
keys first, so a source of any size is never sorted in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.functions.names import source_name
from terrafold.llm.tokenizers import count_tokens, vocabulary
from terrafold.operators.ranking import running_total
from terrafold.session import cut


def notebook_quality(cells: Column) -> Column:
    """Share of a notebook's text that lies in markdown and code cells, from 0.05 to 1; 0.5 if there are no cells."""
    length = lambda cs: F.aggregate(cs, F.lit(0).cast("long"), lambda a, c: a + F.coalesce(c["char_len"], F.lit(0)))
    own = length(F.filter(cells, lambda c: c["cell_type"].isin("markdown", "code")))
    every = length(F.filter(cells, lambda c: c.isNotNull()))
    return F.coalesce(F.when(every > 0, F.greatest(F.lit(0.05), own / every)), F.lit(0.5))


def sized(documents: DataFrame, *, key: str, source: Column, text: str, weight: Column, tokenizer: str | None) -> DataFrame:
    """(id, source, weight, tokens) of documents; a null text has no tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = [0 if t is None else count_tokens(tokenizer, t) for t in pdf["text"]]
            yield pdf[["id", "source", "weight"]].assign(tokens=n)

    rows = documents.select(F.col(key).cast("long").alias("id"), source.alias("source"), weight.cast("double").alias("weight"), F.col(text).alias("text")).where("id IS NOT NULL AND source IS NOT NULL")
    return rows.mapInPandas(run, "id long, source string, weight double, tokens long")


def budgets(totals: dict[str, int], goals: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, tuple[int, int, int]]:
    """source -> (budget, complete epochs, rest) in tokens.

    Without ``total`` the mixture is the largest in which every source can reach its share within its repeats; with it,
    a source that can't fill its budget gives all it may and stays below its share.
    """
    most = {s: totals.get(s, 0) * r for s, (_, r) in goals.items()}
    if total is None:
        total = math.floor(min((most[s] / share for s, (share, _) in goals.items() if share > 0), default=0))
    out = {}
    for s, (share, repeats) in goals.items():
        have = totals.get(s, 0)
        budget = min(round(share * total), most[s])
        epochs = min(repeats, budget // have) if have else 0
        out[s] = (budget, epochs, budget - epochs * have)
    return out


def mixture(documents: DataFrame, targets: DataFrame, *, key: str = "doc_id", source: Column | None = None, text: str = "text", weight: Column | None = None, tokenizer: str | None = "", total_tokens: int | None = None, seed: int = 29, cells_per_octave: int = 256) -> DataFrame:
    """(doc_id, source, n_tokens, copies): the documents of the mixture and how often each is repeated, 1 to max_repeats.

    targets: (source, target_share, max_repeats); shares are scaled to sum 1, sources told apart without regard to case
    and outer blanks; null shares and repeats below 1 give a source nothing. Documents of other sources, null or empty
    ones are not taken; repeated ids are documents of their own. The last document of a source is taken if that brings
    the source nearer to its budget. ``tokenizer`` is a vocabulary file, '' for the default one, None for bytes.
    """
    path = vocabulary() if tokenizer == "" else tokenizer
    source = source_name(F.col("source")) if source is None else source
    weight = notebook_quality(F.col("cells")) if weight is None else weight
    named = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").where("source IS NOT NULL")
    rows = named.groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats")).collect()
    goals = {r["source"]: (max(0.0, r["share"] or 0.0), max(0, r["repeats"] or 0)) for r in rows}
    goals = {s: g for s, g in goals.items() if g[0] > 0 and g[1] > 0}
    whole = sum(g[0] for g in goals.values())
    goals = {s: (g[0] / whole, g[1]) for s, g in goals.items()}
    wanted = documents.where(source.isin(sorted(goals)) if goals else F.lit(False))
    docs = cut(sized(wanted, key=key, source=source, text=text, weight=weight, tokenizer=path)).where("tokens > 0")
    totals = {r["source"]: r["t"] for r in docs.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    # a source without tokens can't reach any share and doesn't bound the others
    goals = {s: g for s, g in goals.items() if totals.get(s)}
    plan = [(s, *b) for s, b in budgets(totals, goals, total_tokens).items()]
    plan_df = documents.sparkSession.createDataFrame(plan, "source string, budget long, epochs int, rest long")
    u = (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    keyed = docs.withColumn("key", -F.log(u) / F.greatest(F.col("weight"), F.lit(1e-6)))
    keyed = keyed.withColumn("bucket", F.floor(F.log2("key") * cells_per_octave)).withColumn("tie", F.xxhash64("id", "tokens", F.lit(seed + 1)))
    summed = running_total(keyed, by=["source"], bucket="bucket", order=[F.col("key"), F.col("tie"), F.col("id")], value=F.col("tokens"), name="upto")
    out = summed.join(plan_df, "source")
    extra = (F.col("upto") - F.col("tokens") / 2.0 <= F.col("rest")) & (F.col("rest") > 0)
    out = out.withColumn("copies", F.col("epochs") + extra.cast("int")).where("copies > 0")
    return out.select(F.col("id").alias("doc_id"), "source", F.col("tokens").alias("n_tokens"), "copies")


def mixture_report(documents: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """(source, target_share, actual_share, n_tokens, n_docs, most_copies) of every target source."""
    got = mixture(documents, targets, **options).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens"), F.count("*").alias("n_docs"), F.max("copies").alias("most_copies"))
    t = targets.select(source_name(F.col("source")).alias("source"), "target_share").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    out = t.join(got, "source", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    whole = F.sum("n_tokens").over(Window.partitionBy(F.lit(0)))  # over as many rows as there are sources
    return out.select("source", "target_share", (zero("n_tokens") / whole).alias("actual_share"), zero("n_tokens").alias("n_tokens"), zero("n_docs").alias("n_docs"), zero("most_copies").alias("most_copies"))
