"""Segmentation metrics from one confusion table, threshold calibration, and hard example selection.

Everything starts from counts per (label, pred), so the rows are read once and what is left has the size of the
classes squared. Macro averages run over the classes that occur as label or prediction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.operators.ranking import running_total, value_bucket

#: Fixed metric names and the modes each takes.
MODES = {"accuracy": ("macro", "micro"), "precision": ("macro", "micro", "per_class"), "recall": ("macro", "micro", "per_class"), "f1": ("macro", "micro", "per_class"), "iou": ("macro", "micro", "per_class"), "mcc": (), "kappa": (), "auroc": ("macro", "micro", "per_class")}


def parse_metric(name: str) -> tuple[str, tuple[str, ...]]:
    """'f1.macro.per_class' -> ('f1', ('macro', 'per_class')); macro if no mode is given and there is a choice."""
    base, *modes = name.split(".")
    if base not in MODES:
        raise ValueError(f"unknown metric {base!r}")
    for m in modes:
        if m not in ("macro", "micro", "per_class"):
            raise ValueError(f"unknown mode {m!r}")
        if m not in MODES[base]:
            raise ValueError(f"{base} takes no mode {m!r}")
    return base, tuple(modes) or MODES[base][:1]


def confusion(rows: DataFrame, *, label: str = "label", pred: str = "pred", by: list[str] | None = None, ignore_index: int | None = None) -> DataFrame:
    """(by, label, pred, n); null labels and predictions and those of ignore_index as label are left out."""
    ok = F.col(label).isNotNull() & F.col(pred).isNotNull()
    if ignore_index is not None:
        ok = ok & (F.col(label) != ignore_index)
    return rows.where(ok).groupBy(*(by or []), F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def class_counts(conf: DataFrame) -> DataFrame:
    """(class, tp, fp, fn) from a confusion table, for every class that is a label or a prediction."""
    hit = F.col("label") == F.col("pred")
    each = F.array(F.struct(F.col("label").alias("class"), F.when(hit, F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(~hit, F.col("n")).otherwise(0).alias("fn")), F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("tp"), F.when(~hit, F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("long").alias("fn")))
    return conf.select(F.inline(each)).groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def class_metrics(conf: DataFrame) -> DataFrame:
    """(class, support, precision, recall, f1, iou); 0 where a ratio has no denominator."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return class_counts(conf).select("class", (tp + fn).alias("support"), _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), _ratio(tp, tp + fp + fn).alias("iou"))


def summary_metrics(conf: DataFrame) -> DataFrame:
    """(metric, mode, value) rows: macro and micro of all, where macro accuracy is macro recall."""
    per = class_metrics(conf)
    c = class_counts(conf)
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    macro = per.agg(F.avg("recall").alias("accuracy"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.avg("iou").alias("iou")).withColumn("mode", F.lit("macro"))
    micro = c.agg(_ratio(tp, tp + fn).alias("accuracy"), _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), _ratio(tp, tp + fp + fn).alias("iou")).withColumn("mode", F.lit("micro"))
    return macro.unionByName(micro).unpivot(["mode"], ["accuracy", "precision", "recall", "f1", "iou"], "metric", "value").select("metric", "mode", "value")


def agreement(conf: DataFrame) -> DataFrame:
    """One row (mcc, kappa) from the marginals of the confusion table."""
    c = class_counts(conf).select((F.col("tp") + F.col("fn")).cast("double").alias("t"), (F.col("tp") + F.col("fp")).cast("double").alias("p"), F.col("tp").cast("double").alias("tp"))
    m = c.agg(F.sum("t").alias("s"), F.sum("tp").alias("c"), F.sum(F.col("t") * F.col("p")).alias("pt"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("p") * F.col("p")).alias("pp"))
    s, k = F.col("s"), F.col("c")
    mcc = _ratio(k * s - F.col("pt"), F.sqrt((s * s - F.col("pp")) * (s * s - F.col("tt"))))
    pe = F.col("pt") / (s * s)
    return m.select(mcc.alias("mcc"), _ratio(k / s - pe, 1 - pe).alias("kappa"))


def auroc(scores: DataFrame, *, by: str = "class", score: str = "score", positive: str = "positive") -> DataFrame:
    """(by, auroc) by rank sums with ties averaged; null where a class has only positives or only negatives.

    Scores are counted per distinct value first, then ranks run over ranges of scores, so no task holds a class.
    """
    pos = F.col(positive).cast("long")
    d = scores.where(F.col(score).isNotNull() & F.col(positive).isNotNull()).groupBy(by, score).agg(F.sum(pos).alias("p"), F.sum(1 - pos).alias("n"))
    d = running_total(d.withColumn("_bucket", value_bucket(F.col(score))), by=[by], bucket="_bucket", order=[F.col(score)], value=F.col("n"), name="_upto")
    won = d.withColumn("won", F.col("p") * (F.col("_upto") - F.col("n") / 2))
    return won.groupBy(by).agg(F.try_divide(F.sum("won"), (F.sum("p") * F.sum("n")).cast("double")).alias("auroc"))


def auroc_summary(scores: DataFrame, *, by: str = "class", score: str = "score", positive: str = "positive") -> DataFrame:
    """(mode, auroc): macro is the mean over the classes that have one, micro that of all classes' scores as one."""
    macro = auroc(scores, by=by, score=score, positive=positive).agg(F.avg("auroc").alias("auroc")).select(F.lit("macro").alias("mode"), "auroc")
    one = scores.select(F.lit("micro").alias("mode"), F.col(score).alias("score"), F.col(positive).alias("positive"))
    return macro.unionByName(auroc(one, by="mode"))


def threshold_sweep(rows: DataFrame, *, n_classes: int, candidates: list[float], metric: str = "f1", label: str = "label", pred: str = "pred", p: str = "p") -> DataFrame:
    """(class, threshold, score): per class the lowest candidate with the best macro score.

    A prediction of the class below the threshold is suppressed and counts as no prediction; the others stay. One
    histogram by (label, pred, number of candidates the confidence reaches) replaces a pass per candidate: candidates
    are counted on the histogram, whose size depends on classes and candidates only.
    """
    if metric not in ("f1", "iou"):
        raise ValueError("metric must be f1 or iou")
    cands = sorted(candidates)
    reached = sum((F.when(F.col(p) >= t, 1).otherwise(0) for t in cands), F.lit(0))
    hist = rows.where(F.col(label).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(label).alias("label"), F.col(pred).alias("pred"), reached.alias("reached")).agg(F.count("*").alias("n"))
    x = hist.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1)))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(cands) - 1))))
    x = x.withColumn("t", F.get(F.array(*map(F.lit, cands)), F.col("i")))
    # reached > i means the confidence is at least candidate i
    x = x.withColumn("shown", (F.col("pred") != F.col("c")) | (F.col("reached") > F.col("i")))
    each = F.array(
        F.struct(F.col("label").alias("k"), F.when(F.col("shown") & (F.col("label") == F.col("pred")), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(~(F.col("shown") & (F.col("label") == F.col("pred"))), F.col("n")).otherwise(0).alias("fn")),
        F.struct(F.col("pred").alias("k"), F.lit(0).cast("long").alias("tp"), F.when(F.col("shown") & (F.col("label") != F.col("pred")), F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("long").alias("fn")),
    )
    k = x.select("c", "t", F.inline(each)).groupBy("c", "t", "k").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    tp, wrong = F.col("tp"), F.col("fp") + F.col("fn")
    value = _ratio(2 * tp, 2 * tp + wrong) if metric == "f1" else _ratio(tp, tp + wrong)
    macro = k.groupBy("c", "t").agg(F.round(F.avg(value), 12).alias("score"))
    best = macro.groupBy("c").agg(F.max(F.struct(F.col("score"), (-F.col("t")).alias("nt"))).alias("b"))
    return best.select(F.col("c").alias("class"), (-F.col("b.nt")).alias("threshold"), F.col("b.score").alias("score"))


def hard_examples(rows: DataFrame, *, p_true: str, min_kept: int, thresh: float, valid: str | None = None) -> DataFrame:
    """Rows a hard-example loss keeps: those whose true-class probability is at most max(thresh, the min_kept-th smallest).

    All valid rows are kept if min_kept is 0 or above their number. The k-th smallest is a top-k over the partitions.
    """
    ok = rows.where(F.col(p_true).isNotNull() & (F.col(valid) if valid else F.lit(True)))
    if min_kept == 0:
        return ok
    kth = ok.select(F.col(p_true).alias("v")).orderBy("v").limit(min_kept).agg(F.max("v").alias("kth"), F.count("*").alias("m")).first()
    return ok if kth["m"] < min_kept else ok.where(F.col(p_true) <= max(thresh, kth["kth"]))


def cross_entropy(p_true: Column) -> Column:
    return F.avg(-F.log(p_true))
