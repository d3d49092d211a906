"""Thresholds and metrics of scores, per key, without leaving the JVM.

Scores are first counted per key and value, and running totals are taken in two levels (within a
bucket of scores, then over buckets), so one large key doesn't land in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


def score_counts(scored: DataFrame, keys: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """keys, score, pos, neg, and the totals at or below each score within its key."""
    counts = scored.groupBy(*keys, F.col(score).alias("score")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    counts = counts.withColumn("bucket", F.floor(F.col("score") * BUCKETS))
    within = Window.partitionBy(*keys, "bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy(*keys, "bucket").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"), F.min("score").alias("lowest"))
    whole = Window.partitionBy(*keys)
    sums = sums.select(*keys, "bucket", F.coalesce(F.sum("bp").over(before), F.lit(0)).alias("p0"), F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("n0"), F.sum("bp").over(whole).alias("all_pos"), F.sum("bn").over(whole).alias("all_neg"), F.lead("lowest").over(Window.partitionBy(*keys).orderBy("bucket")).alias("next_lowest"))
    out = counts.join(sums, [*keys, "bucket"])
    follow = F.coalesce(F.lead("score").over(Window.partitionBy(*keys, "bucket").orderBy("score")), F.col("next_lowest"))
    return out.select(*keys, "score", "pos", "neg", (F.col("p0") + F.sum("pos").over(within)).alias("pos_below"), (F.col("n0") + F.sum("neg").over(within)).alias("neg_below"), "all_pos", "all_neg", follow.alias("next_score"))


def mcc(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Matthews correlation; 0 where a margin is empty."""
    tp, fp, fn, tn = (x.cast("double") for x in (tp, fp, fn, tn))
    under = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return F.when(under > 0, (tp * tn - fp * fn) / under).otherwise(F.lit(0.0))


def choose_threshold(scored: DataFrame, keys: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """keys, threshold: the midpoint of consecutive scores with the best MCC, of equals the nearest to 0.5.

    A key without both classes, or with one score, gets 0.5.
    """
    counts = score_counts(scored, keys, y, score)
    fn, tn = F.col("pos_below"), F.col("neg_below")
    quality = mcc(F.col("all_pos") - fn, F.col("all_neg") - tn, fn, tn)
    middle = (F.col("score") + F.col("next_score")) / 2
    usable = (F.col("all_pos") > 0) & (F.col("all_neg") > 0) & F.col("next_score").isNotNull()
    cuts = counts.select(*keys, F.when(usable, middle).alias("cut"), F.when(usable, quality).alias("q"))
    best = cuts.groupBy(*keys).agg(F.max("q").alias("best"))
    joined = cuts.join(best, keys) if keys else cuts.crossJoin(best)
    close = F.abs(F.col("q") - F.col("best")) <= 1e-8 + 1e-5 * F.abs("best")
    found = joined.groupBy(*keys).agg(F.min(F.when(close, F.struct(F.abs(F.col("cut") - 0.5).alias("far"), F.col("cut").alias("cut")))).alias("m"))
    return found.select(*keys, F.coalesce("m.cut", F.lit(0.5)).alias("threshold"))


def auroc(scored: DataFrame, keys: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """keys, auroc: pairs ranked right, ties half; null without both classes."""
    c = score_counts(scored, keys, y, score)
    right = F.col("pos").cast("double") * (F.col("neg_below") - F.col("neg") + F.col("neg") / 2)
    out = c.groupBy(*keys).agg(F.sum(right).alias("r"), F.max("all_pos").alias("p"), F.max("all_neg").alias("n"))
    return out.select(*keys, F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("r") / (F.col("p").cast("double") * F.col("n"))).alias("auroc"))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 of a label, null where it is in neither labels nor predictions."""
    n = 2 * tp + fp + fn
    return F.when(n > 0, 2 * tp / n)


def binary_metrics(scored: DataFrame, keys: list[str], threshold: Column, y: str = "y", score: str = "score") -> DataFrame:
    """keys, n, chance, accuracy, macro_f1, mcc, mcc_half at ``score >= threshold``."""
    t, hit, half = F.col(y) == 1, F.col(score) >= threshold, F.col(score) >= 0.5
    cells = {"tp": t & hit, "fp": ~t & hit, "fn": t & ~hit, "tn": ~t & ~hit, "htp": t & half, "hfp": ~t & half, "hfn": t & ~half, "htn": ~t & ~half}
    c = scored.groupBy(*keys).agg(*(F.count_if(x).alias(k) for k, x in cells.items()))
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    a, b = _f1(tp, fp, fn), _f1(tn, fn, fp)
    macro = (F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))) / (a.isNotNull().cast("int") + b.isNotNull().cast("int"))
    return c.select(*keys, n.alias("n"), F.greatest((tp + fn) / n, (fp + tn) / n).alias("chance"), ((tp + tn) / n).alias("accuracy"), macro.alias("macro_f1"), mcc(tp, fp, fn, tn).alias("mcc"), mcc(*(F.col(k) for k in ("htp", "hfp", "hfn", "htn"))).alias("mcc_half"))


def collapse(scored: DataFrame, group: list[str], order: str, y: str = "y", score: str = "score") -> DataFrame:
    """One row per group: the label of its first row, and the mean score."""
    return scored.groupBy(*group).agg(F.min_by(y, order).alias("y"), F.avg(score).alias("score"), F.count(F.lit(1)).alias("members"))


def multiclass_metrics(predicted: DataFrame, y: str, guess: str) -> DataFrame:
    """n, accuracy, chance (share of the largest class), macro_f1, mcc of class predictions.

    Works on the confusion table, which has a row per pair of classes.
    """
    pairs = predicted.groupBy(F.col(y).alias("t"), F.col(guess).alias("p")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    sides = pairs.select(F.col("t").alias("k"), F.col("n").alias("true"), F.lit(0.0).alias("said"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0.0).alias("right"))
    sides = sides.union(pairs.select("p", F.lit(0.0), "n", F.lit(0.0)))
    per = sides.groupBy("k").agg(F.sum("true").alias("t"), F.sum("said").alias("p"), F.sum("right").alias("c"))
    s = per.agg(F.sum("t").alias("n"), F.sum("c").alias("c"), F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("p") * F.col("p")).alias("pp"), F.max("t").alias("top"), F.avg(2 * F.col("c") / (F.col("t") + F.col("p"))).alias("macro_f1"))
    n, c = F.col("n"), F.col("c")
    under = F.sqrt((n * n - F.col("pp")) * (n * n - F.col("tt")))
    return s.select(n.cast("long").alias("n"), (c / n).alias("accuracy"), (F.col("top") / n).alias("chance"), "macro_f1", F.when(under > 0, (c * n - F.col("tp")) / under).otherwise(0.0).alias("mcc"))
