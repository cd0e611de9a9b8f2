"""Scores of blocks and frames against the truth, and the deployment gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.temporal import overlapping


def block_iou(truth: DataFrame, predicted: DataFrame, recordings: DataFrame, width: float = 60.0) -> DataFrame:
    """Mean over a recording's truth blocks of the best intersection over hull; 1 if both sides are empty, 0 if one is."""
    p = predicted.select("rid", F.col("start_s").alias("b_start"), F.col("end_s").alias("b_end"))
    pairs = overlapping(truth, p, width)
    both = F.least("end_s", "b_end") - F.greatest("start_s", "b_start")
    hull = F.greatest("end_s", "b_end") - F.least("start_s", "b_start")
    best = pairs.groupBy("rid", "start_s", "end_s").agg(F.max(both / hull).alias("_iou"))
    own = truth.join(best, ["rid", "start_s", "end_s"], "left").groupBy("rid").agg(F.avg(F.coalesce("_iou", F.lit(0.0))).alias("_mean"))
    has = predicted.select("rid").distinct().withColumn("_p", F.lit(1))
    joined = recordings.select("rid").distinct().join(own, "rid", "left").join(has, "rid", "left")
    return joined.select("rid", F.coalesce("_mean", F.when(F.col("_p").isNull(), 1.0).otherwise(0.0)).alias("iou"))


def matches(truth: DataFrame, predicted: DataFrame, width: float = 60.0) -> DataFrame:
    """(rid, kind, start_s, end_s): matched pairs by their truth block, missed truth blocks, extra predictions."""
    p = predicted.select("rid", F.col("start_s").alias("b_start"), F.col("end_s").alias("b_end"))
    pairs = overlapping(truth, p, width)
    as_ = lambda df, kind: df.select("rid", F.lit(kind).alias("kind"), "start_s", "end_s")
    missed = truth.join(pairs.select("rid", "start_s", "end_s").distinct(), ["rid", "start_s", "end_s"], "left_anti")
    met = pairs.select("rid", F.col("b_start").alias("start_s"), F.col("b_end").alias("end_s")).distinct()
    extra = predicted.join(met, ["rid", "start_s", "end_s"], "left_anti")
    return as_(pairs, "matched").unionByName(as_(missed, "missed")).unionByName(as_(extra, "extra"))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(frames: DataFrame, group: str) -> DataFrame:
    """Counts and rates for each group and, with a null group, overall."""
    n = lambda p, t: F.count_if((F.col("pred") == p) & (F.col("truth") == t))
    c = frames.rollup(group).agg(n(1, 1).alias("tp"), n(1, 0).alias("fp"), n(0, 1).alias("fn"), n(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    out = c.withColumn("accuracy", ratio(tp + tn, tp + fp + fn + tn)).withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def show_iou(ious: DataFrame, group: str) -> DataFrame:
    """(group, n_recs, iou): mean over the recordings of each show and, with a null group, over all recordings."""
    return ious.rollup(group).agg(F.count("*").alias("n_recs"), F.avg("iou").alias("iou"))


def proximity(black: DataFrame, silence: DataFrame, most: float = 1.5, width: float = 10.0) -> DataFrame:
    """Each black interval with the silence nearest to it (negative gap: overlap): hull midpoint t, its width dur, gap."""
    s = silence.select("rid", F.col("start_s").alias("b_start"), F.col("end_s").alias("b_end"))
    pairs = overlapping(black, s, width, slack=most)
    gap = F.greatest(F.col("b_start") - F.col("end_s"), F.col("start_s") - F.col("b_end"))
    w = Window.partitionBy("rid", "start_s", "end_s").orderBy("gap", "b_start", "b_end")
    best = pairs.withColumn("gap", gap).where(F.col("gap") <= most).withColumn("_k", F.row_number().over(w)).where("_k = 1")
    lo, hi = F.least("start_s", "b_start"), F.greatest("end_s", "b_end")
    return best.select("rid", F.round((lo + hi) / 2, 3).alias("t"), F.round(hi - lo, 3).alias("dur"), F.round("gap", 3).alias("gap"))


def zipped(truth: DataFrame, other: DataFrame) -> DataFrame:
    """Blocks compared pairwise in order, for recordings with equal counts: (rid, block_no, d_start, d_end)."""
    nth = Window.partitionBy("rid").orderBy("start_s", "end_s")
    num = lambda df: df.withColumn("block_no", F.row_number().over(nth)).withColumn("_n", F.count("*").over(Window.partitionBy("rid")))
    b = num(other).select("rid", "block_no", "_n", F.col("start_s").alias("b_start"), F.col("end_s").alias("b_end"))
    return num(truth).join(b, ["rid", "block_no", "_n"]).select("rid", F.col("block_no").cast("bigint").alias("block_no"), (F.col("start_s") - F.col("b_start")).alias("d_start"), (F.col("end_s") - F.col("b_end")).alias("d_end"))


def zipped_or_counts(truth: DataFrame, other: DataFrame) -> DataFrame:
    """zipped(), and for recordings whose counts differ one row of block 0 without differences: (.., n_truth, n_other)."""
    n = lambda df, name: df.groupBy("rid").agg(F.count("*").alias(name))
    counts = n(truth, "n_truth").join(n(other, "n_other"), "rid", "full").fillna(0, ["n_truth", "n_other"])
    return counts.join(zipped(truth, other), "rid", "left").select("rid", F.coalesce("block_no", F.lit(0).cast("bigint")).alias("block_no"), "d_start", "d_end", "n_truth", "n_other")


def gate(now: DataFrame, history: DataFrame, max_iou_drop: float = 0.05, max_acc_drop: float = 0.03) -> DataFrame:
    """deploy and why: against the last deployed run of the history (one row or none)."""
    last = history.where("deployed").orderBy(F.desc("ts")).limit(1).select(*(F.col(c).alias(f"_{c}") for c in ("iou", "acc", "dim", "test_size")), F.lit(True).alias("_has"))
    joined = now.join(F.broadcast(last), F.lit(True), "left")
    why = (
        F.when(F.col("_has").isNull(), "first").when(F.col("dim") != F.col("_dim"), "features").when(F.col("test_size") != F.col("_test_size"), "test set")
        .when(F.col("_iou") - F.col("iou") > max_iou_drop, "iou").when(F.col("_acc") - F.col("acc") > max_acc_drop, "accuracy").otherwise("ok")
    )
    return joined.withColumn("why", why).withColumn("deploy", ~F.col("why").isin("iou", "accuracy")).drop("_iou", "_acc", "_dim", "_test_size", "_has")
