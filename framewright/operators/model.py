"""The linear head: inference, fitting, calibration, agreement and what to label next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Channel slugs in the order of the head's weights (append only).
CHANNELS = ("kabel-eins", "prosieben", "rtl", "sat-1", "sixx", "vox")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def head(features: Column, weights: Column, bias: Column | float, logo: Column | None = None, w_logo: float = 0.0, channel: Column | None = None, w_channels: Column | None = None, rms: Column | None = None, w_rms: float = 0.0) -> Column:
    """Confidence; an unknown channel adds nothing, a missing loudness counts as 0.5."""
    z = dot(features, weights) + bias
    z = z if logo is None else z + w_logo * logo
    z = z if channel is None else z + dot(one_hot(channel), w_channels)
    z = z if rms is None else z + w_rms * F.coalesce(rms, F.lit(0.5))
    return sigmoid(z)


def one_hot(slug: Column, channels: tuple[str, ...] = CHANNELS) -> Column:
    return F.array(*(F.coalesce((slug == c).cast("float"), F.lit(0.0).cast("float")) for c in channels))


def padded(features: Column, size: int, fill: float = 0.5) -> Column:
    return F.concat(features, F.array_repeat(F.lit(fill).cast("float"), F.greatest(F.lit(size) - F.size(features), F.lit(0))))


def brier(frames: DataFrame, p: str = "p", y: str = "label") -> DataFrame:
    return frames.agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))


def agreement(frames: DataFrame, least: float = 0.7) -> DataFrame:
    """Two views (p_a, p_b): how often sure views agree, and how right they are then."""
    sure = lambda p: F.when(F.col(p) >= least, 1).when(F.col(p) <= 1 - least, 0)
    both = frames.withColumn("_a", sure("p_a")).withColumn("_b", sure("p_b")).where("_a IS NOT NULL AND _b IS NOT NULL")
    n = lambda a, b: F.count_if((F.col("_a") == a) & (F.col("_b") == b))
    right = F.count_if((F.col("_a") == F.col("_b")) & (F.col("_a") == F.col("label")))
    out = both.agg(n(1, 1).alias("both_pos"), n(0, 0).alias("both_neg"), n(1, 0).alias("only_a"), n(0, 1).alias("only_b"), right.alias("right"))
    rate = F.coalesce(F.try_divide(F.col("right").cast("double"), (F.col("both_pos") + F.col("both_neg")).cast("double")), F.lit(0.0))
    return out.withColumn("accuracy", rate).withColumn("verdict", F.when(rate >= 0.95, "GOOD").when(rate >= 0.90, "OK").otherwise("POOR"))


def uncertain(frames: DataFrame, n: int) -> DataFrame:
    """Per recording: the max(1, n / 2) least sure frames, and the rest of n those a sure model and the prior differ on.

    tag: unc, div or both; needs p, prior and idx.
    """
    half = max(1, n // 2)
    w = Window.partitionBy("rid")
    unsure = 1 - 2 * F.abs(F.col("p") - 0.5)
    differ = F.when(F.abs(F.col("p") - 0.5) > 0.3, F.abs(F.col("p") - F.col("prior"))).otherwise(F.lit(-1.0))
    ranked = frames.withColumn("_u", F.row_number().over(w.orderBy(F.desc(F.round(unsure, 9)), "idx"))).withColumn("_d", F.row_number().over(w.orderBy(F.desc(F.round(differ, 9)), "idx")))
    u, d = F.col("_u") <= half, F.col("_d") <= max(n - half, 0)
    return ranked.where(u | d).select("rid", "idx", F.when(u & d, "both").when(u, "unc").otherwise("div").alias("tag"))


def fit_head(frames: DataFrame, features: str = "features", label: str = "label", weight: str = "weight", c: float = 1.0, max_iter: int = 2000):
    """Weighted logistic regression with an L2 penalty of strength 1 / c on the summed loss."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    total = frames.agg(F.sum(weight).alias("w")).first()["w"]
    ready = frames.select(array_to_vector(F.col(features)).alias("features"), F.col(label).cast("double").alias("label"), F.col(weight).cast("double").alias("weight"))
    return LogisticRegression(weightCol="weight", standardization=False, elasticNetParam=0.0, regParam=1.0 / (c * total), maxIter=max_iter, tol=1e-9).fit(ready)


def fit_platt(frames: DataFrame, logit: str = "logit", label: str = "label"):
    """Calibration: a nearly unpenalised regression on one logit; returns (slope, intercept)."""
    m = fit_head(frames.select(F.array(F.col(logit).cast("double")).alias("features"), label, F.lit(1.0).alias("weight")), c=1e6, label=label)
    return float(m.coefficients[0]), float(m.intercept)


def calibration(frames: DataFrame, logit: str = "logit", label: str = "label") -> DataFrame:
    """One row of a held-out set's calibration: slope a, intercept b, frames, recordings (rid), Brier score before and after."""
    a, b = fit_platt(frames, logit, label)
    off = lambda p: F.pow(p - F.col(label), 2)
    z = F.col(logit)
    scores = frames.agg(F.count("*").alias("n_frames"), F.count_distinct("rid").alias("n_recs"), F.avg(off(sigmoid(z))).alias("brier_raw"), F.avg(off(sigmoid(a * z + b))).alias("brier_calibrated"))
    return scores.select(F.lit("platt").alias("method"), F.lit(a).alias("a"), F.lit(b).alias("b"), "*", (F.col("brier_raw") - F.col("brier_calibrated")).alias("improvement"))
