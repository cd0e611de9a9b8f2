"""Labels: intervals to frames, merging of sources, priors, hygiene, weights and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.temporal import covered, overlapping, within


def labelled(frames: DataFrame, blocks: DataFrame, at: str = "time_s", half_open: bool = False, out: str = "label", width: float = 60.0) -> DataFrame:
    """out = 1 on frames inside a block: both ends inclusive, or half-open."""
    return covered(frames, blocks, at, width, out, half_open).withColumn(out, F.col(out).cast("int"))


def smart_merge(auto: DataFrame, user: DataFrame, deleted: DataFrame, width: float = 60.0) -> DataFrame:
    """The user's blocks, and the automatic ones that overlap none of them and none that was deleted."""
    taken = user.unionByName(deleted).select("rid", F.col("start_s").alias("b_start"), F.col("end_s").alias("b_end"))
    hit = overlapping(auto, taken, width).select("rid", "start_s", "end_s").distinct()
    free = auto.join(hit, ["rid", "start_s", "end_s"], "left_anti")
    return free.select("rid", "start_s", "end_s").withColumn("source", F.lit("auto")).unionByName(user.select("rid", "start_s", "end_s").withColumn("source", F.lit("user")))


def minute_prior(frames: DataFrame, smoothing: float = 5.0) -> DataFrame:
    """(slug, minute, p): share of label 1 in each minute of the hour, drawn to the slug's mean; all 60 minutes."""
    own = frames.groupBy("slug", "minute").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    mean = own.groupBy("slug").agg((F.sum("pos") / F.sum("n")).alias("mean"))
    every = mean.withColumn("minute", F.explode(F.sequence(F.lit(0), F.lit(59)).cast("array<bigint>")))
    p = (F.coalesce("pos", F.lit(0)) + smoothing * F.col("mean")) / (F.coalesce("n", F.lit(0)) + smoothing)
    return every.join(own, ["slug", "minute"], "left").select("slug", "minute", F.round(p, 3).alias("p"))


def prior_peaks(prior: DataFrame) -> DataFrame:
    """How many minutes of a slug lie above mean + standard deviation."""
    w = Window.partitionBy("slug")
    at = prior.withColumn("_peak", F.col("p") > F.avg("p").over(w) + F.stddev_pop("p").over(w) + 1e-12)
    return at.groupBy("slug").agg(F.count_if("_peak").alias("peaks"))


def hygiene(frames: DataFrame, teacher: str, confidence: float = 0.9, most: float = 0.3, max_rate: float = 0.5) -> DataFrame:
    """Drops recordings labelled mostly 1 (pseudo labels excepted), and frames a sure teacher contradicts.

    Frames stay where more than ``most`` of their recording would go.
    """
    w = Window.partitionBy("rid")
    p, y = F.col(teacher), F.col("label")
    wrong = ((p >= confidence) & (y == 0)) | ((p <= 1 - confidence) & (y == 1))
    marked = frames.withColumn("_rate", F.avg("label").over(w)).withColumn("_wrong", wrong).withColumn("_share", F.avg(F.col("_wrong").cast("double")).over(w))
    kept = marked.where((F.col("_rate") <= max_rate) | F.col("pseudo")).where(~F.col("_wrong") | (F.col("_share") > most))
    return kept.drop("_rate", "_wrong", "_share")


# The weights of label sources.
BASE_WEIGHTS = {"user": 2.0, "auto": 1.0, "pseudo": 0.3}


def age_decay(days: Column) -> Column:
    """1 at day 0, 0.5 at day 90, 0 from day 180."""
    return F.greatest(F.lit(0.0), 1 - days / 180.0)


def sample_weight(source: Column, days: Column, confirmed: Column, skipped: Column, bumper: Column, cluster: Column) -> Column:
    """Base by source, times age, times confirmation; a bumper or cluster raises it to 1.4 or 1.5 at least."""
    base = F.coalesce(*(F.when(source == k, F.lit(v)) for k, v in BASE_WEIGHTS.items()), F.lit(1.0)) * age_decay(days)
    w = F.when(skipped, base * 1.5).when(confirmed, base * 1.2).otherwise(base)
    w = F.when(bumper, F.greatest(w, F.lit(1.4))).otherwise(w)
    return F.when(cluster, F.greatest(w, F.lit(1.5))).otherwise(w)


def pseudo_labels(frames: DataFrame, high: float = 0.97, low: float = 0.03) -> DataFrame:
    """pseudo 1 where model and prior agree on it, 0 likewise; other frames are left out."""
    y = F.when((F.col("p") >= high) & (F.col("prior") >= 0.5), 1).when((F.col("p") <= low) & (F.col("prior") < 0.5), 0)
    return frames.withColumn("pseudo", y).where("pseudo IS NOT NULL")


def verdict(accuracy: Column) -> Column:
    return F.when(accuracy >= 0.95, "SAFE").when(accuracy >= 0.90, "RISKY").otherwise("UNSAFE")


def in_test(uuid: Column, fraction: float) -> Column:
    """Deterministic split by the md5 digest's first 52 bits."""
    return F.conv(F.substring(F.md5(uuid), 1, 13), 16, 10).cast("double") / float(2**52) < fraction


def bumper_boost(frames: DataFrame, edges: DataFrame, bumpers: DataFrame, reach: float = 2.0) -> DataFrame:
    """boosted: the frame lies within reach of a boundary that has a bumper within reach."""
    near = within(edges, bumpers.select("rid", F.col("t").alias("_t")), F.col("edge_s"), "_t", reach, reach)
    around = near.select("rid", (F.col("edge_s") - reach).alias("start_s"), (F.col("edge_s") + reach).alias("end_s")).distinct()
    return covered(frames, around, "time_s", max(4 * reach, 1.0), "boosted")
