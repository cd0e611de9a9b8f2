"""Speaker signals: voice activity, centroids, confidences and their expansion to frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.model import dot


def samples_of(value: pa.Scalar) -> np.ndarray:
    """A chunk's samples, from little-endian float32 bytes or from an array of numbers."""
    if pa.types.is_binary(value.type):
        return np.frombuffer(value.as_buffer(), "<f4").astype(np.float64)
    return value.values.to_numpy(zero_copy_only=False).astype(np.float64)


def voice_activity(chunks: DataFrame, frame: int = 400, threshold: float = 0.005) -> DataFrame:
    """(rid, frame, speech): frames of samples whose RMS is above the threshold; an unfinished last frame is none.

    chunks: (rid, first, samples), first being the place of a chunk's first sample, a multiple of frame.
    """
    own = chunks.select("rid", F.col("first").cast("bigint").alias("first"), "samples")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (first, value) in enumerate(zip(batch.column("first").to_pylist(), batch.column("samples"), strict=True)):
                x = samples_of(value)
                n, rest = divmod(len(x), frame)
                speech = np.sqrt(np.mean(x[: n * frame].reshape(n, frame) ** 2, axis=1)) > threshold if n else np.empty(0, bool)
                speech = np.concatenate((speech, np.zeros(int(rest > 0), bool)))
                rids = batch.column("rid").take(pa.array(np.full(len(speech), i)))
                yield pa.RecordBatch.from_arrays([rids, pa.array(first // frame + np.arange(len(speech))), pa.array(speech)], names=["rid", "frame", "speech"])

    return own.mapInArrow(run, f"rid {own.schema['rid'].dataType.simpleString()}, frame bigint, speech boolean")


def _windows_of(first: Column, n: Column, window: int, hop: int) -> Column:
    """The windows that samples first .. first + n - 1 lie in."""
    return F.sequence(F.greatest(F.floor((first - window) / hop) + 1, F.lit(0).cast("bigint")), F.floor((first + n - 1) / hop))


def speaking_windows(frames: DataFrame, window: int = 32_000, hop: int = 16_000, frame: int = 400, share: float = 0.5) -> DataFrame:
    """(rid, w, has_speech): windows a hop apart in which the frames with speech have the share of the samples, or more.

    frames: as of voice_activity().  A window beyond the last frame's end is left out.
    """
    start = F.col("frame") * frame
    last = frames.groupBy("rid").agg(((F.max("frame") + 1) * frame).alias("_end"))
    own = frames.select("rid", "speech", start.alias("_s"), F.explode(_windows_of(start, F.lit(frame), window, hop)).alias("w"))
    shared = F.least(F.col("_s") + frame, F.col("w") * hop + window) - F.greatest("_s", F.col("w") * hop)
    out = own.groupBy("rid", "w").agg((F.sum(F.when(F.col("speech"), shared).otherwise(0)) >= share * window).alias("has_speech"))
    return out.join(last, "rid").where(F.col("w") * hop + window <= F.col("_end")).select("rid", "w", "has_speech")


def normalised(e: Column) -> Column:
    n = F.sqrt(dot(e, e))
    return F.transform(e, lambda v: v.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def confidence(e: Column, centroid: Column) -> Column:
    return (1 + dot(e, normalised(centroid))) / 2


def centroids(windows: DataFrame, show: str = "show", embedding: str = "embedding") -> DataFrame:
    """(show, centroid): mean by dimension, then unit length."""
    mean = windows.select(show, F.posexplode(embedding).alias("d", "v")).groupBy(show, "d").agg(F.avg(F.col("v").cast("double")).alias("m"))
    whole = mean.groupBy(show).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda x: x["m"]).alias("_m"))
    return whole.select(show, normalised(F.col("_m")).alias("centroid"))


def separation(windows: DataFrame, distance: str = "distance", own: str = "own") -> DataFrame:
    """Mean, median and 90th percentile of the distance by class."""
    return windows.groupBy(own).agg(F.avg(distance).alias("mean"), F.percentile(distance, 0.5).alias("median"), F.percentile(distance, 0.9).alias("p90"), F.count("*").alias("n"))


def shrunk_inverse(cov: np.ndarray, n: int) -> np.ndarray:
    """Inverse of a covariance drawn to its scaled identity by max(0.1, 1 - n / 1000)."""
    s = max(0.1, 1 - n / 1000)
    d = len(cov)
    return np.linalg.inv((1 - s) * cov + s * np.trace(cov) / d * np.eye(d))


def naive_accuracies(windows: DataFrame, group: str, distance: str = "distance", own: str = "own") -> DataFrame:
    """(group, threshold, own_right, other_right): how often a threshold halfway between the class means tells them apart.

    A window nearer than the threshold is taken for the show's own; a group without one of the classes has nulls.
    """
    means = windows.groupBy(group).agg(((F.avg(F.when(F.col(own), F.col(distance))) + F.avg(F.when(~F.col(own), F.col(distance)))) / 2).alias("threshold"))
    near = F.col(distance) < F.col("threshold")
    return windows.join(means, group).groupBy(group, "threshold").agg(F.avg(F.when(F.col(own), near.cast("double"))).alias("own_right"), F.avg(F.when(~F.col(own), (~near).cast("double"))).alias("other_right"))


def covariance(windows: DataFrame, embedding: str = "embedding") -> tuple[np.ndarray, int]:
    """Sample covariance of the embeddings (as many numbers as dimensions squared), and their count.

    A task sums its outer products; the sums of all tasks meet by cell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, outer, n = None, None, 0
        for batch in batches:
            column = batch.column("e")
            if not len(column):
                continue
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
            total = x.sum(axis=0) + (0 if total is None else total)
            outer = x.T @ x + (0 if outer is None else outer)
            n += len(x)
        if n:
            d = len(total)
            cells = np.concatenate(([n], total, outer.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), d)), pa.array(np.arange(len(cells))), pa.array(cells)], names=["d", "cell", "v"])

    parts = windows.select(F.col(embedding).cast("array<double>").alias("e")).mapInArrow(run, "d bigint, cell bigint, v double")
    rows = parts.groupBy("d", "cell").agg(F.sum("v").alias("v")).collect()  # 1 + d + d * d rows
    d = rows[0]["d"]
    cells = np.zeros(1 + d + d * d)
    for r in rows:
        cells[r["cell"]] = r["v"]
    n, mean, outer = cells[0], cells[1 : d + 1] / cells[0], cells[d + 1 :].reshape(d, d)
    return (outer - n * np.outer(mean, mean)) / max(n - 1, 1), int(n)


def expanded(frames: DataFrame, windows: DataFrame) -> DataFrame:
    """speaker on each frame: the confidence of window int(t / hop) if it has speech, else 0.5.

    hop is the gap of a recording's first two windows (1 where there is one).
    """
    by = Window.partitionBy("rid").orderBy("time_s")
    w = windows.select("rid", "time_s", "conf", "has_speech", (F.row_number().over(by) - 1).cast("bigint").alias("_w"), F.lead("time_s").over(by).alias("_next"))
    hop = w.where("_w = 0").select("rid", F.coalesce(F.col("_next") - F.col("time_s"), F.lit(1.0)).alias("_hop"))
    at = frames.join(hop, "rid", "left").withColumn("_w", (F.col("time_s") / F.col("_hop")).cast("bigint"))
    own = w.where("has_speech").select("rid", "_w", "conf")
    return at.join(own, ["rid", "_w"], "left").withColumn("speaker", F.coalesce("conf", F.lit(0.5))).drop("_w", "_hop", "conf")


def window_embeddings(chunks: DataFrame, embed: Column, window: int = 32_000, hop: int = 16_000) -> DataFrame:
    """(rid, w, embedding): whole windows of samples, a hop apart, through embed over the column xs, at unit length.

    chunks: (rid, first, samples), samples as an array; a chunk gives each window the slice that lies in it.
    """
    n = F.size("samples")
    parts = chunks.select("rid", F.col("first").cast("bigint").alias("first"), "samples", F.explode(_windows_of(F.col("first"), n, window, hop)).alias("w"))
    lo = F.greatest(F.col("w") * hop, F.col("first"))
    hi = F.least(F.col("w") * hop + window, F.col("first") + n)
    cut = parts.where(hi > lo).select("rid", "w", lo.alias("lo"), F.slice("samples", (lo - F.col("first") + 1).cast("int"), (hi - lo).cast("int")).alias("x"))
    whole = cut.groupBy("rid", "w").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("lo", "x"))), lambda s: s["x"])).alias("xs"))
    return whole.where(F.size("xs") == window).select("rid", "w", normalised(embed).alias("embedding"))
