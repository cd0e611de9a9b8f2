"""Per-frame numbers from frames of raw rgb24 bytes (rid, frame, pixels).

A frame's bytes never leave the row that they came in: one Arrow pass over the frames reduces each by numpy to a few
numbers, so nothing is shuffled but those.  Several measures are taken in the same pass (``measured``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRAME = ["rid", "frame"]


def luma(r: Column, g: Column, b: Column) -> Column:
    """BT.601 luma in integers."""
    return F.shiftright(77 * r + 150 * g + 29 * b, 8)


def rgb_of(raw: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8, 3 * width * height).reshape(height, width, 3)


def luma_of(rgb: np.ndarray) -> np.ndarray:
    """luma() of a whole frame."""
    wide = rgb.astype(np.uint16)  # 255 * (77 + 150 + 29) fits
    return (77 * wide[..., 0] + 150 * wide[..., 1] + 29 * wide[..., 2]) >> 8


def gradients(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Sobel gradients of the interior pixels, across and along."""
    s = v.astype(np.int32)
    across = s[:-2] + 2 * s[1:-1] + s[2:]
    along = s[:, :-2] + 2 * s[:, 1:-1] + s[:, 2:]
    return across[:, 2:] - across[:, :-2], along[2:] - along[:-2]


@dataclass(frozen=True)
class Measure:
    """A number (or an array of them) of a frame, from its luma and its rgb values."""

    name: str
    kind: str
    arrow: pa.DataType
    of: Callable[[np.ndarray, np.ndarray], Any]


def black(pixel_threshold: float = 0.10, picture_threshold: float = 0.98) -> Measure:
    """black: enough of the picture at or below the dark level."""
    dark = int(pixel_threshold * 255 + 0.5)
    return Measure("black", "boolean", pa.bool_(), lambda v, _: bool(np.count_nonzero(v <= dark) >= picture_threshold * v.size))


def histogram() -> Measure:
    """histogram: counts of the joint RGB histogram of 8 x 8 x 8 bins."""

    def of(_: np.ndarray, rgb: np.ndarray) -> np.ndarray:
        b = (rgb >> 5).astype(np.uint16)
        return np.bincount(((b[..., 0] << 6) | (b[..., 1] << 3) | b[..., 2]).ravel(), minlength=512).astype(np.int32)

    return Measure("histogram", "array<int>", pa.list_(pa.int32()), of)


def letterbox(bar_rows: int = 32, dark: int = 16, share: float = 0.95) -> Measure:
    """framed: the top rows and the bottom rows are dark, each to the share."""

    def of(v: np.ndarray, _: np.ndarray) -> bool:
        return all(np.count_nonzero(bar <= dark) >= int(bar.size * share) for bar in (v[:bar_rows], v[-bar_rows:]))

    return Measure("framed", "boolean", pa.bool_(), of)


def white(threshold: int = 80) -> Measure:
    """words: bits of pixels above the threshold, 32 to a word, in row-major order."""
    return Measure("words", "array<bigint>", pa.list_(pa.int64()), lambda v, _: words_of((v > threshold).ravel()))


def words_of(bits: np.ndarray) -> np.ndarray:
    packed = np.packbits(bits, bitorder="little")
    return np.concatenate((packed, np.zeros(-len(packed) % 4, np.uint8))).view("<u4").astype(np.int64)


def logo(cells: np.ndarray, threshold: int = 80, y_offset: int = 0) -> Measure:
    """confidence: share of the mask's cells (rows x, y) whose edge is above the threshold; cells outside count as missed."""
    x, y = cells[:, 0] - 1, cells[:, 1] + y_offset - 1

    def of(v: np.ndarray, _: np.ndarray) -> float:
        gx, gy = gradients(v)
        inside = (x >= 0) & (x < gx.shape[1]) & (y >= 0) & (y < gx.shape[0])
        return float(np.count_nonzero(np.abs(gx[y[inside], x[inside]]) + np.abs(gy[y[inside], x[inside]]) > threshold) / max(len(cells), 1))

    return Measure("confidence", "double", pa.float64(), of)


def measured(frames: DataFrame, width: int, height: int, *measures: Measure) -> DataFrame:
    """(rid, frame, and a column a measure): one pass over the frames, without a shuffle; a short frame is left out."""
    own = frames.select(*FRAME, "pixels")
    size = 3 * width * height

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list] = [[] for _ in measures]
            kept = []
            for i, raw in enumerate(batch.column("pixels")):
                if not raw.is_valid or len(raw.as_buffer()) < size:
                    continue
                rgb = rgb_of(raw.as_buffer(), width, height)
                v = luma_of(rgb)
                kept.append(i)
                for column, m in zip(found, measures, strict=True):
                    column.append(m.of(v, rgb))
            keys = batch.select(FRAME).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*keys.columns, *(pa.array(c, m.arrow) for c, m in zip(found, measures, strict=True))], names=[*FRAME, *(m.name for m in measures)])

    kinds = ", ".join([*(f"{c} {own.schema[c].dataType.simpleString()}" for c in FRAME), *(f"{m.name} {m.kind}" for m in measures)])
    return own.mapInArrow(run, kinds)


def colour_shares(histograms: DataFrame) -> DataFrame:
    """(rid, frame, bin, p): the histogram's bins as shares; empty bins have no row."""
    total = F.aggregate("histogram", F.lit(0), lambda a, b: a + b)
    return histograms.select(*FRAME, total.alias("_n"), F.posexplode("histogram").alias("bin", "_c")).where("_c > 0").select(*FRAME, "bin", (F.col("_c") / F.col("_n")).alias("p"))


def frame_distances(histograms: DataFrame) -> DataFrame:
    """(rid, frame, distance): Bhattacharyya distance of each frame to the one before; 1 where they share no bin.

    A frame whose number does not follow the one before is compared with nothing and has distance 1.
    """
    by = Window.partitionBy("rid").orderBy("frame")
    both = histograms.select(*FRAME, "histogram", F.lag("histogram").over(by).alias("_was"), F.lag("frame").over(by).alias("_last")).where("_was IS NOT NULL")
    n = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, b: a + b)
    shared = F.aggregate(F.zip_with("histogram", "_was", lambda a, b: F.sqrt(a.cast("double") * b)), F.lit(0.0), lambda a, b: a + b) / F.sqrt(n("histogram").cast("double") * n("_was"))
    return both.select(*FRAME, F.when(F.col("_last") == F.col("frame") - 1, 1 - F.least(F.lit(1.0), shared)).otherwise(F.lit(1.0)).alias("distance"))


def sobel(frames: DataFrame, width: int, height: int) -> DataFrame:
    """(rid, frame, x, y, gx, gy, magnitude) of the interior pixels: for a look at single pixels; counts need no rows."""
    own = frames.select(*FRAME, "pixels")
    y, x = (a.ravel() + 1 for a in np.indices((height - 2, width - 2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in enumerate(batch.column("pixels")):
                gx, gy = (g.ravel().astype(np.int64) for g in gradients(luma_of(rgb_of(raw.as_buffer(), width, height))))
                keys = batch.select(FRAME).take(pa.array(np.full(len(x), i)))
                yield pa.RecordBatch.from_arrays([*keys.columns, *map(pa.array, (x, y, gx, gy, np.abs(gx) + np.abs(gy)))], names=[*FRAME, "x", "y", "gx", "gy", "magnitude"])

    kinds = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in FRAME)
    return own.mapInArrow(run, f"{kinds}, x bigint, y bigint, gx bigint, gy bigint, magnitude bigint")


def edge_counts(frames: DataFrame, width: int, height: int, threshold: int = 80) -> DataFrame:
    """(x, y, h, v): in how many frames an interior pixel's gradient is above the threshold, across and along.

    A task sums its frames, so what is shuffled is a row a task and pixel.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, v = (np.zeros((height - 2, width - 2), np.int64) for _ in range(2))
        seen = False
        for batch in batches:
            for raw in batch.column("pixels"):
                gx, gy = gradients(luma_of(rgb_of(raw.as_buffer(), width, height)))
                h += np.abs(gx) > threshold
                v += np.abs(gy) > threshold
                seen = True
        if seen:
            y, x = np.indices(h.shape)
            yield pa.RecordBatch.from_arrays([pa.array(a.ravel()) for a in (x + 1, y + 1, h, v)], names=["x", "y", "h", "v"])

    parts = frames.select("pixels").mapInArrow(run, "x bigint, y bigint, h bigint, v bigint")
    return parts.groupBy("x", "y").agg(F.sum("h").alias("h"), F.sum("v").alias("v"))


def bumper_iou(frames: DataFrame, templates: DataFrame) -> DataFrame:
    """Largest intersection over union of a frame's white bits with any template's (column mask); 0 without templates.

    Templates are few and of a frame's size, so they are collected into one array that every frame sees.
    """
    masks = templates.agg(F.collect_list("mask").alias("m")).scalar()
    ones = lambda a, b, f: F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(f(x, y))), F.lit(0).cast("bigint"), lambda s, n: s + n)
    held = frames.withColumn("_masks", masks)
    iou = F.transform(
        "_masks",
        lambda m: F.coalesce(F.try_divide(ones(F.col("words"), m, lambda x, y: x.bitwiseAND(y)).cast("double"), ones(F.col("words"), m, lambda x, y: x.bitwiseOR(y)).cast("double")), F.lit(0.0)),
    )
    return held.select(*FRAME, F.coalesce(F.array_max(iou), F.lit(0.0)).alias("iou"))


def bounding_box(counts: DataFrame, frames: Column, persistence: float, margin: int, width: int, height: int) -> DataFrame:
    """Box around the pixels that are an edge in floor(frames * persistence) frames, with a margin, inside the frame."""
    least = F.floor(frames * persistence)
    box = counts.where(F.greatest("h", "v") >= least).agg(*(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in "xy"), F.count("*").alias("edges"))
    return box.select(
        F.greatest(F.col("min_x") - margin, F.lit(0)).alias("min_x"), F.least(F.col("max_x") + margin, F.lit(width - 1)).alias("max_x"),
        F.greatest(F.col("min_y") - margin, F.lit(0)).alias("min_y"), F.least(F.col("max_y") + margin, F.lit(height - 1)).alias("max_y"), "edges",
    )


def persistence_sweep(counts: DataFrame, frames: Column, start: float, max_area: int, margin: int, width: int, height: int) -> DataFrame:
    """Boxes of all persistences from start by 0.02 while below 1; the first of max_area at most, else the last viable."""
    steps, p = [], start
    while p < 1.0:  # by repeated addition, whose rounding the steps keep
        steps.append((len(steps), p))
        p += 0.02
    spark = counts.sparkSession
    sweep = spark.createDataFrame(steps, "step int, persistence double").withColumn("least", (frames * F.col("persistence")).cast("bigint"))
    met = F.broadcast(sweep).join(counts, F.greatest("h", "v") >= F.col("least"))  # a few dozen steps
    boxes = met.groupBy("step", "persistence").agg(
        F.greatest(F.min("x") - margin, F.lit(0)).alias("min_x"), F.least(F.max("x") + margin, F.lit(width - 1)).alias("max_x"),
        F.greatest(F.min("y") - margin, F.lit(0)).alias("min_y"), F.least(F.max("y") + margin, F.lit(height - 1)).alias("max_y"), F.count("*").alias("edges"),
    ).withColumn("area", (F.col("max_x") - F.col("min_x") + 1) * (F.col("max_y") - F.col("min_y") + 1))
    small = F.when(F.col("area") <= max_area, 0).otherwise(1)
    return boxes.orderBy(small, F.when(small == 0, F.col("step")).otherwise(-F.col("step"))).limit(1).drop("step")


def top_pixels(counts: DataFrame, n: int) -> DataFrame:
    """The n pixels with the largest max(h, v), 0 left out; ties by y, then x."""
    return counts.withColumn("score", F.greatest("h", "v")).where("score > 0").orderBy(F.desc("score"), "y", "x").limit(n)
