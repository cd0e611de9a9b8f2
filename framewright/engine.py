"""From frames and logs to blocks in one call: sources, pixel measures, events, block formation.

All recordings of a job go through together.  Frames are reduced to a few numbers each in one pass; those are written
once, as several stages read them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.operators import blocks as B
from framewright.operators import events as E
from framewright.operators import pixels as P
from framewright.options import Options
from framewright.work import stored


@dataclass(frozen=True)
class Detection:
    """measures: a row a frame; events: (rid, kind, start_s, end_s, pos); blocks: (rid, block_no, start_s, end_s)."""

    measures: DataFrame
    events: DataFrame
    blocks: DataFrame


def bumper_scores(measures: DataFrame, templates: DataFrame, stride: int) -> DataFrame:
    """(rid, frame, iou) of every stride-th frame; the frames between have 0."""
    return P.bumper_iou(measures.where(F.col("frame") % stride == 0).select("rid", "frame", "words"), templates)


def detect(
    frames: DataFrame, width: int, height: int, options: Options, logo: np.ndarray | None, logo_offset: int = 0, silences: DataFrame | None = None, iframes: DataFrame | None = None,
    bumpers_end: DataFrame | None = None, bumpers_start: DataFrame | None = None, nn: DataFrame | None = None, speaker: DataFrame | None = None, bar_rows: int = 32,
) -> Detection:
    """frames: (rid, frame, pixels).  logo: the template's cells (x, y); without one there are no blocks.

    silences: (rid, start_s, end_s); iframes: (rid, times); bumpers: templates (mask); nn: (rid, frame, nn);
    speaker: (rid, frame, speaker).
    """
    o = options.resolved()
    wanted = [P.black(o.blackframe_d), P.histogram(), P.letterbox(bar_rows)]
    wanted += [] if logo is None else [P.logo(logo, y_offset=logo_offset)]
    wanted += [P.white()] if bumpers_end is not None or bumpers_start is not None else []
    measures = stored(P.measured(frames, width, height, *wanted), "measures")
    at = measures.withColumnRenamed("frame", "idx")
    runs = E.black_runs(at, o.fps, 0.10)
    cuts = E.scene_cuts(P.frame_distances(measures).withColumnRenamed("frame", "idx"), o.fps, o.scene_threshold)
    turns = E.letterbox_transitions(at, o.fps)
    point = lambda df, kind: df.select("rid", kind.alias("kind"), F.col("time_s").alias("start_s"), F.col("time_s").alias("end_s"))
    span = lambda df, kind: df.select("rid", F.lit(kind).alias("kind"), "start_s", "end_s")
    found = span(runs, "black").unionByName(point(cuts, F.lit("scene"))).unionByName(point(turns, F.when(F.col("onset"), "onset").otherwise("offset")))
    if silences is not None:
        found = found.unionByName(span(silences, "silence"))
    if iframes is not None:
        found = found.unionByName(point(iframes.select("rid", F.explode("times").alias("time_s")), F.lit("iframe")))
    # The place in a recording's list orders events that tie in everything else.
    found = stored(found.withColumn("pos", F.round(F.col("start_s") * o.fps).cast("bigint")), "events")
    score = F.col("confidence") if logo is not None else F.lit(None).cast("double")
    signals = measures.select("rid", F.col("frame").alias("idx"), (F.col("frame") / o.fps).alias("time_s"), score.alias("logo"))
    for name, extra in (("nn", nn), ("speaker", speaker)):
        if extra is not None:
            signals = signals.join(extra.select("rid", F.col("frame").alias("idx"), name), ["rid", "idx"], "left")
    for name, templates in (("bumper_end", bumpers_end), ("bumper_start", bumpers_start)):
        if templates is not None:
            scores = bumper_scores(measures, templates, o.bumper_stride).select("rid", F.col("frame").alias("idx"), F.col("iou").alias(name))
            signals = signals.join(scores, ["rid", "idx"], "left").fillna(0.0, [name])
    return Detection(measures, found, B.form(signals, found, o))
