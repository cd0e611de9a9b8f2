"""Events from per-frame flags: runs, cuts and transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.temporal import islands, within


def black_runs(frames: DataFrame, fps: float, min_s: float) -> DataFrame:
    """Runs of black frames of min_s or more: start at the first, end at the frame after the last."""
    runs = islands(frames, "black").where("black")
    out = runs.select("rid", (F.col("first") / fps).alias("start_s"), ((F.col("first") + F.col("n")) / fps).alias("end_s"))
    return out.withColumn("duration_s", F.col("end_s") - F.col("start_s")).where(F.col("duration_s") >= min_s)


def scene_cuts(distances: DataFrame, fps: float, threshold: float) -> DataFrame:
    """The second frame of each pair more than threshold apart."""
    return distances.where(F.col("distance") > threshold).select("rid", "idx", (F.col("idx") / fps).alias("time_s"), "distance")


def letterbox_transitions(frames: DataFrame, fps: float) -> DataFrame:
    """Changes of the framed state that last for half a second: (rid, idx, time_s, onset).

    The first run sets the state silently; a shorter run is flicker.
    """
    hold = max(1, int(fps * 0.5))
    w = Window.partitionBy("rid").orderBy("first")
    runs = islands(frames, "framed").withColumn("_nth", F.row_number().over(w))
    kept = runs.where((F.col("_nth") == 1) | (F.col("n") >= max(2, hold))).withColumn("_was", F.lag("framed").over(w))
    at = F.col("first") + (1 if hold == 1 else 0)
    return kept.where(F.col("_was").isNotNull() & (F.col("_was") != F.col("framed"))).select("rid", at.alias("idx"), (at / fps).alias("time_s"), F.col("framed").alias("onset"))


def chunks_merged(events: DataFrame, chunks: DataFrame, fps: float) -> DataFrame:
    """Events found in chunks of a recording (rid, chunk, kind, idx, time_s), in the recording's time.

    chunks: (rid, chunk, start_s), the first being 0.  From the second chunk on, a scene cut at its frame 1 and a first
    letterbox event before int(0.6 * fps) come from the cut itself and go.
    """
    first = Window.partitionBy("rid", "chunk").orderBy(F.when(F.col("kind").isin("onset", "offset"), 0).otherwise(1), "idx")
    later = F.col("chunk") > 0
    own = events.withColumn("_nth", F.row_number().over(first))
    cut = later & (((F.col("kind") == "scene") & (F.col("idx") == 1)) | (F.col("kind").isin("onset", "offset") & (F.col("_nth") == 1) & (F.col("idx") < int(0.6 * fps))))
    moved = own.where(~cut).join(chunks, ["rid", "chunk"])
    return moved.select("rid", "kind", (F.col("idx") + F.round(F.col("start_s") * fps).cast("bigint")).alias("idx"), (F.col("time_s") + F.col("start_s")).alias("time_s"))


def coalesced(events: DataFrame, gap: float) -> DataFrame:
    """Intervals of a recording with gaps of ``gap`` at most between them become one."""
    w = Window.partitionBy("rid").orderBy("start_s", "end_s")
    reach = F.max("end_s").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start_s") - reach <= gap, 0).otherwise(1)
    grouped = events.withColumn("_g", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("rid", "_g").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s")).drop("_g")


def predicted_blocks(frames: DataFrame, fps: float, min_s: float = 30.0) -> DataFrame:
    """Runs of pred = 1 of min_s or more."""
    runs = islands(frames.withColumn("_p", F.col("pred") == 1), "_p").where("_p")
    return runs.where(F.col("n") / fps >= min_s).select("rid", (F.col("first") / fps).alias("start_s"), ((F.col("first") + F.col("n")) / fps).alias("end_s"))


def error_runs(frames: DataFrame, truth_edges: DataFrame, near_s: float = 10.0, least: int = 5, most: int | None = None) -> DataFrame:
    """Runs of pred <> truth of ``least`` frames: type by the first frame, and whether an end lies near a truth edge."""
    wrong = islands(frames.withColumn("wrong", F.col("pred") != F.col("truth")), "wrong").where(F.col("wrong") & (F.col("n") >= least))
    typed = wrong.join(frames.select("rid", F.col("idx").alias("first"), "pred"), ["rid", "first"])
    last = F.col("first") + F.col("n") - 1
    # Both ends of a run look for an edge; a run without one comes through the left join.
    ends = typed.withColumn("_end", F.explode(F.array(F.col("first"), last)))
    met = within(ends, truth_edges.select("rid", F.col("edge_s").alias("_edge")), F.col("_end"), "_edge", near_s, near_s, "left")
    near = F.coalesce(F.bool_or(F.abs(F.col("_edge") - F.col("_end")) < near_s), F.lit(False))
    out = met.groupBy("rid", "first", "n", "pred").agg(near.alias("boundary")).select(
        "rid", F.col("first").alias("start_idx"), last.alias("end_idx"), "n", F.when(F.col("pred") == 1, "FP").otherwise("FN").alias("kind"), "boundary"
    )
    return out if most is None else out.withColumn("_k", F.row_number().over(Window.partitionBy("rid").orderBy("start_idx"))).where(F.col("_k") <= most).drop("_k")
