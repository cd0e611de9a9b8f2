"""Block formation: one function a stage, composed by form().

Signals are one row a frame (rid, idx, time_s, logo, nn?, speaker?, bumper_end?, bumper_start?); blocks are
(rid, block_no, start_s, end_s); events are (rid, kind, start_s, end_s, pos).  All recordings go through at once.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.temporal import islands, nearest, rolling_mean, within
from framewright.options import Options

BLOCK = ["rid", "block_no"]


def by_time():
    return Window.partitionBy("rid").orderBy("start_s", "end_s")


def numbered(blocks: DataFrame) -> DataFrame:
    """Blocks numbered from 0 in order of time."""
    return blocks.select("rid", (F.row_number().over(by_time()) - 1).cast("bigint").alias("block_no"), "start_s", "end_s")


def blended(logo: Column, nn: Column, weight: float, gate: float) -> Column:
    """Logo score, with the network's opinion where it is decided enough."""
    mixed = (1 - weight) * logo + weight * (1 - nn)
    return mixed if gate <= 0 else F.when(F.abs(nn - 0.5) >= gate, mixed).otherwise(logo)


def nudged(score: Column, speaker: Column, weight: float) -> Column:
    return score + weight * (speaker - 0.5)


def state_machine(frames: DataFrame, open_frames: int, close_frames: int, min_frames: int, fps: float = 1.0) -> DataFrame:
    """Blocks of absence: opened by a run of open_frames absent, closed by one of close_frames present.

    In closed form over runs: keep the runs long enough to change the state, then the first of equal ones in a row.
    """
    by = Window.partitionBy("rid").orderBy("first")
    runs = islands(frames, "present").withColumn("_n", F.sum("n").over(Window.partitionBy("rid")))
    kept = runs.where((~F.col("present") & (F.col("n") >= open_frames)) | (F.col("present") & (F.col("n") >= close_frames)))
    turns = kept.withColumn("_was", F.lag("present").over(by)).where(F.col("_was").isNull() | (F.col("_was") != F.col("present")))
    spans = turns.withColumn("_next", F.lead("first").over(by)).where(~F.col("present"))
    end = F.coalesce("_next", "_n")
    return numbered(spans.where(end - F.col("first") >= min_frames).select("rid", (F.col("first") / fps).alias("start_s"), (end / fps).alias("end_s")))


def edges_of(blocks: DataFrame) -> DataFrame:
    """A row for each end of a block: (rid, block_no, edge, t)."""
    ends = F.explode(F.array(F.struct(F.lit("START").alias("edge"), F.col("start_s").alias("t")), F.struct(F.lit("END").alias("edge"), F.col("end_s").alias("t"))))
    return blocks.select(*BLOCK, ends.alias("_e")).select(*BLOCK, "_e.edge", "_e.t")


def blocks_of(edges: DataFrame) -> DataFrame:
    at = lambda e: F.max(F.when(F.col("edge") == e, F.col("t")))
    return edges.groupBy(*BLOCK).agg(at("START").alias("start_s"), at("END").alias("end_s"))


def vote_refine(edges: DataFrame, events: DataFrame, window: float, cluster: float = 2.0, wrong: float = 5.0) -> DataFrame:
    """Each edge moves to the candidate with most weight around it; ties go to the nearer, then to the listed order."""
    kinds = F.create_map(*[x for k, v in {"black": (1, 2.0), "silence": (2, 1.0), "scene": (3, 1.5), "onset": (4, 2.0), "offset": (4, 2.0)}.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("o"), F.lit(v[1]).alias("w")))])
    known = events.where(F.col("kind").isin("black", "silence", "scene", "onset", "offset")).select(
        "rid", "kind", F.explode(F.array(F.struct(F.lit("START").alias("side"), F.col("end_s").alias("anchor")), F.struct(F.lit("END").alias("side"), F.col("start_s").alias("anchor")))).alias("_s"), "pos"
    ).select("rid", "kind", "_s.side", "_s.anchor", "pos")
    known = known.where(~((F.col("kind") == "onset") & (F.col("side") == "END")) & ~((F.col("kind") == "offset") & (F.col("side") == "START")))
    reach = min(wrong, window)
    d = F.col("anchor") - F.col("t")
    ahead = F.when(F.col("edge") == "START", d).otherwise(-d)  # negative: the wrong direction
    # An edge without candidates comes through the left join with none.
    near = within(edges, known, F.col("t"), "anchor", window, window, "left", (F.col("edge") == F.col("side")) & (ahead >= -reach)).withColumn("_k", kinds[F.col("kind")])
    by_edge = Window.partitionBy(*BLOCK, "edge")
    # A range frame on a double has no method of its own.
    frame = f"sum(_k.w) OVER (PARTITION BY rid, block_no, edge ORDER BY anchor RANGE BETWEEN {cluster!r}D PRECEDING AND {cluster!r}D FOLLOWING)"
    voted = near.withColumn("_score", F.expr(frame))
    dist = F.when(ahead < 0, -2 * ahead).otherwise(ahead)
    order = (F.col("anchor").isNull(), F.desc("_score"), dist, "_k.o", "anchor", "pos")
    best = voted.withColumn("_nth", F.row_number().over(by_edge.orderBy(*order))).where("_nth = 1")
    return best.select(*BLOCK, "edge", F.coalesce("anchor", "t").alias("t"))


def snap(edges: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """Each edge to the nearest point (rid, t) within the radius, the earlier of two."""
    return nearest(edges, points, "t", radius, "_s", [*BLOCK, "edge"]).withColumnRenamed("_s", "t")


def letterbox_snap(edges: DataFrame, events: DataFrame, radius: float, past: float = 5.0) -> DataFrame:
    """START: the earliest onset in [t - r, t + 5]; END: the latest offset in [t - 5, t + r]."""
    marks = events.where(F.col("kind").isin("onset", "offset")).select("rid", "kind", F.col("start_s").alias("_p"))
    most = max(radius, past)
    near = within(edges, marks, F.col("t"), "_p", most, most, "left")
    d = F.col("_p") - F.col("t")
    start = (F.col("edge") == "START") & (F.col("kind") == "onset") & (d >= -radius) & (d <= past)
    end = (F.col("edge") == "END") & (F.col("kind") == "offset") & (d >= -past) & (d <= radius)
    return _moved(near, F.coalesce(F.min(F.when(start, F.col("_p"))), F.max(F.when(end, F.col("_p")))))


def _moved(near: DataFrame, to: Column) -> DataFrame:
    """Edges (with the rows found for each) at the aggregate ``to``, or where they are if that is null."""
    return near.groupBy(*BLOCK, "edge").agg(F.coalesce(to, F.first("t")).alias("t"))


def _frame_window(edges: DataFrame, frames: DataFrame, radius_s: float, fps: float) -> DataFrame:
    """Edges with the frames (column i) of int(t * fps) +- int(r * fps), or with a null where there is none."""
    r = int(radius_s * fps)
    return within(edges.withColumn("_c", (F.col("t") * fps).cast("bigint")), frames, F.col("_c"), "i", r, r, "left")


def crossing_refine(edges: DataFrame, frames: DataFrame, threshold: float, radius_s: float, fps: float) -> DataFrame:
    """To the frame nearest to the edge where the smoothed logo goes (START) or comes (END); the earlier of two."""
    w = Window.partitionBy("rid").orderBy("idx")
    turns = frames.withColumn("_now", F.col("logo") >= threshold).withColumn("_was", F.lag("_now").over(w)).where("_now <> _was").select("rid", F.col("idx").alias("i"), "_now")
    near = _frame_window(edges, turns, radius_s, fps)
    # The pair's left frame lies in the window too.
    ok = (F.col("i") - 1 >= F.col("_c") - int(radius_s * fps)) & (F.col("_now") == (F.col("edge") == "END"))
    return _moved(near, F.min_by("i", F.when(ok, F.struct(F.abs(F.col("i") - F.col("_c")), F.col("i")))) / fps)


def bumper_snap(edges: DataFrame, frames: DataFrame, column: str, edge: str, threshold: float, radius_s: float, fps: float) -> DataFrame:
    """END: after the latest bumper frame of the window; START: at the earliest."""
    shown = frames.where(F.col(column) > threshold).select("rid", F.col("idx").alias("i"))
    own = F.when(F.col("edge") == edge, F.col("i"))
    return _moved(_frame_window(edges, shown, radius_s, fps), (F.max(own) + 1) / fps if edge == "END" else F.min(own) / fps)


def long_enough(blocks: DataFrame, min_s: float) -> DataFrame:
    return blocks.where(F.col("end_s") - F.col("start_s") >= min_s)


def gap_merge(blocks: DataFrame, max_gap: float) -> DataFrame:
    """Blocks at max_gap or less after the one before join it; the end is the last one's own, not the largest."""
    new = F.when(F.col("start_s") - F.lag("end_s").over(by_time()) <= max_gap, 0).otherwise(1)
    grouped = blocks.withColumn("_nth", F.row_number().over(by_time())).withColumn("_new", new).withColumn("_g", F.sum("_new").over(by_time().rowsBetween(Window.unboundedPreceding, 0)))
    return numbered(grouped.groupBy("rid", "_g").agg(F.min_by("start_s", "_nth").alias("start_s"), F.max_by("end_s", "_nth").alias("end_s")))


def runaway_drop(blocks: DataFrame, durations: DataFrame, fraction: float) -> DataFrame:
    """Without blocks of more than a fraction of their recording (durations: rid, duration_s)."""
    return blocks.join(durations, "rid").where(~(F.col("end_s") - F.col("start_s") > fraction * F.col("duration_s"))).drop("duration_s")


def split_long(blocks: DataFrame, blacks: DataFrame, max_s: float) -> DataFrame:
    """Blocks longer than max_s are cut at the black midpoint nearest to their middle, again and again.

    A recording's blocks and midpoints meet as two arrays in one row; a cut looks its midpoint up by bisection, so the
    blocks are formed once and each cut costs a logarithm of the midpoints.
    """
    mids = blacks.groupBy("rid").agg(F.sort_array(F.collect_list((F.col("start_s") + F.col("end_s")) / 2)).alias("cs"))
    own = blocks.groupBy("rid").agg(F.collect_list(F.struct("start_s", "end_s")).alias("bs")).join(mids, "rid", "left")
    kind = own.schema["rid"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, starts, ends = [], [], []
            for i, (bs, cs) in enumerate(zip(batch.column("bs").to_pylist(), batch.column("cs").to_pylist(), strict=True)):
                for s, e in cut_long([(b["start_s"], b["end_s"]) for b in bs], cs or [], max_s):
                    which.append(i)
                    starts.append(s)
                    ends.append(e)
            rids = batch.column("rid").take(pa.array(which, pa.int64()))
            yield pa.RecordBatch.from_arrays([rids, pa.array(starts, pa.float64()), pa.array(ends, pa.float64())], names=["rid", "start_s", "end_s"])

    return own.select("rid", "bs", "cs").mapInArrow(run, f"rid {kind}, start_s double, end_s double")


def cut_long(blocks: list[tuple[float, float]], mids: list[float], max_s: float) -> list[tuple[float, float]]:
    """Blocks with those longer than max_s cut at the midpoint (of sorted ones) nearest to their middle, the earlier of two."""
    out, todo = [], list(blocks)
    while todo:
        s, e = todo.pop()
        lo, hi = bisect.bisect_right(mids, s), bisect.bisect_left(mids, e)
        if e - s <= max_s or lo >= hi:
            out.append((s, e))
            continue
        middle = (s + e) / 2
        at = bisect.bisect_left(mids, middle, lo, hi)
        c = min(mids[max(at - 1, lo) : min(at + 1, hi)], key=lambda m: (abs(m - middle), m))
        todo += [(s, c), (c, e)]
    return out


def extend(blocks: DataFrame, durations: DataFrame, start_s: float, end_s: float, min_s: float) -> DataFrame:
    """Signed extension of both ends: a start stops at the extended end before it, an end at the plain start after it."""
    rows = blocks.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start_s", "end_s"))).alias("bs")).join(durations, "rid")
    zero = F.array().cast("array<struct<start_s:double,end_s:double>>")

    def step(acc: Column, i: Column) -> Column:
        b = F.get("bs", i)
        before = F.coalesce(F.get(acc, i - 1)["end_s"], F.lit(0.0))
        after = F.coalesce(F.get("bs", i + 1)["start_s"], F.col("duration_s"))
        ns = F.least(F.greatest(b["start_s"] - start_s, before), b["end_s"] - min_s)
        ne = lambda s: F.greatest(F.least(b["end_s"] + end_s, after), s + min_s)
        return F.concat(acc, F.transform(F.array(ns), lambda s: F.struct(s.alias("start_s"), ne(s).alias("end_s"))))

    moved = F.aggregate(F.sequence(F.lit(0), F.size("bs") - 1), zero, step)
    return rows.select("rid", F.posexplode(moved).alias("block_no", "b")).select("rid", F.col("block_no").cast("bigint").alias("block_no"), "b.start_s", "b.end_s")


def form(signals: DataFrame, events: DataFrame, options: Options) -> DataFrame:
    """All stages in order, for every recording that has a logo series."""
    o = options.resolved()
    whole = Window.partitionBy("rid")
    counts = {f"_{c}": F.count(c).over(whole) for c in ("logo", "nn", "speaker") if c in signals.columns}
    frames = signals.withColumns({"_n": F.count("*").over(whole), **counts}).where("_logo = _n")  # without a logo series there is no result
    logo = F.col("logo")
    frames = rolling_mean(frames, "logo", int(o.logo_smooth_s * o.fps / 2), "_l") if o.logo_smooth_s > 0 else frames.withColumn("_l", logo)
    frames = frames.withColumn("logo", F.col("_l"))
    score = F.col("logo")
    if "nn" in signals.columns and o.nn_weight > 0:
        frames = rolling_mean(frames, "nn", int(o.nn_smooth_s * o.fps / 2), "_s")
        score = F.when(F.col("_nn") == F.col("_n"), blended(F.col("logo"), F.col("_s"), o.nn_weight, o.nn_gate)).otherwise(score)
    if "speaker" in signals.columns and o.speaker_weight:
        score = F.when(F.col("_speaker") == F.col("_n"), nudged(score, F.col("speaker"), o.speaker_weight)).otherwise(score)
    frames = frames.withColumn("present", score >= o.logo_threshold)
    durations = signals.groupBy("rid").agg((F.count("*") / o.fps).alias("duration_s"))
    blocks = state_machine(frames, max(1, o.frames(o.min_absent_open_s)), max(1, o.frames(o.min_show_segment_s)), o.frames(o.min_block_s), o.fps)
    edges = vote_refine(edges_of(blocks), events, o.refine_window_s)
    points = lambda kind: events.where(F.col("kind") == kind).select("rid", F.col("start_s").alias("t"))
    for kind, radius in (("iframe", o.iframe_snap_s), ("scene", o.scene_cut_snap_s)):
        edges = snap(edges, points(kind), radius) if radius > 0 else edges
    edges = letterbox_snap(edges, events, o.letterbox_snap_s)
    edges = crossing_refine(edges, frames, o.logo_threshold, o.logo_cross_refine_s, o.fps) if o.logo_cross_refine_s > 0 else edges
    for column, edge in (("bumper_end", "END"), ("bumper_start", "START")):
        edges = bumper_snap(edges, frames, column, edge, o.bumper_threshold, o.bumper_snap_s, o.fps) if column in signals.columns else edges
    blocks = gap_merge(long_enough(blocks_of(edges), o.min_block_s), o.max_ad_gap_s)
    blocks = runaway_drop(blocks, durations, o.max_block_fraction)
    blocks = numbered(split_long(blocks, events.where("kind = 'black'"), o.max_block_s))
    return extend(blocks, durations, o.start_extend_s, o.end_extend_s, o.min_block_s) if o.start_extend_s or o.end_extend_s else blocks


def two_tier_refine(edges: DataFrame, events: DataFrame, window: float) -> DataFrame:
    """The older refinement: the nearest black event's inner end within the window, else the nearest silence's."""
    own = events.where(F.col("kind").isin("silence", "black")).select("rid", "kind", F.explode(F.array(F.struct(F.lit("START").alias("side"), F.col("end_s").alias("a")), F.struct(F.lit("END").alias("side"), F.col("start_s").alias("a")))).alias("_x")).select("rid", "kind", "_x.side", "_x.a")
    near = within(edges, own, F.col("t"), "a", window, window, "left", F.col("edge") == F.col("side"))
    best = F.min_by("a", F.when(F.col("a").isNotNull(), F.struct(F.col("kind") != "black", F.abs(F.col("a") - F.col("t")), F.col("a"))))
    return _moved(near, best)
