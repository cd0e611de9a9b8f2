"""Structured Streaming forms of the order-dependent detectors.

The batch forms see whole recordings; these keep a few numbers of state for each recording and emit a block as soon as
it closes.  Frames of a recording must come in order of idx within a micro-batch stream; a frame with last = true ends
its recording and flushes what is open, as the batch forms do at the end of the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "idx bigint, absent boolean, run bigint, open bigint, since bigint"


def _machine(open_frames: int, close_frames: int, min_frames: int, fps: float):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # absent: the state; run: frames of the current contrary run; open: where the block began.
        idx, absent, run, opened, since = state.get if state.exists else (-1, False, 0, -1, -1)
        done = []
        rows = pd.concat(list(batches)).sort_values("idx")
        last = False
        for i, present, end in zip(rows["idx"], rows["present"], rows["last"], strict=True):
            idx = int(i)
            if bool(present) == absent:  # contrary to the state
                since = idx if run == 0 else since
                run += 1
                if not absent and run >= open_frames:
                    absent, opened, run = True, since, 0
                elif absent and run >= close_frames:
                    if since - opened >= min_frames:
                        done.append((opened, since))
                    absent, run = False, 0
            else:
                run = 0
            last = last or bool(end)
        if last:
            if absent and idx + 1 - opened >= min_frames:
                done.append((opened, idx + 1))
            state.remove()
        else:
            state.update((idx, absent, run, opened, since))
        yield pd.DataFrame({"rid": [key[0]] * len(done), "start_s": [a / fps for a, _ in done], "end_s": [b / fps for _, b in done]})

    return step


def streamed_blocks(frames: DataFrame, open_frames: int, close_frames: int, min_frames: int, fps: float = 1.0) -> DataFrame:
    """Blocks of absence from a stream of (rid, idx, present, last)."""
    return frames.groupBy("rid").applyInPandasWithState(_machine(max(1, open_frames), max(1, close_frames), min_frames, fps), f"rid {frames.schema['rid'].dataType.simpleString()}, start_s double, end_s double", STATE, "append", GroupStateTimeout.NoTimeout)


def _by_frame(step, out: str):
    """A stateful function over a recording's frames in order of idx: step(state, row, done) returns the next state.

    done takes the rows that come out; a frame with last = true ends the recording, which step sees as row.last.
    """
    names = [c.strip().split(" ")[0] for c in out.split(",")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        done: list[tuple] = []
        last = False
        for row in pd.concat(list(batches)).sort_values("idx").itertuples(index=False):
            held = step(held, row, done)
            last = last or bool(row.last)
        if last:
            state.remove()
        else:
            state.update(held)
        yield pd.DataFrame([(key[0], *d) for d in done], columns=names)

    return run


def streamed_black_runs(frames: DataFrame, fps: float, min_s: float) -> DataFrame:
    """Runs of black frames, as events.black_runs finds them, from a stream of (rid, idx, black, last)."""

    def step(held, row, done):
        first = held[0] if held else -1
        if row.black and first < 0:
            first = int(row.idx)
        if first >= 0 and (not row.black or row.last):
            end = int(row.idx) + (1 if row.black else 0)
            if end / fps - first / fps >= min_s:
                done.append((first / fps, end / fps, end / fps - first / fps))
            first = -1
        return (first,)

    out = f"rid {frames.schema['rid'].dataType.simpleString()}, start_s double, end_s double, duration_s double"
    return frames.groupBy("rid").applyInPandasWithState(_by_frame(step, out), out, "first bigint", "append", GroupStateTimeout.NoTimeout)


def streamed_scene_cuts(frames: DataFrame, fps: float, threshold: float) -> DataFrame:
    """Scene cuts, as events.scene_cuts finds them, from a stream of (rid, idx, histogram, last)."""

    def step(held, row, done):
        now = np.asarray(row.histogram, np.float64)
        if held is not None:
            was = np.asarray(held[1], np.float64)
            distance = 1.0
            if held[0] == row.idx - 1:
                distance = 1 - min(1.0, float(np.sqrt(now * was).sum() / np.sqrt(now.sum() * was.sum())))
            if distance > threshold:
                done.append((int(row.idx), row.idx / fps, distance))
        return (int(row.idx), [int(x) for x in now])

    out = f"rid {frames.schema['rid'].dataType.simpleString()}, idx bigint, time_s double, distance double"
    return frames.groupBy("rid").applyInPandasWithState(_by_frame(step, out), out, "idx bigint, histogram array<bigint>", "append", GroupStateTimeout.NoTimeout)


def streamed_letterbox(frames: DataFrame, fps: float) -> DataFrame:
    """Changes of the framed state, as events.letterbox_transitions finds them, from a stream of (rid, idx, framed, last)."""
    hold = max(1, int(fps * 0.5))

    def step(held, row, done):
        # The state that holds, the value of the run at hand, its first frame and its length.
        known, value, first, n = held if held else (bool(row.framed), bool(row.framed), int(row.idx), 0)
        if bool(row.framed) == value:
            n += 1
        else:
            value, first, n = bool(row.framed), int(row.idx), 1
        if value != known and n >= max(2, hold):
            at = first + (1 if hold == 1 else 0)
            done.append((at, at / fps, value))
            known = value
        return (known, value, first, n)

    out = f"rid {frames.schema['rid'].dataType.simpleString()}, idx bigint, time_s double, onset boolean"
    return frames.groupBy("rid").applyInPandasWithState(_by_frame(step, out), out, "known boolean, value boolean, first bigint, n bigint", "append", GroupStateTimeout.NoTimeout)


def with_current_head(stream: DataFrame, heads: str, use: Callable[[DataFrame, dict, int], None]) -> DataStreamWriter:
    """A writer that reads the newest head file again for each micro-batch, so a new head needs no restart.

    use(batch, head, batch_id) gets a batch and the weights of the last head by name in the folder ``heads``.
    """
    from framewright.sources.frames import heads as read_heads

    def each(batch: DataFrame, batch_id: int) -> None:
        newest = read_heads(batch.sparkSession, heads).orderBy(F.desc("path")).first()
        use(batch, newest.asDict(), batch_id)

    return stream.writeStream.foreachBatch(each)


def second_means(frames: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Mean logo confidence of each second, by event time (ts) with a watermark."""
    return frames.withWatermark("ts", late).groupBy("rid", F.window("ts", "1 second")).agg(F.avg("logo").alias("logo")).select("rid", F.col("window.start").alias("second"), "logo")


def speech_windows(samples: DataFrame, late: str = "10 seconds") -> DataFrame:
    """RMS over sliding windows of two seconds, one second apart."""
    rms = F.sqrt(F.avg(F.col("x") * F.col("x")))
    return samples.withWatermark("ts", late).groupBy("rid", F.window("ts", "2 seconds", "1 second")).agg(rms.alias("rms")).select("rid", F.col("window.start").alias("start"), "rms")
