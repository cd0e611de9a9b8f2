"""Outputs: summaries, cutlists, listings and sidecars, as rows of text to be written with DataFrameWriter.text."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


# The line formats of the cutlist and of the event listings, and the heads of the series.
CUT_HEAD = "FILE PROCESSING COMPLETE  %d FRAMES AT  %d"
CUT_RULE = "-------------------"
CUT_LINE = "%d\t%d"
RUN_LINE = "%s start=%.3f end=%.3f duration=%.3f"
SCENE_LINE = "scene frame=%d t=%.3f dist=%.3f"
LETTERBOX_LINE = "letterbox %s frame=%d t=%.3f"
SERIES_LINE = "%d,%.3f,%.4f"
SERIES_HEADS = {"logo": "idx,time_s,confidence", "bumper": "idx,time_s,bumper_score"}


def summaries(recordings: DataFrame, blocks: DataFrame) -> DataFrame:
    """(rid, value): a JSON summary for each recording (rid, fps, width, height, frame_count); no blocks are [].

    Recordings with a column elapsed_s, the seconds that they took, have stats as well.
    """
    own = blocks.groupBy("rid").agg(F.array_sort(F.collect_list(F.array("start_s", "end_s"))).alias("blocks"))
    j = recordings.join(own, "rid", "left")
    empty = F.array().cast("array<array<double>>")
    stats = [F.struct(F.col("elapsed_s").cast("double").alias("elapsed_s"), (F.col("frame_count") / F.col("elapsed_s")).alias("fps_proc")).alias("stats")] if "elapsed_s" in recordings.columns else []
    return j.select("rid", F.to_json(F.struct("fps", "width", "height", "frame_count", (F.col("frame_count") / F.col("fps")).alias("duration_s"), F.coalesce("blocks", empty).alias("blocks"), *stats)).alias("value"))


def json_lines(rows: DataFrame, *columns: str) -> DataFrame:
    """(rid, idx, value): a JSON object a row, of the columns in order."""
    return rows.select("rid", "idx", F.to_json(F.struct(*columns)).alias("value"))


def _frame(x: Column, fps: Column) -> Column:
    return F.floor(x * fps + 0.5)


def cutlists(recordings: DataFrame, blocks: DataFrame) -> DataFrame:
    """(rid, value): a header line with frames and rate, a rule, and a line a block."""
    line = F.format_string(CUT_LINE, _frame(F.col("start_s"), F.col("fps")), _frame(F.col("end_s"), F.col("fps")))
    own = blocks.join(recordings.select("rid", "fps"), "rid").groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("start_s", line.alias("l")))), lambda x: x["l"]).alias("lines"))
    head = F.format_string(CUT_HEAD, "frame_count", F.floor(F.col("fps") * 100 + 0.5))
    rule = F.lit(CUT_RULE)
    return recordings.join(own, "rid", "left").select("rid", F.concat_ws("\n", head, rule, F.coalesce("lines", F.array().cast("array<string>"))).alias("value"))


def run_listing(runs: DataFrame, name: str) -> DataFrame:
    """(rid, start_s, value): a line a run; name is blackframe or silence."""
    return runs.select("rid", "start_s", F.format_string(RUN_LINE, F.lit(name), "start_s", "end_s", F.col("end_s") - F.col("start_s")).alias("value"))


def scene_listing(cuts: DataFrame) -> DataFrame:
    return cuts.select("rid", "time_s", F.format_string(SCENE_LINE, "idx", "time_s", "distance").alias("value"))


def letterbox_listing(turns: DataFrame) -> DataFrame:
    return turns.select("rid", "time_s", F.format_string(LETTERBOX_LINE, F.when(F.col("onset"), "onset").otherwise("offset"), "idx", "time_s").alias("value"))


def series_listing(frames: DataFrame, column: str, fps: float) -> DataFrame:
    """(rid, idx, value): a CSV line a frame, to stand under its head of SERIES_HEADS."""
    return frames.select("rid", "idx", F.format_string(SERIES_LINE, "idx", F.col("idx") / fps, F.col(column)).alias("value"))


def speaker_csv(windows: DataFrame) -> DataFrame:
    return windows.select("rid", F.concat_ws(",", F.format_string("%.3f", "time_s"), F.format_string("%.4f", "conf"), F.col("has_speech").cast("int").cast("string")).alias("value"))


def template_rows(counts: DataFrame, least: Column | int, min_x: int, max_x: int, min_y: int, max_y: int) -> DataFrame:
    """(y, value): mask rows of an inclusive box: + for both gradients, | for v alone, - for h alone, a space for none."""
    cell = F.when((F.col("h") >= least) & (F.col("v") >= least), "+").when(F.col("v") >= least, "|").when(F.col("h") >= least, "-").otherwise(" ")
    spark = counts.sparkSession
    grid = spark.range(min_y, max_y + 1).select(F.col("id").cast("int").alias("y"), F.explode(F.sequence(F.lit(min_x), F.lit(max_x))).alias("x"))
    full = grid.join(counts, ["x", "y"], "left").select("x", "y", F.coalesce(cell, F.lit(" ")).alias("c"))
    return full.groupBy("y").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "c"))), lambda z: z["c"]), "").alias("value"))


def history(runs: DataFrame, most: int = 200) -> DataFrame:
    """The last runs, newest first."""
    return runs.orderBy(F.desc("ts")).limit(most)


def confusion_text(scores: DataFrame) -> DataFrame:
    """(nth, value): the table of a show evaluation (columns show, n_recs, frames, accuracy, f1, iou), OVERALL last."""
    name = F.rpad(F.substring(F.coalesce("show", F.lit("OVERALL")), 1, 40), 40, " ")
    line = F.format_string("%s %4d %7d %5.1f%% %5.2f %5.2f", name, "n_recs", "frames", F.col("accuracy") * 100, "f1", "iou")
    return scores.select(F.row_number().over(Window.orderBy(F.col("show").isNull(), "show")).alias("nth"), line.alias("value"))  # a row a show


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file, on whatever file system the path names; it is there whole or not at all."""
    jvm = spark.sparkContext._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    held = jvm.org.apache.hadoop.fs.Path(f"{path}.writing")
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(held, True)
    out.write(bytearray(content))
    out.close()
    fs.delete(to, False)
    fs.rename(held, to)


def release_head(spark: SparkSession, head: bytes, output: str, archive: str, stamp: str, deploy: bool, calibration: dict | None = None, test_set: list[str] | None = None) -> str:
    """Archives a head file under its stamp and, if it is to be deployed, puts it and its sidecars in place; returns the archived name."""
    name = f"head.{stamp}.bin"
    write_bytes(spark, f"{archive}/{name}", head)
    if deploy:
        stem = output.rsplit(".", 1)[0]
        write_bytes(spark, output, head)
        if calibration is not None:
            write_bytes(spark, f"{stem}.calibration.json", json.dumps({**calibration, "ts": stamp}, indent=2).encode())
        if test_set is not None:
            write_bytes(spark, f"{stem}.test-set.json", json.dumps({"ts": stamp, "n": len(test_set), "uuids": test_set}, indent=2).encode())
    return name
