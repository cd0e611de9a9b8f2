"""Readers and writers on small inputs and round trips."""

import struct

import pytest
from pyspark.sql import functions as F

from framewright import sinks
from framewright.functions import text as X
from framewright.operators import pixels as P
from framewright.operators import speaker as S
from framewright.sources import frames as V
from framewright.sources import logs


def log(spark, *lines):
    return spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "rid bigint, line_no bigint, line string")


def test_silence_log(spark):
    got = logs.silence(log(spark, "frame=1", "[silencedetect @ 0x1] silence_start: 12.345", "silence_end: 13.567 | silence_duration: 1.222", "size=2", "silence_start: 100.5", "silence_end: 102 | silence_duration: 1.5", "silence_start: 200", "silence_end: 200.7 | silence_duration: 0.7")).collect()
    assert [(r.start_s, r.end_s, r.duration_s) for r in got] == [(12.345, 13.567, 1.222), (100.5, 102, 1.5), (200, 200.7, 0.7)]
    assert logs.silence(log(spark, "silence_start: 50", "silence_end: 60 | silence_duration: 10", "silence_start: 90")).count() == 1


def test_speaker(spark, tmp_path):
    (tmp_path / "s.csv").write_text("time_s,speaker_conf,has_speech\n0.0,0.825,1\n1.0,0.412,0\n2.0,0.901,1\n")
    w = logs.speaker_windows(spark, f"file://{tmp_path}/s.csv").withColumn("rid", F.lit(1).cast("bigint"))
    assert [(r.conf, r.has_speech) for r in w.orderBy("time_s").collect()] == [(0.825, True), (0.412, False), (0.901, True)]
    f = spark.range(100).select(F.lit(1).cast("bigint").alias("rid"), F.col("id").alias("idx"), (F.col("id") / 25).alias("time_s"))
    got = [r.speaker for r in S.expanded(f, w).orderBy("idx").collect()]
    assert got == [0.825] * 25 + [0.5] * 25 + [0.901] * 25 + [0.5] * 25


def test_rates(spark):
    got = spark.createDataFrame([(x,) for x in ("25/1", "30000/1001", "", "0/0", "5/0", "x/y", "25")], "s string").select(X.rate(F.col("s")).alias("r")).collect()
    assert [r.r for r in got] == pytest.approx([25, 30000 / 1001, 0, 0, 0, 0, 0])


def test_slugs(spark):
    r = spark.createDataFrame([("Käse & Brot -- Größe!",)], "s string").select(X.slug(F.col("s")).alias("a"), X.plain_slug(F.col("s")).alias("b"), X.comma_list(F.lit(" a, ,b,")).alias("c"), X.title(F.lit("News $2024")).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == ("kaese-brot-groesse", "k-se-brot-gr-e", ["a", "b"], "News")


@pytest.mark.parametrize("shape", [{}, {"w_logo": 0.5}, {"w_channels": [0.1] * 6}, {"w_logo": 0.5, "w_channels": [0.1] * 6}, {"w_logo": 0.5, "w_rms": 0.25}, {"w_logo": 0.5, "w_channels": [0.1] * 6, "w_rms": 0.25}])
def test_head_files(shape):
    raw = V.write_head([0.25] * 1280, -1.0, **shape)
    h = V.parse_head(raw)
    assert len(raw) in V.LAYOUTS and h["bias"] == -1.0 and h["w_logo"] == shape.get("w_logo", 0.0) and h["w_rms"] == shape.get("w_rms", 0.0)
    with pytest.raises(ValueError):
        V.parse_head(raw[:-4] if len(raw) - 4 not in V.LAYOUTS else struct.pack("<3f", 1, 2, 3))


def test_raw_frames(spark, tmp_path):
    black, white = bytes(3 * 256), b"\xff" * (3 * 256)
    (tmp_path / "v.rgb").write_bytes(black + white + black + b"tail")
    spark.dataSource.register(V.Rgb24)
    f = spark.read.format("rgb24").options(path=f"{tmp_path}/v.rgb", width=16, height=16, framesPerPartition=2).load()
    assert [r.frame for r in f.orderBy("frame").collect()] == [0, 1, 2]
    m = P.measured(f, 16, 16, P.black(), P.histogram(), P.letterbox(4, 16))
    assert [(r.black, r.framed) for r in m.orderBy("frame").collect()] == [(True, True), (False, False), (True, True)]
    assert [r.distance for r in P.frame_distances(m).orderBy("frame").collect()] == [1.0, 1.0]


def test_template_round_trip(spark):
    counts = spark.createDataFrame([(x, y, 10, 10 if x == y else 0) for x in range(3, 6) for y in range(4, 7)], "x bigint, y bigint, h bigint, v bigint")
    rows = [r.value for r in sinks.template_rows(counts, 5, 2, 7, 3, 8).orderBy("y").collect()]
    text = "\n".join(["logoMinX=2", "logoMaxX=7", "logoMinY=3", "logoMaxY=8", "picWidth=16", "picHeight=16", "", "Combined Logo Mask", "\x82", *rows])
    got = {(r.x, r.y) for r in logs.logo_template(spark.createDataFrame([(1, text)], "rid bigint, value string")).collect()}
    # The writer's box is inclusive, the reader's exclusive: a cell in its last row or column would be lost.
    assert got == {(x, y) for x in range(3, 6) for y in range(4, 7)}


def test_summary_without_blocks(spark):
    rec = spark.createDataFrame([(1, 25.0, 720, 576, 100)], "rid bigint, fps double, width int, height int, frame_count bigint")
    none = spark.createDataFrame([], "rid bigint, start_s double, end_s double")
    assert '"blocks":[]' in sinks.summaries(rec, none).first()["value"]
    assert sinks.cutlists(rec, none).first()["value"].startswith("FILE PROCESSING COMPLETE  100 FRAMES AT  2500\n")


def test_recordings(spark):
    paths = [f"/r/_rec_a/{n}" for n in ("index.m3u8", "Show $1.txt", "x.logo.txt")] + ["/r/_rec_b/index.m3u8", "/c/a.ts", "/c/b.ts"]
    got = logs.recordings(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    assert [(r.uuid, r.stem) for r in got] == [("a", "Show $1")]


def test_pseudo_sidecars(spark):
    f = spark.createDataFrame([(1, '{"frames": [5, 9], "labels": [1, 0]}'), (2, "broken")], "rid bigint, value string")
    assert [(r.rid, r.frame, r.label) for r in logs.pseudo_labels(f).orderBy("frame").collect()] == [(1, 5, 1), (1, 9, 0)]
