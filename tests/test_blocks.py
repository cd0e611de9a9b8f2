"""Golden cases of block formation, and set-based stages against row-by-row models."""

import random

import pytest
from pyspark.sql import functions as F

from framewright.operators import blocks as B
from framewright.operators import events as E
from framewright.options import Options

FPS = 25


def signal(spark, seconds, absent):
    inside = [f"(t >= {a} AND t < {b})" for a, b in absent] or ["false"]
    f = spark.range(seconds * FPS).select(F.lit(1).cast("bigint").alias("rid"), F.col("id").alias("idx"), (F.col("id") / FPS).alias("t"))
    return f.select("rid", "idx", F.col("t").alias("time_s"), F.expr(f"IF({' OR '.join(inside)}, 0.0D, 1.0D)").alias("logo"))


def events(spark, rows=()):
    return spark.createDataFrame([(1, k, float(a), float(b), i) for i, (k, a, b) in enumerate(rows)], "rid bigint, kind string, start_s double, end_s double, pos bigint")


def formed(spark, seconds, absent, rows=(), **options):
    out = B.form(signal(spark, seconds, absent), events(spark, rows), Options(logo_smooth_s=0, logo_cross_refine_s=0, **options))
    return [(r.start_s, r.end_s) for r in out.orderBy("start_s").collect()]


def near(got, want, tolerance):
    assert len(got) == len(want)
    assert all(abs(x - y) <= tolerance for g, w in zip(got, want) for x, y in zip(g, w))


def test_basic_block(spark):
    near(formed(spark, 1800, [(600, 900)]), [(600, 900)], 0.5)


def test_short_block_is_filtered(spark):
    assert formed(spark, 1800, [(600, 630)]) == []


def test_refines_to_black(spark):
    near(formed(spark, 1800, [(600, 900)], [("black", 602.5, 603.0), ("black", 897.0, 897.5)], refine_window_s=10), [(603, 897)], 0.001)


def test_runaway(spark):
    assert formed(spark, 1800, [(30, 1770)]) == []
    got = formed(spark, 1800, [(30, 1770)], max_block_fraction=1.0)
    assert len(got) == 1 and got[0][1] - got[0][0] >= 1500


def test_extension(spark):
    near(formed(spark, 1000, [(600, 700)], start_extend_s=50, end_extend_s=50, min_block_s=50), [(550, 750)], 1)
    a, b = formed(spark, 1800, [(60, 120), (200, 260)], start_extend_s=60, end_extend_s=60, min_block_s=50)
    assert a[1] <= b[0] and abs(a[1] - b[0]) < 1


def test_no_logo_no_result(spark):
    s = signal(spark, 100, []).withColumn("logo", F.lit(None).cast("double"))
    assert B.form(s, events(spark), Options()).count() == 0


def test_zero_means_default():
    o = Options(max_block_fraction=0, max_ad_gap_s=0, bumper_snap_s=-1, letterbox_snap_s=0, iframe_snap_s=0).resolved()
    assert (o.max_block_fraction, o.max_ad_gap_s, o.bumper_snap_s, o.letterbox_snap_s, o.iframe_snap_s) == (0.5, 30, 10, 5, 0)


def edges(spark, *rows):
    return spark.createDataFrame([(1, i, e, float(t)) for i, (e, t) in enumerate(rows)], "rid bigint, block_no bigint, edge string, t double")


@pytest.mark.parametrize("t,r,want", [(22.5, 5, 22.5), (21, 5, 22.5), (24, 5, 22.5), (100, 5, 100), (41, 30, 22.5)])
def test_iframe_snap(spark, t, r, want):
    points = spark.createDataFrame([(1, x) for x in (10.0, 22.5, 60.0, 600.0)], "rid bigint, t double")
    assert B.snap(edges(spark, ("START", t)), points, r).first()["t"] == want


@pytest.mark.parametrize("edge,t,r,th,want", [
    ("END", 4.5, 5, .85, 4.84), ("END", 6, 5, .85, 4.84), ("END", 3, 5, .85, 4.84), ("END", 7, .5, .85, 7.0), ("END", 4.5, 5, .99, 4.5),
    ("START", 4.5, 5, .85, 4.0), ("START", 2, 5, .85, 4.0), ("START", 7, 5, .85, 4.0), ("START", 9, .5, .85, 9.0), ("START", 4.5, 5, .99, 4.5)])
def test_bumpers(spark, edge, t, r, th, want):
    f = spark.range(250).select(F.lit(1).cast("bigint").alias("rid"), F.col("id").alias("idx"), F.expr("IF(id BETWEEN 100 AND 120, 0.95D, 0.0D)").alias("b"))
    assert B.bumper_snap(edges(spark, (edge, t)), f, "b", edge, th, r, 25.0).first()["t"] == pytest.approx(want)


def test_votes(spark):
    e = events(spark, [("black", 120, 120.3), ("silence", 119.8, 120.5), ("scene", 119.8, 119.8), ("scene", 100, 100)])
    assert 119.2 <= B.vote_refine(edges(spark, ("END", 121)), e, 30.0).first()["t"] <= 121.1
    assert B.vote_refine(edges(spark, ("END", 500)), events(spark), 30.0).first()["t"] == 500
    e = events(spark, [("black", 100, 100.5), ("black", 110, 110.5)])
    assert B.vote_refine(edges(spark, ("START", 105)), e, 30.0).first()["t"] == 110.5


@pytest.mark.parametrize("edge,rough,low_first,want", [("START", 4.5, False, 4.0), ("END", 3.5, True, 4.0), ("START", 5.0, None, 5.0)])
def test_crossing(spark, edge, rough, low_first, want):
    logo = {False: "IF(id < 100, 1.0D, 0.0D)", True: "IF(id < 100, 0.0D, 1.0D)", None: "1.0D"}[low_first]
    f = spark.range(250).select(F.lit(1).cast("bigint").alias("rid"), F.col("id").alias("idx"), F.expr(logo).alias("logo"))
    assert B.crossing_refine(edges(spark, (edge, rough)), f, 0.10, 2.0, 25.0).first()["t"] == want


def machine(flags, n_open, n_close, least):
    out, absent, run, opened = [], False, 0, 0
    for i, p in enumerate(flags):
        if p == absent:
            since = i if run == 0 else since
            run += 1
            if not absent and run >= n_open:
                absent, opened, run = True, since, 0
            elif absent and run >= n_close:
                out.append((opened, since))
                absent, run = False, 0
        else:
            run = 0
    if absent:
        out.append((opened, len(flags)))
    return [(a, b) for a, b in out if b - a >= least]


def test_state_machine_against_a_loop(spark):
    rng = random.Random(5)
    rows, want = [], []
    for rid in range(60):
        p, flags = rng.random() < 0.5, []
        while len(flags) < 150:
            flags += [p] * rng.randint(1, 12)
            p = not p
        rows += [(rid, i, x) for i, x in enumerate(flags)]
        want += [(rid, float(a), float(b)) for a, b in machine(flags, 3, 5, 6)]
    df = spark.createDataFrame(rows, "rid bigint, idx bigint, present boolean")
    got = [(r.rid, r.start_s, r.end_s) for r in B.state_machine(df, 3, 5, 6).collect()]
    assert sorted(got) == sorted(want)


def test_split_against_recursion(spark):
    rng = random.Random(6)
    blacks = [(r, a, a + 1.0) for r in range(20) for a in sorted(rng.uniform(0, 3000) for _ in range(8))]
    blocks = [(r, 0, float(rng.randint(0, 500)), float(rng.randint(1500, 3000))) for r in range(20)]

    def cut(r, s, e):
        mids = sorted((abs((a + b) / 2 - (s + e) / 2), (a + b) / 2) for q, a, b in blacks if q == r and s < (a + b) / 2 < e)
        return [(r, s, e)] if e - s <= 600 or not mids else cut(r, s, mids[0][1]) + cut(r, mids[0][1], e)

    want = sorted(x for r, _, s, e in blocks for x in cut(r, s, e))
    out = B.split_long(spark.createDataFrame(blocks, "rid bigint, block_no bigint, start_s double, end_s double"), spark.createDataFrame(blacks, "rid bigint, start_s double, end_s double"), 600.0)
    assert sorted((r.rid, round(r.start_s, 6), round(r.end_s, 6)) for r in out.collect()) == [(r, round(s, 6), round(e, 6)) for r, s, e in want]


def flags(spark, name, runs):
    rows, i = [], 0
    for value, n in runs:
        rows += [(1, i + k, value) for k in range(n)]
        i += n
    return spark.createDataFrame(rows, f"rid bigint, idx bigint, {name} boolean")


def test_black_run(spark):
    got = E.black_runs(flags(spark, "black", [(False, 6), (True, 10), (False, 15), (True, 2)]), 25.0, 0.10).collect()
    assert [(r.start_s, r.end_s) for r in got] == [(0.24, 0.64)]


def test_letterbox(spark):
    once = E.letterbox_transitions(flags(spark, "framed", [(False, 30), (True, 30)]), 25.0).collect()
    assert [(r.idx, r.onset) for r in once] == [(30, True)]
    assert E.letterbox_transitions(flags(spark, "framed", [(False, 20), (True, 3), (False, 20)]), 25.0).count() == 0
    both = E.letterbox_transitions(flags(spark, "framed", [(False, 30), (True, 60), (False, 30)]), 25.0).orderBy("idx").collect()
    assert [r.onset for r in both] == [True, False]


def test_streamed_blocks_equal_batch(spark, tmp_path):
    from framewright.plans import views
    from framewright.streaming.detect import streamed_blocks

    d = "/root/testdata/sf0.001"
    p = views.present(spark, d).select("rid", "idx", "present")
    n = p.groupBy("rid").agg((F.max("idx")).alias("_m"))
    p.join(n, "rid").select("rid", "idx", "present", (F.col("idx") == F.col("_m")).alias("last")).repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("rid bigint, idx bigint, present boolean, last boolean").parquet(str(tmp_path / "in"))
    q = streamed_blocks(stream, views.OPEN, views.CLOSE, views.LEAST).writeStream.format("memory").queryName("streamed").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.rid, r.start_s, r.end_s) for r in spark.table("streamed").collect())
    assert got == sorted((r.rid, r.start_s, r.end_s) for r in views.blocks(spark, d).collect())
