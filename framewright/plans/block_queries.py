"""Queries of events and block formation."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright import sinks
from framewright.operators import blocks as B
from framewright.operators import events as E
from framewright.operators.temporal import rolling_mean
from framewright.options import Options
from framewright.plans.views import BLOCKS, FRAMES, SIG, blocks, events, frames, present, runs_sql, sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return keep


def durations(spark, d):
    return frames(spark, d).groupBy("rid").agg(F.count("*").cast("double").alias("duration_s"))


@query("b2_rolling_mean", sql(FRAMES, BLOCKS, select="SELECT rid, idx, round(s, 9) AS smooth FROM sm"))
def b2(spark, d):
    return rolling_mean(frames(spark, d), "logo", 12, "s").select("rid", "idx", F.round("s", 9).alias("smooth"))


@query("b3_nn_blend", sql(FRAMES, select="SELECT rid, idx, round(CASE WHEN abs(nn - 0.5) >= 0.3 THEN 0.7 * logo + 0.3 * (1 - nn) ELSE logo END, 9) AS score FROM frames"))
def b3(spark, d):
    return frames(spark, d).select("rid", "idx", F.round(B.blended(F.col("logo"), F.col("nn"), 0.3, 0.3), 9).alias("score"))


@query("b4_speaker_nudge", sql(FRAMES, select="SELECT rid, idx, round(logo + 0.2 * (speaker - 0.5), 9) AS score, logo + 0.2 * (speaker - 0.5) >= 0.4301 AS present FROM frames"))
def b4(spark, d):
    s = B.nudged(F.col("logo"), F.col("speaker"), 0.2)
    return frames(spark, d).select("rid", "idx", F.round(s, 9).alias("score"), (s >= 0.4301).alias("present"))


@query("b6_state_machine", sql(FRAMES, BLOCKS, select="SELECT rid, block_no, start_s, end_s FROM blocks"))
def b6(spark, d):
    return blocks(spark, d)


VOTE = """cand AS (SELECT rid, side, anchor, pos, CASE kind WHEN 'black' THEN 1 WHEN 'silence' THEN 2 WHEN 'scene' THEN 3 ELSE 4 END AS o, CASE kind WHEN 'black' THEN 2.0 WHEN 'silence' THEN 1.0 WHEN 'scene' THEN 1.5 ELSE 2.0 END AS w
 FROM (SELECT *, 'START' AS side, end_s AS anchor FROM sig WHERE kind <> 'offset' UNION ALL SELECT *, 'END', start_s FROM sig WHERE kind <> 'onset')),
near AS (SELECT e.*, c.anchor, c.o, c.w, c.pos, CASE WHEN edge = 'START' THEN anchor - t ELSE t - anchor END AS ahead FROM edges e JOIN cand c ON e.rid = c.rid AND e.edge = c.side AND abs(anchor - t) <= 4.0),
voted AS (SELECT *, sum(w) OVER (PARTITION BY rid, block_no, edge ORDER BY anchor RANGE BETWEEN 2.0 PRECEDING AND 2.0 FOLLOWING) AS score FROM near WHERE ahead >= -4.0),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid, block_no, edge ORDER BY score DESC, CASE WHEN ahead < 0 THEN -2 * ahead ELSE ahead END, o, anchor, pos) AS k FROM voted) WHERE k = 1)"""


@query("b7_vote_refine", sql(FRAMES, BLOCKS, SIG, VOTE, select="SELECT e.rid, e.block_no, e.edge, round(coalesce(b.anchor, e.t), 6) AS t FROM edges e LEFT JOIN best b USING (rid, block_no, edge)"))
def b7(spark, d):
    return B.vote_refine(B.edges_of(blocks(spark, d)), events(spark, d), 4.0).withColumn("t", F.round("t", 6))


def _snap_sql(points: str, r: float) -> str:
    return f"""near AS (SELECT e.rid, e.block_no, e.edge, p.t AS p, abs(p.t - e.t) AS dist FROM edges e JOIN ({points}) p ON e.rid = p.rid AND abs(p.t - e.t) <= {r}),
best AS (SELECT rid, block_no, edge, p FROM (SELECT *, row_number() OVER (PARTITION BY rid, block_no, edge ORDER BY dist, p) AS k FROM near) WHERE k = 1)"""


SNAPPED = "SELECT e.rid, e.block_no, e.edge, coalesce(b.p, e.t) AS t FROM edges e LEFT JOIN best b USING (rid, block_no, edge)"


@query("b19_two_tier_refine", sql(FRAMES, BLOCKS, SIG, """a AS (SELECT rid, kind, 'START' AS edge, end_s AS p FROM sig WHERE kind IN ('black', 'silence') UNION ALL SELECT rid, kind, 'END', start_s FROM sig WHERE kind IN ('black', 'silence')),
best AS (SELECT rid, block_no, edge, p FROM (SELECT e.rid, e.block_no, e.edge, p, row_number() OVER (PARTITION BY e.rid, e.block_no, e.edge ORDER BY kind, abs(p - t), p) AS k FROM edges e JOIN a ON a.rid = e.rid AND a.edge = e.edge AND abs(p - t) <= 3) WHERE k = 1)""", select="SELECT e.rid, e.block_no, e.edge, round(coalesce(b.p, e.t), 6) AS t FROM edges e LEFT JOIN best b USING (rid, block_no, edge)"))
def b19(spark, d):
    return B.two_tier_refine(B.edges_of(blocks(spark, d)), events(spark, d), 3.0).withColumn("t", F.round("t", 6))


@query("b8_iframe_snap", sql(FRAMES, BLOCKS, _snap_sql("SELECT rid, time_s AS t FROM frames WHERE idx % 12 = 0", 5.0), select=SNAPPED))
def b8(spark, d):
    points = frames(spark, d).where("idx % 12 = 0").select("rid", F.col("time_s").alias("t"))
    return B.snap(B.edges_of(blocks(spark, d)), points, 5.0)


@query("b9_scene_snap", sql(FRAMES, BLOCKS, SIG, _snap_sql("SELECT rid, start_s AS t FROM sig WHERE kind = 'scene'", 3.0), select=SNAPPED))
def b9(spark, d):
    points = events(spark, d).where("kind = 'scene'").select("rid", F.col("start_s").alias("t"))
    return B.snap(B.edges_of(blocks(spark, d)), points, 3.0)


@query("b10_letterbox_snap", sql(FRAMES, BLOCKS, SIG, """best AS (SELECT rid, block_no, edge, CASE WHEN edge = 'START' THEN min(p) ELSE max(p) END AS p FROM
 (SELECT e.rid, e.block_no, e.edge, s.start_s AS p FROM edges e JOIN sig s ON e.rid = s.rid AND ((edge = 'START' AND kind = 'onset' AND s.start_s BETWEEN e.t - 3 AND e.t + 5) OR (edge = 'END' AND kind = 'offset' AND s.start_s BETWEEN e.t - 5 AND e.t + 3))) GROUP BY rid, block_no, edge)""", select=SNAPPED))
def b10(spark, d):
    return B.letterbox_snap(B.edges_of(blocks(spark, d)), events(spark, d), 3.0)


@query("b11_cross_refine", sql(FRAMES, BLOCKS, """turns AS (SELECT rid, idx AS i, now FROM (SELECT rid, idx, logo >= 0.43 AS now, lag(logo >= 0.43) OVER (PARTITION BY rid ORDER BY idx) AS was FROM frames) WHERE now <> was),
near AS (SELECT e.rid, e.block_no, e.edge, i::DOUBLE AS p, abs(i - trunc(t)) AS dist FROM edges e JOIN turns c ON e.rid = c.rid AND i BETWEEN trunc(t) - 6 AND trunc(t) + 6 AND i - 1 >= trunc(t) - 6 AND now = (edge = 'END')),
best AS (SELECT rid, block_no, edge, p FROM (SELECT *, row_number() OVER (PARTITION BY rid, block_no, edge ORDER BY dist, p) AS k FROM near) WHERE k = 1)""", select=SNAPPED))
def b11(spark, d):
    return B.crossing_refine(B.edges_of(blocks(spark, d)), frames(spark, d), 0.43, 6.0, 1.0)


def _bumper_sql(edge: str, to: str) -> str:
    return f"best AS (SELECT e.rid, e.block_no, e.edge, ({to})::DOUBLE AS p FROM edges e JOIN frames f ON e.rid = f.rid AND edge = '{edge}' AND f.nn > 0.85 AND f.idx BETWEEN trunc(t) - 10 AND trunc(t) + 10 GROUP BY e.rid, e.block_no, e.edge)"


@query("b12_bumper_end", sql(FRAMES, BLOCKS, _bumper_sql("END", "max(idx) + 1"), select=SNAPPED))
def b12(spark, d):
    return B.bumper_snap(B.edges_of(blocks(spark, d)), frames(spark, d), "nn", "END", 0.85, 10.0, 1.0)


@query("b13_bumper_start", sql(FRAMES, BLOCKS, _bumper_sql("START", "min(idx)"), select=SNAPPED))
def b13(spark, d):
    return B.bumper_snap(B.edges_of(blocks(spark, d)), frames(spark, d), "nn", "START", 0.85, 10.0, 1.0)


@query("b14_min_length", sql(FRAMES, BLOCKS, select="SELECT rid, block_no, start_s, end_s FROM blocks WHERE end_s - start_s >= 20"))
def b14(spark, d):
    return B.long_enough(blocks(spark, d), 20.0)


MERGED = """mg AS (SELECT *, sum(CASE WHEN gap <= 10 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY block_no) AS g FROM (SELECT *, start_s - lag(end_s) OVER (PARTITION BY rid ORDER BY block_no) AS gap FROM blocks)),
merged AS (SELECT rid, (row_number() OVER (PARTITION BY rid ORDER BY min(block_no)) - 1)::BIGINT AS block_no, arg_min(start_s, block_no) AS start_s, arg_max(end_s, block_no) AS end_s FROM mg GROUP BY rid, g)"""


@query("b15_gap_merge", sql(FRAMES, BLOCKS, MERGED, select="SELECT * FROM merged"))
def b15(spark, d):
    return B.gap_merge(blocks(spark, d), 10.0)


@query("b16_runaway_drop", sql(FRAMES, BLOCKS, select="SELECT rid, block_no, start_s, end_s FROM blocks JOIN nf USING (rid) WHERE NOT end_s - start_s > 0.1 * duration_s"))
def b16(spark, d):
    return B.runaway_drop(blocks(spark, d), durations(spark, d), 0.1)


@query("b17_split_long", sql(FRAMES, BLOCKS, SIG, """cs AS (SELECT rid, (start_s + end_s) / 2 AS c FROM sig WHERE kind = 'black'),
r AS (SELECT rid, start_s AS s, end_s AS e FROM blocks UNION ALL
 SELECT rid, CASE WHEN h = 0 THEN s ELSE c END, CASE WHEN h = 0 THEN c ELSE e END FROM (SELECT r.rid, s, e, (SELECT arg_min(c, struct_pack(d := abs(c - (s + e) / 2), c := c)) FROM cs WHERE cs.rid = r.rid AND c > s AND c < e) AS c FROM r WHERE e - s > 15), (VALUES (0), (1)) v(h) WHERE c IS NOT NULL)""",
    recursive=True, select="SELECT rid, round(s, 6) AS start_s, round(e, 6) AS end_s FROM r WHERE e - s <= 15 OR NOT EXISTS (SELECT 1 FROM cs WHERE cs.rid = r.rid AND c > s AND c < e)"))
def b17(spark, d):
    return B.split_long(blocks(spark, d), events(spark, d).where("kind = 'black'"), 15.0).select("rid", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


@query("b18_extend", sql(FRAMES, BLOCKS, """nb AS (SELECT *, lead(start_s) OVER (PARTITION BY rid ORDER BY block_no) AS after FROM blocks JOIN nf USING (rid)),
x AS (SELECT rid, block_no, least(greatest(start_s - 7, 0), end_s - 8) AS ns, greatest(least(end_s + 5, coalesce(after, duration_s)), least(greatest(start_s - 7, 0), end_s - 8) + 8) AS ne FROM nb WHERE block_no = 0
 UNION ALL SELECT n.rid, n.block_no, least(greatest(start_s - 7, x.ne), end_s - 8), greatest(least(end_s + 5, coalesce(after, duration_s)), least(greatest(start_s - 7, x.ne), end_s - 8) + 8) FROM x JOIN nb n ON n.rid = x.rid AND n.block_no = x.block_no + 1)""",
    recursive=True, select="SELECT rid, block_no, ns AS start_s, ne AS end_s FROM x"))
def b18(spark, d):
    return B.extend(blocks(spark, d), durations(spark, d), 7.0, 5.0, 8.0)


OPTIONS = Options(fps=1.0, min_block_s=8, max_block_s=60, max_block_fraction=0.5, min_show_segment_s=6, min_absent_open_s=3, logo_threshold=0.43, refine_window_s=4, max_ad_gap_s=10, letterbox_snap_s=3, iframe_snap_s=5, logo_smooth_s=24, nn_weight=0.0, logo_cross_refine_s=2)


def _stage_sql(nth: int, near: str, to: str) -> str:
    """CTEs that take the edges e<nth - 1> to e<nth>: near finds candidates (p) for each, to is what becomes of them."""
    e = f"e{nth - 1}"
    return f"""n{nth} AS ({near.format(e=e)}),
e{nth} AS (SELECT e.rid, e.block_no, e.edge, coalesce(b.p, e.t) AS t FROM {e} e LEFT JOIN (SELECT rid, block_no, edge, {to} AS p FROM n{nth} GROUP BY rid, block_no, edge) b USING (rid, block_no, edge))"""


FORM = ",\n".join([
    "e0 AS (SELECT * FROM edges)",
    _stage_sql(1, """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid, block_no, edge ORDER BY score DESC, CASE WHEN ahead < 0 THEN -2 * ahead ELSE ahead END, o, p, pos) AS k FROM
 (SELECT *, sum(w) OVER (PARTITION BY rid, block_no, edge ORDER BY p RANGE BETWEEN 2.0 PRECEDING AND 2.0 FOLLOWING) AS score FROM
 (SELECT e.*, c.anchor AS p, c.o, c.w, c.pos, CASE WHEN edge = 'START' THEN anchor - t ELSE t - anchor END AS ahead FROM {e} e JOIN cand c ON e.rid = c.rid AND e.edge = c.side AND abs(anchor - t) <= 4.0) WHERE ahead >= -4.0)) WHERE k = 1""", "any_value(p)"),
    _stage_sql(2, "SELECT e.*, f.time_s AS p FROM {e} e JOIN frames f ON e.rid = f.rid AND f.idx % 12 = 0 AND abs(f.time_s - e.t) <= 5", "arg_min(p, struct_pack(d := abs(p - t), p := p))"),
    _stage_sql(3, "SELECT e.*, s.start_s AS p FROM {e} e JOIN sig s ON e.rid = s.rid AND ((edge = 'START' AND kind = 'onset' AND s.start_s BETWEEN e.t - 3 AND e.t + 5) OR (edge = 'END' AND kind = 'offset' AND s.start_s BETWEEN e.t - 5 AND e.t + 3))", "CASE WHEN edge = 'START' THEN min(p) ELSE max(p) END"),
    "turns AS (SELECT rid, idx AS i, now FROM (SELECT rid, idx, s >= 0.43 AS now, lag(s >= 0.43) OVER (PARTITION BY rid ORDER BY idx) AS was FROM sm) WHERE now <> was)",
    _stage_sql(4, "SELECT e.*, i::DOUBLE AS p FROM {e} e JOIN turns c ON e.rid = c.rid AND i BETWEEN trunc(t) - 2 AND trunc(t) + 2 AND i - 1 >= trunc(t) - 2 AND now = (edge = 'END')", "arg_min(p, struct_pack(d := abs(p - trunc(t)), p := p))"),
    "bl AS (SELECT rid, block_no, max(t) FILTER (edge = 'START') AS s, max(t) FILTER (edge = 'END') AS e FROM e4 GROUP BY rid, block_no)",
    "lo AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY s, e) AS nth FROM bl WHERE e - s >= 8)",
    "gm AS (SELECT *, sum(CASE WHEN gap <= 10 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY nth) AS g FROM (SELECT *, s - lag(e) OVER (PARTITION BY rid ORDER BY nth) AS gap FROM lo))",
    "ga AS (SELECT rid, g, arg_min(s, nth) AS s, arg_max(e, nth) AS e FROM gm GROUP BY rid, g)",
    "ru AS (SELECT ga.rid, s, e FROM ga JOIN nf USING (rid) WHERE NOT e - s > 0.5 * duration_s)",
    "cs AS (SELECT rid, (start_s + end_s) / 2 AS c FROM sig WHERE kind = 'black')",
    """sp AS (SELECT rid, s, e FROM ru UNION ALL
 SELECT rid, CASE WHEN h = 0 THEN s ELSE c END, CASE WHEN h = 0 THEN c ELSE e END FROM (SELECT sp.rid, s, e, (SELECT arg_min(c, struct_pack(d := abs(c - (s + e) / 2), c := c)) FROM cs WHERE cs.rid = sp.rid AND c > s AND c < e) AS c FROM sp WHERE e - s > 60), (VALUES (0), (1)) v(h) WHERE c IS NOT NULL)""",
])


@query("form_full", sql(FRAMES, BLOCKS, SIG, VOTE.split(",\nnear AS")[0], FORM, recursive=True, select="""SELECT rid, (row_number() OVER (PARTITION BY rid ORDER BY s, e) - 1)::BIGINT AS block_no, round(s, 6) AS start_s, round(e, 6) AS end_s FROM sp
 WHERE e - s <= 60 OR NOT EXISTS (SELECT 1 FROM cs WHERE cs.rid = sp.rid AND c > s AND c < e)"""))
def form_full(spark, d):
    e = events(spark, d).unionByName(frames(spark, d).where("idx % 12 = 0").select("rid", F.lit("iframe").alias("kind"), F.col("time_s").alias("start_s"), F.col("time_s").alias("end_s"), F.col("idx").alias("pos")))
    out = B.form(frames(spark, d).select("rid", "idx", "time_s", "logo"), e, OPTIONS)
    return out.select("rid", "block_no", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


@query("e1_black_runs", sql(FRAMES, "f AS (SELECT rid, idx, value < 20 AS b FROM frames)", select="""SELECT rid, min(idx) / 25.0 AS start_s, (min(idx) + count(*)) / 25.0 AS end_s, round((min(idx) + count(*)) / 25.0 - min(idx) / 25.0, 9) AS duration_s
 FROM (SELECT *, idx - row_number() OVER (PARTITION BY rid, b ORDER BY idx) AS g FROM f) WHERE b GROUP BY rid, g HAVING (min(idx) + count(*)) / 25.0 - min(idx) / 25.0 >= 0.1"""))
def e1(spark, d):
    return E.black_runs(frames(spark, d).withColumn("black", F.col("value") < 20), 25.0, 0.1).withColumn("duration_s", F.round("duration_s", 9))


@query("e3_letterbox_transitions", sql(FRAMES, """f AS (SELECT rid, idx, event_id % 40 < 12 AS framed FROM frames),
i AS (SELECT rid, framed, min(idx) AS first, count(*) AS n FROM (SELECT *, idx - row_number() OVER (PARTITION BY rid, framed ORDER BY idx) AS g FROM f) GROUP BY rid, framed, g),
k AS (SELECT *, lag(framed) OVER (PARTITION BY rid ORDER BY first) AS was FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY first) AS nth FROM i) WHERE nth = 1 OR n >= 3)""", select="SELECT rid, first AS idx, first / 6.0 AS time_s, framed AS onset FROM k WHERE was IS NOT NULL AND was <> framed"))
def e3(spark, d):
    return E.letterbox_transitions(frames(spark, d).withColumn("framed", F.col("event_id") % 40 < 12), 6.0)


@query("e4_coalesce", sql(FRAMES, SIG, "b AS (SELECT *, max(end_s) OVER (PARTITION BY rid ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sig WHERE kind = 'black')", "g AS (SELECT *, sum(CASE WHEN start_s - reach <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY start_s, end_s) AS g FROM b)",
    select="SELECT rid, min(start_s) AS start_s, max(end_s) AS end_s FROM g GROUP BY rid, g"))
def e4(spark, d):
    return E.coalesced(events(spark, d).where("kind = 'black'"), 2.0)


@query("e6_pred_blocks", sql(FRAMES, runs_sql("p", "pred", 2), select="SELECT * FROM p"))
def e6(spark, d):
    return E.predicted_blocks(frames(spark, d), 1.0, 2.0)


@query("e7_error_runs", sql(FRAMES, runs_sql("t", "truth"), """w AS (SELECT rid, min(idx) AS a, max(idx) AS z, count(*) AS n, arg_min(pred, idx) AS p FROM (SELECT *, pred <> truth AS w, idx - row_number() OVER (PARTITION BY rid, pred <> truth ORDER BY idx) AS g FROM frames) WHERE w GROUP BY rid, g HAVING count(*) >= 2)""",
    select="SELECT rid, a AS start_idx, z AS end_idx, n, CASE WHEN p = 1 THEN 'FP' ELSE 'FN' END AS kind, EXISTS (SELECT 1 FROM t WHERE t.rid = w.rid AND least(abs(t.start_s - a), abs(t.start_s - z), abs(t.end_s - a), abs(t.end_s - z)) < 3) AS boundary FROM w"))
def e7(spark, d):
    from framewright.plans.views import truth

    edges = truth(spark, d).select("rid", F.explode(F.array("start_s", "end_s")).alias("edge_s"))
    return E.error_runs(frames(spark, d), edges, 3.0, 2)


RECORDINGS = "rec AS (SELECT rid, 25.0::DOUBLE AS fps, 720 AS width, 576 AS height, count(*) AS frame_count FROM frames GROUP BY rid)"


def recordings(spark, d):
    return frames(spark, d).groupBy("rid").agg(F.count("*").alias("frame_count")).select("rid", F.lit(25.0).alias("fps"), F.lit(720).alias("width"), F.lit(576).alias("height"), "frame_count", F.lit(0.5).alias("elapsed_s"))


@query("k1_summary_json", sql(FRAMES, BLOCKS, RECORDINGS, select="""SELECT r.rid, '{"fps":25.0,"width":720,"height":576,"frame_count":' || frame_count || ',"duration_s":' || frame_count / fps || ',"blocks":[' || coalesce(string_agg('[' || start_s || ',' || end_s || ']', ',' ORDER BY start_s), '')
 || ']' || ',"stats":{"elapsed_s":0.5,"fps_proc":' || (frame_count * 2)::DOUBLE || '}}' AS value FROM rec r LEFT JOIN blocks b ON r.rid = b.rid GROUP BY r.rid, frame_count, fps"""))
def k1(spark, d):
    return sinks.summaries(recordings(spark, d), blocks(spark, d))


@query("k3_scene_listing", sql(FRAMES, select="SELECT rid, time_s, printf('scene frame=%d t=%.3f dist=%.3f', idx, time_s, nn) AS value FROM frames WHERE event_type = 'click'"))
def k3_scene(spark, d):
    cuts = frames(spark, d).where("event_type = 'click'")
    return sinks.scene_listing(cuts.select("rid", "idx", "time_s", F.col("nn").alias("distance")))


@query("k9_json_lines", sql(FRAMES, select="""SELECT rid, idx, '{"idx":' || idx || ',"event_type":"' || event_type || '","truth":' || truth || '}' AS value FROM frames"""))
def k9(spark, d):
    return sinks.json_lines(frames(spark, d), "idx", "event_type", "truth")


@query("k2_cutlist", sql(FRAMES, BLOCKS, RECORDINGS, select="""SELECT r.rid, 'FILE PROCESSING COMPLETE  ' || frame_count || ' FRAMES AT  2500' || chr(10) || '-------------------' || coalesce(string_agg(chr(10) || floor(start_s * 25 + 0.5)::BIGINT || chr(9) || floor(end_s * 25 + 0.5)::BIGINT, '' ORDER BY start_s), '') AS value
 FROM rec r LEFT JOIN blocks b ON r.rid = b.rid GROUP BY r.rid, frame_count"""))
def k2(spark, d):
    return sinks.cutlists(recordings(spark, d), blocks(spark, d))


@query("k3_event_listing", sql(FRAMES, SIG, select="SELECT rid, start_s, printf('blackframe start=%.3f end=%.3f duration=%.3f', start_s, end_s, end_s - start_s) AS value FROM sig WHERE kind = 'black'"))
def k3(spark, d):
    return sinks.run_listing(events(spark, d).where("kind = 'black'"), "blackframe")


@query("k3_series_listing", sql(FRAMES, select="SELECT rid, idx, printf('%d,%.3f,%.4f', idx, idx / 25.0, nn) AS value FROM frames"))
def k3_series(spark, d):
    return sinks.series_listing(frames(spark, d), "nn", 25.0)


@query("k3_letterbox_listing", sql(FRAMES, SIG, select="SELECT rid, start_s AS time_s, printf('letterbox %s frame=%d t=%.3f', kind, pos, start_s) AS value FROM sig WHERE kind IN ('onset', 'offset')"))
def k3_letterbox(spark, d):
    turns = events(spark, d).where("kind IN ('onset', 'offset')")
    return sinks.letterbox_listing(turns.select("rid", F.col("start_s").alias("time_s"), (F.col("kind") == "onset").alias("onset"), F.col("pos").alias("idx")))
