"""Queries of pixels, parsers, labels, evaluation, speakers and the head."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from framewright.functions import text as X
from framewright.operators import evaluate as V
from framewright.operators import events as E
from framewright.operators import labels as L
from framewright.operators import model as M
from framewright.operators import pixels as P
from framewright.operators import speaker as S
from framewright.plans.views import FRAMES, PIX, SIDE, SIG, _read, events, frames, image, runs_sql, sql, truth
from framewright.sources import logs

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return keep


# ---- pixels


@query("p1_luma", "SELECT l_orderkey, l_linenumber, ((77 * (l_partkey % 256) + 150 * (l_suppkey % 256) + 29 * (l_orderkey % 256)) >> 8)::BIGINT AS luma FROM lineitem")
def p1(spark, d):
    v = P.luma(*(F.col(c) % 256 for c in ("l_partkey", "l_suppkey", "l_orderkey")))
    return _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", v.cast("bigint").alias("luma"))


@query("p2_black_frame", sql(PIX, select="SELECT frame, count(*) FILTER (v <= 128) >= 0.5 * count(*) AS black FROM pix GROUP BY frame"))
def p2(spark, d):
    return P.measured(image(spark, d), SIDE, SIDE, P.black(0.5, 0.5)).drop("rid")


def histograms(spark, d):
    return P.measured(image(spark, d), SIDE, SIDE, P.histogram())


@query("p3_rgb_hist", sql(PIX, select="SELECT frame, ((v >> 5) << 6) | ((v >> 5) << 3) | (v >> 5) AS bin, count(*) / 64.0 AS p FROM pix GROUP BY ALL"))
def p3(spark, d):
    return P.colour_shares(histograms(spark, d)).drop("rid")


DIST = """h AS (SELECT frame, v >> 5 AS b, count(*) / 64.0 AS p FROM pix GROUP BY ALL),
f AS (SELECT frame FROM pix GROUP BY frame),
dist AS (SELECT f.frame, 1 - least(1.0, coalesce(sum(sqrt(a.p * q.p)), 0)) AS distance FROM f LEFT JOIN h a ON a.frame = f.frame LEFT JOIN h q ON q.frame = f.frame - 1 AND q.b = a.b WHERE f.frame > (SELECT min(frame) FROM f) GROUP BY f.frame)"""


@query("p4_bhattacharyya", sql(PIX, DIST, select="SELECT frame, round(distance, 9) AS distance FROM dist"))
def p4(spark, d):
    return P.frame_distances(histograms(spark, d)).select("frame", F.round("distance", 9).alias("distance"))


@query("e2_scene_cuts", sql(PIX, DIST, select="SELECT frame AS idx, frame / 25.0 AS time_s, round(distance, 9) AS distance FROM dist WHERE distance > 0.0301"))
def e2(spark, d):
    dist = P.frame_distances(histograms(spark, d)).withColumnRenamed("frame", "idx")
    return E.scene_cuts(dist, 25.0, 0.0301).drop("rid").withColumn("distance", F.round("distance", 9))


SOBEL = """sob AS (SELECT c.frame, c.x, c.y, sum(n.v * (n.x - c.x) * CASE WHEN n.y = c.y THEN 2 ELSE 1 END)::BIGINT AS gx, sum(n.v * (n.y - c.y) * CASE WHEN n.x = c.x THEN 2 ELSE 1 END)::BIGINT AS gy
 FROM pix c JOIN pix n ON n.frame = c.frame AND abs(n.x - c.x) <= 1 AND abs(n.y - c.y) <= 1 AND NOT (n.x = c.x AND n.y = c.y) WHERE c.x BETWEEN 1 AND 6 AND c.y BETWEEN 1 AND 6 GROUP BY ALL)"""


@query("p5_sobel", sql(PIX, SOBEL, select="SELECT frame, x, y, gx, gy, abs(gx) + abs(gy) AS magnitude FROM sob"))
def p5(spark, d):
    return P.sobel(image(spark, d), SIDE, SIDE).drop("rid")


@query("p6_logo_conf", sql(PIX, SOBEL, select="SELECT frame, count(*) FILTER (abs(gx) + abs(gy) > 80 AND (x + y) % 2 = 0 AND y >= 2) / 28.0 AS confidence FROM sob GROUP BY frame"))
def p6(spark, d):
    cells = np.array([(x, y) for y in range(1, SIDE) for x in range(SIDE) if (x + y) % 2])
    return P.measured(image(spark, d), SIDE, SIDE, P.logo(cells, 80, 1)).drop("rid")


@query("p7_bumper_iou", sql(PIX, "w AS (SELECT frame, i, v > 120 AS on_ FROM pix)", select="""SELECT frame, max(iou) AS iou FROM (SELECT a.frame, t.frame AS k, coalesce(round(count(*) FILTER (a.on_ AND t.on_) / nullif(count(*) FILTER (a.on_ OR t.on_), 0), 9), 0) AS iou
 FROM w a JOIN w t USING (i) WHERE t.frame < 3 GROUP BY ALL) GROUP BY frame"""))
def p7(spark, d):
    bits = P.measured(image(spark, d), SIDE, SIDE, P.white(120))
    return P.bumper_iou(bits, bits.where("frame < 3").select(F.col("words").alias("mask"))).select("frame", F.round("iou", 9).alias("iou"))


@query("p8_letterbox_frame", sql(PIX, select="SELECT frame, count(*) FILTER (y < 2 AND v <= 130) >= floor(16 * 0.5) AND count(*) FILTER (y >= 6 AND v <= 130) >= floor(16 * 0.5) AS framed FROM pix GROUP BY frame"))
def p8(spark, d):
    return P.measured(image(spark, d), SIDE, SIDE, P.letterbox(2, 130, 0.5)).drop("rid")


COUNTS = "ec AS (SELECT x, y, count(*) FILTER (abs(gx) > 40) AS h, count(*) FILTER (abs(gy) > 40) AS v FROM sob GROUP BY x, y)"


@query("a3_edge_counts", sql(PIX, SOBEL, COUNTS, select="SELECT * FROM ec"))
def a3(spark, d):
    return P.edge_counts(image(spark, d), SIDE, SIDE, 40)


def pictures(spark, d):
    """How many pictures there are, as a number that the plan finds."""
    return _read(spark, d, "embeddings").agg(F.count("*")).scalar()


@query("a4_bbox", sql(PIX, SOBEL, COUNTS, "n AS (SELECT count(DISTINCT frame) AS n FROM pix)", select="SELECT greatest(min(x) - 1, 0) AS min_x, least(max(x) + 1, 7) AS max_x, greatest(min(y) - 1, 0) AS min_y, least(max(y) + 1, 7) AS max_y, count(*) AS edges FROM ec, n WHERE greatest(h, v) >= floor(n * 0.5)"))
def a4(spark, d):
    return P.bounding_box(P.edge_counts(image(spark, d), SIDE, SIDE, 40), pictures(spark, d), 0.5, 1, SIDE, SIDE)


@query("a5_persistence_sweep", sql("ps AS (SELECT 0 AS step, 0.3::DOUBLE AS p UNION ALL SELECT step + 1, p + 0.02::DOUBLE FROM ps WHERE p + 0.02::DOUBLE < 1)", PIX, SOBEL, COUNTS, "n AS (SELECT count(DISTINCT frame) AS n FROM pix)",
    "bx AS (SELECT step, p AS persistence, greatest(min(x) - 1, 0) AS min_x, least(max(x) + 1, 7) AS max_x, greatest(min(y) - 1, 0) AS min_y, least(max(y) + 1, 7) AS max_y, count(*) AS edges FROM ps, n, ec WHERE greatest(h, v) >= trunc(n * p) GROUP BY step, p)",
    recursive=True, select="SELECT round(persistence, 9) AS persistence, min_x, max_x, min_y, max_y, edges, area FROM (SELECT *, (max_x - min_x + 1) * (max_y - min_y + 1) AS area FROM bx) ORDER BY area > 49, CASE WHEN area <= 49 THEN step ELSE -step END LIMIT 1"))
def a5(spark, d):
    return P.persistence_sweep(P.edge_counts(image(spark, d), SIDE, SIDE, 40), pictures(spark, d), 0.3, 49, 1, SIDE, SIDE).withColumn("persistence", F.round("persistence", 9))


@query("t1_top_pixels", sql(PIX, SOBEL, COUNTS, select="SELECT *, greatest(h, v) AS score FROM ec WHERE greatest(h, v) > 0 ORDER BY score DESC, y, x LIMIT 10"))
def t1(spark, d):
    return P.top_pixels(P.edge_counts(image(spark, d), SIDE, SIDE, 40), 10)


# ---- parsers


def log_lines(spark, d, line):
    f = frames(spark, d)
    return f.select("rid", F.col("idx").alias("line_no"), line(f).alias("line"))


@query("s2_fps_parse", "SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 7 = 0 THEN 0.0 ELSE (l_partkey % 61 * 1000)::DOUBLE / (l_suppkey % 7 * 100 + 1) END AS fps FROM lineitem")
def s2(spark, d):
    s = F.when(F.col("l_suppkey") % 7 == 0, F.lit("25/0")).otherwise(F.format_string("%d/%d", F.col("l_partkey") % 61 * 1000, F.col("l_suppkey") % 7 * 100 + 1))
    return _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.rate(s).alias("fps"))


@query("s4_silence_parse", sql(FRAMES, "m AS (SELECT *, lag(CASE WHEN event_type = 'view' THEN idx END) OVER (PARTITION BY rid ORDER BY idx) AS st FROM frames WHERE event_type IN ('view', 'click'))", select="SELECT rid, st::DOUBLE AS start_s, idx::DOUBLE AS end_s, (event_id % 100)::DOUBLE AS duration_s FROM m WHERE event_type = 'click' AND st IS NOT NULL"))
def s4(spark, d):
    line = lambda f: F.when(f.event_type == "view", F.format_string("[silencedetect] silence_start: %d", "idx")).when(f.event_type == "click", F.format_string("silence_end: %d | silence_duration: %d", F.col("idx"), F.col("event_id") % 100)).otherwise("frame=1 fps=25")
    return logs.silence(log_lines(spark, d, line))


@query("s5_silence_detect", sql(FRAMES, select="""SELECT rid, min(idx)::DOUBLE AS start_s, (min(idx) + count(*))::DOUBLE AS end_s, count(*)::DOUBLE AS duration_s FROM (SELECT rid, idx, logo < 0.31622776601683794 AS q, idx - row_number() OVER (PARTITION BY rid, logo < 0.31622776601683794 ORDER BY idx) AS g FROM frames)
 WHERE q GROUP BY rid, g HAVING count(*) >= 2"""))
def s5(spark, d):
    return logs.silence_from_level(frames(spark, d).select("rid", "idx", F.col("logo").alias("rms")), -10.0, 2.0)


@query("s6_iframe_list", sql(FRAMES, select="SELECT rid, time_s AS t FROM frames WHERE idx % 12 = 0"))
def s6(spark, d):
    times = logs.iframes(log_lines(spark, d, lambda f: F.when(f.idx % 12 == 0, F.format_string("%.6f", "time_s")).when(f.idx % 12 == 1, "N/A").otherwise("")))
    return times.select("rid", F.explode("times").alias("t"))


@query("s7_rms_normalise", sql(FRAMES, "n AS (SELECT rid, count(*) AS n FROM frames GROUP BY rid)", "r AS (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY idx) - 1 AS sec, CASE WHEN event_id % 11 = 0 THEN 0.0 ELSE greatest(least((60.0 - event_id % 97) / 60, 1), 0) END AS l FROM frames WHERE event_type <> 'signup')",
    select="SELECT n.rid, s.sec, round(coalesce(l, 0.5), 9) AS level FROM n, LATERAL (SELECT unnest(range(n.n)) AS sec) s LEFT JOIN r ON r.rid = n.rid AND r.sec = s.sec"))
def s7(spark, d):
    line = lambda f: F.when(f.event_type == "signup", "noise").when(f.event_id % 11 == 0, "RMS_level=-inf").otherwise(F.format_string("lavfi.astats.RMS_level=%d", -(F.col("event_id") % 97)))
    n = frames(spark, d).groupBy("rid").agg(F.count("*").alias("n"))
    return logs.loudness(log_lines(spark, d, line), n).withColumn("level", F.round("level", 9))


@query("s9_template_cells", "SELECT vec_id AS rid, 10 + i AS x, 20 + j AS y FROM (SELECT vec_id, unnest(range(7)) AS i, embedding FROM embeddings), (SELECT unnest(range(7)) AS j) WHERE embedding[j * 8 + i + 1] > 0")
def s9(spark, d):
    row = lambda j: F.array_join(F.transform(F.slice("embedding", j * 8 + 1, 8), lambda e: F.when(e > 0, "+").otherwise(" ")), "")
    head = F.lit("logoMinX=10\nlogoMaxX=17\nlogoMinY=20\nlogoMaxY=27\npicWidth=720\npicHeight=576\n\nCombined Logo Mask\n\u0082")
    files = _read(spark, d, "embeddings").select(F.col("vec_id").alias("rid"), F.concat_ws("\n", head, *(row(j) for j in range(8))).alias("value"))
    return logs.logo_template(files)


@query("s12_label_json", sql(FRAMES, select="SELECT event_id AS rid, CASE WHEN k = 2 THEN 'deleted' ELSE 'user' END AS source, idx::DOUBLE + k AS start_s, idx::DOUBLE + k + 9 AS end_s FROM frames, (VALUES (0), (2)) v(k) WHERE event_id % 5 <> 4 AND (k = 0 OR event_id % 2 = 1)"))
def s12(spark, d):
    j = F.when(F.col("event_id") % 5 == 4, "{broken").when(F.col("event_id") % 2 == 0, F.format_string("[[%d.0, %d]]", "idx", F.col("idx") + 9)).otherwise(
        F.format_string('{"ads": [[%d, %d]], "deleted": [[%d, %d]], "confirmed_show": true}', F.col("idx"), F.col("idx") + 9, F.col("idx") + 2, F.col("idx") + 11))
    return logs.labels(frames(spark, d).select(F.col("event_id").alias("rid"), j.alias("value")))


@query("s15_cutlist_parse", sql(FRAMES, "b AS (SELECT rid, idx * 100.0 AS s, idx * 100.0 + value AS e FROM (SELECT rid, idx, floor(value * 25)::BIGINT / 25.0 AS value FROM frames) WHERE value >= 60)", "c AS (SELECT *, max(e) OVER (PARTITION BY rid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b)", "g AS (SELECT *, sum(CASE WHEN s - reach <= 45 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY s, e) AS g FROM c)",
    select="SELECT rid, min(s)::DOUBLE AS start_s, max(e)::DOUBLE AS end_s FROM g GROUP BY rid, g"))
def s15(spark, d):
    f = frames(spark, d)
    body = f.select("rid", (F.col("idx") + 1).alias("line_no"), F.format_string("%d\t%d", F.col("idx") * 2500, F.col("idx") * 2500 + F.floor(F.col("value") * 25)).alias("line"))
    head = f.select("rid").distinct().select("rid", F.lit(0).cast("bigint").alias("line_no"), F.lit("FILE PROCESSING COMPLETE  5 FRAMES AT  2500").alias("line"))
    return logs.cutlist(body.unionByName(head))


@query("s17_uniformity", sql(FRAMES, "n AS (SELECT rid, count(*) // 2 AS n FROM frames GROUP BY rid)", "m AS (SELECT *, last_value(CASE WHEN idx % 2 = 0 THEN event_id % 90 END IGNORE NULLS) OVER (PARTITION BY rid ORDER BY idx) AS lo FROM frames)", "u AS (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY idx) - 1 AS sec, greatest(least((event_id % 255 - lo) / 200.0, 1), 0) AS u FROM m WHERE idx % 2 = 1)",
    select="SELECT n.rid, s.sec, round(coalesce(u, 0.5), 9) AS uniformity FROM n, LATERAL (SELECT unnest(range(n.n)) AS sec) s LEFT JOIN u ON u.rid = n.rid AND u.sec = s.sec"))
def s17(spark, d):
    line = lambda f: F.when(f.idx % 2 == 0, F.format_string("YLOW=%d", F.col("event_id") % 90)).otherwise(F.format_string("YHIGH=%d", F.col("event_id") % 255))
    n = frames(spark, d).groupBy("rid").agg(F.floor(F.count("*") / 2).alias("n"))
    return logs.uniformity(log_lines(spark, d, line), n).withColumn("uniformity", F.round("uniformity", 9))


@query("s18_crop_offset", sql(FRAMES, select="SELECT rid, CASE WHEN y < 8 THEN 0 ELSE greatest(0, y - 20) END AS y_offset FROM (SELECT rid, arg_max(event_id % 90, idx) AS y FROM frames WHERE idx % 3 = 0 GROUP BY rid)"))
def s18(spark, d):
    return logs.crop_offset(log_lines(spark, d, lambda f: F.when(f.idx % 3 == 0, F.format_string("crop=720:400:0:%d", F.col("event_id") % 90)).otherwise("size=N/A")))


SLUG = "regexp_replace(regexp_replace({}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query("slug_a", "SELECT doc_id, " + SLUG.format("replace(replace(replace(replace(lower(text), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')") + " AS slug FROM documents")
def slug_a(spark, d):
    return _read(spark, d, "documents").select("doc_id", X.slug(F.col("text")).alias("slug"))


@query("slug_b", "SELECT doc_id, " + SLUG.format("lower(text)") + " AS slug FROM documents")
def slug_b(spark, d):
    return _read(spark, d, "documents").select("doc_id", X.plain_slug(F.col("text")).alias("slug"))


# ---- labels and evaluation

T, PR = runs_sql("t", "truth"), runs_sql("p", "pred")


@query("j1_speaker_expand", sql(FRAMES, "w AS (SELECT rid, speaker AS conf, nn > 0.3 AS has_speech, row_number() OVER (PARTITION BY rid ORDER BY idx) - 1 AS w FROM frames WHERE idx % 4 = 0)", select="SELECT f.rid, f.idx, CASE WHEN has_speech THEN conf ELSE 0.5 END AS speaker FROM frames f LEFT JOIN w ON w.rid = f.rid AND w.w = f.idx // 4"))
def j1(spark, d):
    f = frames(spark, d)
    w = f.where("idx % 4 = 0").select("rid", "time_s", F.col("speaker").alias("conf"), (F.col("nn") > 0.3).alias("has_speech"))
    return S.expanded(f.select("rid", "idx", "time_s"), w).select("rid", "idx", "speaker")


@query("j2_rms_join", sql(FRAMES, "r AS (SELECT rid, idx AS sec, nn AS level FROM frames WHERE idx % 3 <> 0)", select="SELECT f.rid, f.idx, coalesce(level, 0.5) AS level FROM frames f LEFT JOIN r ON r.rid = f.rid AND r.sec = f.idx // 25"))
def j2(spark, d):
    f = frames(spark, d)
    r = f.where("idx % 3 <> 0").select("rid", F.col("idx").alias("sec"), F.col("nn").alias("level"))
    return f.select("rid", "idx", (F.col("idx") / 25).cast("bigint").alias("sec")).join(r, ["rid", "sec"], "left").select("rid", "idx", F.coalesce("level", F.lit(0.5)).alias("level"))


@query("j3_label_frames", sql(FRAMES, T, select="SELECT rid, idx, (EXISTS (SELECT 1 FROM t WHERE t.rid = f.rid AND f.time_s BETWEEN start_s AND end_s))::INT AS label FROM frames f"))
def j3(spark, d):
    return L.labelled(frames(spark, d), truth(spark, d)).select("rid", "idx", "label")


@query("j4_half_open_label", sql(FRAMES, T, select="SELECT rid, idx, (EXISTS (SELECT 1 FROM t WHERE t.rid = f.rid AND f.time_s >= start_s AND f.time_s < end_s))::INT AS label FROM frames f"))
def j4(spark, d):
    return L.labelled(frames(spark, d), truth(spark, d), half_open=True).select("rid", "idx", "label")


@query("j5_smart_merge", sql(FRAMES, T, PR, "u AS (SELECT * FROM t WHERE start_s % 3 = 0)", "del AS (SELECT * FROM t WHERE start_s % 5 = 1)", select="SELECT rid, start_s, end_s, 'auto' AS source FROM p WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM u UNION ALL SELECT * FROM del) x WHERE x.rid = p.rid AND x.start_s < p.end_s AND x.end_s > p.start_s) UNION ALL SELECT *, 'user' FROM u"))
def j5(spark, d):
    t = truth(spark, d)
    return L.smart_merge(truth(spark, d, "pred"), t.where("start_s % 3 = 0"), t.where("start_s % 5 = 1"), 8.0)


@query("j6_block_iou", sql(FRAMES, T, PR, "b AS (SELECT t.rid, t.start_s, coalesce(max(CASE WHEN p.rid IS NULL THEN 0 ELSE (least(t.end_s, p.end_s) - greatest(t.start_s, p.start_s)) / (greatest(t.end_s, p.end_s) - least(t.start_s, p.start_s)) END), 0) AS iou FROM t LEFT JOIN p ON p.rid = t.rid AND p.start_s < t.end_s AND p.end_s > t.start_s GROUP BY t.rid, t.start_s)", select="SELECT rid, round(avg(iou), 9) AS iou FROM b GROUP BY rid"))
def j6(spark, d):
    return V.block_iou(truth(spark, d), truth(spark, d, "pred"), frames(spark, d), 8.0).select("rid", F.round("iou", 9).alias("iou"))


@query("j7_match_miss_extra", sql(FRAMES, T, PR, "m AS (SELECT t.rid, t.start_s AS ts, t.end_s AS te, p.start_s AS ps, p.end_s AS pe FROM t JOIN p ON p.rid = t.rid AND p.start_s < t.end_s AND p.end_s > t.start_s)",
    select="SELECT rid, 'matched' AS kind, ts AS start_s, te AS end_s FROM m UNION ALL SELECT rid, 'missed', start_s, end_s FROM t WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.rid = t.rid AND m.ts = t.start_s) UNION ALL SELECT rid, 'extra', start_s, end_s FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.rid = p.rid AND m.ps = p.start_s)"))
def j7(spark, d):
    return V.matches(truth(spark, d), truth(spark, d, "pred"), 8.0)


@query("j8_proximity", sql(FRAMES, SIG, "x AS (SELECT b.rid, b.start_s AS bs, b.end_s AS be, s.start_s AS ss, s.end_s AS se, greatest(s.start_s - b.end_s, b.start_s - s.end_s) AS gap FROM sig b JOIN sig s ON s.rid = b.rid AND b.kind = 'black' AND s.kind = 'silence' WHERE greatest(s.start_s - b.end_s, b.start_s - s.end_s) <= 1.5)", "y AS (SELECT *, row_number() OVER (PARTITION BY rid, bs, be ORDER BY gap, ss, se) AS k FROM x)",
    select="SELECT rid, round((least(bs, ss) + greatest(be, se)) / 2, 3) AS t, round(greatest(be, se) - least(bs, ss), 3) AS dur, round(gap, 3) AS gap FROM y WHERE k = 1"))
def j8(spark, d):
    e = events(spark, d)
    return V.proximity(e.where("kind = 'black'"), e.where("kind = 'silence'"))


@query("j9_boundary_boost", sql(FRAMES, T, SIG, "e AS (SELECT rid, unnest([start_s, end_s]) AS x FROM t)", "n AS (SELECT * FROM e WHERE EXISTS (SELECT 1 FROM sig WHERE sig.rid = e.rid AND kind = 'black' AND abs(sig.start_s - e.x) <= 1))", select="SELECT rid, idx, EXISTS (SELECT 1 FROM n WHERE n.rid = f.rid AND abs(n.x - f.time_s) <= 1) AS boosted FROM frames f"))
def j9(spark, d):
    edges = truth(spark, d).select("rid", F.explode(F.array("start_s", "end_s")).alias("edge_s"))
    bumpers = events(spark, d).where("kind = 'black'").select("rid", F.col("start_s").alias("t"))
    return L.bumper_boost(frames(spark, d), edges, bumpers, 1.0).select("rid", "idx", "boosted")


@query("j11_usable_episodes", "SELECT c_custkey FROM customer WHERE c_nationkey = 3 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000) AND c_custkey IN (SELECT vec_id FROM embeddings)")
def j11(spark, d):
    c = _read(spark, d, "customer").where("c_nationkey = 3")
    edited = _read(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(edited, "c_custkey", "left_semi").join(_read(spark, d, "embeddings").select(F.col("vec_id").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("j12_pending_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT vec_id FROM embeddings WHERE label < 7) ORDER BY c_custkey LIMIT 50")
def j12(spark, d):
    done = _read(spark, d, "embeddings").where("label < 7").select(F.col("vec_id").alias("c_custkey"))
    return _read(spark, d, "customer").join(done, "c_custkey", "left_anti").select("c_custkey").orderBy("c_custkey").limit(50)


@query("j13_zip_compare", sql(FRAMES, T, PR, "a AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY start_s, end_s) AS k, count(*) OVER (PARTITION BY rid) AS n FROM t)", "b AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY start_s, end_s) AS k, count(*) OVER (PARTITION BY rid) AS n FROM p)", "c AS (SELECT rid, coalesce(x.n, 0) AS n_truth, coalesce(y.n, 0) AS n_other FROM (SELECT rid, count(*) AS n FROM t GROUP BY rid) x FULL JOIN (SELECT rid, count(*) AS n FROM p GROUP BY rid) y USING (rid))", "z AS (SELECT a.rid, a.k AS block_no, a.start_s - b.start_s AS d_start, a.end_s - b.end_s AS d_end FROM a JOIN b USING (rid, k, n))", select="SELECT rid, coalesce(block_no, 0) AS block_no, d_start, d_end, n_truth, n_other FROM c LEFT JOIN z USING (rid)"))
def j13(spark, d):
    return V.zipped_or_counts(truth(spark, d), truth(spark, d, "pred"))


@query("a1_mean_logo", sql(FRAMES, select="SELECT rid, round(avg(logo), 9) AS mean_logo FROM frames WHERE event_type <> 'error' GROUP BY rid"))
def a1(spark, d):
    return frames(spark, d).where("event_type <> 'error'").groupBy("rid").agg(F.round(F.avg("logo"), 9).alias("mean_logo"))


@query("a2_second_mean", sql(FRAMES, "n AS (SELECT rid, max(idx) // 4 AS last FROM frames GROUP BY rid)", "m AS (SELECT rid, idx // 4 AS sec, avg(logo) AS m FROM frames WHERE value >= 30 GROUP BY ALL)", select="SELECT n.rid, s.sec, round(coalesce(m, 0.5), 9) AS logo FROM n, LATERAL (SELECT unnest(range(n.last + 1)) AS sec) s LEFT JOIN m ON m.rid = n.rid AND m.sec = s.sec"))
def a2(spark, d):
    f = frames(spark, d)
    every = f.groupBy("rid").agg(F.floor(F.max("idx") / 4).alias("last")).select("rid", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("sec"))
    mean = f.where("value >= 30").groupBy("rid", F.floor(F.col("idx") / 4).alias("sec")).agg(F.avg("logo").alias("m"))
    return every.join(mean, ["rid", "sec"], "left").select("rid", "sec", F.round(F.coalesce("m", F.lit(0.5)), 9).alias("logo"))


CENTROID = "m AS (SELECT label, i, avg(e::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL)"


@query("a6_centroid", sql(CENTROID, "n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY label)", select="SELECT label, i - 1 AS dim, round(m / n, 7) AS value FROM m JOIN n USING (label)"))
def a6(spark, d):
    return S.centroids(_read(spark, d, "embeddings"), "label").select("label", F.posexplode("centroid").alias("dim", "value")).select("label", F.col("dim").cast("bigint").alias("dim"), F.round("value", 7).alias("value"))


COS = sql(CENTROID, "n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY label)", "c AS (SELECT vec_id, label, sum(e::DOUBLE * m / n) AS cos FROM (SELECT vec_id, label, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings) JOIN m USING (label, i) JOIN n USING (label) GROUP BY ALL)", select="{}")


@query("p15_cosine_conf", COS.format("SELECT vec_id, round((1 + cos) / 2, 7) AS conf FROM c"))
def p15(spark, d):
    e = _read(spark, d, "embeddings")
    return e.join(S.centroids(e, "label"), "label").select("vec_id", F.round(S.confidence(F.col("embedding"), F.col("centroid")), 7).alias("conf"))


@query("a8_separation", COS.format("SELECT label, round(avg(1 - cos), 6) AS mean, round(quantile_cont(1 - cos, 0.5), 6) AS median, round(quantile_cont(1 - cos, 0.9), 6) AS p90, count(*) AS n FROM c GROUP BY label"))
def a8(spark, d):
    e = _read(spark, d, "embeddings")
    dist = e.join(S.centroids(e, "label"), "label").select("label", (1 - M.dot(F.col("embedding"), F.col("centroid"))).alias("distance"))
    return S.separation(dist, own="label").select("label", *(F.round(c, 6).alias(c) for c in ("mean", "median", "p90")), "n")


@query("a9_show_eval", sql(FRAMES, "c AS (SELECT event_type, count(*) FILTER (pred = 1 AND truth = 1) AS tp, count(*) FILTER (pred = 1 AND truth = 0) AS fp, count(*) FILTER (pred = 0 AND truth = 1) AS fn, count(*) FILTER (pred = 0 AND truth = 0) AS tn FROM frames GROUP BY ROLLUP (event_type))",
    "r AS (SELECT *, (tp + tn) / (tp + fp + fn + tn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM c)", select="SELECT event_type, tp, fp, fn, tn, round(accuracy, 9) AS accuracy, round(precision, 9) AS precision, round(recall, 9) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 9) AS f1 FROM r"))
def a9(spark, d):
    return V.confusion(frames(spark, d), "event_type").select("event_type", "tp", "fp", "fn", "tn", *(F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1")))


PRIOR = "o AS (SELECT event_type AS slug, minute(ts) AS minute, count(*) AS n, sum(truth) AS pos FROM frames GROUP BY ALL), mm AS (SELECT slug, sum(pos) / sum(n) AS mean FROM o GROUP BY slug), prior AS (SELECT mm.slug, k.minute, round((coalesce(pos, 0) + 5 * mean) / (coalesce(n, 0) + 5), 3) AS p FROM mm, (SELECT unnest(range(60)) AS minute) k LEFT JOIN o ON o.slug = mm.slug AND o.minute = k.minute)"


def slugged(spark, d):
    minute = X.minute_of_hour(F.unix_timestamp(F.col("ts").cast("timestamp")))
    return frames(spark, d).select(F.col("event_type").alias("slug"), minute.alias("minute"), F.col("truth").alias("label"))


@query("a10_minute_prior", sql(FRAMES, PRIOR, select="SELECT * FROM prior"))
def a10(spark, d):
    return L.minute_prior(slugged(spark, d))


@query("a11_prior_peaks", sql(FRAMES, PRIOR, select="SELECT slug, count(*) FILTER (p > m + s + 1e-12) AS peaks FROM (SELECT *, avg(p) OVER (PARTITION BY slug) AS m, stddev_pop(p) OVER (PARTITION BY slug) AS s FROM prior) GROUP BY slug"))
def a11(spark, d):
    return L.prior_peaks(L.minute_prior(slugged(spark, d)))


@query("a13_brier", sql(FRAMES, select="SELECT round(avg((nn - truth) ** 2), 9) AS brier FROM frames"))
def a13(spark, d):
    return M.brier(frames(spark, d), "nn", "truth").select(F.round("brier", 9).alias("brier"))


@query("a14_agreement", sql(FRAMES, "s AS (SELECT truth, CASE WHEN nn >= 0.7 THEN 1 WHEN nn <= 0.3 THEN 0 END AS a, CASE WHEN speaker >= 0.7 THEN 1 WHEN speaker <= 0.3 THEN 0 END AS b FROM (SELECT truth, nn + 0.005 AS nn, speaker + 0.005 AS speaker FROM frames))", "c AS (SELECT count(*) FILTER (a = 1 AND b = 1) AS both_pos, count(*) FILTER (a = 0 AND b = 0) AS both_neg, count(*) FILTER (a = 1 AND b = 0) AS only_a, count(*) FILTER (a = 0 AND b = 1) AS only_b, count(*) FILTER (a = b AND a = truth) AS right_ FROM s WHERE a IS NOT NULL AND b IS NOT NULL)",
    select='SELECT both_pos, both_neg, only_a, only_b, right_ AS "right", round(right_ / (both_pos + both_neg), 9) AS accuracy, CASE WHEN right_ / (both_pos + both_neg) >= 0.95 THEN \'GOOD\' WHEN right_ / (both_pos + both_neg) >= 0.9 THEN \'OK\' ELSE \'POOR\' END AS verdict FROM c'))
def a14(spark, d):
    f = frames(spark, d).select((F.col("nn") + 0.005).alias("p_a"), (F.col("speaker") + 0.005).alias("p_b"), F.col("truth").alias("label"))
    return M.agreement(f).withColumn("accuracy", F.round("accuracy", 9))


@query("a15_hygiene", sql(FRAMES, "m AS (SELECT *, avg(truth) OVER (PARTITION BY rid) AS rate, avg((((nn >= 0.9) AND truth = 0) OR (nn <= 0.095 AND truth = 1))::INT) OVER (PARTITION BY rid) AS share, (((nn >= 0.9) AND truth = 0) OR (nn <= 0.095 AND truth = 1)) AS wrong FROM (SELECT * REPLACE (nn + 0.005 AS nn) FROM frames))", select="SELECT rid, idx FROM m WHERE (rate <= 0.5 OR rid % 2 = 0) AND (NOT wrong OR share > 0.3)"))
def a15(spark, d):
    f = frames(spark, d).select("rid", "idx", F.col("truth").alias("label"), (F.col("nn") + 0.005).alias("nn"), (F.col("rid") % 2 == 0).alias("pseudo"))
    return L.hygiene(f, "nn").select("rid", "idx")


@query("a16_weights", sql(FRAMES, "w AS (SELECT event_id, CASE event_type WHEN 'view' THEN 2.0 WHEN 'error' THEN 0.3 ELSE 1.0 END * greatest(0, 1 - (event_id % 200) / 180.0) * CASE WHEN event_id % 7 = 0 THEN 1.5 WHEN event_id % 5 = 0 THEN 1.2 ELSE 1 END AS w FROM frames)", select="SELECT event_id, round(CASE WHEN event_id % 13 = 0 THEN greatest(CASE WHEN event_id % 11 = 0 THEN greatest(w, 1.4) ELSE w END, 1.5) WHEN event_id % 11 = 0 THEN greatest(w, 1.4) ELSE w END, 9) AS weight FROM w"))
def a16(spark, d):
    e = F.col("event_id")
    source = F.when(F.col("event_type") == "view", "user").when(F.col("event_type") == "error", "pseudo").otherwise("auto")
    w = L.sample_weight(source, (e % 200).cast("double"), e % 5 == 0, e % 7 == 0, e % 11 == 0, e % 13 == 0)
    return frames(spark, d).select("event_id", F.round(w, 9).alias("weight"))


@query("a17_pseudo_select", sql(FRAMES, "s AS (SELECT event_type AS slug, truth, CASE WHEN nn >= 0.97 AND speaker >= 0.5 THEN 1 WHEN nn <= 0.03 AND speaker < 0.5 THEN 0 END AS y FROM frames)", select="SELECT slug, count(*) AS n, round(avg((y = truth)::INT), 9) AS accuracy, CASE WHEN avg((y = truth)::INT) >= 0.95 THEN 'SAFE' WHEN avg((y = truth)::INT) >= 0.9 THEN 'RISKY' ELSE 'UNSAFE' END AS verdict FROM s WHERE y IS NOT NULL GROUP BY slug"))
def a17(spark, d):
    f = frames(spark, d).select(F.col("event_type").alias("slug"), "truth", F.col("nn").alias("p"), F.col("speaker").alias("prior"))
    out = L.pseudo_labels(f).groupBy("slug").agg(F.count("*").alias("n"), F.round(F.avg((F.col("pseudo") == F.col("truth")).cast("int")), 9).alias("accuracy"))
    return out.withColumn("verdict", L.verdict(F.col("accuracy")))


@query("t2_uncertain", sql(FRAMES, "r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY round(1 - 2 * abs(nn - 0.5), 9) DESC, idx) AS u, row_number() OVER (PARTITION BY rid ORDER BY round(CASE WHEN abs(nn - 0.5) > 0.3 THEN abs(nn - speaker) ELSE -1 END, 9) DESC, idx) AS k FROM frames)", select="SELECT rid, idx, CASE WHEN u <= 10 AND k <= 10 THEN 'both' WHEN u <= 10 THEN 'unc' ELSE 'div' END AS tag FROM r WHERE u <= 10 OR k <= 10"))
def t2(spark, d):
    return M.uncertain(frames(spark, d).select("rid", "idx", F.col("nn").alias("p"), F.col("speaker").alias("prior")), 20)


@query("t3_last_deployed", "SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def t3(spark, d):
    return _read(spark, d, "orders").where("o_orderkey % 2 = 0").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("t4_history", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 200")
def t4(spark, d):
    from framewright.sinks import history

    return history(_read(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderkey").alias("ts"))).drop("ts")


@query("u1_bucket_union", sql(FRAMES, select="SELECT rid, idx, CASE WHEN nn > 0.9 AND speaker > 0.9 THEN 'both' WHEN nn > 0.9 THEN 'a' ELSE 'b' END AS tag FROM frames WHERE nn > 0.9 OR speaker > 0.9"))
def u1(spark, d):
    f = frames(spark, d)
    a, b = f.where("nn > 0.9").select("rid", "idx", F.lit("a").alias("_a")), f.where("speaker > 0.9").select("rid", "idx", F.lit("b").alias("_b"))
    return a.join(b, ["rid", "idx"], "full").select("rid", "idx", F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "both").otherwise(F.coalesce("_a", "_b")).alias("tag"))


@query("x1_hash_split", "SELECT DISTINCT user_id, (('0x' || md5(user_id::VARCHAR)[1:13])::BIGINT)::DOUBLE / 4503599627370496 < 0.2 AS test FROM events")
def x1(spark, d):
    return _read(spark, d, "events").select("user_id").distinct().select("user_id", L.in_test(F.col("user_id").cast("string"), 0.2).alias("test"))


@query("x2_modulo_sample", sql(FRAMES, select="SELECT rid, idx, (idx + 1) % 5 = 0 AS one_based, idx % 5 = 0 AS zero_based FROM frames"))
def x2(spark, d):
    return frames(spark, d).select("rid", "idx", ((F.col("idx") + 1) % 5 == 0).alias("one_based"), (F.col("idx") % 5 == 0).alias("zero_based"))


@query("x3_stride", sql(FRAMES, select="SELECT rid, idx, CASE WHEN idx % 5 = 0 THEN nn ELSE 0 END AS bumper FROM frames"))
def x3(spark, d):
    return frames(spark, d).select("rid", "idx", F.when(F.col("idx") % 5 == 0, F.col("nn")).otherwise(0.0).alias("bumper"))


@query("x4_gate", sql(FRAMES, "h AS (SELECT * FROM frames WHERE pred = 1 ORDER BY event_id DESC LIMIT 1)", select="SELECT f.event_id, CASE WHEN f.idx % 3 <> h.idx % 3 THEN 'features' WHEN f.rid % 2 <> h.rid % 2 THEN 'test set' WHEN h.nn - f.nn > 0.05 THEN 'iou' WHEN h.speaker - f.speaker > 0.03 THEN 'accuracy' ELSE 'ok' END AS why, NOT (f.idx % 3 = h.idx % 3 AND f.rid % 2 = h.rid % 2 AND (h.nn - f.nn > 0.05 OR h.speaker - f.speaker > 0.03)) AS deploy FROM frames f, h"))
def x4(spark, d):
    run = frames(spark, d).select("event_id", F.col("event_id").alias("ts"), F.col("nn").alias("iou"), F.col("speaker").alias("acc"), (F.col("idx") % 3).alias("dim"), (F.col("rid") % 2).alias("test_size"), (F.col("pred") == 1).alias("deployed"))
    return V.gate(run, run).select("event_id", "why", "deploy")


@query("x5_pad", "SELECT vec_id, label % 5 + 66 AS size, list_sum(list_transform(embedding, lambda e: 0)) + ((label % 5 + 2) * 0.5)::DOUBLE AS fill FROM embeddings")
def x5(spark, d):
    e = _read(spark, d, "embeddings")
    size = F.col("label") % 5 + 66
    wide = F.concat("embedding", F.array_repeat(F.lit(0.5).cast("float"), size - F.size("embedding")))
    return e.select("vec_id", F.size(wide).alias("size"), F.aggregate(F.slice(wide, F.lit(65), F.size(wide)), F.lit(0.0), lambda s, x: s + x).alias("fill"))


@query("p11_head_sigmoid", "SELECT vec_id, round(1 / (1 + exp(-(-0.1 + list_sum(list_transform(range(64), lambda i: embedding[i + 1]::DOUBLE * ((i * 7) % 11 - 5) / 50.0))))), 7) AS conf FROM embeddings")
def p11(spark, d):
    w = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ((i * 7) % 11 - 5) / 50.0)
    return _read(spark, d, "embeddings").select("vec_id", F.round(M.head(F.col("embedding"), w, -0.1), 7).alias("conf"))


@query("p12_one_hot", "SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 4 ELSE 0 END AS code FROM events")
def p12(spark, d):
    hot = M.one_hot(F.col("event_type"), ("click", "purchase_", "view"))
    return _read(spark, d, "events").select("event_id", F.aggregate(F.zip_with(hot, F.array(F.lit(1), F.lit(2), F.lit(4)), lambda a, b: a.cast("int") * b), F.lit(0), lambda s, x: s + x).alias("code"))


def chunks(spark, d, vectors):
    """(rid, first, samples): the embeddings of a label in a row as sound, some vectors to a chunk."""
    nth = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    e = _read(spark, d, "embeddings").select("label", "embedding", nth.cast("bigint").alias("nth"))
    parts = e.groupBy(F.col("label").alias("rid"), F.floor(F.col("nth") / vectors).alias("chunk")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("nth", "embedding"))), lambda x: x["embedding"])).alias("samples"))
    return parts.select("rid", (F.col("chunk") * vectors * 64).alias("first"), "samples")


@query("p13_vad", sql("s AS (SELECT label AS rid, row_number() OVER (PARTITION BY label ORDER BY vec_id, i) - 1 AS i, e::DOUBLE AS x FROM (SELECT label, vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings))", select="SELECT rid, i // 50 AS frame, sqrt(avg(x * x)) > 0.1251 AND count(*) = 50 AS speech FROM s GROUP BY ALL"))
def p13(spark, d):
    return S.voice_activity(chunks(spark, d, 25), 50, 0.1251)


@query("p13_speaking_windows", sql("s AS (SELECT label AS rid, row_number() OVER (PARTITION BY label ORDER BY vec_id, i) - 1 AS i, e::DOUBLE AS x FROM (SELECT label, vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings))",
    "f AS (SELECT rid, i // 50 AS frame, sqrt(avg(x * x)) > 0.1251 AND count(*) = 50 AS speech FROM s GROUP BY ALL)", "n AS (SELECT rid, (max(frame) + 1) * 50 AS n FROM f GROUP BY rid)", "w AS (SELECT rid, unnest(range((n - 130) // 70 + 1)) AS w FROM n WHERE n >= 130)",
    select="SELECT w.rid, w.w, sum(CASE WHEN speech THEN least(frame * 50 + 50, w * 70 + 130) - greatest(frame * 50, w * 70) ELSE 0 END) >= 65 AS has_speech FROM w JOIN f ON f.rid = w.rid AND frame * 50 < w * 70 + 130 AND frame * 50 + 50 > w * 70 GROUP BY ALL"))
def p13_windows(spark, d):
    return S.speaking_windows(S.voice_activity(chunks(spark, d, 25), 50, 0.1251), 130, 70, 50)


@query("p16_pair_average", sql("s AS (SELECT vec_id, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i FROM embeddings)", select="SELECT vec_id // 2 AS sec, i - 1 AS dim, round(avg(e), 9) AS value FROM s GROUP BY ALL HAVING count(*) = 2"))
def p16(spark, d):
    e = _read(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("sec"), F.posexplode("embedding").alias("dim", "e"))
    return e.groupBy("sec", F.col("dim").cast("bigint").alias("dim")).agg(F.round(F.avg(F.col("e").cast("double")), 9).alias("value"), F.count("*").alias("_n")).where("_n = 2").drop("_n")


@query("a7_covariance_inverse")
def a7(spark, d):
    cov, n = S.covariance(_read(spark, d, "embeddings"))
    inv = S.shrunk_inverse(cov, n)
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(inv)], "row int, value array<double>")


@query("a12_fit_head")
def a12(spark, d):
    f = _read(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("features"), (F.col("label") < 3).cast("int").alias("label"), F.lit(1.0).alias("weight"))
    m = M.fit_head(f)
    return spark.createDataFrame([(i, float(c)) for i, c in enumerate([*m.coefficients, m.intercept])], "i int, w double")


@query("s1_probe", sql(FRAMES, select="SELECT event_id AS rid, 720 AS width, 576 AS height, CASE WHEN event_id % 4 = 0 THEN 50.0 ELSE 25.0 END::DOUBLE AS fps, (idx + 1)::DOUBLE AS duration_s, CASE WHEN event_id % 3 = 0 THEN 77 ELSE floor((idx + 1) * CASE WHEN event_id % 4 = 0 THEN 50.0 ELSE 25.0 END + 0.5)::BIGINT END AS frame_count FROM frames"))
def s1(spark, d):
    e = F.col("event_id")
    video = F.format_string('{"codec_type":"video","width":720,"height":576,"r_frame_rate":"%s","avg_frame_rate":"25/1"%s}', F.when(e % 4 == 0, "50/1").otherwise("0/0"), F.when(e % 3 == 0, ',"nb_frames":"77"').otherwise(""))
    doc = F.format_string('{"streams":[{"codec_type":"audio"},%s],"format":{"duration":"%d.0"}}', video, F.col("idx") + 1)
    return logs.probe(frames(spark, d).select(e.alias("rid"), doc.alias("value")))


@query("s19_pending_features", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def s19(spark, d):
    return _read(spark, d, "documents").select("doc_id").join(_read(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("j10_dimension_lookup", "SELECT o_orderkey, coalesce(c_name, '') AS name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 > 0) ON c_custkey = o_custkey")
def j10(spark, d):
    c = _read(spark, d, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return _read(spark, d, "orders").join(c, "o_custkey", "left").select("o_orderkey", F.coalesce("c_name", F.lit("")).alias("name"))


@query("k4_template_rows", sql(PIX, SOBEL, COUNTS, "n AS (SELECT count(DISTINCT frame) // 2 AS n FROM pix)", select="SELECT y, string_agg(CASE WHEN h >= n AND v >= n THEN '+' WHEN v >= n THEN '|' WHEN h >= n THEN '-' ELSE ' ' END, '' ORDER BY x) AS value FROM ec, n GROUP BY y"))
def k4(spark, d):
    from framewright.sinks import template_rows

    half = F.floor(pictures(spark, d) / 2)
    return template_rows(P.edge_counts(image(spark, d), SIDE, SIDE, 40), half, 1, 6, 1, 6).select(F.col("y").cast("bigint").alias("y"), "value")


@query("k5_speaker_csv", sql(FRAMES, select="SELECT rid, printf('%.3f', time_s) || ',' || printf('%.4f', speaker) || ',' || (nn > 0.3)::INT AS value FROM frames"))
def k5(spark, d):
    from framewright.sinks import speaker_csv

    return speaker_csv(frames(spark, d).select("rid", "time_s", F.col("speaker").alias("conf"), (F.col("nn") > 0.3).alias("has_speech")))


@query("p14_window_embeddings", sql("s AS (SELECT label AS rid, row_number() OVER (PARTITION BY label ORDER BY vec_id, i) - 1 AS i, e::DOUBLE AS x FROM (SELECT label, vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings))", "n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid)", "w AS (SELECT rid, unnest(range((n - 64) // 32 + 1)) AS w FROM n WHERE n >= 64)",
    "m AS (SELECT w.rid, w.w, avg(x) AS a, max(x) AS b FROM w JOIN s ON s.rid = w.rid AND s.i >= 32 * w.w AND s.i < 32 * w.w + 64 GROUP BY ALL)", select="SELECT rid, w, round(a / sqrt(a * a + b * b), 7) AS e0, round(b / sqrt(a * a + b * b), 7) AS e1 FROM m"))
def p14(spark, d):
    embed = F.array(F.aggregate("xs", F.lit(0.0), lambda a, x: a + x) / F.size("xs"), F.array_max("xs").cast("double"))
    return S.window_embeddings(chunks(spark, d, 3), embed, 64, 32).select("rid", "w", F.round(F.get("embedding", 0), 7).alias("e0"), F.round(F.get("embedding", 1), 7).alias("e1"))


NAIVE = """g AS (SELECT vec_id, label // 2 AS g, label % 2 = 0 AS own, embedding FROM embeddings),
m AS (SELECT g, i, avg(e::DOUBLE) AS m FROM (SELECT g, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM g WHERE own) GROUP BY ALL), nn AS (SELECT g, sqrt(sum(m * m)) AS n FROM m GROUP BY g),
c AS (SELECT vec_id, g, own, 1 - sum(e::DOUBLE * m / n) AS d FROM (SELECT vec_id, g, own, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM g) JOIN m USING (g, i) JOIN nn USING (g) GROUP BY ALL),
t AS (SELECT g, (avg(d) FILTER (own) + avg(d) FILTER (NOT own)) / 2 AS threshold FROM c GROUP BY g)"""


@query("a8_naive_accuracies", sql(NAIVE, select="SELECT g, round(threshold, 6) AS threshold, round(avg((d < threshold)::INT) FILTER (own), 9) AS own_right, round(avg((d >= threshold)::INT) FILTER (NOT own), 9) AS other_right FROM c JOIN t USING (g) GROUP BY g, threshold"))
def a8_naive(spark, d):
    e = _read(spark, d, "embeddings").select("vec_id", F.floor(F.col("label") / 2).alias("g"), (F.col("label") % 2 == 0).alias("own"), "embedding")
    own = e.join(S.centroids(e.where("own"), "g"), "g")
    out = S.naive_accuracies(own.select("g", "own", (1 - M.dot(F.col("embedding"), F.col("centroid"))).alias("distance")), "g")
    return out.select("g", F.round("threshold", 6).alias("threshold"), *(F.round(c, 9).alias(c) for c in ("own_right", "other_right")))


@query("a9_show_iou", f"SELECT rid % 3 AS show, count(*) AS n_recs, round(avg(iou), 9) AS iou FROM ({ORACLE['j6_block_iou']}) GROUP BY ROLLUP (rid % 3)")
def a9_iou(spark, d):
    ious = V.block_iou(truth(spark, d), truth(spark, d, "pred"), frames(spark, d), 8.0)
    return V.show_iou(ious.select((F.col("rid") % 3).alias("show"), F.round("iou", 9).alias("iou")), "show").withColumn("iou", F.round("iou", 9))


@query("a13_calibration")
def a13_calibration(spark, d):
    return M.calibration(frames(spark, d).select("rid", (4 * F.col("nn") - 2 + F.col("truth")).alias("logit"), F.col("truth").alias("label")))


@query("p11_head_terms", sql(FRAMES, select="SELECT event_id, round(1 / (1 + exp(-(-0.5 + 0.25 * nn - 0.125 * speaker + 0.75 * logo + CASE event_type WHEN 'click' THEN 0.5 WHEN 'view' THEN -0.25 ELSE 0 END + 0.375 * coalesce(CASE WHEN idx % 3 > 0 THEN pred + 0.25 END, 0.5)))), 9) AS conf FROM frames"))
def p11_terms(spark, d):
    hot = F.create_map(F.lit("click"), F.lit("rtl"), F.lit("view"), F.lit("vox"))
    rms = F.when(F.col("idx") % 3 > 0, F.col("pred") + 0.25)
    w = F.array(*(F.lit(x) for x in (0.0, 0.0, 0.5, 0.0, 0.0, -0.25)))
    p = M.head(F.array("nn", "speaker"), F.array(F.lit(0.25), F.lit(-0.125)), -0.5, F.col("logo"), 0.75, hot[F.col("event_type")], w, rms, 0.375)
    return frames(spark, d).select("event_id", F.round(p, 9).alias("conf"))


@query("slug_c", "SELECT doc_id, " + SLUG.format("replace(replace(replace(replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')") + " AS slug FROM documents")
def slug_c(spark, d):
    return _read(spark, d, "documents").select("doc_id", X.shell_slug(F.col("text")).alias("slug"))


@query("text_helpers", "SELECT o_orderkey, (o_orderkey::VARCHAR)[1:2] AS short_id, rpad(o_orderpriority[1:6], 6, ' ') AS padded, strftime(o_orderdate, '%Y%m%dT%H%M%S') AS stamp, (2000000000 - epoch(o_orderdate)::BIGINT) / 86400 AS age FROM orders")
def text_helpers(spark, d):
    unix = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return _read(spark, d, "orders").select("o_orderkey", X.short_id(F.col("o_orderkey").cast("string"), 2).alias("short_id"), X.padded(F.col("o_orderpriority"), 6).alias("padded"), X.stamp(unix).alias("stamp"), X.age_days(unix, F.lit(2_000_000_000)).alias("age"))


@query("s14_dimensions", "SELECT o_orderkey::VARCHAR AS uuid, CASE WHEN o_custkey % 4 > 0 AND n_name IS NOT NULL THEN 'n' || n_nationkey ELSE '' END AS slug, CASE WHEN o_orderkey % 3 = 0 AND o_custkey <> 0 THEN o_custkey::BIGINT ELSE o_orderkey END AS start_s FROM orders LEFT JOIN nation ON n_nationkey = o_custkey % 30")
def s14(spark, d):
    n = _read(spark, d, "nation").select(F.format_string('{"channels":[{"name":"%s","slug":"n%d"},{"name":"","slug":"x"}]}', F.col("n_nationkey").cast("string"), "n_nationkey").alias("value"))
    name = F.when(F.col("o_custkey") % 4 > 0, (F.col("o_custkey") % 30).cast("string")).otherwise("none")
    real = F.when(F.col("o_orderkey") % 3 == 0, F.format_string('"start_real":%d,', "o_custkey")).otherwise("")
    o = _read(spark, d, "orders").select(F.format_string('{"entries":[{"uuid":"%d","channelname":"%s",%s"start":%d}]}', "o_orderkey", name, real, "o_orderkey").alias("value"))
    return logs.dimensions(n, o)


@query("e5_chunk_merge", sql(FRAMES, "e AS (SELECT rid, idx // 50 AS chunk, event_type, idx % 50 AS i FROM frames WHERE event_type IN ('click', 'purchase', 'signup'))", "k AS (SELECT *, row_number() OVER (PARTITION BY rid, chunk, event_type = 'click' ORDER BY i) AS nth FROM e)",
    select="SELECT rid, CASE event_type WHEN 'click' THEN 'scene' WHEN 'purchase' THEN 'onset' ELSE 'offset' END AS kind, chunk * 50 + i AS idx, (i / 10.0 + chunk * 5.0)::DOUBLE AS time_s FROM k WHERE NOT (chunk > 0 AND ((event_type = 'click' AND i = 1) OR (event_type <> 'click' AND nth = 1 AND i < 6)))"))
def e5(spark, d):
    f = frames(spark, d).where("event_type IN ('click', 'purchase', 'signup')")
    kind = F.when(F.col("event_type") == "click", "scene").when(F.col("event_type") == "purchase", "onset").otherwise("offset")
    e = f.select("rid", F.floor(F.col("idx") / 50).alias("chunk"), kind.alias("kind"), (F.col("idx") % 50).alias("idx")).withColumn("time_s", F.col("idx") / 10)
    return E.chunks_merged(e, e.select("rid", "chunk").distinct().withColumn("start_s", F.col("chunk") * 5.0), 10.0)
