"""Signal tables bound to the supplied tables, in Spark and, with the same arithmetic, in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.operators import blocks as B
from framewright.operators.temporal import rolling_mean

HALF, THRESHOLD, OPEN, CLOSE, LEAST = 12, 0.43, 3, 6, 8


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def frames(spark: SparkSession, d: str) -> DataFrame:
    rid = F.col("user_id") % 8
    nth = F.row_number().over(Window.partitionBy(rid).orderBy("ts", "event_id")) - 1
    e = _read(spark, d, "events")
    return e.select(
        rid.alias("rid"), nth.cast("bigint").alias("idx"), nth.cast("double").alias("time_s"), F.least(F.col("value") / 100, F.lit(1.0)).alias("logo"),
        (((F.col("event_id") * 37) % 101) / 100).alias("nn"), (((F.col("event_id") * 53) % 101) / 100).alias("speaker"),
        F.when(F.col("event_id") % 40 < 12, 1).otherwise(0).alias("truth"), F.when(F.col("event_id") % 43 < 13, 1).otherwise(0).alias("pred"), "event_type", "value", "event_id", "ts",
    )


FRAMES = """frames AS (SELECT user_id % 8 AS rid, i AS idx, i::DOUBLE AS time_s, least(value / 100, 1.0) AS logo, ((event_id * 37) % 101) / 100.0 AS nn, ((event_id * 53) % 101) / 100.0 AS speaker,
 CASE WHEN event_id % 40 < 12 THEN 1 ELSE 0 END AS truth, CASE WHEN event_id % 43 < 13 THEN 1 ELSE 0 END AS pred, event_type, value, event_id, ts
 FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) - 1 AS i FROM events))"""


def _hashed(rid: int) -> int:
    """DuckDB's hash of a BIGINT."""
    x = rid % 2**64
    for _ in range(2):
        x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 % 2**64
    return x ^ x >> 32


#: Bits by which DuckDB's hash groups part the recordings: the fewest, the most looked at, and the rows a group may have on average.
LEAST_BITS, MOST_BITS, GROUP_ROWS = 4, 20, 122_880


def rows_ahead(spark: SparkSession, d: str) -> DataFrame:
    """(rid, ahead): the rows of the recordings that DuckDB sorts before this one in its hash group.

    A group has one segment tree, so they place the blocks in which its windows add up; of the recordings here 3 and 6
    share a group until the table has GROUP_ROWS * 16 rows.
    """
    n = _read(spark, d, "events").groupBy((F.col("user_id") % 8).alias("rid")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    bits = F.lit(LEAST_BITS)
    for b in range(LEAST_BITS, MOST_BITS):
        bits = F.when(F.floor(total / 2**b) > GROUP_ROWS, b + 1).otherwise(bits)
    # The hash's bits from the 48th down; a recording is -7 to 7.
    low = F.create_map(*(F.lit(x) for rid in range(-7, 8) for x in (rid, _hashed(rid) % 2**48)))
    group = F.call_function("shiftright", low[F.col("rid").cast("int")], 48 - F.col("bits"))
    before = Window.partitionBy("group").orderBy("rid").rowsBetween(Window.unboundedPreceding, -1)
    return n.withColumn("bits", bits).withColumn("group", group).select("rid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))


def present(spark: SparkSession, d: str) -> DataFrame:
    placed = frames(spark, d).join(F.broadcast(rows_ahead(spark, d)), "rid", "left")
    return rolling_mean(placed, "logo", HALF, "s", ahead=F.coalesce("ahead", F.lit(0))).drop("ahead").withColumn("present", F.col("s") >= THRESHOLD)


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return B.state_machine(present(spark, d), OPEN, CLOSE, LEAST)


def events(spark: SparkSession, d: str) -> DataFrame:
    kind = F.create_map(*(F.lit(x) for p in {"error": "black", "view": "silence", "click": "scene", "purchase": "onset", "signup": "offset"}.items() for x in p))
    point = F.col("event_type").isin("click", "purchase", "signup")
    return frames(spark, d).select("rid", kind[F.col("event_type")].alias("kind"), F.col("time_s").alias("start_s"), F.when(point, F.col("time_s")).otherwise(F.col("time_s") + F.col("value") / 230).alias("end_s"), F.col("idx").alias("pos"))


def truth(spark: SparkSession, d: str, column: str = "truth") -> DataFrame:
    from framewright.operators.events import predicted_blocks

    return predicted_blocks(frames(spark, d).withColumn("pred", F.col(column)), 1.0, 1.0)


BLOCKS = f"""sm AS (SELECT *, avg(logo) OVER (PARTITION BY rid ORDER BY idx ROWS BETWEEN {HALF} PRECEDING AND {HALF} FOLLOWING) AS s FROM frames),
pr AS (SELECT *, s >= {THRESHOLD} AS present FROM sm),
isl AS (SELECT rid, present, min(idx) AS st, count(*) AS n FROM (SELECT *, idx - row_number() OVER (PARTITION BY rid, present ORDER BY idx) AS g FROM pr) GROUP BY rid, present, g),
alt AS (SELECT *, lag(present) OVER (PARTITION BY rid ORDER BY st) AS was FROM isl WHERE (NOT present AND n >= {OPEN}) OR (present AND n >= {CLOSE})),
alt2 AS (SELECT *, lead(st) OVER (PARTITION BY rid ORDER BY st) AS nx FROM alt WHERE was IS NULL OR was <> present),
nf AS (SELECT rid, count(*) AS n_frames, count(*)::DOUBLE AS duration_s FROM frames GROUP BY rid),
blocks AS (SELECT rid, (row_number() OVER (PARTITION BY rid ORDER BY st) - 1)::BIGINT AS block_no, st::DOUBLE AS start_s, coalesce(nx, n_frames)::DOUBLE AS end_s
 FROM alt2 JOIN nf USING (rid) WHERE NOT present AND coalesce(nx, n_frames) - st >= {LEAST}),
edges AS (SELECT rid, block_no, 'START' AS edge, start_s AS t FROM blocks UNION ALL SELECT rid, block_no, 'END', end_s FROM blocks)"""

SIG = """sig AS (SELECT rid, CASE event_type WHEN 'error' THEN 'black' WHEN 'view' THEN 'silence' WHEN 'click' THEN 'scene' WHEN 'purchase' THEN 'onset' WHEN 'signup' THEN 'offset' END AS kind,
 time_s AS start_s, CASE WHEN event_type IN ('error', 'view') THEN time_s + value / 230 ELSE time_s END AS end_s, idx AS pos FROM frames)"""


def runs_sql(name: str, column: str, least: int = 1) -> str:
    return f"""{name} AS (SELECT rid, min(idx)::DOUBLE AS start_s, (min(idx) + count(*))::DOUBLE AS end_s FROM (SELECT rid, idx, {column} AS f, idx - row_number() OVER (PARTITION BY rid, {column} ORDER BY idx) AS g FROM frames)
 WHERE f = 1 GROUP BY rid, g HAVING count(*) >= {least})"""


#: Width and height of the pictures below.
SIDE = 8


def image(spark: SparkSession, d: str) -> DataFrame:
    """(rid 0, frame, pixels): grey 8 x 8 pictures as rgb24 bytes, from the embeddings."""
    grey = lambda e: F.floor(F.least(F.greatest((e.cast("double") + 0.5) * 256, F.lit(0.0)), F.lit(255.0))).cast("int")
    bytes_ = F.unhex(F.array_join(F.transform("embedding", lambda e: F.repeat(F.lpad(F.hex(grey(e)), 2, "0"), 3)), ""))
    return _read(spark, d, "embeddings").select(F.lit(0).cast("bigint").alias("rid"), F.col("vec_id").alias("frame"), bytes_.alias("pixels"))


PIX = """pix AS (SELECT frame, i, i % 8 AS x, i // 8 AS y, floor(least(greatest((e::DOUBLE + 0.5) * 256, 0), 255))::INT AS v
 FROM (SELECT vec_id AS frame, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings))"""


def sql(*parts: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + select
