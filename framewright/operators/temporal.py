"""Time-series building blocks: islands, rolling means, range and nearest joins.

Range joins carry an equi key (the bucket of a point; an interval has the few buckets that it touches), so they are
hash or sort-merge joins on (recording, bucket), never nested loops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, flag: str, order: str = "idx", key: str = "rid") -> DataFrame:
    """Maximal runs of equal flag over consecutive order values: (key, flag, first, n)."""
    w = Window.partitionBy(key, flag).orderBy(order)
    runs = df.select(key, flag, order, (F.col(order) - F.row_number().over(w)).alias("_g"))
    return runs.groupBy(key, flag, "_g").agg(F.min(order).alias("first"), F.count("*").alias("n")).drop("_g")


#: Rows of a recording that are added up by themselves where a window holds all of them.
BLOCK_ROWS = 16


def rolling_mean(df: DataFrame, column: str, half: int, out: str, order: str = "idx", key: str = "rid", ahead: Column | None = None) -> DataFrame:
    """Centred mean of 2 * half + 1 rows, fewer at the ends; nulls do not count.

    A mean may be compared with a threshold that it equals but for its last bits, so the order of addition is fixed: that
    of a segment tree over the recording, as in DuckDB's windows.  The rows before the window's first whole block of
    BLOCK_ROWS come first, then each block's own sum, then the rows behind the last.  ``ahead`` is the number of rows that
    a tree of several recordings holds before this one's; it moves the blocks, and no other recording's value is added.
    """
    w = Window.partitionBy(key).orderBy(order)
    window = w.rowsBetween(-half, half)
    size, first = F.size("_values"), F.greatest(F.col("_row") - half, F.lit(0))
    add = lambda part, to: F.aggregate(part, to, lambda a, x: a + x)
    head = F.least(F.pmod(-first if ahead is None else -first - ahead, F.lit(BLOCK_ROWS)).cast("int"), size)
    blocks = F.floor((size - head) / BLOCK_ROWS).cast("int")
    total = add(F.slice("_values", 1, head), F.lit(0.0))
    if most := (2 * half + 1) // BLOCK_ROWS:
        block = lambda k: add(F.slice("_values", head + k * BLOCK_ROWS + 1, BLOCK_ROWS), F.lit(0.0))
        total = F.aggregate(F.array(*map(F.lit, range(most))), total, lambda a, k: a + F.when(k < blocks, block(k)).otherwise(0.0))
    total = add(F.slice("_values", head + blocks * BLOCK_ROWS + 1, size), total)
    # A null is 0 in the sum, so that it keeps its place.
    values = F.collect_list(F.coalesce(F.col(column).cast("double"), F.lit(0.0))).over(window)
    found = df.withColumns({"_values": values, "_row": F.row_number().over(w) - 1, "_count": F.count(column).over(window)})
    return found.withColumn(out, F.when(F.col("_count") > 0, total / F.col("_count"))).drop("_values", "_row", "_count")


def within(edges: DataFrame, points: DataFrame, at: Column, point: str, before: float, after: float, how: str = "inner", also: Column | None = None, key: str = "rid") -> DataFrame:
    """edges joined to the points of their recording with at - before <= point <= at + after, and what ``also`` asks.

    points' columns, but for the key, must not clash with those of edges.  With how "left" an edge has a row of nulls for
    each bucket of its window that holds no point of it.
    """
    width = max(before + after, 1e-9)
    e = edges.withColumn("_lo", at - F.lit(before)).withColumn("_hi", at + F.lit(after))
    e = e.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width))))
    p = points.withColumnRenamed(key, "_key").withColumn("_at", F.floor(F.col(point) / width))
    on = (F.col(key) == F.col("_key")) & (F.col("_bucket") == F.col("_at")) & (F.col(point) >= F.col("_lo")) & (F.col(point) <= F.col("_hi"))
    return e.join(p, on if also is None else on & also, how).drop("_key", "_bucket", "_at", "_lo", "_hi")


def overlapping(a: DataFrame, b: DataFrame, width: float, key: str = "rid", slack: float = 0.0) -> DataFrame:
    """Pairs of intervals (a: start_s, end_s; b: b_start, b_end) that overlap, or miss each other by slack at most.

    width is about the usual interval length.  A pair is joined in the first bucket that both touch only.
    """
    touched = lambda s, e: F.explode(F.sequence(F.floor(s / width), F.floor(e / width)))
    x = a.withColumn("_bucket", touched(F.col("start_s") - slack, F.col("end_s") + slack))
    y = b.withColumn("_bucket", touched(F.col("b_start"), F.col("b_end")))
    first = F.greatest(F.floor((F.col("start_s") - slack) / width), F.floor(F.col("b_start") / width))
    near = (F.col("b_start") < F.col("end_s") + slack) & (F.col("b_end") > F.col("start_s") - slack) if not slack else (F.col("b_start") <= F.col("end_s") + slack) & (F.col("b_end") >= F.col("start_s") - slack)
    return x.join(y, [key, "_bucket"]).where((F.col("_bucket") == first) & near).drop("_bucket")


def nearest(edges: DataFrame, points: DataFrame, at: str, radius: float, out: str, id_: list[str]) -> DataFrame:
    """(id_, out): the point (column t) nearest to ``at`` within the radius, the earlier of two; else at.

    edges are read once: one without points comes through the left join, so nothing is joined back.
    """
    found = within(edges, points.select("rid", F.col("t").alias("_t")), F.col(at), "_t", radius, radius, "left")
    by = F.when(F.col("_t").isNotNull(), F.struct(F.abs(F.col("_t") - F.col(at)), F.col("_t")))
    return found.groupBy(*id_).agg(F.coalesce(F.min_by("_t", by), F.first(at)).alias(out))


def covered(points: DataFrame, intervals: DataFrame, at: str, width: float, out: str, half_open: bool = False, key: str = "rid") -> DataFrame:
    """points with ``out``: whether ``at`` lies in an interval (start_s, end_s) of its recording, ends included or half-open.

    Intervals that touch become one first, so a point meets one row at most, by the bucket of ``width`` that it is in.
    """
    by = Window.partitionBy(key).orderBy("start_s", "end_s")
    reach = F.max("end_s").over(by.rowsBetween(Window.unboundedPreceding, -1))
    part = F.sum(F.when(F.col("start_s") <= reach, 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    whole = intervals.withColumn("_part", part).groupBy(key, "_part").agg(F.min("start_s").alias("_s"), F.max("end_s").alias("_e"))
    own = whole.select(F.col(key).alias("_key"), "_s", "_e", F.explode(F.sequence(F.floor(F.col("_s") / width), F.floor(F.col("_e") / width))).alias("_bucket"))
    t = F.col(at)
    on = (F.col(key) == F.col("_key")) & (F.floor(t / width) == F.col("_bucket")) & (t >= F.col("_s")) & ((t < F.col("_e")) if half_open else (t <= F.col("_e")))
    return points.join(own, on, "left").withColumn(out, F.col("_s").isNotNull()).drop("_key", "_s", "_e", "_bucket")
