"""Line dedup by site-relative frequency (native DataFrame code only).

Group documents by host; a line is boilerplate of a host where it stands on more than ``ratio`` of the host's pages, and
on more than one: a line that only one page has is no repetition.  Equal texts of a host are one page, so copies of a page
are no evidence of boilerplate.  Boilerplate lines go, the other lines keep their order.

Only hashes of lines are shuffled: (host, hash of the trimmed line), counted once a page and combined before the
shuffle, so neither a hot host nor a hot line gathers in a task.  A host has fewer boilerplate lines than its mean
number of distinct lines a page divided by ``ratio``, so the array kept for a host is bounded.  The arrays are
broadcast where their measured size allows it; else the documents are joined by host, with adaptive skew splitting.

Nulls and ties: a null text stays null and is no page; a null host belongs to no site and keeps all its lines; blank lines
are never boilerplate; a line repeated in a page counts once; repeated rows get a row each.  An empty table gives an empty
table.  A very long text is one row's work: its lines are hashed once and looked up in the few that it shares with its
host's.  Columns named n_lines and n_dropped are replaced; others pass as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import SPACE, columns_of, stored

RATIO = 0.05
#: Pages that a line must stand on, at least: on one alone it repeats nothing.
MIN_PAGES = 2
#: Boilerplate hashes (8 bytes each) that may be broadcast.
BROADCAST_HASHES = 1_000_000


def line_key(line: Column) -> Column:
    """Hash of a trimmed line; 0 for a blank one."""
    bare = F.regexp_replace(line, rf"^{SPACE}|{SPACE}$", "")
    return F.when(bare == "", F.lit(0).cast("bigint")).otherwise(F.xxhash64(bare))


def line_keys(lines: Column) -> Column:
    return F.transform(lines, line_key)


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines): hashes of each host's boilerplate lines, for hosts that have any."""
    own = docs.select(F.col(host).alias("host"), F.col(text).alias("text")).where("host IS NOT NULL AND text IS NOT NULL")
    pages = own.select("host", F.xxhash64("text").alias("h"), F.array_distinct(line_keys(F.split("text", "\n", -1))).alias("keys")).dropDuplicates(["host", "h"])
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    seen = pages.select("host", F.explode("keys").alias("line")).where("line <> 0").groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    return seen.join(totals, "host").where(F.col("n") > F.lit(ratio) * F.col("pages")).groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def deduped(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs with boilerplate lines cut from ``text``, and n_lines, n_dropped."""
    known = stored(boilerplate(docs, host, text, ratio, min_pages), "boilerplate")
    size = known.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0)).alias("n")).first()["n"]
    known = F.broadcast(known) if size <= BROADCAST_HASHES else known
    # The caller's columns go in one struct, so that no name of theirs meets one of these.
    own = docs.select(F.struct(*columns_of(docs, "n_lines", "n_dropped")).alias("row"), F.col(host).alias("host"), F.split(text, "\n", -1).alias("split"))
    met = F.array_intersect(line_keys(F.col("split")), F.col("lines"))
    out = (
        own.join(known, "host", "left")
        .withColumn("met", F.when(F.col("lines").isNotNull(), met))
        .withColumn("kept", F.when(F.size("met") > 0, F.filter("split", lambda s: ~F.array_contains("met", line_key(s)))))
        .withColumn("n_lines", F.coalesce(F.size("split"), F.lit(0)).cast("bigint"))
        .withColumn("n_lines", F.when(F.col("split").isNull(), F.lit(0).cast("bigint")).otherwise(F.col("n_lines")))
        .withColumn("n_dropped", F.when(F.col("kept").isNull(), F.lit(0).cast("bigint")).otherwise((F.col("n_lines") - F.size("kept")).cast("bigint")))
        .withColumn("cut", F.when(F.col("n_dropped") > 0, F.array_join("kept", "\n")).otherwise(F.col("row").getField(text)))
    )
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return out.select(*(F.col("cut").alias(c) if c.lower() == text.lower() else F.col("row").getField(c).alias(c) for c in names), "n_lines", "n_dropped")
