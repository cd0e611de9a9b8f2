"""Feature cache: a Parquet table that is read through.

A recording's features are known by its uuid, its source's modification time, the frame rate they were taken at and the
set of extras in them.  A change of any of them misses the cache; old rows stay where they are and are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The extras' marks, in the order in which a set names them.
MARKS = {"logo": "-l2", "channel": "-c1", "audio": "-a1", "yamnet": "-y1", "uniformity": "-u1"}
KEY = ["uuid", "source_mtime", "fps100", "feature_set"]


def feature_set(*extras: str) -> str:
    """The set's name: the marks of its extras, always in the same order; plain features are 'plain'."""
    unknown = set(extras) - set(MARKS)
    if unknown:
        raise ValueError(f"unknown extras: {sorted(unknown)}")
    return "".join(m for name, m in MARKS.items() if name in extras) or "plain"


def keyed(recordings: DataFrame, fps: float, *extras: str) -> DataFrame:
    """recordings (uuid, source_mtime, ...) with the rest of the key."""
    return recordings.withColumns({"source_mtime": F.col("source_mtime").cast("bigint"), "fps100": F.lit(int(fps * 100)), "feature_set": F.lit(feature_set(*extras))})


def stored(recordings: DataFrame, path: str, schema: str) -> DataFrame:
    """The cache's table, empty where nothing was written yet."""
    spark = recordings.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    whole = f"uuid string, source_mtime bigint, {schema}, fps100 int, feature_set string"
    return spark.read.schema(whole).parquet(path) if exists else spark.createDataFrame([], whole)


def read_through(recordings: DataFrame, path: str, schema: str, compute: Callable[[DataFrame], DataFrame], fps: float, *extras: str) -> DataFrame:
    """Features of all recordings: those of the cache, and what compute makes of the others, which is added to it.

    compute takes the recordings that are missing, with their key, and returns rows of the key and of schema's columns.
    The cache is parted by frame rate and set, so a run reads only its own.
    """
    wanted = keyed(recordings, fps, *extras)
    names = [*KEY[:2], *(c.strip().split(" ")[0] for c in schema.split(",")), *KEY[2:]]
    missing = wanted.join(stored(recordings, path, schema).select(*KEY).distinct(), KEY, "left_anti")
    compute(missing).select(*names).write.mode("append").partitionBy("fps100", "feature_set").parquet(path)
    return stored(recordings, path, schema).join(wanted.select(*KEY).distinct(), KEY)
