"""Two-pass external shuffle into shards.

Pass 1 scatters whole records uniformly over memory-sized buckets by seeded hashes and writes them with their draws.
Pass 2 takes one bucket at a time, puts it in a fixed order, Fisher-Yates shuffles it with the bucket's own seed and
writes it.  The buckets' counts, summed in bucket order, give every record its place in one global permutation, and
cutting that into ``shards`` equal runs gives the law ``rows``: shard counts differ by one at most.

The hash takes the document id, the text and the row's place in the scan, so neither copies nor a repeated id nor even
repeated rows gather in a bucket.  The draws are written before anything is counted, so a lost executor's bucket is
rebuilt the same.  Counts are summed in two levels, ranges of ``RANGE`` buckets and the buckets of a range, and meet their
buckets in a cogroup: nothing is broadcast, and no task sees more than a range's counts or one count a range.

Nulls and ties: a null text has size 1 and stays null in the files; a null doc_id is scattered by its text and place.
Repeated rows get a slot each.  An empty table gives an empty one.  A very long text makes its bucket so much larger, as
records are never cut.  Columns named size, text_crc32, shard and slot are replaced; others pass as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.common import columns_of, new_path, partitions, stored, text_of

SHARDS = 16
SEED = 20_250_101
#: Text bytes of a bucket: what one task holds at a time, with as much again for its permutation.
BUCKET_BYTES = 8 << 20
#: Buckets whose counts are summed together.
RANGE = 4096
LAW = "rows"


def _mixed(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", "text", F.monotonically_increasing_id())


def _fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniform permutation by the Fisher-Yates exchange, from a bucket's own seed."""
    order = np.arange(n, dtype=np.int64)
    np.random.Generator(np.random.PCG64(seed)).shuffle(order)  # numpy's shuffle is Fisher-Yates
    return order


def _shuffled(seed: int, shards: int, total: int):
    def run(group: pa.Table, starts: pa.Table) -> pa.Table:
        bucket, n = group.column("bucket")[0].as_py(), group.num_rows
        group = group.take(pa.compute.sort_indices(group, sort_keys=[(c, "ascending") for c in ("draw", "size", "text_crc32")]))
        group = group.take(pa.array(_fisher_yates(n, seed * 1_000_003 + bucket)))
        shard, slot = _cut(starts.column("start")[0].as_py() + np.arange(n, dtype=np.int64), total, shards)
        return group.select(["row", "size", "text_crc32"]).append_column("shard", pa.array(shard, pa.int32())).append_column("slot", pa.array(slot, pa.int64()))

    return run


def _cut(place: np.ndarray, total: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of global places: the first total % shards shards have one record more."""
    small, more = divmod(total, shards)
    head = more * (small + 1)
    rest = place - head
    in_head = place < head
    shard = np.where(in_head, place // (small + 1), more + rest // max(small, 1))
    slot = np.where(in_head, place % (small + 1), rest % max(small, 1))
    return shard.astype(np.int32), slot


def _starts(counts: DataFrame) -> DataFrame:
    """(bucket, start): the sum of the counts of all buckets before each, in two levels."""
    part = F.floor(F.col("bucket") / RANGE)
    ranges = counts.groupBy(part.alias("part")).agg(F.sum("n").alias("n"))  # one row for RANGE buckets
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    own = counts.withColumn("part", part).withColumn("own", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return own.join(ranges, "part").select("bucket", (F.col("base") + F.col("own")).alias("start"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes docs, shuffled, to ``path``/shard=N; returns the written table, with size, text_crc32, shard and slot."""
    size = (F.octet_length(text_of("text")) + 1).cast("bigint")
    found = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    total, buckets = found["n"], max(1, -(-found["b"] // bucket_bytes))
    # The caller's columns go in one struct, so that no name of theirs meets one of these.
    drawn = docs.select(
        F.struct(*columns_of(docs, "size", "text_crc32", "shard", "slot")).alias("row"),
        size.alias("size"),
        F.crc32(text_of("text").cast("binary")).alias("text_crc32"),
        F.pmod(_mixed(seed), F.lit(buckets)).alias("bucket"),
        _mixed(seed + 1).alias("draw"),
    )
    drawn = stored(drawn, "drawn")
    starts = _starts(stored(drawn.groupBy("bucket").agg(F.count("*").alias("n")), "buckets"))
    schema = T.StructType([drawn.schema[c] for c in ("row", "size", "text_crc32")] + [T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    n = max(partitions(docs.sparkSession), buckets // 4)
    out = drawn.repartition(n, "bucket").groupBy("bucket").cogroup(starts.repartition(n, "bucket").groupBy("bucket")).applyInArrow(_shuffled(seed, shards, total), schema)
    out = out.select("row.*", "size", "text_crc32", "shard", "slot")
    out.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, path: str | None = None) -> DataFrame:
    """Digest of the written shards: one row a record, read back from the files."""
    path = path or new_path(docs.sparkSession, "shards")
    return write_shards(docs, path, shards, seed).select(
        "doc_id",
        (F.octet_length(text_of("text")) + 1).cast("bigint").alias("size"),
        F.crc32(text_of("text").cast("binary")).alias("text_crc32"),
        F.lit(LAW).alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
