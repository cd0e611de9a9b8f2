"""Benchmark decontamination by winnowing.

A window is 13 consecutive words of an item, or the whole of a shorter item.  Of the nine 5-grams in 13 words the one
with the smallest hash (the leftmost of equals) is their fingerprint, so any 13 words that a document shares with an
item have one fingerprint in both.

1. The benchmark's windows become a table: fingerprint, two hashes of the window, and the set of items that have it.
2. One scan of the documents takes their fingerprints.  Those that no item has go at once, by a bitmap of ``BITS`` bits
   that is broadcast; it is as large for any benchmark, and a false hit in it costs a row, not a wrong result.  A
   fingerprint that stays is extended over the windows that it stands for, and a second bitmap drops windows that no
   item has.  Items below 13 words, which winnowing does not reach, are met by windows of their own lengths.
3. The fingerprints left, with their windows, are joined to the benchmark's.  The windows hit, run together, are a
   text's hit words.

What is joined is a row a (text, window), so an item that repeats a passage, or a passage that very many items have,
makes no pairs of places; sets of items are joined by a number of theirs.  Texts are known by a 128-bit hash: equal
texts are judged once, and every row gets the verdict of its text.  Windows are equal where two 64-bit hashes are.

Nulls and ties: a null text has no words; a document without words has no hits and is clean; an item without words has
no windows.  An item with a null item_id marks the words it shares but has no id to count or list.  Items with equal texts
are all reported; rows of one item_id are one item.  Repeated rows get a row each.  An empty benchmark leaves all
documents clean; an empty table gives an empty table.  Very long texts are hashed in parts of ``PART`` words.  Columns
beside doc_id, item_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import columns_of, stored, utf8
from framewright.llm.rolling import prefix_hash, smallest, stretch

WINDOW = 13
GRAM = 5
#: 5-grams in a window.
SPAN = WINDOW - GRAM + 1
#: Words of a text that are hashed at a time; parts share WINDOW - 1 words.
PART = 1 << 17
#: Size of a bitmap: 8 MB.
BITS = 1 << 26
#: Rows of the benchmark's tables that may be broadcast, by count; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Files of a working table that comes from a shuffle, unless there are more cores.  Each file costs a local file system
#: without Hadoop's native library two processes (chmod), forked from a JVM whose memory they share until they start.
FILES = 32

#: Bytes that are words ([0-9a-z] and all of UTF-8 beyond ASCII) stay; A-Z become lower case; the rest become spaces.
TABLE = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    return utf8(text).translate(TABLE).split()


class Words:
    """Some words in a row, with hashes of any run of them."""

    def __init__(self, ws: list[bytes]):
        self.data = np.frombuffer(b" ".join(ws), np.uint8)
        sizes = np.fromiter(map(len, ws), np.int64, len(ws))
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        self.sums: dict[int, np.ndarray] = {}

    def runs(self, k: int, at: np.ndarray, n: int) -> np.ndarray:
        """The k-th hash of the n words from each place."""
        if k not in self.sums:
            self.sums[k] = prefix_hash(self.data, k)
        return stretch(self.sums[k], k, self.starts[at], self.ends[at + n - 1])

    def fingerprints(self) -> np.ndarray:
        """The fingerprint of each window of WINDOW words."""
        h = self.runs(0, np.arange(len(self.ends) - GRAM + 1), GRAM)
        low = np.uint64((PART + WINDOW).bit_length())
        # The place breaks ties, the leftmost first, which depends on the window's own words only.
        first = smallest((h >> low << low) | np.arange(len(h), dtype=np.uint64), SPAN)
        return h[(first & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)]


def parts(ws: list[bytes], size: int = PART) -> Iterator[tuple[int, Words]]:
    for start in range(0, max(len(ws) - WINDOW + 1, 1), size):
        yield start, Words(ws[start : start + size + WINDOW - 1])


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


ITEMS = "item string, n int, g bigint, w1 bigint, w2 bigint"


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column("item").to_pylist(), batch.column("text"), strict=True):
            ws = words(text.as_py())
            if not ws:
                continue
            for _, part in parts(ws):
                n = min(len(ws), WINDOW)
                at = np.arange(len(part.ends) - n + 1)
                w1, w2 = part.runs(0, at, n), part.runs(1, at, n)
                g = part.fingerprints() if n == WINDOW else w1
                columns = [pa.array([item] * len(at), pa.string()), pa.array(np.full(len(at), n, np.int32)), *map(_signed, (g, w1, w2))]
                yield pa.RecordBatch.from_arrays(columns, names=["item", "n", "g", "w1", "w2"])


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(n, g, w1, w2, items): each window of the benchmark once, with its fingerprint and the sorted ids of its items."""
    own = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    return own.mapInArrow(_item_windows, ITEMS).groupBy("n", "g", "w1", "w2").agg(F.array_sort(F.collect_set("item")).alias("items"))


def bitmap(df: DataFrame, h: str | Column, bits: int = BITS) -> np.ndarray:
    """A bitmap of the hashes in a column: ``bits`` bits reach the driver at most, however many rows there are."""
    slot = (F.col(h) if isinstance(h, str) else h).bitwiseAND(F.lit(bits - 1)) + 1  # bits: 2 ** 15 at least
    rows = df.groupBy(F.bitmap_bucket_number(slot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("b")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["b"], np.uint8)
    return out


def among(own: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes' bits are set in a bitmap."""
    slot = h & np.uint64(len(own) * 8 - 1)
    return (own[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def hit_windows(ws: list[bytes], lengths: list[int], grams: np.ndarray, windows: np.ndarray, words_at_once: int = PART) -> tuple[np.ndarray, ...]:
    """(place, n, fingerprint, both hashes) of the windows that the bitmaps do not rule out."""
    out: list[tuple[np.ndarray, ...]] = []
    for start, part in parts(ws, words_at_once):
        size = len(part.ends)
        for n in lengths:
            if size < n or (n == WINDOW and size < WINDOW):
                continue
            # Windows below WINDOW words that start in the shared words belong to the next part.
            most = size - n + 1 if start + size == len(ws) else size - WINDOW + 1
            at = np.arange(most)
            if n == WINDOW:
                g = part.fingerprints()
                at = at[among(grams, g)]
                g = g[at]
                w1 = part.runs(0, at, n)
            else:
                g = w1 = part.runs(0, at, n)
            keep = among(windows, w1)
            if keep.any():
                at, g, w1 = at[keep], g[keep], w1[keep]
                out.append((at + start, np.full(len(at), n), g, w1, part.runs(1, at, n)))
    if not out:
        return (np.empty(0, np.int64), np.empty(0, np.int64), *(np.empty(0, np.uint64) for _ in range(3)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


SCANNED = "doc_id bigint, k1 bigint, k2 bigint, n_words bigint, hits array<struct<at:int,n:int,g:bigint,w1:bigint,w2:bigint>>"


def _scan(shared: Broadcast[Any], lengths: list[int], words_at_once: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, windows = shared.value
        for batch in batches:
            counts, found, sizes = [], [], [0]
            for text in batch.column("text"):
                ws = words(text.as_py())
                counts.append(len(ws))
                own = hit_windows(ws, lengths, grams, windows, words_at_once) if ws else None
                n = 0 if own is None else len(own[0])
                sizes.append(sizes[-1] + n)
                if n:
                    found.append(own)
            flat = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 2 + [np.empty(0, np.uint64)] * 3
            structs = pa.StructArray.from_arrays([pa.array(flat[0].astype(np.int32)), pa.array(flat[1].astype(np.int32)), *map(_signed, flat[2:])], names=["at", "n", "g", "w1", "w2"])
            hits = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), structs)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k1"), batch.column("k2"), pa.array(counts, pa.int64()), hits], names=["doc_id", "k1", "k2", "n_words", "hits"])

    return run


def text_keys() -> list[Column]:
    """Two hashes that know a text."""
    return [F.xxhash64("text"), F.xxhash64(F.lit(13), "text")]


VERDICTS = "k1 bigint, k2 bigint, n_hit bigint, n_items bigint, items_sha256 string, starts array<int>, ends array<int>"
NO_ITEMS = hashlib.sha256(b"").hexdigest()


def runs_of(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows as maximal runs [start, end) of words; runs that touch are one."""
    order = np.argsort(at, kind="stable")
    at, ends = at[order], np.maximum.accumulate((at + n)[order])
    new = np.concatenate(([True], at[1:] > ends[:-1]))
    return at[new], ends[np.concatenate((new[1:], [True]))]


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            at, n = (np.array([w[c] for w in r["windows"]], np.int64) for c in ("at", "n"))
            starts, ends = runs_of(at, n)
            ids = sorted(r["items"] or ())
            rows.append({"k1": r["k1"], "k2": r["k2"], "n_hit": int((ends - starts).sum()), "n_items": len(ids), "items_sha256": hashlib.sha256(",".join(ids).encode()).hexdigest(), "starts": starts.tolist(), "ends": ends.tolist()})
        kinds = [("k1", pa.int64()), ("k2", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))


def _few(df: DataFrame) -> DataFrame:
    """df in FILES partitions at most, or one a core: its groups are still made one shuffle partition at a time."""
    return df.coalesce(max(FILES, df.sparkSession.sparkContext.defaultParallelism))


def _small(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_ROWS else df


def _judged_texts(docs: DataFrame, benchmark: DataFrame, bits: int, words_at_once: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k1, k2, n_words, met) of every row, and the verdicts of the texts that are hit."""
    spark: SparkSession = docs.sparkSession
    bench = stored(_few(item_windows(benchmark)), "benchmark-windows")
    lengths = sorted(r["n"] for r in bench.select("n").distinct().collect())  # WINDOW at most
    shared = spark.sparkContext.broadcast((bitmap(bench.where(F.col("n") == WINDOW), "g", bits), bitmap(bench, "w1", bits)))
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *(k.alias(c) for k, c in zip(text_keys(), ("k1", "k2"), strict=True)))
    scanned = stored(own.mapInArrow(_scan(shared, lengths, words_at_once), SCANNED), "scanned")
    size = bench.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("items")), F.lit(0)).alias("items")).first()
    sets = bench.select(F.xxhash64("items").alias("set"), "items")
    marked = (
        scanned.where(F.size("hits") > 0)
        .select("k1", "k2", F.explode("hits").alias("w"))
        .select("k1", "k2", "w.*")
        .distinct()  # copies of a text hit once
        .join(_small(bench.select("g", "w1", "w2", F.xxhash64("items").alias("set")), size["n"]), ["g", "w1", "w2"])
    )
    marked = marked.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "n")).alias("windows"), F.collect_set("set").alias("sets"))
    marked = stored(_few(marked), "marked")
    listed = (
        marked.select("k1", "k2", F.explode("sets").alias("set"))
        .join(_small(sets.dropDuplicates(["set"]), size["items"]), "set")
        .select("k1", "k2", F.explode("items").alias("item"))
        .groupBy("k1", "k2")
        .agg(F.collect_set("item").alias("items"))
    )
    verdicts = marked.select("k1", "k2", "windows").join(listed, ["k1", "k2"], "left").mapInArrow(_verdicts, VERDICTS)
    return scanned.select("doc_id", "k1", "k2", "n_words", (F.size("hits") > 0).alias("met")), verdicts


def _contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def contamination(docs: DataFrame, benchmark: DataFrame, bits: int = BITS, words_at_once: int = PART) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the hit runs [starts, ends) in words."""
    scanned, verdicts = _judged_texts(docs, benchmark, bits, words_at_once)
    none = F.array().cast("array<int>")
    hit = scanned.where("met").join(verdicts, ["k1", "k2"], "left")
    return hit.unionByName(scanned.where("NOT met"), allowMissingColumns=True).select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items_sha256", F.lit(NO_ITEMS)).alias("items_sha256"),
        _contaminated(F.coalesce("n_hit", F.lit(0)), F.col("n_words")).alias("contaminated"),
        F.coalesce("starts", none).alias("starts"),
        F.coalesce("ends", none).alias("ends"),
    )


def _ruled_out(shared: Broadcast[Any], key: str, stays: bool):
    """Rows whose key the bitmap rules out, or the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            met = among(own, batch.column(key).to_numpy().view(np.uint64))
            yield batch.filter(pa.array(~met if stays else met))

    return run


def clean(docs: DataFrame, benchmark: DataFrame, bits: int = BITS, words_at_once: int = PART) -> DataFrame:
    """docs without the contaminated rows, with docs' columns.

    A bitmap of the contaminated texts' keys lets all rows that it rules out pass where they are; only the others are
    joined to the keys themselves, so clean texts are never shuffled.
    """
    scanned, verdicts = _judged_texts(docs, benchmark, bits, words_at_once)
    bad = scanned.where("met").select("k1", "k2", "n_words").distinct().join(verdicts, ["k1", "k2"]).where(_contaminated(F.col("n_hit"), F.col("n_words"))).select("k1", "k2")
    bad = stored(bad, "contaminated")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(bad, "k1", bits))
    # The caller's columns go in one struct, so that no name of theirs meets one of these.
    keyed = docs.select(F.struct(*columns_of(docs)).alias("row"), *(k.alias(c) for k, c in zip(text_keys(), ("k1", "k2"), strict=True)))
    passed = keyed.mapInArrow(_ruled_out(shared, "k1", True), keyed.schema)
    doubtful = keyed.mapInArrow(_ruled_out(shared, "k1", False), keyed.schema)
    return passed.unionByName(doubtful.join(bad, ["k1", "k2"], "left_anti").select(*keyed.columns)).select("row.*")
