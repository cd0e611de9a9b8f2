"""Near-duplicates by word shingles: SimHash and MinHash candidates, each then checked by its exact Jaccard similarity.

A document is the set of its ``SHINGLE``-word shingles (lower-case A-Z, words parted by ASCII white space; a shorter
text: its whole word sequence; none: the empty set).  Two documents link where their sets have a Jaccard similarity of
``SIMILARITY`` or more, and of a linked component one document is kept.

Equal sets are one row.  Sets whose SimHash fingerprints differ in ``simhash.BUDGET`` bits or fewer are candidates, all of
them: the fingerprints go through the binary trie's self-join.  A fingerprint's bits are the majority of the hashes in the set.

Two sets of similarity 0.8 may differ in some 17 of 64 bits, where a trie walk prunes next to nothing, so MinHash finds
those beyond the budget.  Each set has ``BANDS`` keys of ``ROWS`` minima; sets that share a key are candidates too, which
two sets of similarity s are with a probability of 1 - (1 - s ** ROWS) ** BANDS (0.9999 at 0.8, more above).  Equal keys
lie side by side in the sorted rows of a partition, so neighbours are linked and no group is held or paired.

The candidates' components (clusters) hold every candidate pair.  A cluster's texts meet in one task, where each pair
that is not joined already is compared exactly, so a dense cluster of n near copies takes about n comparisons.

Nulls and ties as in ``simhash``: a null text is the empty set, a null doc_id is kept and never the smallest.  An empty
table gives an empty table; a very long text is one set of all its shingles; other columns pass as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import key_of, partitions, stored, utf8
from framewright.llm.simhash import components, first_rows, links, majority, spanning

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 6
SEED = 42
_draw = np.random.default_rng(SEED)
FACTORS = _draw.integers(0, 2**31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _draw.integers(0, 2**32, BANDS * ROWS, np.uint32)
MIX = _draw.integers(0, 2**63, ROWS // 2, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    ws = utf8(text).lower().split()
    digest = xxhash.xxh64_intdigest
    if len(ws) < width:
        return np.array([digest(b" ".join(ws), SEED)] if ws else [], np.uint64)
    joined = memoryview(b" ".join(ws))
    ends = np.cumsum([len(w) + 1 for w in ws]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(ws) - width + 1
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, n))


def band_keys(own: np.ndarray) -> np.ndarray:
    """One key a band, which names the band too; none for the empty set."""
    if not len(own):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    half = own.astype(np.uint32)[:, None]
    for i in range(0, len(half), 256):  # so that the products stay in cache
        np.minimum(least, (half[i : i + 256] * FACTORS + SHIFTS).min(axis=0), out=least)
    mixed = (least.view(np.uint64).reshape(BANDS, ROWS // 2) * MIX).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * MIX[0]
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, fps, keys = [], [], []
        for t in batch.column("text"):
            own = shingles(t.as_py())
            digests.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
            fps.append(majority(own))
            keys.append(band_keys(own))
        offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *keys])))
        digest, fp = (pa.array(np.array(v, np.uint64).view(np.int64)) for v in (digests, fps))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), digest, fp, listed], names=["doc_id", "h", "digest", "fp", "keys"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of sets that share a key; rows come sorted by key."""
    xs, ys = np.empty(0, np.int64), np.empty(0, np.int64)
    last: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.int64), np.empty(0, np.int64))

    def reduced(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = spanning(iter([(a, b)]))
        return np.array(x, np.int64), np.array(y, np.int64)

    for batch in batches:
        key, digest = (np.concatenate((before, batch.column(c).to_numpy())) for before, c in zip(last, ("key", "digest"), strict=True))
        same = key[1:] == key[:-1]
        xs, ys = np.concatenate((xs, digest[:-1][same])), np.concatenate((ys, digest[1:][same]))
        last = key[-1:], digest[-1:]
        if len(xs) > 500_000:
            xs, ys = reduced(xs, ys)
            if len(xs) > 250_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(xs, ys)), pa.array(np.maximum(xs, ys))], names=["a", "b"])
                xs, ys = xs[:0], ys[:0]
    xs, ys = reduced(xs, ys)
    if len(xs):
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(xs, ys)), pa.array(np.maximum(xs, ys))], names=["a", "b"])


def linked(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """For each set the number of its component under Jaccard >= similarity: the smallest place in it."""
    n = len(sets)
    label, sizes = np.arange(n), np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(codes) + 1, np.int8)
    for i in range(n - 1):
        later = np.arange(i + 1, n)
        later = later[(label[i + 1 :] != label[i]) & (np.minimum(sizes[i + 1 :], sizes[i]) >= similarity * np.maximum(sizes[i + 1 :], sizes[i]) - 1e-9)]
        if not len(later):
            continue
        mine = codes[starts[i] : starts[i + 1]]
        mark[mine] = 1
        ends = np.cumsum(sizes[later])
        at = np.repeat(starts[later] - (ends - sizes[later]), sizes[later]) + np.arange(ends[-1])
        both = np.add.reduceat(mark[codes[at]], ends - sizes[later], dtype=np.int64)
        mark[mine] = 0
        met = later[both >= similarity * (sizes[i] + sizes[later] - both) - 1e-9]
        if len(met):
            joined = np.isin(label, [label[i], *label[met]])
            label[joined] = label[joined].min()
    return label


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, digest, text) sorted by cluster to (node, root), the smallest digest of its checked component."""
    cluster: int | None = None
    held: dict[int, np.ndarray] = {}
    nodes: list[int] = []
    roots: list[int] = []

    def close() -> None:
        digests = sorted(held)
        nodes.extend(digests)
        roots.extend(digests[k] for k in linked([held[d] for d in digests]).tolist())
        held.clear()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], names=["node", "root"])

    for batch in batches:
        for c, d, t in zip(batch.column("cluster").to_pylist(), batch.column("digest").to_pylist(), batch.column("text"), strict=True):
            if c != cluster and held:
                close()
            cluster = c
            if d not in held:
                held[d] = shingles(t.as_py())
        yield out()
        nodes, roots = [], []
    if held:
        close()
        yield out()


def trie_links(sets: DataFrame) -> DataFrame:
    """(a, b): spanning links of the sets (digest, fp) whose fingerprints differ in simhash.BUDGET bits or fewer."""
    # Of the sets with one fingerprint the first stands for it.
    fps = stored(sets.groupBy("fp").agg(F.min("digest").alias("first")), "set-fingerprints")
    first = lambda side: fps.select(F.col("fp").alias(side), F.col("first").alias(f"{side}_first"))
    near = links(fps.select("fp"), spanning_only=True).join(first("a"), "a").join(first("b"), "b").select("a_first", "b_first")
    equal = sets.join(fps, "fp").where("digest <> first").select("first", "digest")
    return near.union(equal).toDF("x", "y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def candidates(own: DataFrame) -> DataFrame:
    """(a, b): links of digests that join all sets (digest, fp, keys) with near fingerprints or a key in common."""
    keyed = own.dropDuplicates(["digest"]).select(F.explode("keys").alias("key"), "digest")
    met = keyed.repartition(partitions(own.sparkSession), "key").sortWithinPartitions("key").mapInArrow(_neighbours, "a bigint, b bigint")
    # The empty set has no keys; it is near no other.
    return met.unionByName(trie_links(own.where(F.size("keys") > 0).select("digest", "fp").distinct())).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, h, root): one row a document; h is its text's hash, root the smallest digest of its component."""
    n = partitions(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    own = stored(texts.mapInArrow(_signed, "doc_id bigint, h bigint, digest bigint, fp bigint, keys array<bigint>"), "minhash")
    clusters = stored(components(candidates(own)).select(F.col("node"), F.col("root").alias("cluster")), "clusters")
    # The root itself is no node of its own.
    clusters = clusters.unionByName(clusters.select(F.col("cluster").alias("node"), "cluster")).distinct()
    me = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("doc_id"), F.col("h").alias("h"))
    # One document of each set stands for it.
    named = own.select("digest", me.alias("me")).join(clusters, F.col("digest") == F.col("node")).groupBy("cluster", "digest").agg(F.min("me").alias("me"))
    named = named.select("cluster", "digest", key_of("me.doc_id").alias("_id"), F.col("me.h").alias("_h"))
    on = (key_of("doc_id") == F.col("_id")) & (F.col("h") == F.col("_h"))
    members = texts.join(named.hint("merge"), on).select("cluster", "digest", "text")
    roots = stored(members.repartition(n, "cluster").sortWithinPartitions("cluster").mapInArrow(_checked, "node bigint, root bigint"), "checked")
    return own.join(roots, own["digest"] == roots["node"], "left").select("doc_id", "h", F.coalesce("root", "digest").alias("root"))


def representatives(docs: DataFrame) -> DataFrame:
    """docs' rows, one of each component: that with the smallest doc_id (a null one last; of equal ids, by text hash)."""
    return first_rows(docs, near_duplicates(docs))
