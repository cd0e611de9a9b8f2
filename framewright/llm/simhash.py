"""SimHash near-duplicates by a binary trie self-join.

A document's fingerprint: lower-case A-Z, words parted by ASCII white space, 3-word shingles with repeats (a shorter
text: its whole word sequence; none: fingerprint zero); bit b is 1 where more than half of the shingles' XXH64 values
(seed 42) have it.  Two fingerprints link at ``BUDGET`` differing bits or fewer.

Distinct fingerprints only are joined, so exact copies cost one row.  They are one binary trie, joined with itself from
the root: node pairs go down together, each adding the bits in which its two branches differ, and a pair is left as
soon as its sum passes the budget.

The top of the trie is walked on DataFrames: it is cut at the bits that part the fingerprints best, and each
fingerprint becomes a row of every node pair that its node is in within the budget (1 + d + d(d-1)/2 of them for d bits).
Pairs with an empty side end there; those of more than ``GROUP`` fingerprints (a dense cluster of near copies) are cut
again, each at its own bits.  The others are walked to the leaves in tasks, a node pair in one.  As many bits are cut as
bring pairs to that size, so tasks are bounded at any number of fingerprints; nothing is dropped.

Links become components by large-star and small-star rounds on DataFrames, cut by tables in the shared folder.  In a
group only spanning links are passed on (at most one a fingerprint), which leaves the components as they are.

Nulls and ties: a null text has no words; a null doc_id is kept and never the smallest of a component (null only if the
component has no other id); repeated rows share fingerprint and component.  An empty table gives an empty table; a very
long text is hashed whole.  Columns beside doc_id and text are not read, or pass as they are, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import columns_of, key_of, partitions, stored, utf8

SHINGLE = 3
SEED = 42
BUDGET = 2
#: Fingerprints of a node pair that one task walks.
GROUP = 4096
#: Most bits at which the trie is first cut, and those at which a node pair that is still large is.
MOST_BITS, NEXT_BITS = 14, 6
#: Node pairs of a depth that go down together.
FRONTIER = 1 << 19


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    ws = utf8(text).lower().split()
    if not ws:
        return 0
    if len(ws) < shingle:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(ws), SEED)], np.uint64)
    else:
        joined = memoryview(b" ".join(ws))
        ends = np.cumsum([len(w) + 1 for w in ws]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: len(ws) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(ws) - shingle + 1)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits of which each is 1 where more than half of the unsigned hashes have it."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):  # so that the unpacked bits stay in cache
        part = hashes[i : i + 8192]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(fp.view(np.int64))], names=["doc_id", "h", "fp"])

    return run


def fingerprinted(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, h, fp): one row a document; h is its text's hash, fp the fingerprint's 64 bits as a signed long."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    return own.mapInArrow(_fingerprints(shingle), "doc_id bigint, h bigint, fp bigint")


# ---- the trie


def trie_pairs(fps: np.ndarray, other: np.ndarray | None = None, budget: int = BUDGET, met: Counter | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs (arrays of values) in a sorted array of distinct unsigned values, or between it and another.

    A node is a slice of a sorted array: the values under one prefix.  All node pairs of a depth go down together, each
    to its four pairs of children; a pair whose branches differ has used one more bit, and pairs beyond the budget are
    never made.  ``met`` counts node pairs by depth.
    """
    a, b = fps, fps if other is None else other
    # (a's slice, b's slice, bits differing, whether both are one node), level by level from the top bit.
    one = np.zeros(1, np.int64)
    todo = [(63, (one, one + len(a), one, one + len(b), one, np.full(1, other is None)))]
    while todo:
        bit, (a0, a1, b0, b1, used, same) = todo.pop()
        if met is not None:
            met[63 - bit] += len(a0)
        # Single values on both sides need no more nodes.
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        x, y = a[a0[leaf & ~same]], b[b0[leaf & ~same]]
        close = (np.bitwise_count(x ^ y) <= budget) & (x != y)
        if close.any():
            yield x[close], y[close]
        a0, a1, b0, b1, used, same = (c[~leaf] for c in (a0, a1, b0, b1, used, same))
        if not len(a0) or bit < 0:
            continue
        am, bm = (hi - (ones[hi] - ones[lo]) for lo, hi, ones in ((a0, a1, _ones(a, bit)), (b0, b1, _ones(b, bit))))
        spent, cross = used + 1, np.zeros(len(a0), bool)
        children = [(a0, am, b0, bm, used, same), (am, a1, bm, b1, used, same), (a0, am, bm, b1, spent, cross), (am, a1, b0, bm, spent, cross)]
        keep = [
            # Of a node with itself one of the two mixed pairs is enough.
            (c[1] > c[0]) & (c[3] > c[2]) & (c[4] <= budget) & ~((k == 3) & same)
            for k, c in enumerate(children)
        ]
        level = tuple(np.concatenate([c[i][m] for c, m in zip(children, keep, strict=True)]) for i in range(6))
        for start in range(0, len(level[0]), FRONTIER):  # a wide level goes on in parts, to bound its memory
            todo.append((bit - 1, tuple(c[start : start + FRONTIER] for c in level)))


def _ones(values: np.ndarray, bit: int) -> np.ndarray:
    return np.concatenate(([0], np.cumsum((values >> np.uint64(bit) & np.uint64(1)).astype(np.int64))))


def spanning(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[list[int], list[int]]:
    """Of the links, those that join two parts not joined before."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    xs: list[int] = []
    ys: list[int] = []
    for a, b in pairs:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            rx, ry = find(x), find(y)
            if rx != ry:
                root[max(rx, ry)] = min(rx, ry)
                xs.append(x)
                ys.append(y)
    return xs, ys


def _walk(spanning_only: bool, budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key: a node pair, or a node with itself."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 20_000:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column("key").to_numpy()
            cut = int(np.searchsorted(keys[::-1] != keys[-1], True)) if keys[0] != keys[-1] else len(keys)
            ready = len(keys) - cut  # the last key may go on in the next batch
            if ready > 0:
                yield from _groups(table.slice(0, ready), spanning_only, budget)
                held = table.slice(ready).to_batches()
        if held:
            yield from _groups(pa.Table.from_batches(held).combine_chunks(), spanning_only, budget)

    return run


def _groups(table: pa.Table, spanning_only: bool, budget: int) -> Iterator[pa.RecordBatch]:
    keys, side, cross = (table.column(c).to_numpy() for c in ("key", "side", "cross"))
    fps = table.column("fp").to_numpy().view(np.uint64)
    edges = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
    xs: list[int] = []
    ys: list[int] = []
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        # Were two node pairs ever to share a key, their union holds the links of both.
        if cross[lo:hi].all():
            found = trie_pairs(np.unique(fps[lo:hi][side[lo:hi] == 0]), np.unique(fps[lo:hi][side[lo:hi] == 1]), budget)
        else:
            found = trie_pairs(np.unique(fps[lo:hi]), None, budget)
        if spanning_only:
            x, y = spanning(found)
        else:
            got = list(found)
            x, y = ([v for p in got for v in p[i].tolist()] for i in (0, 1))
        xs += x
        ys += y
    if xs:
        a, b = (np.array(v, np.uint64).view(np.int64) for v in (xs, ys))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _bits(picked: Column) -> Column:
    """The fingerprint's bits at the picked places, as one number."""
    return F.aggregate(picked, F.lit(0).cast("bigint"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(F.call_function("shiftrightunsigned", F.col("fp"), b).bitwiseAND(F.lit(1))))


def _masks(bits: int, ones: int) -> Column:
    """All numbers of so many bits with so many ones or fewer."""
    found = [sum(1 << i for i in places) for n in range(ones + 1) for places in itertools.combinations(range(bits), n)]
    return F.array(*(F.lit(m).cast("bigint") for m in found))


def _cut(members: DataFrame, bits: int, budget: int, first: bool) -> DataFrame:
    """The node pairs ``bits`` levels below those of members, in an order of bits that parts each of them well.

    A fingerprint goes to every pair that its node is in within what is left of the budget.
    """
    # A bit's lack of balance in a node pair; the bits that it has come down by are out.
    off = [
        F.when(F.max(F.shiftrightunsigned("done", b).bitwiseAND(F.lit(1))) == 1, F.lit(2**62)).otherwise(F.abs(2 * F.sum(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1))) - F.count("*")))
        for b in range(64)
    ]
    listed = F.array(*(F.struct(o.alias("off"), F.lit(b).alias("bit")) for b, o in enumerate(off))).alias("_off")
    picked = F.transform(F.slice(F.array_sort("_off"), 1, bits), lambda x: x["bit"]).alias("picked")
    # At first all fingerprints are in one node, so there is one row of picks.
    chosen = members.withColumn("picked", members.agg(listed).select(picked).scalar()) if first else members.join(members.groupBy("key").agg(listed).select("key", picked), "key")
    left = budget - F.col("used")
    masks = _masks(bits, budget)
    for ones in range(budget):
        masks = F.when(left == ones, _masks(bits, ones)).otherwise(masks)
    placed = chosen.withColumn("node", _bits(F.col("picked"))).withColumn("mask", F.explode(masks))
    node, mine = F.col("node"), F.col("side") == 0
    met = node.bitwiseXOR(F.col("mask"))
    low = F.when(F.col("cross"), F.when(mine, node).otherwise(met)).otherwise(F.least(node, met))
    high = F.when(F.col("cross"), F.when(mine, met).otherwise(node)).otherwise(F.greatest(node, met))
    return placed.select(
        F.xxhash64("key", low, high).alias("key"),
        "fp",
        F.when(F.col("cross"), F.col("side")).otherwise((node > met).cast("int")).alias("side"),
        (F.col("cross") | (F.col("mask") != 0)).alias("cross"),
        (F.col("used") + F.bit_count("mask")).cast("int").alias("used"),
        F.aggregate("picked", F.col("done"), lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), b))).alias("done"),
    )


def links(fps: DataFrame, spanning_only: bool = False, group: int = GROUP, budget: int = BUDGET) -> DataFrame:
    """(a, b): linked pairs of distinct fingerprints, a < b as signed longs; fps has distinct values in fp.

    spanning_only keeps, of each node pair's links, a spanning set.
    """
    spark = fps.sparkSession
    n = partitions(spark)
    total = fps.count()
    members = fps.select(F.lit(0).cast("bigint").alias("key"), "fp", F.lit(0).alias("side"), F.lit(False).alias("cross"), F.lit(0).alias("used"), F.lit(0).cast("bigint").alias("done"))
    ready: list[DataFrame] = []
    small = ("key", "fp", "side", "cross")
    if total <= group:
        ready.append(members.select(*small))
        total = 0
    bits = min(MOST_BITS, max(1, (2 * total // group).bit_length()))
    while total:
        members = stored(_cut(members, bits, budget, not ready), "node-pairs")
        sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("side") == 0).alias("n0"), F.bool_and("cross").alias("only"))
        # Node pairs with nothing on one side end here.
        sizes = sizes.where("n > 1 AND (NOT only OR (n0 > 0 AND n0 < n))").select("key", "n")
        sized = stored(members.join(sizes, "key"), "sized-pairs")
        ready.append(sized.where(F.col("n") <= group).select(*small))
        members = sized.where(F.col("n") > group).drop("n")
        total = members.count()
        bits = NEXT_BITS
    todo = functools.reduce(DataFrame.unionByName, ready).repartition(n, "key").sortWithinPartitions("key")
    return todo.mapInArrow(_walk(spanning_only, budget), "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each linked node's component, by large-star and small-star rounds."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        met = both.join(least, "a")
        if large:
            return met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        return met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64(F.least("a", "b"), F.greatest("a", "b")).cast("decimal(38,0)"))).first())
    edges = stored(edges.select("a", "b"), "star")
    before, now = None, state(edges)
    while now != before and now[0]:
        edges = stored(star(star(edges, True), False), "star")
        before, now = now, state(edges)
    return edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).groupBy("node").agg(F.min("root").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, h, fp, root, component_id): one row a document; root is the component's smallest fingerprint."""
    own = stored(fingerprinted(docs, shingle), "fingerprints")
    distinct = stored(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct, spanning_only=True))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select(F.col("fp").alias("_fp"), "root", "component_id")
    return own.join(named, own["fp"] == F.col("_fp")).select("doc_id", "h", "fp", "root", "component_id")


def representatives(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs' rows, one of each component: that with the smallest doc_id (a null one last; of equal ids, by text hash)."""
    return first_rows(docs, near_duplicates(docs, shingle))


def first_rows(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """docs' rows, the first of each root; rooted has a row (doc_id, h, root) for each of them.

    A row is known by its doc_id and text, so rows that share an id, or have none, are judged one by one.  Only the keys
    of rows that go are joined to the documents, so the join has no row for a document that stays.
    """
    me = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("doc_id"), F.col("h").alias("h"))
    found = stored(rooted.select("root", me.alias("me")), "components")
    first = stored(found.groupBy("root").agg(F.min("me").alias("first")), "representatives")
    marked = found.join(first, "root")
    key = lambda df: df.select(key_of("me.doc_id").alias("id"), F.col("me.h").alias("h"))
    # The caller's columns go in one struct, so that no name of theirs meets one of these.
    own = docs.select(F.struct(*columns_of(docs)).alias("row"), key_of("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    # How many go grows with the corpus, so they are never broadcast: the plan is the same at every size.
    kept = own.join(key(marked.where("NOT (me <=> first)")).distinct().hint("merge"), ["id", "h"], "left_anti")
    twice = marked.where("me <=> first").groupBy("me").agg(F.count("*").alias("n")).where("n > 1")
    if twice.isEmpty():
        return kept.select("row.*")
    # Repeated rows: those rows alone are cut to one each.
    again = key(twice)
    one = kept.join(again, ["id", "h"], "left_semi").dropDuplicates(["id", "h"])
    return kept.join(again, ["id", "h"], "left_anti").unionByName(one).select("row.*")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
