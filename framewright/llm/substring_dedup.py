"""Exact substring dedup by maximal repeats of an enhanced suffix array.

Every byte that lies in a ``LENGTH``-byte string which also starts earlier (smaller doc_id, or earlier in the same
document) goes.  Texts are UTF-8 bytes; matches stay within a document.

1. Every window of LENGTH bytes names an anchor: the ``GRAM``-byte gram in it with the smallest hash.  Windows in a row
   with the same anchor form a segment.  Equal windows have equal anchors, so repeats meet by anchor, at about
   2 / (LENGTH - GRAM + 2) segments a byte.
2. Equal segments become one copy with its number of occurrences, first in the scan task and then by anchor; the first of
   them in the corpus stands for all.  An anchor with one segment that occurs once holds no repeat.
3. The copies left go to buckets by anchor.  A bucket's bytes get a suffix array and a table of common prefixes (of the
   suffixes whose first LENGTH bytes another may share); a stack scan of that table gives the tree of common-prefix
   intervals, and every interval of LENGTH bytes or more whose occurrences differ in the byte before them is a maximal
   repeat, with all its occurrences; so is a copy that occurs more than once.  All occurrences but the first are removed:
   in the copies where they stand, and in the other occurrences of a copy by joining them to it.
4. An anchor with more than ``GROUP`` different segments (the rim of a passage that very many documents frame differently)
   would not fit a task, and cutting its segments at a further anchor would leave as many different ones there.  Its
   segments are cut into single windows, which have anchors of their own, and these take steps 2 and 3 like all others.

Segments are taken for equal where two 64-bit hashes are, of a gram and of the whole.

Nulls and ties: a null text is empty; a null doc_id counts as the smallest.  Different texts of one doc_id, or of none,
are documents in the order of their hash; a repeated row is one document, not a repeat of itself.  An empty table gives an
empty table; a very long text is scanned in parts that share LENGTH - 1 bytes.  Columns beside doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import key_of, partitions, stored, text_of, utf8
from framewright.llm.rolling import mix, prefix_hash, smallest, stretch

LENGTH = 100
GRAM = 24
#: Different segments of an anchor that go to one bucket.
GROUP = 2048
#: Bytes of a bucket.
BUCKET_BYTES = 1 << 19
#: A longer document is scanned in parts of so many bytes, which share LENGTH - 1 bytes.
PART = 1 << 22
#: Segments that a scan task combines at a time.
COMBINE = 200_000


def segments(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor, whole, lo, hi, windows): segment i has the windows that start at lo[i] .. hi[i]."""
    n = len(data)
    grams = prefix_hash(data, 0)
    at = np.arange(n - gram + 1)
    h = stretch(grams, 0, at, at + gram)
    # The place breaks ties, the leftmost first, which depends on the window's own bytes only.
    low = np.uint64(PART.bit_length() + 1)
    first = smallest((h >> low << low) | at.astype(np.uint64), length - gram + 1)
    place = (first & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    lo = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
    hi = np.concatenate((lo[1:] - 1, [len(place) - 1]))
    anchor = h[place[lo]]
    sums = prefix_hash(data, 1)
    whole = stretch(sums, 1, lo, hi + length) ^ mix((place[lo] - lo).astype(np.uint64) + np.uint64(1))
    return anchor, whole, lo, hi, sums


#: repeat: equal to an earlier one of its scan batch; n: how often a first one occurs in its batch.
FOUND = "repeat boolean, anchor bigint, whole bigint, doc bigint, lo int, hi int, n int"


def _firsts(anchor: np.ndarray, whole: np.ndarray, doc: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """For the first entry, by (doc, lo), of those with an anchor and whole, how many there are; 0 for the others."""
    order = np.lexsort((lo, doc, whole, anchor))
    a, w = anchor[order], whole[order]
    at = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (w[1:] != w[:-1]))))
    times = np.zeros(len(order), np.int32)
    times[order[at]] = np.diff(np.concatenate((at, [len(order)])))
    return times


def _combined(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    anchor, whole, doc, lo, hi = (np.concatenate(c) for c in zip(*held, strict=True))
    n = _firsts(anchor, whole, doc, lo)
    columns = [pa.array(n == 0), pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(doc), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(n)]
    yield pa.RecordBatch.from_arrays(columns, names=["repeat", "anchor", "whole", "doc", "lo", "hi", "n"])


def _scan(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text"), strict=True):
                data = np.frombuffer(utf8(text.as_py()), np.uint8)
                for start in range(0, max(len(data) - length + 1, 0), PART):
                    anchor, whole, lo, hi, _ = segments(data[start : start + PART + length - 1], length, gram)
                    held.append((anchor, whole, np.full(len(lo), doc, np.int64), lo + start, hi + start))
                    size += len(lo)
                if size > COMBINE:
                    yield from _combined(held)
                    held, size = [], 0
        if held:
            yield from _combined(held)

    return run


# ---- the enhanced suffix array of a bucket


def sparse_suffixes(text: bytes, ends: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """Places where a repeat of ``least`` bytes can start: their first ``least`` bytes have a hash that another has."""
    sizes = np.maximum(ends - starts - least + 1, 0)
    first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    at = np.repeat(starts - first, sizes) + np.arange(int(sizes.sum()))
    h = stretch(prefix_hash(np.frombuffer(text, np.uint8), 0), 0, at, at + least)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return at[twice]


def suffix_array(text: bytes, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that start at the places, each up to its part's end: their order, and the bytes shared with the one before."""
    suffixes = [text[a:b] for a, b in zip(at.tolist(), end.tolist(), strict=True)]
    order = np.array(sorted(range(len(at)), key=suffixes.__getitem__), np.int64)
    size = (end - at)[order]
    width = int(size.max()) if len(size) else 0
    data = np.frombuffer(text + bytes(width), np.uint8)
    lcp = np.zeros(len(order), np.int64)
    for i in range(1, len(order), 65_536):  # so many rows at a time, to bound the comparison's memory
        k = np.arange(i, min(i + 65_536, len(order)))
        most = np.minimum(size[k], size[k - 1])
        differ = data[at[order[k]][:, None] + np.arange(width)] != data[at[order[k - 1]][:, None] + np.arange(width)]
        shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        lcp[k] = np.minimum(shared, most)
    return order, lcp


def intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the common-prefix intervals of ``least`` or more, by one scan with a stack."""
    stack: list[tuple[int, int]] = []
    runs = np.flatnonzero(lcp >= least)
    previous = -2
    for r in [*runs.tolist(), len(lcp)]:
        if r != previous + 1 or r == len(lcp):
            while stack:
                n, first = stack.pop()
                yield n, first, previous
            if r == len(lcp):
                break
        start, n = r - 1, int(lcp[r])
        while stack and stack[-1][0] > n:
            m, start = stack.pop()
            yield m, start, r - 1
        if not stack or stack[-1][0] < n:
            stack.append((n, start))
        previous = r


def maximal_repeats(parts: list[bytes], least: int, times: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places): every repeat of ``least`` bytes or more that its occurrences' surroundings do not extend.

    places are offsets into the parts joined with a byte that UTF-8 does not have between them.  times: how often each part
    occurs; one that occurs more than once is a repeat in itself, with the place where it stands.
    """
    text = b"\xff".join(parts) + b"\xff"
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    for i in np.flatnonzero(times > 1) if times is not None else ():
        yield int(sizes[i]), (ends - sizes)[i : i + 1]
    at = sparse_suffixes(text, ends, ends - sizes, least)
    order, lcp = suffix_array(text, at, ends[np.searchsorted(ends, at)])
    at = at[order]
    before = np.frombuffer(b"\xff" + text, np.uint8)[at]
    edge = before == 0xFF  # the start of a part can't be extended, so it differs from all
    # For left diversity of an interval in one look-up: where the byte before differs from its neighbour's in order.
    change = np.concatenate(([0], np.cumsum((before[1:] != before[:-1]) | edge[1:] | edge[:-1])))
    for n, first, last in intervals(lcp, least):
        if change[last] > change[first]:
            yield n, at[first : last + 1]


#: Spans of copies that repeat an earlier place (doc, lo, hi), and copies that occur more than once (anchor, whole).
TREES = "doc bigint, lo int, hi int, anchor bigint, whole bigint"


def _repeats(length: int):
    """A bucket: rows (anchor, whole, doc, lo, n, bytes) to what its tree says of them."""

    def of(group: pa.Table) -> pa.Table:
        parts = group.column("bytes").to_pylist()
        starts = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))[:-1]
        doc, lo, times = (group.column(c).to_numpy() for c in ("doc", "lo", "n"))
        size = int(starts[-1]) + len(parts[-1]) + 1
        owner = np.repeat(np.arange(len(parts)), np.diff(np.concatenate((starts, [size]))))
        place = lo[owner] + np.arange(size) - starts[owner]
        rank = np.empty(size, np.int64)
        rank[np.lexsort((place, doc[owner]))] = np.arange(size)
        reach = np.zeros(size, np.int64)
        several = np.zeros(len(parts), bool)
        for n, at in maximal_repeats(parts, length, times):
            if len(at) == 1:  # a copy that occurs more than once
                several[owner[at]] = True
                continue
            r = rank[at]
            k = r.argmin()
            # The same place may stand in two parts that overlap; it is not a repeat of itself.
            later = at[(doc[owner[at]] != doc[owner[at[k]]]) | (place[at] != place[at[k]])]
            np.maximum.at(reach, later, n)
        at = np.flatnonzero(reach)
        copies = np.flatnonzero(several)
        none, nowhere = pa.nulls(len(at), pa.int64()), pa.nulls(len(copies), pa.int32())
        keys = group.select(["anchor", "whole"]).take(pa.array(copies)).combine_chunks()
        spans = pa.table({"doc": pa.array(doc[owner[at]], pa.int64()), "lo": pa.array(place[at].astype(np.int32)), "hi": pa.array((place[at] + reach[at]).astype(np.int32)), "anchor": none, "whole": none})
        return pa.concat_tables([spans, pa.table({"doc": pa.nulls(len(copies), pa.int64()), "lo": nowhere, "hi": nowhere, "anchor": keys.column("anchor"), "whole": keys.column("whole")})])

    return of


PARTS = "key bigint, anchor bigint, whole bigint, doc bigint, lo int, n bigint, bytes binary"


def _bytes_of(length: int):
    """Documents with the copies that they give, to the copies' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "anchor", "whole", "doc", "lo", "n", "bytes"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc, text, found in zip(batch.column("doc").to_pylist(), batch.column("text"), batch.column("open"), strict=True):
                raw = utf8(text.as_py())
                for s in found.as_py():
                    for column, v in zip(rows, (s["key"], s["anchor"], s["whole"], doc, s["lo"], s["n"], raw[s["lo"] : s["hi"] + length]), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=names)

    return run


def _windows_of(length: int):
    """Documents with segments of crowded anchors, to their single windows, combined as the scan combines segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[np.ndarray, ...]] = []
            for doc, text, found in zip(batch.column("doc").to_pylist(), batch.column("text"), batch.column("open"), strict=True):
                data = np.frombuffer(utf8(text.as_py()), np.uint8)
                sums = prefix_hash(data, 0), prefix_hash(data, 1)
                lo = np.unique(np.concatenate([np.arange(s["lo"], min(s["hi"], len(data) - length) + 1) for s in found.as_py()]))
                held.append((stretch(sums[0], 0, lo, lo + length), stretch(sums[1], 1, lo, lo + length), np.full(len(lo), doc, np.int64), lo, lo))
            if held:
                yield from _combined(held)

    return run


def _marked(found: DataFrame, n: int) -> DataFrame:
    """found's segments, each the first of its kind (nth 1, with total occurrences n) or a later one; kinds: how many its anchor has.

    First ones of an anchor that has nothing else go.  Repeats found in their scan batch only pass through, dealt by
    document; the others are dealt by anchor.
    """
    dealt = found.withColumn("key", F.when(F.col("repeat"), F.xxhash64("doc", "lo")).otherwise(F.col("anchor"))).repartition(n, "key")
    same = Window.partitionBy("key", "repeat", "whole")
    ranked = (
        dealt.withColumn("first", ~F.col("repeat") & (F.row_number().over(same.orderBy("doc", "lo")) == 1))
        .withColumn("total", F.sum("n").over(same))
        .withColumn("kinds", F.count_if("first").over(Window.partitionBy("key", "repeat")))
    )
    kept = ranked.where(~F.col("first") | (F.col("total") > 1) | (F.col("kinds") > 1))
    return stored(kept.select("first", "anchor", "whole", "doc", "lo", "hi", F.col("total").alias("n"), "kinds"), "segments")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc, lo, hi): spans of bytes [lo, hi) that repeat an earlier place; docs has doc and text."""
    n = partitions(docs.sparkSession)
    listed = lambda df, *names: df.groupBy("doc").agg(F.collect_list(F.struct(*names)).alias("open"))
    marked = _marked(docs.mapInArrow(_scan(length, gram), FOUND), n)
    crowded = F.col("kinds") > group
    # A crowded anchor's segment that occurs more than once is also a copy by itself, for its other occurrences.
    copies = marked.where(F.col("first") & (~crowded | (F.col("n") > 1))).withColumn("key", F.when(crowded, F.xxhash64("anchor", "whole")).otherwise(F.col("anchor")))
    later = marked.where("NOT first")
    cut = marked.where(F.col("first") & crowded)
    if not cut.isEmpty():
        windows = _marked(docs.join(listed(cut, "lo", "hi"), "doc").mapInArrow(_windows_of(length), FOUND), n)
        copies = copies.unionByName(windows.where("first").withColumn("key", F.col("anchor")))
        later = later.unionByName(windows.where("NOT first"))
    size = copies.agg(F.coalesce(F.sum(F.col("hi") - F.col("lo") + length), F.lit(0)).alias("n")).first()["n"]
    parts = docs.join(listed(copies, "key", "anchor", "whole", "lo", "hi", "n"), "doc").mapInArrow(_bytes_of(length), PARTS)
    bucket = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-size // bucket_bytes))))
    trees = stored(parts.select(bucket.alias("bucket"), "anchor", "whole", "doc", "lo", "n", "bytes").groupBy("bucket").applyInArrow(_repeats(length), TREES), "trees")
    several = trees.where("whole IS NOT NULL").select("anchor", "whole")
    others = later.join(several, ["anchor", "whole"], "left_semi").select("doc", "lo", (F.col("hi") + length).cast("int").alias("hi"))
    return trees.where("whole IS NULL").select("doc", "lo", "hi").unionByName(others)


def union_of(lo: np.ndarray, hi: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The spans, clipped to n bytes, as maximal runs (runs that touch are one)."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.minimum(hi[order], n)
    lo, hi = lo[lo < hi], hi[lo < hi]
    if not len(lo):
        return []
    reach = np.maximum.accumulate(hi)
    new = np.concatenate(([True], lo[1:] > reach[:-1]))
    return list(zip(lo[new].tolist(), reach[np.concatenate((new[1:], [True]))].tolist(), strict=True))


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def _removed(with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for doc, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("spans"), strict=True):
                raw = utf8(text.as_py())
                runs = union_of(*(spans.values.field(c).to_numpy() for c in ("lo", "hi")), len(raw)) if spans.is_valid else []
                kept, at = [], 0
                for a, b in runs:
                    kept.append(raw[at:a])
                    at = b
                rest = b"".join([*kept, raw[at:]])
                for column, v in zip(rows, (doc, len(raw), len(raw) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest if with_bytes else None), strict=True):
                    column.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _keyed(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """own, with ``doc`` telling texts apart, and the same with each text once.

    Where an id (or none) has several texts, doc becomes a key in the order of id and text hash.
    """
    ids = own.select("doc", F.xxhash64("text").alias("h"))
    seen = ids.groupBy("doc").agg((F.min("h") != F.max("h")).alias("several"), F.count("*").alias("n"))
    several, most = seen.agg(F.coalesce(F.bool_or("several"), F.lit(False)), F.coalesce(F.max("n"), F.lit(0))).first()
    if not several:
        return own, own if most < 2 else own.dropDuplicates(["doc"])
    # Row numbers of a sorted table grow with its order; written, they stay as they are.
    keys = stored(ids.distinct().orderBy("doc", "h").select(F.col("doc").alias("_d"), F.col("h").alias("_h"), F.monotonically_increasing_id().alias("_key")), "text-keys")
    own = own.join(keys, (F.col("doc") == F.col("_d")) & (F.xxhash64("text") == F.col("_h"))).select("doc_id", F.col("_key").alias("doc"), "text")
    return own, own.dropDuplicates(["doc"])


def deduped(docs: DataFrame, length: int = LENGTH, with_bytes: bool = True, **how) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256 and the bytes kept (null unless with_bytes)."""
    own, once = _keyed(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), key_of("doc_id").alias("doc"), text_of("text").alias("text")))
    spans = repeated_spans(once.select("doc", "text"), length, **how).groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return own.join(spans, "doc", "left").select("doc_id", "text", "spans").mapInArrow(_removed(with_bytes), RESULT)
