"""Best-fit packing of documents into sequences of ``CAPACITY`` tokens.

Pieces matter to packing only by length, so the problem is a histogram of at most CAPACITY lengths, whatever the
number of documents.  Its configuration linear program (which multisets of lengths fill a sequence, and how often to
use each) is solved by multiplicative weights: every length has a price, a knapsack dynamic program finds the
configuration that is full and worth most at these prices, and the prices of lengths that it serves fall.  How often a
configuration is used is rounded down to a whole number as it is found.  Rounds go on until what is left fills no
sequence; that remainder is packed best-fit decreasing.

A round serves half of the count of one length at least, so there are three rounds a length at most, whatever the number
of documents, and the plan has a row for each configuration and length in it: that bounds what is broadcast.  The plan
is then applied by rank: the r-th piece of a length goes to the
sequence that the plan gives to rank r.  Ranks are counted in salted groups, with as many salts for a length as its
share of the pieces asks for, so a length that a third of all pieces have is not one task's.

Nulls and ties: a null text is empty and has one token (the closing id).  Repeated rows are packed one by one; pieces
of equal length are interchangeable, and their order is by doc_id and piece.  An empty table has no pieces.  A very long
text is encoded whole and becomes as many pieces as it needs.  Columns beside doc_id and text are not read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import partitions, stored, text_of

CAPACITY = 2048
#: The closing id, 0, as it stands in a sequence.
END_ID = bytes(4)
SEED = 20_250_103
#: Lengths that a round prices at first.
PRICED = 64
#: Most of a length's count that one round serves, and the rate at which served lengths lose weight.
STEP = 0.5
RATE = 0.5
#: How much more than its share a length of a whole sequence is worth.
LONGER = 1.0
#: Tokens that a configuration may leave open.
WASTE = 2
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: Text that is split and encoded at a time.
BATCH_BYTES = 8_000_000


#: Encoded words that a Python worker keeps, over its tasks, and the longest that it keeps.  They are kept in two
#: generations: a full one ages, and what is met again moves to the new one, so common words stay.
CACHE_WORDS, CACHE_CHARS = 1_500_000, 48
_kept: dict[str, list[dict[str, bytes]]] = {}


def encoded_words(t, words: list[str]) -> Iterator[bytes]:
    """Each word's ids.  A special token stands between words, so that many are encoded as one text and parted by its id."""
    special = sorted(a.content for a in t.get_added_tokens_decoder().values())
    mark = special[0] if special else None
    for i in range(0, len(words), 2000):
        part = words[i : i + 2000]
        if mark is None or any(a in w for w in part if "<" in w for a in special):
            for e in t.encode_batch_fast(part, add_special_tokens=False):
                yield struct.pack(f"<{len(e.ids)}I", *e.ids)
            continue
        ids = np.array(t.encode_batch_fast([mark.join(part)], add_special_tokens=False)[0].ids, "<u4")
        cut = np.flatnonzero(ids == t.token_to_id(mark))
        raw = ids.tobytes()
        for a, b in zip([0, *(4 * cut + 4).tolist()], [*(4 * cut).tolist(), len(raw)], strict=True):
            yield raw[a:b]


def token_ids(path: str, cache_words: int = CACHE_WORDS):
    """A function from an Arrow array of texts to each text's ids (uint32, little-endian bytes).

    The vocabulary's pre-tokenizer drops white space and no token spans it, so a text's ids are those of its words in a
    row.  Arrow splits the texts and numbers their distinct words; a word is encoded when a worker first meets it.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    kept = _kept.setdefault(path, [{"": b""}, {}])

    def encode(texts: pa.Array) -> Iterator[bytes]:
        split = pa.compute.ascii_split_whitespace(texts)
        numbered = split.flatten().dictionary_encode()
        words = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        known, old = kept
        new = []
        for w in [w for w in words if w not in known]:
            if (found := old.get(w)) is None:
                new.append(w)
            else:
                known[w] = found
        once: dict[str, bytes] = {}
        for w, found in zip(new, encoded_words(t, new), strict=True):
            (known if len(w) <= CACHE_CHARS else once)[w] = found
        own = [once[w] if w in once else known[w] for w in words] if once else [known[w] for w in words]
        ids = np.frombuffer(b"".join(own), "<u4")
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        starts = np.cumsum(sizes) - sizes
        at = numbered.indices.to_numpy()
        n = sizes[at]
        ends = np.concatenate(([0], np.cumsum(n)))
        flat = ids[np.repeat(starts[at] - ends[:-1], n) + np.arange(ends[-1])]
        bounds = ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield flat[a:b].tobytes()
        if len(known) > cache_words // 2:
            kept[:] = {"": b""}, known

    return encode


def _in_parts(batches: Iterator[pa.RecordBatch], part_bytes: int) -> Iterator[tuple[list, pa.Array]]:
    """Document ids and texts, some part_bytes of text at a time: the more at once, the fewer words are looked up twice."""
    held: list[pa.RecordBatch] = []

    def parts() -> Iterator[tuple[list, pa.Array]]:
        docs = [d for b in held for d in b.column("doc_id").to_pylist()]
        texts = pa.concat_arrays([b.column("text") for b in held])
        sizes = np.cumsum(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(texts):
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + part_bytes, "right")))
            yield docs[start:end], texts.slice(start, end - start)
            start = end

    for batch in batches:
        held.append(batch)
        if sum(b.column("text").nbytes for b in held) >= part_bytes:
            yield from parts()
            held.clear()
    if held:
        yield from parts()


def _cut(path: str, capacity: int, with_ids: bool, cache_words: int, part_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(path, cache_words)
        for docs, texts in _in_parts(batches, part_bytes):
            rows: list[list] = [[], [], [], [], [], []]
            for doc, ids in zip(docs, encode(texts), strict=True):
                a = ids + END_ID
                for k, start in enumerate(range(0, len(a) // 4, capacity)):
                    own = a[4 * start : 4 * (start + capacity)]
                    for column, v in zip(rows, (doc, k, start, len(own) // 4, zlib.crc32(own), own if with_ids else None), strict=True):
                        column.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            n = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows[:n], kinds[:n], strict=True)], names=names[:n])

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False, cache_words: int = CACHE_WORDS, part_bytes: int = BATCH_BYTES) -> DataFrame:
    """Every document's tokens and the closing id, cut where longer than capacity; with_ids adds the ids (uint32, little-endian).

    cache_words (about 200 bytes each) and part_bytes trade a worker's memory for time; the result does not depend on them.
    """
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of("text").alias("text")).mapInArrow(
        _cut(tokenizer, capacity, with_ids, cache_words, part_bytes), PIECES + (", ids binary" if with_ids else "")
    )


# ---- the plan, on a histogram of lengths


def best_configuration(price: np.ndarray, lengths: np.ndarray, count: np.ndarray, capacity: int, waste: int = 0) -> Counter:
    """The knapsack dynamic program: of the multisets of lengths that leave ``waste`` tokens at most, the one worth most.

    No length is taken more often than there is.  Empty where no multiset fills a sequence so far.
    """
    value = np.full(capacity + 1, -np.inf)
    value[0] = 0.0
    takes = []
    for n, p, most in zip(lengths.tolist(), price.tolist(), count.tolist(), strict=True):
        # A length may be taken 1, 2, 4, ... times at once, so a bounded number of copies needs few steps.
        k, left = 1, min(most, capacity // n)
        while left > 0:
            m = min(k, left)
            w = n * m
            got = value[: capacity + 1 - w] + p * m
            better = got > value[w:]
            takes.append((n, m, w, better))
            np.maximum(got, value[w:], out=value[w:])
            left -= m
            k *= 2
    room = capacity - waste + int(value[capacity - waste :].argmax())
    chosen: Counter = Counter()
    if value[room] == -np.inf:
        return chosen
    for n, m, w, better in reversed(takes):
        if room >= w and better[room - w]:
            chosen[n] += m
            room -= w
    return chosen


def configurations(hist: dict[int, int], capacity: int, seed: int = SEED) -> list[tuple[int, Counter]]:
    """(times, configuration) by multiplicative weights: whole numbers of times, no length served more than it is there.

    Each round prices the lengths, and the knapsack program finds the best configuration among ``PRICED`` of the lengths
    still open, drawn by their weights; where these fill no sequence, four times as many are priced, up to all.  It is
    used until one of its lengths has ``STEP`` of its count served, and each length that it serves loses weight by its
    share.  Rounds end when no configuration of all that is left wastes ``WASTE`` tokens or less.
    """
    lengths = np.array(sorted(hist, reverse=True), np.int64)
    count = np.array([hist[int(n)] for n in lengths], np.int64)
    left = count.copy()
    weight = np.ones(len(lengths))
    place = {int(n): i for i, n in enumerate(lengths)}
    # A length is worth its share of a sequence, longer ones a little more, as they are harder to place.
    worth = lengths / capacity * (1 + LONGER * lengths / capacity)
    rng = np.random.default_rng(seed)
    found: Counter = Counter()
    while True:
        open_ = np.flatnonzero(left)
        if not len(open_):
            break
        priced = PRICED
        while True:
            some = open_
            if priced < len(open_):
                # The largest of log(u) / weight: a draw without replacement by weight.
                some = open_[np.sort(np.argpartition(np.log(rng.random(len(open_))) / weight[open_], -priced)[-priced:])]
            config = best_configuration((worth * weight)[some], lengths[some], left[some], capacity, WASTE if len(some) == len(open_) else 0)
            if config or len(some) == len(open_):
                break
            priced *= 4
        if not config:
            break
        own = [(place[n], m) for n, m in config.items()]
        times = min(min(max(int(STEP * count[i]), m), left[i]) // m for i, m in own)
        found[tuple(sorted(config.items(), reverse=True))] += int(times)
        for i, m in own:
            left[i] -= m * times
            weight[i] *= np.exp(-RATE * m * times / count[i])
    return [(times, Counter(dict(key))) for key, times in found.items()]


def plan(hist: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, Counter]]:
    """(times, configuration): together they hold every piece of the histogram exactly once."""
    left = Counter({n: c for n, c in hist.items() if c > 0})
    out: list[tuple[int, Counter]] = []
    if left.get(capacity):
        out.append((left.pop(capacity), Counter({capacity: 1})))
    for times, config in configurations(dict(left), capacity):
        out.append((times, config))
        for n, m in config.items():
            left[n] -= times * m
    return out + best_fit(Counter({n: c for n, c in left.items() if c}), capacity)


def best_fit(left: Counter, capacity: int) -> list[tuple[int, Counter]]:
    """Best-fit decreasing on counts: equal bins are kept as one row with a number of times."""
    bins: dict[int, Counter] = {}  # room left -> {configuration: times}
    done: Counter = Counter()
    for n in sorted(left, reverse=True):
        todo = left[n]
        while todo:
            room = min((r for r in bins if r >= n), default=None)
            if room is None:
                fits = capacity // n
                full, rest = divmod(todo, fits)
                for times, m in ((full, fits), (1 if rest else 0, rest)):
                    if times:
                        bins.setdefault(capacity - n * m, Counter())[((n, m),)] += times
                break
            config, times = next(iter(bins[room].items()))
            m = min(room // n, -(-todo // times)) if todo > times else 1
            used = min(times, todo // m) or 1
            if todo < m * used:
                m, used = todo, 1
            bins[room][config] -= used
            if not bins[room][config]:
                del bins[room][config]
            if not bins[room]:
                del bins[room]
            new = config + ((n, m),)
            todo -= m * used
            if room - n * m:
                bins.setdefault(room - n * m, Counter())[new] += used
            else:
                done[new] += used
    for configs in bins.values():
        done.update(configs)
    return [(times, Counter(dict(c))) for c, times in done.items()]


def plan_rows(planned: list[tuple[int, Counter]]) -> list[tuple]:
    """(length, from_rank, to_rank, per, sequence, offset): ranks of a length that one configuration takes.

    Rank r goes to sequence + (r - from_rank) // per, at offset + length * ((r - from_rank) % per).
    """
    rows, ranks, sequence = [], Counter(), 0
    for times, config in planned:
        offset = 0
        for n, m in sorted(config.items(), reverse=True):
            rows.append((n, ranks[n], ranks[n] + times * m, m, sequence, offset))
            ranks[n] += times * m
            offset += n * m
        sequence += times
    return rows


def packed(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts (with doc_id, piece, length) and where each goes: sequence_id and offset."""
    spark = parts.sparkSession
    n = partitions(spark)
    hist = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).toLocalIterator()}  # capacity rows at most
    rows = plan_rows(plan(hist, capacity)) or [(0, 0, 0, 1, 0, 0)]
    # A length has a salt for each share of the pieces that a task should hold.
    share = max(1, sum(hist.values()) // (8 * n))
    sizes = spark.createDataFrame([(k, -(-c // share)) for k, c in hist.items()] or [(0, 1)], "length bigint, _salts bigint")
    salted = parts.join(F.broadcast(sizes), "length").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_salts")))
    own = Window.partitionBy("length", "_salt")
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        stored(salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")), "salts")
        .select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    )
    ranked = (
        salted.withColumn("_own", F.row_number().over(own.orderBy("doc_id", "piece", "start")) - 1)
        .join(firsts, ["length", "_salt"])
        .withColumn("_rank", F.col("_first") + F.col("_own"))
    )
    plans = spark.createDataFrame(rows, "length bigint, _from bigint, _to bigint, _per bigint, _sequence bigint, _offset bigint")
    # For each length the plan's steps stand in one sorted array, so a piece meets its length's row only.
    steps = plans.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("_from", "_to", "_per", "_sequence", "_offset"))).alias("_steps"))
    step = F.filter("_steps", lambda s: (s["_from"] <= F.col("_rank")) & (F.col("_rank") < s["_to"]))
    nth = F.col("_rank") - F.col("_step._from")
    return (
        ranked.join(F.broadcast(steps), "length")
        .withColumn("_step", F.get(step, F.lit(0)))
        .withColumn("sequence_id", F.col("_step._sequence") + F.floor(nth / F.col("_step._per")))
        .withColumn("offset", F.col("_step._offset") + F.col("length") * F.pmod(nth, F.col("_step._per")))
        .drop("_salts", "_salt", "_own", "_first", "_rank", "_steps", "_step")
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, cache_words: int = CACHE_WORDS, part_bytes: int = BATCH_BYTES) -> DataFrame:
    """Pieces of all docs with sequence_id and offset.  Tokens are counted once, in one pass over the texts."""
    return packed(stored(pieces(docs, tokenizer, capacity, cache_words=cache_words, part_bytes=part_bytes), "pieces"), capacity)


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids array<int>), in order of offset."""
    placed = packed(stored(pieces(docs, tokenizer, capacity, with_ids=True), "pieces"), capacity)

    def join(group: pa.Table) -> pa.Table:
        group = group.sort_by("offset")
        ids = np.frombuffer(b"".join(group.column("ids").to_pylist()), "<u4").astype(np.int32)
        return pa.table({"sequence_id": pa.array([group.column("sequence_id")[0].as_py()], pa.int64()), "ids": pa.array([ids.tolist()], pa.list_(pa.int32()))})

    return placed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(join, "sequence_id bigint, ids array<int>")
