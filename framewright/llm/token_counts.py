"""Token counts through a digest cache.

Texts are normalised (null becomes empty, nothing else, since every byte counts for a byte-level tokenizer) and
reduced to a SHA-256 digest.  The digest and the digest of the tokenizer file are joined to stored counts; only
distinct texts the cache does not hold are encoded, and their counts are appended to it.

A byte-level tokenizer parts a text into pieces (a word with the space before it, say) and encodes each by itself.  Texts
of characters whose classes are beyond doubt are parted here, and each distinct piece of a batch is encoded once; all
other texts, and other tokenizers, go through the library whole.

Copies are dropped inside each scan task before the shuffle, so a text that a third of all rows share reaches the
shuffle once a task.  Only digests stand in a task's memory, never the texts of a whole partition.

Nulls and ties: a null text counts as empty (0 bytes, 0 tokens); a null doc_id is kept as a row.  Repeated rows are returned
as often as they come in.  An empty table encodes nothing and gives an empty table.  A very long text is encoded whole, in
a call of its own.  Columns named n_bytes, n_tokens and over_limit are replaced; others pass as they are.  Lone
surrogates cannot occur in Parquet strings.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import columns_of, new_path, partitions, stored, text_of

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens bigint"
LIMIT = 512
#: Characters encoded in one call, so that a batch of long texts stays small.
BATCH_CHARS = 2_000_000


def version_of(path: str) -> str:
    """Digest of the tokenizer's file: another version never finds this one's counts."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def counter(path: str):
    """A function from texts to token counts."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    whole = lambda texts: [len(x.ids) for x in t.encode_batch_fast(texts, add_special_tokens=False)]
    if not parted_by_pieces(path):
        return whole
    added = [a.content for a in t.get_added_tokens_decoder().values()]
    pieces = piece_pattern()
    known: dict[str, int] = {}

    def count(texts: list[str]) -> list[int]:
        parted = [pieces.findall(x) if PLAIN.fullmatch(x) and not any(a in x for a in added) else None for x in texts]
        new = list({p for ps in parted if ps for p in ps} - known.keys())
        for i in range(0, len(new), 10_000):
            part = new[i : i + 10_000]
            known.update(zip(part, whole(part), strict=True))
        rest = iter(whole([x for x, ps in zip(texts, parted, strict=True) if ps is None]))
        out = [next(rest) if ps is None else sum(map(known.__getitem__, ps)) for ps in parted]
        if len(known) > KNOWN_PIECES:
            known.clear()
        return out

    return count


#: Pieces whose counts a task keeps between its batches; beyond it they are counted anew.
KNOWN_PIECES = 400_000
#: Characters whose class (letter, number, white space, other) all Unicode versions agree on: texts of these are parted here.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\u024f\u2010-\u2027\u2030-\u205e\u20ac]*")


def parted_by_pieces(path: str) -> bool:
    """Whether the file says that texts are parted by the byte-level pattern, and each piece is encoded by itself."""
    if not path.endswith(".json"):
        return False
    own = json.loads(Path(path).read_text(encoding="utf-8"))
    before = own.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    return plain and own.get("normalizer") is None and own.get("model", {}).get("type") == "BPE"


def piece_pattern() -> re.Pattern:
    """The byte-level pattern for PLAIN texts: words, numbers and signs with the space before them, and white space."""
    chars = [chr(c) for c in range(0x2100) if PLAIN.fullmatch(chr(c))]
    of = lambda kind: "".join(re.escape(c) for c in chars if unicodedata.category(c)[0] == kind)
    letter, number, space = of("L"), of("N"), " \\t\\n\\r"
    # The endings and their order are the tokenizer's.
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


def _first_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for i, d in enumerate(batch.column("digest").to_pylist()):
            if d not in seen:
                seen.add(d)
                keep.append(i)
        if keep:
            yield batch.take(pa.array(keep, pa.int64()))


def _encode(path: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in _first_in_task(batches):
            texts, counts, held, size = batch.column("text"), [], [], 0
            for t in texts:
                held.append(t.as_py())
                size += len(held[-1])
                if size > BATCH_CHARS:
                    counts += count(held)
                    held, size = [], 0
            counts += count(held) if held else []
            n = len(counts)
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([version] * n, pa.string()), pa.array(counts, pa.int64())], names=["digest", "tokenizer", "n_tokens"])

    return run


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache at path, or an empty one where nothing was written yet."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    exists = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(CACHE_SCHEMA).parquet(path) if exists else spark.createDataFrame([], CACHE_SCHEMA)


def counted(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = LIMIT) -> DataFrame:
    """docs' columns with n_bytes, n_tokens and over_limit.

    cache: a Parquet folder that outlives the job; None takes a new one in the shared folder.  Counts found there
    are reused, missing ones are appended in one commit, so a rerun after a failure loses nothing.
    """
    spark = docs.sparkSession
    cache = cache or new_path(spark, "token-counts")
    version = version_of(tokenizer)
    digest = F.unhex(F.sha2(text_of("text").cast("binary"), 256))
    known = open_cache(spark, cache).where(F.col("tokenizer") == version).select("digest")
    # Two texts of a task are compared by digest; then those of all tasks, next to the cache's digests.
    texts = docs.select(digest.alias("digest"), text_of("text").alias("text"))
    missing = (
        texts.mapInArrow(_first_in_task, texts.schema)
        .join(known, "digest", "left_anti")
        .repartition(partitions(spark), "digest")
        .mapInArrow(_encode(tokenizer, version), CACHE_SCHEMA)
    )
    missing.write.mode("append").parquet(cache)
    # A digest may be there twice after two jobs appended at the same time.
    counts = open_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    # As a table of its own, so that the join below can split the rows of a digest that very many documents have.
    counts = stored(counts, "digest-counts")
    # The caller's columns go in one struct, so that no name of theirs meets one of these.
    own = docs.select(F.struct(*columns_of(docs, "n_bytes", "n_tokens", "over_limit")).alias("row"), F.octet_length(text_of("text")).cast("bigint").alias("n_bytes"), digest.alias("digest"))
    return own.join(counts, "digest").select("row.*", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
