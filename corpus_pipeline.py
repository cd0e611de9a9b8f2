"""The corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs.  All stages but the last return the columns of documents, and no others that docs may have.

Nulls and ties, by stage: a null text fails the quality rules and goes; a null source keeps all its lines; a null doc_id
passes and is never the one that stays of a group; n_chars is counted anew only where lines were cut, and is null
otherwise where it was; repeated rows are near-duplicates of each other, so one stays.  Empty tables, an empty benchmark
and a table without labels pass through: each stage returns an empty or an uncut table.  Very long texts are read whole
by every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import decontaminate, line_dedup, minhash, packing, quality_rules
from framewright.llm.common import stored, table
from framewright.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the base rules or the likelihood ratio reject."""
    return quality_rules.accepted(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts boilerplate lines of a source; a document stays even where little is left of it.  Copies count as one page."""
    out = line_dedup.deduped(docs)
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component of documents linked at 5-word Jaccard 0.8 the one with the smallest doc_id.

    Candidates come from the SimHash trie and, beyond its budget, from MinHash.
    """
    return minhash.representatives(docs).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences: one row a piece."""
    # Workers of the other stages share the executors' memory, so this one keeps fewer words and texts.
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), cache_words=300_000, part_bytes=2_000_000).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("best_fit_packing", packed),
]

#: The hashed ratio, the fingerprints and the packing have no SQL form; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
