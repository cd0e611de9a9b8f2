"""The queries opN_<name>: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import class_lm, decontaminate, html_text, line_dedup, packing, quality_rules, sharding, simhash, substring_dedup, token_counts
from framewright.llm.common import table


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    return line_dedup.deduped(docs).select("doc_id", "text", "n_lines", "n_dropped")


OP1_SQL = """
WITH l AS (SELECT doc_id, source, text, i, line, regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS bare
           FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line,
                        generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)),
     p AS (SELECT source, count(DISTINCT text) AS pages FROM documents WHERE source IS NOT NULL GROUP BY source),
     b AS (SELECT source, bare FROM (SELECT source, bare, count(DISTINCT text) AS n FROM l WHERE bare <> '' GROUP BY source, bare) JOIN p USING (source)
           WHERE n >= 2 AND n > 0.05 * pages),
     k AS (SELECT l.doc_id, l.i, l.line, b.bare IS NOT NULL AS gone FROM l LEFT JOIN b ON l.source = b.source AND l.bare = b.bare)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') END AS text,
       count(k.i) AS n_lines, count(*) FILTER (gone) AS n_dropped
FROM documents d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id, d.text
"""


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduped(table(spark, sf_dir, "documents", "doc_id", "text"), with_bytes=False).drop("kept")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = quality_rules.judged(docs, table(spark, sf_dir, "labels"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("word_bpe_49k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.scored(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = token_counts.counted(docs, tokenizer_path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_html_text": op2_html_text,
    "op3_packing": op3_packing,
    "op4_class_lm": op4_class_lm,
    "op5_token_counts": op5_token_counts,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_simhash": op7_simhash,
    "op8_quality_rules": op8_quality_rules,
    "op9_sharding": op9_sharding,
    "op10_decontamination": op10_decontamination,
}

ORACLE_SQL: dict[str, str] = {"op1_line_dedup": OP1_SQL}
