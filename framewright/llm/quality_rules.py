"""Quality rules: counted text features, then a hashed n-gram likelihood ratio (native DataFrame code only).

Two multinomials over ``buckets`` hashed word unigrams and bigrams: one from a trusted target (documents
labelled quality 1), one from the whole raw corpus.  A document's score is the mean, over its n-grams, of
log p_target - log p_raw; it is kept where the score reaches ``threshold``.  Every document gets the same fixed
rule, so a verdict does not depend on what else is in its partition.

Nulls: a null text has no words, fails the base rules and is dropped.  A null doc_id is never a target.
Repeated rows are counted and judged one by one.  With no labels the ratio is 0 everywhere and only the base
rules decide; an empty table gives an empty table.  A very long text is one row's work, n log n in its words.  Columns
beside doc_id and text are not read; those of docs by the names of ``FEATURES`` are replaced, or left alone by
``accepted``, which adds none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import SPACE, columns_of, stored

BUCKETS = 65_536
THRESHOLD = -0.15
#: Pseudo-counts of a bucket.
PRIOR = 10.0
#: Labelled target rows used, a hashed share where there are more; the only bounded part.
MAX_TARGET_ROWS = 200_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


#: The columns that are added, and those of the working, which do not stay.
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept", "_words", "_lines", "_windows", "_ordered", "_twice", "_placed", "_at")


#: A line with a word.
WORD = r"[^\x20\x09-\x0D]"
#: A window's hash and place.
PLACED = "struct<h:bigint,i:int>"
#: Repeated windows of a text that are looked up one by one.
FEW = 32


def with_repeated_words(df: DataFrame) -> DataFrame:
    """From _windows (hashes in text order), n_repeat_words: words in a 3-word window found twice or more.

    Sorting the windows by hash puts equal ones side by side, so the work is n log n in a text's length.
    """
    h = F.col("_windows")
    # Hashes found twice or more: side by side once sorted.
    ordered = F.col("_ordered")
    twice = F.array_distinct(F.array_compact(F.zip_with(ordered, F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))), lambda a, b: F.when(a == b, a))))
    few = F.array_compact(F.transform(h, lambda x, i: F.when(F.array_contains("_twice", x), i)))
    # With many of them, the windows are sorted with their places instead of looked up one by one.
    s = F.col("_placed")
    none = F.array(F.lit(None).cast(PLACED))
    beside = F.zip_with(
        F.zip_with(s, F.concat(none, s), lambda x, a: F.when(x["h"] == a["h"], True).otherwise(False)),
        F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda x, b: F.struct((x["h"] == b["h"]).alias("next"), x["i"].alias("i"))),
        lambda before, x: F.when(before | x["next"], x["i"]),
    )
    many = F.array_sort(F.filter(beside, lambda i: i.isNotNull()))
    placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    # A window adds the words that the window before it did not cover.
    added = F.aggregate(
        F.col("_at"),
        F.struct(F.lit(-9).alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return (
        df.withColumn("_ordered", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(h)))
        .withColumn("_twice", twice)
        .withColumn("_placed", F.when(F.size("_twice") > FEW, placed))
        .withColumn("_at", F.when(F.col("_placed").isNotNull(), many).when(F.col("_twice").isNotNull(), few))
        .withColumn("n_repeat_words", F.when(F.col("_at").isNull(), F.lit(0).cast("bigint")).otherwise(added))
        .drop("_ordered", "_twice", "_placed", "_at")
    )


def _here(verdict: Column) -> Column:
    """The verdict, not to be pushed below the projections it stands on.

    The row number keeps the optimizer from moving a filter down, which would copy the features' expressions into each
    other and evaluate them many times a row.
    """
    return verdict & (F.monotonically_increasing_id() >= 0)


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds _words (array) and the counted features."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda s: s.rlike(WORD))
    w = F.col("_words")
    windows = F.when(
        F.size(w) >= 3,
        F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1))),
    ).otherwise(F.array().cast("array<bigint>"))
    counted = (
        docs.withColumn("_words", words_of(F.col(text)))
        .withColumn("n_words", F.size(w).cast("bigint"))
        .withColumn("word_chars", F.length(F.regexp_replace(body, SPACE, "")).cast("bigint"))
        .withColumn("n_symbols", (F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))).cast("bigint"))
        .withColumn("_lines", lines)
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"))
        .withColumn("_windows", windows)
    )
    return (
        with_repeated_words(counted)
        .withColumn("base_failed", _here((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))))
        .drop("_lines", "_windows")
    )


def following(words: Column) -> Column:
    """The word after each, null after the last."""
    return F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))


def bucket(buckets: int, *words: Column) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(buckets)).cast("int")


def ratio_weights(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, max_target_rows: int = MAX_TARGET_ROWS) -> Column:
    """A constant array: for each bucket log p_target - log p_raw, both smoothed.

    The counts cover every document.  The driver gets ``buckets`` numbers, whatever the corpus' size; as a constant
    they reach the tasks once, not once a row.
    """
    target = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_target")).distinct()
    found = target.count()
    if found > max_target_rows:  # a share of them by hash, so that what is broadcast stays bounded
        target = target.where(F.pmod(F.xxhash64("_target"), F.lit(1 << 30)) < int((1 << 30) * max_target_rows / found))
    grams = (
        docs.select("doc_id", "text")
        .join(F.broadcast(target), F.col("doc_id") == F.col("_target"), "left")
        .select(F.col("_target").isNotNull().alias("t"), words_of(F.col("text")).alias("w"))
        .select("t", F.explode(F.arrays_zip(F.col("w").alias("a"), following(F.col("w")).alias("b"))).alias("p"))
        .select("t", F.explode(F.array(bucket(buckets, F.col("p.a")), F.when(F.col("p.b").isNotNull(), bucket(buckets, F.col("p.a"), F.col("p.b"))))).alias("b"))
        .where("b IS NOT NULL")
    )
    # Written once: the totals and the weights below read these ``buckets`` rows, not the corpus again.
    counts = stored(grams.groupBy("b").agg(F.count("*").alias("raw"), F.count_if("t").alias("target")), "ngram-counts")
    total = counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    spark = docs.sparkSession
    raw_n, target_n = (F.coalesce(total.select(c).scalar(), F.lit(0)) for c in ("raw", "target"))
    every = spark.range(buckets).select(F.col("id").cast("int").alias("b"))
    # PRIOR n-grams a bucket smooth the raw multinomial, and as many times the target's share of all n-grams the target's:
    # a bucket that few documents have says little either way, however small the corpus.
    share = target_n / F.greatest(raw_n, F.lit(1))
    p_raw = (F.coalesce("raw", F.lit(0)) + PRIOR) / (raw_n + PRIOR * buckets)
    p_target = (F.coalesce("target", F.lit(0)) + PRIOR * share) / (target_n + PRIOR * share * buckets)
    ratio = F.when(target_n > 0, F.log(p_target / p_raw)).otherwise(F.lit(0.0))
    weights = every.join(counts, "b", "left").select("b", F.round(ratio, 6).alias("w")).orderBy("b").collect()
    return F.from_json(F.lit("[" + ",".join(str(r["w"]) for r in weights) + "]"), "array<double>")


def judged(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """docs with the counted features, ``score`` and ``kept``; columns of docs by those names are replaced."""
    docs = docs.select(*columns_of(docs, *FEATURES))
    weights = ratio_weights(docs, labels, buckets)
    own = F.zip_with(
        "_words",
        following(F.col("_words")),
        lambda a, b: F.get(weights, bucket(buckets, a)) + F.when(b.isNull(), 0.0).otherwise(F.get(weights, bucket(buckets, a, b))),
    )
    total = F.aggregate(own, F.lit(0.0), lambda acc, w: acc + w)
    score = F.when(F.col("n_words") > 0, total / (2 * F.col("n_words") - 1)).otherwise(F.lit(0.0))
    return (
        with_features(docs)
        .withColumn("score", score)
        .withColumn("kept", _here(~F.col("base_failed") & (F.round("score", 9) >= F.lit(threshold))))
        .drop("_words")
    )


def accepted(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """docs' rows that the rules keep, with docs' columns, whatever their names."""
    own = docs.select(F.struct(*columns_of(docs)).alias("_row"), "doc_id", "text")
    return judged(own, labels, **how).where("kept").select("_row.*")
