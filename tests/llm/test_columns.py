"""Extra columns of any name pass through or are replaced as stated, never mixed up; quality scores and draws by hand."""

import math
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from framewright.llm import class_lm, decontaminate, line_dedup, minhash, packing, quality_rules, sharding, simhash, substring_dedup, token_counts
from framewright.llm.queries import tokenizer_path
from tests.llm.conftest import SCHEMA, row

#: Names that the operators use for their own columns, now or before, in other letters too, and odd ones.
NAMES = ["_host", "host", "lines", "_lines", "met", "kept_", "split", "cut", "_id", "id", "_H", "h", "row", "_row", "k1", "digest", "Bucket", "draw", "_order", "_start", "root", "me", "key", "_words", "_windows", "t", "w", "b", "fp", "bytes", "open", "doc", "lo", "n", "a.b", "with space", "back`tick"]


@pytest.fixture(scope="module")
def clashing(spark, prose):
    rows = [row(i, prose(60) + "\nsame line") for i in range(6)] + [row(6, None), row(None, prose(60)), row(0, prose(60))]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(f"own {c}") for c in NAMES})


def unharmed(df):
    """Whether every extra column still says its own name."""
    kept = [c for c in NAMES if c in df.columns]
    quoted = ["`" + c.replace("`", "``") + "`" for c in kept]
    return kept == NAMES and all(list(r) == [f"own {c}" for c in NAMES] for r in df.select(*quoted).collect())


def test_columns_pass(spark, clashing):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(1, "same line")], "item_id bigint, text string")
    lined = line_dedup.deduped(clashing)
    assert unharmed(lined) and lined.where("n_dropped > 0").count() > 0
    for out in (quality_rules.accepted(clashing, labels), simhash.representatives(clashing), minhash.representatives(clashing), decontaminate.clean(clashing, bench)):
        assert out.columns == clashing.columns and unharmed(out)
    assert unharmed(token_counts.counted(clashing, tokenizer_path("byte_bpe_50k.json")))


def test_shards_keep_columns(spark, clashing, tmp_path):
    out = sharding.write_shards(clashing, f"file://{tmp_path}/shards")
    assert unharmed(out) and out.count() == clashing.count()


def test_columns_are_not_read(clashing):
    """These return columns of their own only."""
    assert class_lm.scored(clashing).count() == clashing.count()
    assert substring_dedup.deduped(clashing).count() == clashing.count()
    assert packing.pack(clashing, tokenizer_path("word_bpe_49k.json")).count() >= clashing.count()
    assert simhash.near_duplicates(clashing).count() == clashing.count()


def test_replaced_columns(spark, prose):
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame([row(i, prose(60)) for i in range(4)], SCHEMA).withColumns({"score": F.lit("mine"), "n_words": F.lit("mine"), "n_lines": F.lit("mine"), "size": F.lit("mine"), "slot": F.lit("mine"), "n_bytes": F.lit("mine")})
    assert [r.score for r in quality_rules.accepted(docs, labels).select("score").distinct().collect()] == ["mine"]
    assert {r.n_words for r in quality_rules.judged(docs, labels).collect()} == {60}
    assert {r.n_lines for r in line_dedup.deduped(docs).collect()} == {1}
    assert {type(r.n_bytes) for r in token_counts.counted(docs, tokenizer_path("byte_bpe_50k.json")).collect()} == {int}
    assert {r.slot for r in sharding.sharded(docs, shards=2).collect()} == {0, 1}


# ---- 8


def signed(h):
    return h - 2**64 if h >= 2**63 else h


def spark_hash(*words):
    """Spark's xxhash64 of strings in a row: each is seeded with the hash of those before."""
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return signed(h)


def test_quality_scores_by_hand(spark, prose):
    rows = [row(i, prose(70) + (" #x $y %z & <b> |" if i % 2 else "")) for i in range(8)] + [row(8, "buy now " * 40), row(9, None), row(10, "short")]
    rows += [row(20 + i, " ".join(f"junk{(i * k) % 7}" for k in range(80))) for i in range(5)]
    labels = {0: 1, 1: 1, 2: 1, 8: 0, 21: 0}
    docs = spark.createDataFrame(rows, SCHEMA)
    table = spark.createDataFrame([(d, q, 0) for d, q in labels.items()], "doc_id bigint, quality int, toxic int")
    buckets = 512

    def grams(text):
        ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        return [(w,) for w in ws] + list(zip(ws, ws[1:]))

    slots = {r[0]: [spark_hash(*g) % buckets for g in grams(r[1])] for r in rows}
    raw = Counter(s for d in slots for s in slots[d])
    target = Counter(s for d in slots if labels.get(d) == 1 for s in slots[d])
    n_raw, n_target = sum(raw.values()), sum(target.values())
    share = n_target / n_raw

    def weight(s):
        p_raw = (raw[s] + quality_rules.PRIOR) / (n_raw + quality_rules.PRIOR * buckets)
        return round(math.log((target[s] + quality_rules.PRIOR * share) / (n_target + quality_rules.PRIOR * share * buckets) / p_raw), 6)

    for r in quality_rules.judged(docs, table, buckets=buckets).collect():
        own = [weight(s) for s in slots[r.doc_id]]
        score = sum(own) / len(own) if own else 0.0
        assert r.score == pytest.approx(score, abs=1e-8)
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", r.text or ""))
        assert r.kept == (not r.base_failed and round(r.score, 9) >= quality_rules.THRESHOLD)


# ---- 9


def test_one_id_on_all_rows_spreads(spark):
    """Rows of one id, and even equal rows, are scattered over the buckets, and shuffled into all shards."""
    docs = spark.createDataFrame([(7, f"text {i % 50} " + "x" * 200) for i in range(4000)], "doc_id bigint, text string").repartition(4)
    size = (F.octet_length("text") + 1).cast("bigint")
    total = docs.agg(F.sum(size)).first()[0]
    buckets = docs.select(F.pmod(sharding._mixed(sharding.SEED), F.lit(20)).alias("b")).groupBy("b").count().collect()
    assert len(buckets) == 20 and max(r["count"] for r in buckets) < 2 * 4000 / 20
    out = sharding.write_shards(docs, sharding.new_path(spark, "one-id"), bucket_bytes=total // 20).collect()
    assert Counter(Counter(r.shard for r in out).values()) == {250: 16}
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(250)) for s in range(16))
    assert len({(r.shard, r.text) for r in out}) > 700


def test_starts_of_buckets(spark):
    counts = spark.createDataFrame([(b, b % 5 + 1) for b in range(0, 9000, 3)], "bucket bigint, n bigint")
    got = {r.bucket: r.start for r in sharding._starts(counts).collect()}
    want, at = {}, 0
    for b in range(0, 9000, 3):
        want[b] = at
        at += b % 5 + 1
    assert got == want


def test_permutation():
    order = sharding._fisher_yates(1000, 5)
    assert sorted(order.tolist()) == list(range(1000)) and order.tolist() != list(range(1000))
    assert (order == sharding._fisher_yates(1000, 5)).all() and (order != sharding._fisher_yates(1000, 6)).any()
