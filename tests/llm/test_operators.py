"""Each operator against a brute-force version, and on awkward and empty tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from framewright.llm import class_lm, decontaminate, html_text, line_dedup, packing, quality_rules, sharding, simhash, substring_dedup, token_counts
from framewright.llm.common import BATCH_BYTES, ROW_GROUP_BYTES
from framewright.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path
from tests.llm.conftest import SCHEMA, row

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i < 6), 0) for i in range(12)] + [(None, 1, 0), (3, 1, 0)], "doc_id bigint, quality int, toxic int")


# ---- 1


def lines_by_hand(rows, ratio, least):
    once = {(s, t) for _, t, s in rows if t is not None and s is not None}
    pages = Counter(s for s, _ in once)
    bare = lambda x: x.strip(" \t\n\r\x0b\x0c")
    seen = Counter((s, b) for s, t in once for b in {bare(x) for x in t.split("\n")} - {""})
    gone = {k for k, n in seen.items() if n >= least and n > ratio * pages[k[0]]}
    return sorted((d, None if t is None else "\n".join(x for x in t.split("\n") if (s, bare(x)) not in gone)) for d, t, s in rows)


def test_lines(spark):
    rng = random.Random(1)
    rows = [(i, "\n".join(rng.choice(["menu", " menu ", "foot", "", f"own {i}", f"x{rng.randint(0, 9)}"]) for _ in range(rng.randint(0, 6))), rng.choice(["a", "b", None])) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for ratio, least in ((0.3, 3), (0.05, 2)):
        got = sorted((r.doc_id, r.text) for r in line_dedup.deduped(df, ratio=ratio, min_pages=least).collect())
        assert got == lines_by_hand(rows, ratio, least)


def test_lines_of_small_hosts(spark):
    """A host of two pages has boilerplate too; one page, or copies of one, has none."""
    rows = [(1, "menu\nab", "x"), (2, "menu\ncd", "x"), (3, "menu\nab", "y"), (4, "menu\nab", "y"), (5, "menu\nab", "z"), (6, "menu", None), (7, None, "x"), (8, "", "x")]
    out = line_dedup.deduped(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in out} == {1: ("ab", 2, 1), 2: ("cd", 2, 1), 3: ("menu\nab", 2, 0), 4: ("menu\nab", 2, 0), 5: ("menu\nab", 2, 0), 6: ("menu", 1, 0), 7: (None, 0, 0), 8: ("", 1, 0)}


def test_lines_edges(awkward, nothing):
    out = line_dedup.deduped(awkward)
    assert out.count() == awkward.count() and set(awkward.columns) < set(out.columns)
    assert out.where("text IS NULL AND (n_lines > 0 OR n_dropped > 0)").count() == 0
    assert line_dedup.deduped(nothing).count() == 0


def test_pipeline_lines_of_copies(spark, prose):
    """Copies of one page are no evidence of boilerplate, lines of five different pages are."""
    import corpus_pipeline

    page = "\n".join(prose(9) for _ in range(3))
    rows = [row(i, page) for i in range(6)] + [row(10 + i, prose(9) + "\nsubscribe now") for i in range(5)]
    out = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert all(out[i] == page for i in range(6))
    assert all(out[10 + i] == rows[6 + i][1].split("\n")[0] for i in range(5))


# ---- 2

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style><script>var x="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies here and there, you know.</div>
<article><h1>A &amp; B</h1><p>First   para&shy;graph with <b>bold</b> and <a href="#">a link</a>.<p>Unclosed second, caf&eacute; &#x263A; &lt;tag&gt;<br>next line</p><!-- <p>hidden</p> -->
<aside>Side text that nobody should read in the main text at all.</aside><form><p>Your name <input></p></form><p>No.</p></article>
<div id="comments"><p>What a fine article, I have read it from the start to the end twice.</p></div><footer>&copy; Me</footer></body>"""


def test_page():
    want = ["A & B", "First para­graph with bold and a link.", "Unclosed second, café ☺ <tag> next line", "No."]
    assert html_text.main_text(PAGE) == "\n\n".join(want)


def test_pages_without_an_article_and_broken_ones():
    text = "A long enough sentence stands here in a plain block, as old pages have it."
    assert html_text.main_text(f"<div>{text}</div>") == text
    assert html_text.main_text("<article><p>cut off in the mid") == "cut off in the mid"
    for page in ("", None, "<", "<p", "</p></p>", "<article></article>", "plain", "<script>", "<a href='"):
        assert isinstance(html_text.main_text(page), str)
    assert html_text.main_text("<ul>" + "<li><a href='/x'>Ten words of a link that leads to some other page</a></li>" * 9 + "</ul>") == ""


def test_page_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "u", "", "x"), (1, "u", PAGE, "x")], "page_id bigint, url string, html string, text string")
    rows = html_text.extracted(df).collect()
    assert len(rows) == 4 and all(r.n_chars == len(r.text) for r in rows)


# ---- 3


def check_plan(hist):
    planned = packing.plan(hist)
    assert sum((Counter({k: m * t for k, m in c.items()}) for t, c in planned), Counter()) == hist
    assert all(t > 0 and sum(k * m for k, m in c.items()) <= 2048 for t, c in planned)
    return sum(t for t, _ in planned), -(-sum(k * m for k, m in hist.items()) // 2048)


def test_plan_holds_all_pieces():
    rng = np.random.default_rng(2)
    for n in (0, 1, 40, 3000):
        used, low = check_plan(Counter(np.clip(rng.lognormal(5.5, 1, n).astype(int) + 1, 1, 2048).tolist()))
        assert used <= low + 1 + low // 1000


def test_plan_of_lengths_that_do_not_fit_together():
    assert check_plan(Counter({1100: 50}))[0] == 50
    assert check_plan(Counter({1500: 10, 600: 10}))[0] <= 14
    assert check_plan(Counter({683: 9}))[0] == 5
    assert check_plan(Counter({1: 5000, 2047: 3}))[0] == 6
    assert check_plan(Counter({2048: 7, 1024: 4}))[0] == 9


@pytest.mark.parametrize(("pieces", "mean"), [(10_000, 5.5), (1_000_000, 5.5), (1_000_000, 6.3)])
def test_program_packs_most_pieces(pieces, mean):
    rng = np.random.default_rng(3)
    hist = Counter(np.clip(rng.lognormal(mean, 1, pieces).astype(int) + 1, 1, 2048).tolist())
    used, low = check_plan(hist)
    assert used <= low * 1.001 + 1
    partial = {n: c for n, c in hist.items() if n < 2048}
    by_program = sum(t * sum(c.values()) for t, c in packing.configurations(partial, 2048))
    assert by_program >= 0.8 * sum(partial.values())


def test_knapsack_finds_the_dearest_full_configuration():
    rng = random.Random(6)
    for _ in range(30):
        lengths = np.array(sorted(rng.sample(range(1, 15), 4), reverse=True))
        count = np.array([rng.randint(1, 3) for _ in lengths])
        price = np.array([rng.random() for _ in lengths])
        full = [c for c in itertools.product(*(range(n + 1) for n in count.tolist())) if np.dot(c, lengths) == 20]
        got = packing.best_configuration(price, lengths, count, 20)
        assert bool(got) == bool(full)
        if full:
            assert sum(n * m for n, m in got.items()) == 20 and all(got[n] <= c for n, c in zip(lengths.tolist(), count.tolist()))
            assert sum(price[lengths.tolist().index(n)] * m for n, m in got.items()) == pytest.approx(max(np.dot(c, price) for c in full))


def check_packed(rows, capacity=2048):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_packing(awkward, nothing):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = packing.pack(awkward, path).collect()
    n = check_packed(rows)
    assert n <= -(-sum(r.length for r in rows) // 2048) + 1
    want = Counter()
    for r in awkward.collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((r.doc_id, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert packing.pack(nothing, path).count() == 0
    whole = packing.sequences(awkward, path).collect()
    assert len(whole) == n and sum(len(r.ids) for r in whole) == sum(r.length for r in rows)


# ---- 4


def test_blocks_in_small_parts(spark):
    """A task's blocks are not read, or handed to Python, all at once: a block is megabytes, and a large split has hundreds."""
    texts = spark.range(0, 12, 1, 1).select(F.col("id").alias("doc_id"), F.expr("concat_ws(' ', transform(sequence(1, 610000), i -> pmod(xxhash64(i, id), 60000)))").alias("text"))
    blocks, _, _ = class_lm.fitted(texts, k=8, rounds=1)
    assert blocks.count() == 12
    (path,) = blocks.inputFiles()
    found = pq.ParquetFile(path.removeprefix("file://")).metadata
    sizes = [found.row_group(k).total_byte_size for k in range(found.num_row_groups)]
    assert len(sizes) > 1 and max(sizes) <= ROW_GROUP_BYTES + 8_000_000  # a block over
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b") == str(BATCH_BYTES)


def test_scores(spark, prose):
    rows = [row(i, prose(80)) for i in range(60)] + [row(60, None), row(61, "UNSEEN Words"), row(None, "the of")]
    out = class_lm.scored(spark.createDataFrame(rows, SCHEMA), share=0.001, k=8, rounds=2, at_least=1).collect()
    tokens = {r[0]: [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").lower())] + [b""] for r in rows}
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d in tokens}
    c = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    assert len(out) == len(rows)
    for r in out:
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        assert r.score < 0 and math.isfinite(r.score)


def test_scores_by_hand(spark, prose):
    """Every score from the model's parts by plain loops, and probabilities that sum to 1."""
    unseen = next(i for i in range(131, 200) if class_lm.is_held_out(i))
    rows = [row(i, prose(60)) for i in range(80)] + [row(100 + i, " ".join(w + "q" * (i % 3) for w in prose(30).split())) for i in range(20)] + [row(130, None), row(unseen, "Zebra zebra ünü")]
    blocks, vocabulary, m = class_lm.fitted(spark.createDataFrame(rows, SCHEMA).repartition(3), share=0.002, k=8, rounds=3, at_least=5)
    counts = {r.word: r.n for r in vocabulary.collect()}
    frequent = {w: i for i, w in enumerate(m["frequent"].tolist())}
    cls = lambda key: int(m["classes"][frequent[key] if key in frequent else len(frequent) + key % class_lm.ENDINGS])
    # The seen words of a class and its unseen mass are all of it, and so are the classes after a class.
    for c in range(1, 8):
        seen = [n for w, n in counts.items() if w != class_lm.END_HASH and cls(w) == c]
        if seen:
            assert sum(seen) == m["class_tokens"][c]
            unseen = max(seen.count(1) * (seen.count(1) - 1) / (2 * (seen.count(2) + 1)), 1)
            assert sum((n - class_lm.DISCOUNT) / sum(seen) for n in seen) + unseen * 10 ** (m["unseen"][c] - m["novel"][c]) == pytest.approx(1)
    assert (10 ** m["steps"]).sum(axis=1) == pytest.approx(np.ones(8))
    assert len(frequent) > 5 and class_lm.word_key(b"zebra") not in counts

    def by_hand(text, spelled):
        total, last = 0.0, class_lm.END
        for w in [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())]:
            key = class_lm.word_key(w)
            c, n = cls(key), counts.get(key, 0)
            total += m["steps"][last, c]
            total += math.log10((n - class_lm.DISCOUNT) / m["class_tokens"][c]) if n else m["unseen"][c] + (spelled_by_hand(m["spelling"], w) if spelled else -m["novel"][c])
            last = c
        return total + m["steps"][last, class_lm.END]

    out = {r.doc_id: (r.score, r.spelled_score) for r in class_lm.applied(blocks, vocabulary, m).collect()}
    assert len(out) == len(rows)
    for r in rows:
        assert out[r[0]] == pytest.approx((by_hand(r[1], False), by_hand(r[1], True)), abs=1e-6)


def spelled_by_hand(model, word):
    three, one = model[: class_lm.CONTEXTS], model[class_lm.CONTEXTS :]
    total, padded = 0.0, b"\0\0\0" + word
    for i in range(len(word) + 1):
        a, b, c = padded[i : i + 3]
        h = (a * 40_503 + b * 10_139 + c * 2_531 >> 4) % class_lm.CONTEXTS
        s = word[i] if i < len(word) else 256
        total += math.log10((three[h, s] + class_lm.SPELLING_PRIOR * one[c, s]) / (three[h].sum() + class_lm.SPELLING_PRIOR))
    return total


def test_spellings():
    words = [b"river", b"rivers", b"r", "ünï".encode(), b"stone"] * 3
    cells, n = class_lm.spelling_cells(words)
    counts = np.zeros((class_lm.CONTEXTS + 256) * class_lm.SYMBOLS, np.int64)
    counts[cells] = n
    assert counts.sum() == 2 * sum(len(w) + 1 for w in words)
    model = class_lm.spelling_model(counts)
    asked = [b"river", b"riverine", b"x", b"zzz", "ü".encode()]
    assert class_lm.spelling_scores(model, asked) == pytest.approx([spelled_by_hand(model, w) for w in asked])
    assert class_lm.spelling_scores(model, [b"rivers"])[0] > class_lm.spelling_scores(model, [b"srevir"])[0]
    # After any bytes the next symbols' probabilities sum to 1.
    for context in (b"\0\0\0", b"riv", b"qqq"):
        h = (context[0] * 40_503 + context[1] * 10_139 + context[2] * 2_531 >> 4) % class_lm.CONTEXTS
        p = (model[h] + class_lm.SPELLING_PRIOR * model[class_lm.CONTEXTS + context[2]]) / (model[h].sum() + class_lm.SPELLING_PRIOR)
        assert p.sum() == pytest.approx(1)


def test_exchange_step():
    """Each unit goes to the class under which its neighbours' classes are likeliest, by plain loops."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    matrix = rng.integers(0, 50, (5, 5)).astype(float)
    rows = [(u, s, int(rng.integers(1, 9))) for u in range(1, 20) for s in rng.choice(10, 4, replace=False).tolist()]
    out = class_lm._moved(matrix)(pa.table({"unit": [r[0] for r in rows], "slot": [r[1] for r in rows], "n": [r[2] for r in rows]}))
    smooth = matrix + 0.1
    for u, got in zip(out.column("unit").to_pylist(), out.column("class").to_pylist()):
        gain = {}
        for c in range(1, 5):
            gain[c] = sum(n * math.log(smooth[c, s] / smooth[c].sum() if s < 5 else smooth[s - 5, c] / smooth[:, c].sum()) for v, s, n in rows if v == u)
        assert gain[got] == pytest.approx(max(gain.values()))


def test_scores_beat_unigrams(spark):
    out = QUERIES["op4_class_lm"](spark, SF).where("held_out").selectExpr("sum(score) AS s", "sum(base_score) AS b").first()
    assert out.s > out.b


def test_scores_edges(awkward, nothing):
    assert class_lm.scored(awkward).count() == awkward.count()
    assert class_lm.scored(nothing).count() == 0


# ---- 5


def test_token_counts(spark, awkward, nothing, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):  # the second run finds all counts in the cache
        rows = token_counts.counted(awkward, path, cache).collect()
        want = Counter((r.doc_id, len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in awkward.collect())
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == want
        assert all(r.over_limit == (r.n_tokens > 512) for r in rows)
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count()
    assert token_counts.counted(nothing, path).count() == 0


def test_counts_of_pieces():
    """Counting by pieces gives what the library gives, on whole tables, odd strings and random ones."""
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    assert token_counts.parted_by_pieces(path) and not token_counts.parted_by_pieces(tokenizer_path("word_bpe_49k.json"))
    t = Tokenizer.from_file(path)
    count = token_counts.counter(path)
    rng = random.Random(12)
    odd = ["", " ", "  ", "\n", " \n ", "a\n\nb", "a  b", "a \n b", "it's we'll I'D 'sx ''s", "don't'", "x\t\ty", "\r\n\r\n", "1 23 ²³ ½", "é" * 3000, "€5 – “q” … \u2028 x", "\x85a\xa0b", "\x00\x1f", "a\u200bb", "<|endoftext|> x", "日本 語", "🙂 ok", "ǅ ª º µ", " 's", "a 1b2 c_d--e", "\u00ad x\u00ad"]
    odd += ["".join(rng.choice(" \n\tab'sél1²-–€.\xa0\u2009") for _ in range(rng.randrange(40))) for _ in range(2000)]
    odd += ["".join(chr(rng.choice((rng.randrange(0x20, 0x250), rng.randrange(0x2010, 0x2060), 32))) for _ in range(rng.randrange(30))) for _ in range(2000)]
    for texts in (odd, *([x or "" for x in pq.read_table(f"/root/testdata/{d}/documents.parquet").column("text").to_pylist()] for d in ("sf0.001", "sf0.01"))):
        assert count(texts) == [len(e.ids) for e in t.encode_batch_fast(texts, add_special_tokens=False)]


# ---- 6


def removed_by_hand(docs, length=100):
    seen, out = set(), {}
    for d, t in sorted(docs):
        b = t.encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = [True] * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("how", [{}, {"group": 3}, {"bucket_bytes": 3000}])
def test_substrings(spark, how):
    rng = random.Random(3)
    passages = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (100, 101, 150, 400)]
    docs = [(d * 7 % 80, "".join(rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("xyzü") for _ in range(rng.randrange(120))) for _ in range(rng.randrange(6)))) for d in range(80)]
    docs += [(500, "ab" * 400), (501, "ab" * 300), (502, "a" * 1000), (503, "")]
    out = substring_dedup.deduped(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), **how).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == removed_by_hand(docs)


def test_substrings_of_shared_and_missing_ids(spark):
    rng = random.Random(1)
    a, b, c = ("".join(rng.choice("abcdef") for _ in range(300)) for _ in range(3))
    rows = [(None, a), (None, b + c[:120]), (1, b), (1, c), (1, c), (2, "zz" + a)]
    out = substring_dedup.deduped(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed) for r in out)[-1] == (True, 2, 302, 300)
    assert sum(r.n_removed for r in out if r.doc_id is None) == 0
    assert sorted(r.n_removed for r in out if r.doc_id == 1) == [120, 120, 300]


def test_substrings_edges(awkward, nothing):
    out = substring_dedup.deduped(awkward).collect()
    assert len(out) == awkward.count() and all(len(r.kept) == r.n_bytes - r.n_removed for r in out)
    assert substring_dedup.deduped(nothing).count() == 0


# ---- 7


def fingerprint_by_hand(text):
    ws = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    grams = [b" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [b" ".join(ws)] if ws else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components_by_hand(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_fingerprints(prose):
    for t in (None, "", "one", "ONE Two", "a b c", "É é A", prose(500), "x " * 50):
        assert simhash.fingerprint(t) == fingerprint_by_hand(t)


@pytest.mark.parametrize("group", [4, 256])
def test_links(spark, group):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (2**64 - 1) for b in base for _ in range(12)} | {base[0] ^ (1 << i) for i in range(40)})
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), group=group).collect()}
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2}
    assert got == want


def linked_by_hand(values, budget):
    v = np.array(values, np.uint64)
    i, j = np.nonzero(np.triu(np.bitwise_count(v[:, None] ^ v[None, :]) <= budget, 1))
    return {tuple(sorted((int(v[a]), int(v[b])))) for a, b in zip(i, j)}


@pytest.mark.parametrize("budget", [0, 1, 2, 4])
def test_trie_is_walked_to_its_leaves(budget):
    """Large groups, dense and sparse; pairs beyond the budget are never reached, so levels stay far below all pairs."""
    rng = random.Random(8)
    sparse = {rng.getrandbits(64) for _ in range(1500)}
    near = {c ^ (1 << i) ^ (1 << j) for c in list(sparse)[:5] for i in range(0, 60, 3) for j in range(0, 60, 3)}
    values = np.array(sorted(sparse | near), np.uint64)
    met = Counter()
    got = [tuple(sorted((int(x), int(y)))) for a, b in simhash.trie_pairs(values, None, budget, met) for x, y in zip(a, b)]
    assert len(got) == len(set(got)) and set(got) == linked_by_hand(values, budget)
    assert len(met) > 20 and met[0] == 1 and met[1] <= 3 and max(met.values()) < (len(values) ** 2 / 2 if budget > 2 else len(values) ** 2 / 8)
    half = len(values) // 2
    got = {tuple(sorted((int(x), int(y)))) for a, b in simhash.trie_pairs(values[:half], values[half:], budget) for x, y in zip(a, b)}
    own = set(values[:half].tolist())
    assert got == {p for p in linked_by_hand(values, budget) if (p[0] in own) != (p[1] in own)}


@pytest.mark.parametrize("group", [16, 300])
def test_links_of_dense_groups(spark, group):
    """A ball of fingerprints around one, as thousands of near copies make it, among others; cut twice and more."""
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = sorted({centre} | {centre ^ (1 << i) ^ (1 << j) for i in range(0, 64, 3) for j in range(0, 64, 2)} | {rng.getrandbits(64) for _ in range(400)})
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    got = {(r.a % 2**64, r.b % 2**64) for r in simhash.links(df, group=group).collect()}
    assert {tuple(sorted(p)) for p in got} == linked_by_hand(fps, 2)
    tree = {(r.a % 2**64, r.b % 2**64) for r in simhash.links(df, spanning_only=True, group=group).collect()}
    assert {tuple(sorted(p)) for p in tree} <= linked_by_hand(fps, 2)
    assert components_of(fps, tree) == components_of(fps, got)


def components_of(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_components(spark, prose):
    docs = [(i, prose(40)) for i in range(60)]
    docs += [(100 + i, docs[i][1]) for i in range(10)] + [(200 + i, docs[i][1] + " zz") for i in range(20)] + [(300, None), (301, "")]
    ids = [d for d, _ in docs]
    roots = components_by_hand([fingerprint_by_hand(t) for _, t in docs])
    groups = {}
    for d, r in zip(ids, roots):
        groups.setdefault(r, []).append(d)
    want = {d: min(g) for g in groups.values() for d in g}
    out = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.component_id for r in out} == want


def test_representatives(awkward, nothing):
    out = simhash.representatives(awkward)
    assert out.columns == awkward.columns
    assert len({fingerprint_by_hand(r.text) for r in out.collect()}) == out.count() < awkward.count()
    assert simhash.representatives(nothing).count() == 0


def test_representatives_of_shared_and_missing_ids(spark, prose):
    a, b, c = prose(60), prose(60), prose(60)
    df = spark.createDataFrame([row(None, a), row(1, a), row(None, b), row(5, b + " "), row(5, c), row(7, c), row(7, c), row(None, None)], SCHEMA)
    assert sorted(((r.doc_id, r.text) for r in simhash.representatives(df).collect()), key=str) == sorted([(1, a), (5, b + " "), (5, c), (None, None)], key=str)


def grams_by_hand(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()


def test_pipeline_near_duplicates(spark, prose):
    """The stage links at 5-word Jaccard 0.8, edits that SimHash's 2 bits miss included."""
    import corpus_pipeline

    rng = random.Random(9)
    texts = [prose(200) for _ in range(12)] + [None, "", "a b", "A  b"]
    for t in texts[:12]:
        for edits in (1, 2, 3, 4, 6, 8):
            ws = t.split()
            for at in rng.sample(range(len(ws)), edits):
                ws[at] = "zz"
            texts.append(" ".join(ws))
    sets = [grams_by_hand(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA), "")
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(root))


def test_pipeline_candidates_come_from_the_trie_too(spark):
    """Sets are candidates by fingerprints within 2 bits, without a MinHash key in common, or by a key alone."""
    from framewright.llm import minhash

    far = lambda n: (0x0123456789ABCDEF * (2 * n + 1)) % 2**63
    rows = [(1, far(1), [1]), (2, far(1) ^ 0b101, [2]), (3, far(1), [3]), (4, far(1) ^ 0b111 << 20, [4]), (5, far(2), [5]), (6, far(3), [5]), (7, far(1) ^ 1 << 30, []), (5, far(2), [5])]
    own = spark.createDataFrame(rows, "digest bigint, fp bigint, keys array<bigint>")
    root = {d: d for d in range(1, 8)}
    for r in minhash.candidates(own).collect():
        a, b = root[r.a], root[r.b]
        root = {d: min(a, b) if x in (a, b) else x for d, x in root.items()}
    assert root == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}


def test_fingerprints_of_sets():
    from framewright.llm import minhash

    text = "a b c d e f g A b c d e x y"
    hashes = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams_by_hand(text)]
    assert simhash.majority(minhash.shingles(text)) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


# ---- 8


def test_quality(spark, awkward, labels, nothing):
    rows = quality_rules.judged(awkward, labels).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(windows)
        again = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(again), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert not (r.base_failed and r.kept)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert all(r.kept != r.base_failed for r in quality_rules.judged(awkward, none).collect())
    assert quality_rules.judged(nothing, labels).count() == 0


def test_quality_of_labelled_documents(spark):
    rows = QUERIES["op8_quality_rules"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    judged = [r for r in rows if not r.base_failed]
    assert all(r.kept == (r.quality == 1) for r in judged)


# ---- 9


def test_shards(spark, awkward, nothing):
    df = awkward.unionByName(spark.createDataFrame([row(i, "same") for i in range(100, 400)], SCHEMA))
    first, second = (sorted(sharding.sharded(df).collect(), key=str) for _ in range(2))
    assert first == second
    n = Counter(r.shard for r in first)
    assert set(n) == set(range(16)) and max(n.values()) - min(n.values()) <= 1 and sum(n.values()) == df.count()
    for s in n:
        assert sorted(r.slot for r in first if r.shard == s) == list(range(n[s]))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in first) == Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.collect())
    same = Counter(r.shard for r in first if r.doc_id and r.doc_id >= 100)
    assert max(same.values()) < 40  # equal texts spread over the shards
    assert sharding.sharded(nothing).count() == 0


# ---- 10


def contamination_by_hand(docs, items):
    w = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        ws = w(t)
        for k in range(max(len(ws) - 12, 1)) if ws else ():
            windows.setdefault(tuple(ws[k : k + 13]), set()).add(i)
    out = []
    for d, t in docs:
        ws, hit, found = w(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(ws) - n + 1):
                if (x := tuple(ws[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[x]
        ids = ",".join(sorted(map(str, found)))
        out.append((d, len(ws), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws)))
    return Counter(out)


@pytest.mark.parametrize(("bits", "words_at_once"), [(1 << 26, 1 << 17), (1 << 15, 20)])
def test_contamination(spark, awkward, prose, bits, words_at_once):
    texts = [r.text for r in awkward.where("doc_id < 12").orderBy("doc_id").collect()]
    items = [(1, " ".join(texts[0].split()[5:25])), (2, " ".join(texts[1].split()[:13])), (3, " ".join(texts[2].split()[3:7])), (4, None), (5, ""), (6, texts[3].upper()), (7, prose(30)), (7, "the"), (8, " ".join(texts[0].split()[5:25]))]
    items += [(9 + k, prose(5) + " " + " ".join(texts[4].split()[k : k + 14]) + " " + prose(5)) for k in range(12)] + [(40, "a b"), (41, " ".join(texts[5].split()[-12:])), (42, " ".join(texts[5].split()[:1]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    # Repeated rows, several texts of one id and rows without an id among them.
    df = awkward.where("doc_id IS NULL OR doc_id < 24").unionByName(awkward.where("doc_id < 6"))
    out = decontaminate.contamination(df, bench, bits, words_at_once).collect()
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out)
    assert got == contamination_by_hand([(r.doc_id, r.text) for r in df.collect()], items)
    kept = decontaminate.clean(df.withColumns({"k1": F.lit(1), "K2": F.lit("x"), "h.i": F.lit(2)}), bench, bits, words_at_once)
    assert kept.columns == [*df.columns, "k1", "K2", "h.i"] and kept.count() == sum(n for k, n in got.items() if not k[5])
    assert kept.where("k1 <> 1").count() == 0


def test_contamination_of_the_table(spark):
    read = lambda t: [tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(*(("doc_id", "text") if t == "documents" else ("item_id", "text"))).collect()]
    out = QUERIES["op10_decontamination"](spark, SF).collect()
    assert Counter(map(tuple, out)) == contamination_by_hand(read("documents"), read("benchmark"))


def test_items_without_an_id(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "five")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(None, "two three"), (3, "four"), (None, "four"), (None, "five")], "item_id bigint, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {1: (3, 1, hashlib.sha256(b"3").hexdigest()), 2: (1, 0, hashlib.sha256(b"").hexdigest())}


def test_contamination_of_a_long_text(spark, prose):
    """A text of several parts, with an item across each boundary."""
    ws = [f"w{i}" for i in range(300_000)]
    text = " ".join(ws)
    items = [(k, " ".join(ws[at : at + 20])) for k, at in enumerate((0, (1 << 17) - 10, (1 << 18) - 13, 299_980))]
    out = decontaminate.contamination(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).first()
    assert (out.n_words, out.n_hit, out.n_items) == (300_000, 80, 4)


def test_contamination_edges(spark, awkward, nothing):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination(awkward, none).where("contaminated").count() == 0
    assert decontaminate.clean(awkward, none).count() == awkward.count()
    assert decontaminate.contamination(nothing, none).count() == 0


def test_contamination_writes_few_files(spark, prose, tmp_path, monkeypatch):
    """A file is two processes forked from an executor's JVM on a local file system, so a partition need not be a file."""
    texts = [prose(80) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = [(k, " ".join(x.split()[k % 50 : k % 50 + 20])) for k, x in enumerate(texts)]
    monkeypatch.setattr("framewright.work.shared_dir", lambda _: f"file://{tmp_path}")
    now = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k, None) for k in now}
    try:
        for k, v in now.items():
            spark.conf.set(k, v)
        out = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out)
    assert got == contamination_by_hand(list(enumerate(texts)), items)
    files = Counter(p.parent.name.rsplit("-", 1)[0] for p in tmp_path.glob("*/part-*"))
    assert set(files) == {"benchmark-windows", "scanned", "marked"}
    assert max(files["benchmark-windows"], files["marked"]) <= max(decontaminate.FILES, spark.sparkContext.defaultParallelism)


# ---- all


def test_line_query_matches_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    r = c.sql(ORACLE_SQL["op1_line_dedup"])
    want = sorted(tuple(row[list(r.columns).index(x)] for x in ("doc_id", "text", "n_lines", "n_dropped")) for row in r.fetchall())
    got = QUERIES["op1_line_dedup"](spark, SF).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert sorted(map(tuple, got)) == want


def test_pipeline(spark, awkward, nothing, labels, tmp_path):
    import corpus_pipeline

    for name, df in (("some", awkward), ("none", nothing)):
        d = f"{tmp_path}/{name}"
        df.write.parquet(f"{d}/documents.parquet")
        labels.write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, "a b c")], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
        out = corpus_pipeline.run(spark, d)
        assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        check_packed(out.collect())
    assert corpus_pipeline.run(spark, SF).count() > 0
