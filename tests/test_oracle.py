"""Every query that has an SQL form, against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from framewright.plans import block_queries, signal_queries

SF = "/root/testdata/sf0.001"
QUERIES = block_queries.QUERIES | signal_queries.QUERIES
ORACLE = block_queries.ORACLE | signal_queries.ORACLE


def plain(v):
    return round(float(v), 6) if hasattr(v, "is_integer") or type(v).__name__ == "Decimal" else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    r = duck.sql(ORACLE[name])
    names = list(r.columns)
    assert sorted(names) == columns
    want = sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in r.fetchall())
    assert got == want
    assert got or name == "b16_runaway_drop"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_head_is_fitted_with_the_operators_iterations(spark, monkeypatch):
    seen, fit = {}, signal_queries.M.fit_head
    monkeypatch.setattr(signal_queries.M, "fit_head", lambda f, **more: seen.update(more) or fit(f, **more))
    assert QUERIES["a12_fit_head"](spark, SF).count() > 0
    assert seen.get("max_iter", 2000) == 2000


@pytest.mark.parametrize("name", ["slug_a", "slug_b"])
def test_slugs_of_whole_texts(spark, name):
    assert max(len(r.slug or "") for r in QUERIES[name](spark, SF).collect()) > 1000


def test_all_blocks_are_zipped(spark):
    from framewright.operators import evaluate

    blocks = lambda *rows: spark.createDataFrame(rows, "rid string, start_s double, end_s double")
    truth = blocks(("a", 10.0, 20.0), ("a", 500.0, 520.0), ("b", 5.0, 9.0), ("b", 300.0, 310.0), ("c", 1.0, 2.0))
    other = blocks(("a", 11.0, 20.0), ("a", 498.0, 521.0), ("b", 5.0, 9.0))
    got = {tuple(r) for r in evaluate.zipped_or_counts(truth, other).collect()}
    assert got == {("a", 1, -1.0, 0.0, 2, 2), ("a", 2, 2.0, -1.0, 2, 2), ("b", 0, None, None, 2, 1), ("c", 0, None, None, 1, 0)}


def test_means_have_the_sqls_last_bits(spark, tmp_path):
    """Recordings 3 and 6 are in one hash group; a mean near the threshold depends on the order of addition."""
    from framewright.plans import views

    c = duckdb.connect()
    c.sql(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + i * INTERVAL 1 SECOND AS ts, (i * 7919) % 8 + CASE WHEN i % 11 = 0 THEN 8 ELSE 0 END AS user_id, 'view' AS event_type,
     CASE WHEN i % 97 = 0 THEN NULL ELSE ((i * 7907) % 8600) / 100.0 END::DOUBLE AS value FROM range(10005) t(i) WHERE i % 13 <> 5) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = {r[:2]: r[2] for r in c.sql(views.sql(views.FRAMES, views.BLOCKS, select="SELECT rid, idx, s FROM sm")).fetchall()}
    got = {(r.rid, r.idx): r.s for r in views.present(spark, str(tmp_path)).select("rid", "idx", "s").collect()}
    assert len({rid for rid, _ in got}) == 8
    assert got == want


@pytest.mark.parametrize("half", [0, 3, 8, 40])
def test_rolling_mean_of_other_widths(spark, half):
    from framewright.operators.temporal import rolling_mean

    xs = [None if i % 10 == 3 or 200 < i < 220 else (i * 7907 % 8600) / 100 for i in range(500)]
    got = {r.idx: r.s for r in rolling_mean(spark.createDataFrame([("a", i, x) for i, x in enumerate(xs)], "rid string, idx bigint, x double"), "x", half, "s").collect()}
    for i in range(500):
        own = [x for x in xs[max(i - half, 0) : i + half + 1] if x is not None]
        assert got[i] == (pytest.approx(sum(own) / len(own), rel=1e-12) if own else None)
