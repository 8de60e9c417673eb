"""Queries on small tables of which a part would give another result, and against whole-table SQL of the tests' own."""

import math
import random

import duckdb
import numpy as np
import pytest

from colloquy.operators import quality
from colloquy.plans import content, metrics, searching

from duck import assert_same
from duck import rows as plain_rows

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def saved(spark, tmp_path):
    def save(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return save


def test_document_numbers_reads_whole_texts_of_all_documents(spark, saved):
    rows = [(1, "x " * 1500 + "costs 1,234.5 EUR"), (2, "paid in euros"), (3, "JPY"), (4, "₹ only"), (5, "no such thing"), (6, None), (7, ""), (8, "a -3.5 b 9")]
    got = content.document_numbers(spark, saved("documents", rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.number, r.currency) for r in got} == {1: (1234.5, "EUR"), 2: (None, "EUR"), 3: (None, "JPY"), 4: (None, "INR"), 5: (None, None), 6: (None, None), 7: (None, None), 8: (-3.5, None)}
    assert len(got) == len(rows)


def test_cluster_coverage_counts_all_vectors(spark, saved):
    # groups are vec_id % 3; vectors 5, 6, 12 and 13 have vec_id % 7 of 5 and 6
    rows = [(0, 1), (1, 1), (2, 1), (5, 2), (6, 2), (12, 2), (13, 3)]
    got = metrics.cluster_coverage(spark, saved("embeddings", rows, "vec_id long, label int")).collect()
    third = pytest.approx(100 / 3 * 2, abs=1e-6)
    assert {r.grp: r.coverage for r in got} == {0: third, 1: third, 2: third}
    assert all(r.coverage < 100 for r in got)


def test_cluster_coverage_equals_whole_sql(spark):
    sql = metrics.V + ", k AS (SELECT count(DISTINCT label) AS k FROM v), n AS (SELECT grp, label, count(*) AS n FROM v GROUP BY ALL), q AS (SELECT grp, n / sum(n) OVER (PARTITION BY grp) AS p FROM n) SELECT grp, round(100.0 * count(*) / k, 6) AS coverage, round(100 * sum(-p * log2(p)) / log2(k), 6) AS entropy FROM q, k GROUP BY grp, k"
    assert_same(metrics.cluster_coverage(spark, DATA), sql, DATA)


def test_uncovered_pairs_takes_all_parts(spark, saved):
    rows = [(1, 1, "a"), (2, 2, "b"), (151, 1, "b"), (900, 3, "c")]
    got = searching.uncovered_pairs(spark, saved("part", rows, "p_partkey long, p_size int, p_brand string")).collect()
    assert {(r.p_size, r.p_brand) for r in got} == {(2, "a"), (3, "a"), (3, "b"), (1, "c"), (2, "c")}


def test_uncovered_pairs_equals_whole_sql(spark):
    sql = "SELECT * FROM (SELECT DISTINCT p_size FROM part), (SELECT DISTINCT p_brand FROM part) EXCEPT SELECT p_size, p_brand FROM part"
    assert_same(searching.uncovered_pairs(spark, DATA), sql, DATA)


def test_date_steps_has_every_order(spark):
    sql = "SELECT o_orderkey, array_to_string(list_transform(range(5), lambda i: strftime(CAST(o_orderdate AS DATE) + CAST(i * 30 AS INTEGER), '%Y-%m-%d')), ',') AS dates, CAST(o_orderkey % 24 * 3600 + o_orderkey % 60 * 60 + o_orderkey % 7 AS INTEGER) AS seconds FROM orders"
    assert_same(searching.date_steps(spark, DATA), sql, DATA)


def test_novelty_archive_takes_groups_in_batches(spark):
    rng = np.random.default_rng(4)
    rows = [(g, i, rng.uniform(0, 10, 2).tolist()) for g in (None, "a", "b", "c") for i in range(200)]
    want = set()
    for g in (None, "a", "b", "c"):
        kept = []
        for _, i, v in (r for r in rows if r[0] == g):
            if all(math.dist(v, w) > 1.0 for w in kept):
                kept.append(v)
                want.add((g, i))
    frame = spark.createDataFrame(random.Random(5).sample(rows, len(rows)), "g string, i int, v array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = quality.novelty_archive(frame, "g", "i", "v", 1.0)
        assert {(r.g, r.i) for r in out.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # no operator takes a whole group as one frame
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()


def test_crowding_of_equal_points_is_that_of_its_sql(spark, tmp_path):
    # sizes of a group with equal prices are neighbours by size, however rows came; the sizes 3, 6 and 9 have one least price
    prices = {1: (9, 12), 4: (9, 14), 7: (9, 14), 10: (9, 14), 13: (9, 14), 16: (10, 15), 19: (10, 15), 22: (10, 15), 25: (8, 16), 28: (11, 11), 3: (9, 10), 6: (9, 12), 9: (9, 13)}
    rows = [(s, float(p)) for s, both in prices.items() for p in both]
    for seed in range(3):
        path = str(tmp_path / f"{seed}" / "part.parquet")
        spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), "p_size int, p_retailprice double").coalesce(1).write.parquet(path)
        with duckdb.connect() as con:
            con.sql(f"CREATE VIEW part AS SELECT * FROM read_parquet('{path}/*.parquet')")
            want = con.sql(metrics.SQL["crowding"])
            got = metrics.crowding(spark, str(tmp_path / f"{seed}"))
            assert plain_rows(got.columns, got.collect()) == plain_rows(want.columns, want.fetchall())


def test_currency_searches_a_text_once_for_each_kind(spark, saved):
    rows = [(1, "xUSD EURO eur"), (2, "DOLLARS, then GBP"), (3, "a yen"), (4, "5 € in USD"), (5, "Rupees_ pounds."), (6, "éeuros")]
    found = content.document_numbers(spark, saved("documents", rows, "doc_id long, text string"))
    assert {r.doc_id: r.currency for r in found.collect()} == {1: None, 2: "GBP", 3: "JPY", 4: "EUR", 5: "GBP", 6: None}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 4
