"""Prefix sums, parts and interpolated histories against plain Python."""

import datetime
import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from colloquy.operators import history, stats

START = datetime.datetime(2024, 1, 1)


@pytest.fixture
def runs(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, None]), START + datetime.timedelta(seconds=rng.randrange(0, 400, 7)), i, rng.random() < 0.3) for i in range(200)]
    rows += [(1, None, 900, True), (2, None, 901, None)]
    return rows, spark.createDataFrame(rows, "run int, ts timestamp, id int, failed boolean")


def in_order(rows, run):
    return sorted((r for r in rows if r[0] == run), key=lambda r: (r[1] is not None, r[1] or START, r[2]))


def test_running_counts_carry_sums_between_units(runs):
    rows, frame = runs
    got = {r.id: (r.test_size, r.failures) for r in history.running_counts(frame, "run", ["ts", "id"], "failed").collect()}
    want = {}
    for run in (1, 2, None):
        failures = 0
        for i, r in enumerate(in_order(rows, run), 1):
            failures += bool(r[3])
            want[r[2]] = i, failures
    assert got == want


def test_equal_parts_leave_the_remainder(runs):
    rows, frame = runs
    got = {r.id: r.part for r in history.equal_parts(frame, "run", ["ts", "id"], 4).collect()}
    want = {}
    for run in (1, 2, None):
        own = in_order(rows, run)
        size = len(own) // 4
        want |= {r[2]: i // size for i, r in enumerate(own) if i // size < 4}
    assert got == want
    assert history.equal_parts(frame, "run", ["ts", "id"], 500).count() == 0


def test_failures_over_time_is_interpolated(runs):
    rows, frame = runs
    counts = history.running_counts(frame, "run", ["ts", "id"], "failed").filter("run is not null")
    got = {(r.run, r.time): (r.budget, r.failures) for r in history.failures_over_time(counts, "run", 1000, 300).collect()}
    for run in (1, 2):
        found = np.cumsum([bool(r[3]) for r in in_order(rows, run)])
        times = (np.arange(len(found)) + 1) * 1000 / len(found)
        for t in (0, 300, 600, 900, 1200):
            budget, failures = got.pop((run, float(t)))
            assert budget == pytest.approx(t / 10)
            assert failures == pytest.approx(np.interp(t, times, found))
    assert not got


def test_signed_rank_with_ties(spark):
    rng = random.Random(8)
    pairs = [(g, float(rng.randrange(6)), float(rng.randrange(6))) for g in "ab" for _ in range(60)]
    got = {r.g: r for r in stats.signed_rank(spark.createDataFrame(pairs, "g string, x double, y double"), ["g"]).collect()}
    for g in "ab":
        d = np.array([x - y for h, x, y in pairs if h == g and x != y])
        rank = np.array([(np.abs(d) < a).sum() + ((np.abs(d) == a).sum() + 1) / 2 for a in np.abs(d)])
        n, w = len(d), min(rank[d > 0].sum(), rank[d < 0].sum())
        ties = sum(t**3 - t for t in np.unique(np.abs(d), return_counts=True)[1].tolist())
        z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
        assert (got[g].n, got[g].w) == (n, w)
        assert (got[g].z, got[g].p) == (pytest.approx(z), pytest.approx(math.erfc(abs(z) / math.sqrt(2))))


def test_signed_rank_of_millions(spark):
    # n * (n + 1) * (2 * n + 1) is no long from 1.7 million differences on
    n = 1_800_000
    pairs = spark.range(n).select(F.lit("a").alias("g"), F.when(F.col("id") % 3 == 0, -1.0).otherwise(2.0).alias("x"), F.lit(0.0).alias("y"))
    (got,) = stats.signed_rank(pairs, ["g"]).collect()
    low = n // 3
    w, ties = low * (low + 1) / 2, low**3 - low + (n - low) ** 3 - (n - low)
    assert (got.n, got.w) == (n, w)
    assert got.z == pytest.approx((w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48))
