"""Fronts in batches, survivors, spacing, crossover and mutation against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.functions import variation
from colloquy.operators import history, quality
from colloquy.operators import search as S


def brute_fronts(points):
    left, out, front = dict(points), {}, 0
    while left:
        best = [k for k, p in left.items() if not any(all(a <= b for a, b in zip(q, p, strict=True)) and q != p for q in left.values())]
        out |= dict.fromkeys(best, front)
        left = {k: p for k, p in left.items() if k not in best}
        front += 1
    return out


def test_fronts_of_groups_cut_by_batches(spark, monkeypatch):
    monkeypatch.setattr(quality, "MATRIX", 4)
    rng = random.Random(2)
    rows = [(rng.choice([None, "a", "b", "c"]), i, *(float(rng.randrange(5)) for _ in range(3))) for i in range(150)]
    frame = spark.createDataFrame(rows, "g string, i int, x double, y double, z double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.i: r.front for r in quality.front_ranks(frame, "g", ["x", "y", "z"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for g in (None, "a", "b", "c"):
        want |= brute_fronts([(r[1], r[2:]) for r in rows if r[0] == g])
    assert got == want
    assert quality.front_ranks(frame.limit(0), "g", ["x"]).count() == 0


def test_survivors_prefer_the_ends(spark):
    rows = spark.createDataFrame([(1, "a", 0.0, 4.0), (1, "b", 1.0, 3.0), (1, "c", 1.5, 2.5), (1, "d", 4.0, 0.0), (1, "e", 5.0, 5.0)], "g int, k string, x double, y double")
    got = quality.survivors(rows, "g", "k", ["x", "y"], 3).orderBy("place").collect()
    assert [r.k for r in got] == ["a", "d", "c"]
    # gaps (4 - 1) / 4 and (3 - 0) / 4 about c
    assert got[2].crowding == pytest.approx(0.75)


def test_spacing(spark):
    rows = spark.createDataFrame([(1, 0.0, 3.0), (1, 1.0, 2.0), (1, 3.0, 0.0), (2, 1.0, 1.0)], "g int, x double, y double")
    got = {r.g: (r.n, r.spacing) for r in quality.spacing(rows, "g", "x", "x", "y").collect()}
    assert got == {1: (3, pytest.approx(np.std([2, 2, 4]))), 2: (1, 0.0)}


def test_crossover_and_mutation_stay_in_bounds(spark):
    rng = random.Random(6)
    rows = [(rng.random(), rng.random(), rng.random()) for _ in range(200)] + [(0.0, 1.0, 0.999), (0.4, 0.4, 0.2), (1.0, 0.0, 0.001)]
    frame = spark.createDataFrame(rows, "a double, b double, u double")
    a, b, u = F.col("a"), F.col("b"), F.col("u")
    for r in frame.select(a, b, u, *(c.alias(n) for c, n in zip(variation.crossed(a, b, u, 5), "xy", strict=True)), variation.mutated(a, u, 30).alias("m")).collect():
        assert 0 <= r.x <= min(r.a, r.b) + 1e-9 + abs(r.a - r.b) / 2 and max(r.a, r.b) - abs(r.a - r.b) / 2 - 1e-9 <= r.y <= 1
        assert 0 <= r.m <= 1 and (r.m <= r.a + 1e-9 if r.u <= 0.5 else r.m >= r.a - 1e-9)
        if r.a == r.b:
            assert r.x == r.y == r.a


def test_utterance_distance_without_entries(spark):
    none = F.array().cast("array<double>")
    row = spark.range(1).select(variation.utterance_distance(F.lit(1.0), F.lit(None).cast("double"), (none, none), (F.array().cast("array<string>"),) * 2).alias("d")).collect()[0].d
    assert (row.question, row.answer, row.ordinal, row.categorical, row.combined) == (0.0, 0.5, 0.0, 0.0, 0.0)


def test_grid_and_runs(spark):
    assert {(r.x, r.y) for r in S.grid(spark, {"x": (0.0, 1.0), "y": (2.0, 4.0)}, 3).collect()} == {(x, y) for x in (0, 0.5, 1) for y in (2, 3, 4)}
    rows = spark.createDataFrame([(1, "finished", 3, True), (2, "failed", 9, True), (3, "finished", None, True)], "run int, state string, value int, failed boolean")
    kept = history.relabelled(history.finished(rows, "state", "run >= 1"), "failed", "value > 5")
    assert {(r.run, r.failed) for r in kept.collect()} == {(1, False), (3, False)}
