"""Contents of turns, selections, elimination in order, and tables of running searches against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import dedup, turns
from colloquy.streaming import tables


def test_turn_contents(spark):
    content = {"category": "cafe", "price": "$", "food": "thai", "rating": None, "parking": "yes"}
    rows = [(c, i, content | ({"price": "$$$"} if i > 2 else {}), new) for c in range(3) for i, new in enumerate(["food", None, "price", None, "parking"])] + [(9, 0, {"category": None, "price": None}, "price"), (10, 0, None, None)]
    df = spark.createDataFrame(rows, "conv long, i int, content map<string,string>, new string")
    got = {(r.conv, r.i): r for r in turns.turn_contents(df, "conv", "i", "content", "new").collect()}
    for c in range(3):
        used = set()
        for i, new in enumerate(["food", None, "price", None, "parking"]):
            now = content | ({"price": "$$$"} if i > 2 else {})
            assert got[c, i].used == sorted(used)
            assert got[c, i].turn_content == {k: now[k] for k in {"category", *used, *([new] if new else [])}}
            used |= {new} - {None}
    assert got[9, 0].turn_content == {"category": None} and got[10, 0].turn_content is None


def test_fields_are_drawn_once_each(spark):
    content = {"category": "cafe", "price": "$", "food": "thai", "rating": None, "parking": "yes"}
    df = spark.createDataFrame([(i, content) for i in range(200)] + [(999, {"category": "x"})], "id long, content map<string,string>")
    key = F.col("id").cast("string")
    rows = df.withColumn("first", turns.first_field(F.col("content"), key)).withColumn("second", turns.next_field(F.col("content"), F.array("first"), key)).withColumn("none", turns.next_field(F.col("content"), F.array(*map(F.lit, ("price", "food", "parking"))), key)).collect()
    assert {r.first for r in rows} == {"food", "parking", "price", None} and all(r.first != r.second for r in rows[:-1]) and all(r.none is None for r in rows)
    assert rows[-1].first is None and min(sum(r.first == f for r in rows) for f in ("food", "parking", "price")) > 40


def test_requirements(spark):
    df = spark.createDataFrame([({"price": "$", "category": "cafe", "food": None}, "price"), ({}, None)], "c map<string,string>, new string")
    assert [r.t for r in df.select(turns.requirements(F.col("c"), F.col("new")).alias("t")).collect()] == ["category: cafe\nprice: $ (new)", ""]


PLACES = [{"id": "7", "name": "a"}, {"id": None, "name": "b"}, {"id": "1", "name": "c"}]


@pytest.mark.parametrize("selected, confidence, name", [("7", "high", "a"), ("1", "high", "c"), ("2", "high", "c"), ("0", "medium", "a"), ("1", "low", "a"), ("1", None, "a"), ("9", "high", "a"), ("x", "high", "a"), (None, "high", "a"), ("99999999999999999999", "high", "a")])
def test_confirmed_place(spark, selected, confidence, name):
    df = spark.createDataFrame([(PLACES, selected, confidence), ([], selected, confidence), (None, selected, confidence)], "p array<struct<id:string,name:string>>, s string, c string")
    got = df.select(turns.confirmed_place(F.col("p"), F.col("s"), F.col("c"))["name"].alias("n")).collect()
    assert [r.n for r in got] == [name, None, None]


def test_selected_and_extracted(spark):
    rows = [(i, i % 2 == 0, i % 3 == 0, None if i == 8 else i != 4, [None, "  ", "q"][i % 3], None if i % 5 == 0 else i / 10) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, crit boolean, opt boolean, ok boolean, question string, content double")
    ids = lambda d: sorted(r.id for r in d.collect())
    pick = lambda mode, **k: ids(turns.selected_tests(df, mode, F.col("crit"), F.col("opt"), **k))
    assert pick("all") == list(range(12)) and pick("opt") == [0, 3, 6, 9] and pick("crit", feasible=F.col("ok")) == [0, 2, 6, 10] and pick("crit", order="id", most=2) == [0, 2]
    with pytest.raises(ValueError, match="best"):
        pick("best")
    assert ids(turns.extracted_questions(df, "question", False, F.col("crit"), F.col("content"))) == [2, 5, 8, 11]
    assert ids(turns.extracted_questions(df, "question", True, F.col("crit"), F.col("content"))) == [2, 8]


def test_keep_apart_in_order(spark):
    rng = np.random.default_rng(4)
    rows = [(int(g), i, float(x), float(y)) for i, (g, x, y) in enumerate(zip(rng.integers(0, 3, 300), rng.random(300), rng.random(300), strict=True))] + [(7, 1000 + i, i * 0.04, 0.0) for i in range(20)] + [(8, 2000 + i, 0.5, 0.5) for i in range(30)]
    df = spark.createDataFrame([*rows, (0, 5000, None, 0.1), (0, 5001, float("nan"), 0.1)], "g long, k long, x double, y double")
    within = {"x": 0.05, "y": 0.2}
    kept = []
    for g, k, x, y in rows:
        if not any(h == g and abs(u - x) < 0.05 and abs(v - y) < 0.2 for h, _, u, v in kept):
            kept.append((g, k, x, y))
    assert sorted(r.k for r in dedup.keep_apart(df, ["g"], "k", within).collect()) == [*(k for _, k, _, _ in kept), 5000, 5001]
    first = {r.k: r.first for r in dedup.near_pairs(df, ["g"], "k", within).collect()}
    want = {}
    for g, k, x, y in rows:
        near = [j for h, j, u, v in rows if h == g and j < k and abs(u - x) < 0.05 and abs(v - y) < 0.2]
        if near:
            want[k] = min(near)
    assert first == want
    assert dedup.keep_apart(df.limit(0), ["g"], "k", within).count() == 0
    with pytest.raises(ValueError, match="bounds"):
        dedup.near_links(df, ["g"], "k", {"x": 0.0})


def test_batches_are_written_once(spark, tmp_path):
    source, table, state = (str(tmp_path / n) for n in ("in", "table", "state"))
    seen = []
    rows = spark.createDataFrame([(r, i % 3 == 0) for r in (1, 2) for i in range(7)], "run int, failed boolean")

    def start():
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
        both = tables.merged(tables.table_callback(table, tables.generation_summary), lambda batch, i: seen.append((i, batch.count())))
        stream.writeStream.foreachBatch(both).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    rows.coalesce(1).write.mode("append").parquet(source)
    rows.coalesce(1).write.mode("append").parquet(source)
    start()
    assert [n for _, n in seen] == [14, 14]
    # a batch that had written its table but not ended is run again after a restart
    (tmp_path / "state" / "commits" / "1").unlink()
    for crc in (tmp_path / "state" / "commits").glob(".1.crc"):
        crc.unlink()
    start()
    assert [i for i, _ in seen] == [0, 1, 1]
    got = sorted(tuple(r) for r in tables.running_table(table, spark).collect())
    assert got == [(r, b, 7 * (b + 1), 3 * (b + 1), 3 / 7) for r in (1, 2) for b in (0, 1)]


@pytest.mark.parametrize("batch", [5, 64, 10_000])
def test_rows_apart_and_near_in_small_and_large_groups(spark, batch):
    rng = np.random.default_rng(batch)
    sizes = [1, 2, 7, 40, 3, 500, 1, 16, 17, 4]
    # on a grid whose steps meet the bounds, on both sides of 0
    rows = [(g, 1000 * g + i, int(x) / 10, int(y) / 20) for g, n in enumerate(sizes) for i, (x, y) in enumerate(rng.integers(-30, 30, (n, 2)))]
    odd = [(None, 90_000, 0.0, 0.0), (None, 90_001, 0.0, 0.0), (5, 90_002, float("inf"), 0.0), (5, 90_003, float("inf"), 0.0), (5, 90_004, None, 0.0)]
    df = spark.createDataFrame([*rows, *odd], "g int, k long, x double, y double").repartition(3)
    within, kept, links = {"x": 0.3, "y": 0.1}, [], set()
    for g, k, x, y in rows:
        links |= {(k, j) for h, j, u, v in rows if h == g and j < k and abs(u - x) < 0.3 and abs(v - y) < 0.1}
        if not any(h == g and abs(u - x) < 0.3 and abs(v - y) < 0.1 for h, _, u, v in kept):
            kept.append((g, k, x, y))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        assert sorted(r.k for r in dedup.keep_apart(df, ["g"], "k", within).collect()) == [*(r[1] for r in kept), *(r[1] for r in odd)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = [(r.k, r.first) for r in dedup.near_links(df, ["g"], "k", within).collect()]
    assert len(found) == len(set(found)) and set(found) == links
    if batch == 64:
        one = df.filter("g = 3")
        assert sorted(r.k for r in dedup.keep_apart(one, [], "k", within).collect()) == [r[1] for r in kept if r[0] == 3]


def test_near_links_send_few_rows_twice(spark):
    df = spark.range(4000).select((F.col("id") % 100).alias("g"), "id", (F.col("id") / 4000).alias("x"), (F.col("id") % 63 / 63).alias("y"))
    plan = dedup.near_links(df, ["g"], "id", {"x": 0.05, "y": 0.05})._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" in plan and "array((" not in plan
    # apart in order of keys within groups: no rounds of links
    assert "Join" not in dedup.keep_apart(df, ["g"], "id", {"x": 0.05, "y": 0.05})._jdf.queryExecution().optimizedPlan().toString()
