import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.functions import features, text, vector
from colloquy.operators import agreement, conversation, dedup, history, quality, rules, scoring, stats


def one(df):
    return df.collect()[0]


def test_turn_pairs_edges(spark):
    log = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "assistant", "c"), (1, 4, "user", "d"), (2, 0, "assistant", "x")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in conversation.turn_pairs(log).orderBy("turn").collect()] == [(1, 1, "a", "b", 0), (1, 4, "d", None, 1)]


def test_efficiency_of_unanswered(spark):
    turns = spark.createDataFrame([(1, 0, None), (1, 1, "reject"), (2, 0, "inform")], "conv_id long, turn_idx int, intent string")
    assert {r.conv_id: r.efficiency for r in conversation.efficiency(turns).collect()} == {1: 0.5, 2: 1.0}


def test_ordinal_last_bin(spark):
    values = F.array(*map(F.lit, "abcd"))
    row = one(spark.range(1).select(features.ordinal_label(values, F.lit(1.0)).alias("x"), features.ordinal_label(values, F.lit(0.25)).alias("y"), features.category_label(values, F.lit(9)).alias("z"), features.label_index(values, F.lit("q")).alias("w")))
    assert tuple(row) == ("d", "b", None, None)


def test_kappa_perfect_and_constant(spark):
    rows = [(i, r, i % 2) for i in range(6) for r in range(3)]
    assert one(agreement.fleiss_kappa(spark.createDataFrame(rows, "item int, rater int, label int"))).kappa == pytest.approx(1)
    same = spark.createDataFrame([(i, r, 1) for i in range(4) for r in range(2)], "item int, rater int, label int")
    assert one(agreement.fleiss_kappa(same)).kappa == 1
    assert one(agreement.krippendorff_alpha(same)).alpha == 1
    assert one(agreement.cohen_kappa(spark.createDataFrame([(1, 1), (1, 1)], "a int, b int"))).kappa == 1


def test_majority_ties(spark):
    rows = spark.createDataFrame([(1, 0, 2), (1, 1, 1), (2, 0, 0), (2, 1, 0)], "item int, rater int, label int")
    assert {r.item: r.label for r in agreement.majority(rows).collect()} == {1: 1, 2: 0}
    assert {r.item: r.label for r in agreement.majority(rows, "max").collect()} == {1: 2, 2: 0}


def test_a12_is_antisymmetric(spark):
    x, y = [1, 2, 2, 5], [2, 3, 1, 1, 9]
    rows = [("x", float(v)) for v in x] + [("y", float(v)) for v in y]
    a = one(stats.a12(spark.createDataFrame(rows, "g string, v double"), "g", "v")).a
    assert a == pytest.approx(np.mean([(i > j) + 0.5 * (i == j) for i in x for j in y]))
    b = one(stats.a12(spark.createDataFrame([("z" if g == "x" else g, v) for g, v in rows], "g string, v double"), "g", "v")).a
    assert a + b == pytest.approx(1)


def test_pareto_front_is_antichain(spark):
    rng = np.random.default_rng(1)
    p = [(int(g), float(x), float(y)) for g, x, y in zip(rng.integers(0, 3, 200), rng.integers(0, 12, 200), rng.integers(0, 12, 200), strict=True)]
    got = sorted(tuple(r) for r in quality.pareto_front(spark.createDataFrame(p, "g int, x double, y double"), "g", "x", "y").collect())
    want = sorted(a for a in p if not any(b[0] == a[0] and b[1] <= a[1] and b[2] <= a[2] and b[1:] != a[1:] for b in p))
    assert got == want
    ranks = quality.front_ranks(spark.createDataFrame(p, "g int, x double, y double"), "g", ["x", "y"])
    assert sorted(tuple(r)[:3] for r in ranks.filter("front = 0").collect()) == want


def test_mean_dissimilarity_equals_pairs(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(9, 4))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    pairs = [(1 - u[i] @ u[j]) / 2 for i in range(9) for j in range(i)]
    df = spark.createDataFrame([(1, x.tolist()) for x in v] + [(2, [1.0, 0.0, 0.0, 0.0])], "g int, v array<double>")
    got = {r.g: r.dissimilarity for r in quality.mean_dissimilarity(df, "g", "v").collect()}
    assert got[1] == pytest.approx(np.mean(pairs)) and got[2] == -1


def test_novelty_archive_is_ordered(spark):
    df = spark.createDataFrame([(1, 0, [0.0]), (1, 1, [0.5]), (1, 2, [1.2]), (1, 3, [0.6])], "g int, i int, v array<double>")
    assert [r.i for r in quality.novelty_archive(df, "g", "i", "v", 1.0).orderBy("i").collect()] == [0, 2]


def test_crowding_ends(spark):
    df = spark.createDataFrame([(0, float(i), float(-i)) for i in range(4)], "g int, x double, y double")
    got = [r.crowding for r in quality.crowding(df, "g", ["x", "y"]).orderBy("x").collect()]
    assert got[0] == got[-1] == float("inf") and got[1] == pytest.approx(2 / 3)


def test_near_pairs_and_keep_first(spark):
    df = spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.04), (1, 3, 0.5), (2, 4, 0.0)], "g int, k int, x double")
    assert [tuple(r) for r in dedup.near_pairs(df, ["g"], "k", {"x": 0.05}).collect()] == [(2, 1)]
    first = dedup.keep_first(df, [F.round("x", 1)], "k")
    assert sorted(r.k for r in first.collect()) == [1, 3]
    assert dedup.keep_first(first, [F.round("x", 1)], "k").count() == 2


def test_turnwise_equal(spark):
    s = "pair int, turn_idx int, vec array<double>"
    a = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.0]), (3, 0, [1.0, 0.0])], s)
    b = spark.createDataFrame([(1, 0, [2.0, 0.1]), (2, 0, [0.0, 1.0]), (3, 0, [1.0, 0.0]), (3, 1, [1.0, 0.0])], s)
    assert {r.pair: r.equal for r in dedup.turnwise_equal(a, b).collect()} == {1: True, 2: False, 3: False}


def test_text_functions(spark):
    df = spark.createDataFrame([("I paid 1,234.50 dollars", "yes"), (None, "maybe"), ("", "noo")], "t string, b string")
    got = df.select(text.word_count(F.col("t")), text.first_float(F.col("t")), text.currency(F.col("t")), text.as_bool(F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(6, 1234.5, "USD", True), (-1, None, None, None), (0, None, None, False)]
    row = one(spark.range(1).select(text.listed(F.array(F.lit("a"), F.lit("b"), F.lit("c"))), text.jaccard(F.lit("a b"), F.lit("B c")), text.leet(F.lit("leet")), text.swap_inner(F.lit("hello it"))))
    assert tuple(row) == ("a, b and c", pytest.approx(1 / 3), "l33t", "hlelo it")


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(4.0))
    assert tuple(one(spark.range(1).select(vector.euclidean(a, b), vector.cosine(a, b), vector.mae(a, b), vector.mse(a, b)))) == (5.0, 0.0, 3.5, 12.5)


def test_scoring(spark):
    row = one(spark.range(1).select(scoring.threshold(F.lit(-0.9), ">=", 0.9), scoring.mean_of_known(F.array(F.lit(1.0), F.lit(None).cast("double"), F.lit(0.0))), scoring.logit_share(F.lit(1.0), F.lit(1.0))))
    assert tuple(row) == (True, 0.5, 0.5)


def test_rules(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 80)], "i int, k int")
    got = one(rules.statistics(rules.property_rules(df, [rules.Rule("small", "k < 50", "k is not null")])))
    assert (got.checks, got.passed, got.failed, got.na, got.fail_rate) == (3, 1, 1, 1, "50.00%")
    assert tuple(one(rules.global_rule(df, "k > 1", 2))) == (2, True)


def test_resampled_interpolates(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:10:00", 0), (1, "2024-01-01 02:05:00", 4)], "run int, ts string, v int").withColumn("ts", F.to_timestamp("ts"))
    assert [r.value for r in history.resampled(df, "run", "ts", "v").orderBy("bucket").collect()] == [0.0, 2.0, 4.0]
    assert [r.value for r in history.extrapolated(spark.createDataFrame([(1, 1, 2.0), (1, 2, 5.0)], "run int, s int, value double"), "run", "s", "value", 2).orderBy("s").collect()] == [8.0, 11.0]


def test_numbers_and_currencies_by_their_rules(spark):
    cases = [
        ("-5", 5.0, None), (".5", 0.5, None), ("1,5", 15.0, None), ("+2.5 and 3", 2.5, None), ("1,2,3 euros", 123.0, "EUR"), ("Europe EUROPE", None, None), ("EUR then $", None, "USD"),
        ("GBP before EUR", None, "GBP"), ("pounds, dollars", None, "GBP"), ("dollar", None, None), ("Yen", None, "JPY"), ("x" * 3000 + " 7 INR", 7.0, "INR"), ("", None, None), (None, None, None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "i int, t string")
    got = df.select(text.first_float(F.col("t")), text.currency(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [c[1:] for c in cases]


def test_spread_by_hand(spark):
    from colloquy.operators import quality

    df = spark.createDataFrame([("a", 0.0, 4.0), ("a", 1.0, 3.0), ("a", 3.0, 1.0), ("a", 4.0, 0.0), ("b", 1.0, 1.0)], "g string, x double, y double")
    got = {r.g: r for r in quality.spread(df, "g", "x", "y").collect()}
    # gaps 1, 2, 1 (times root 2), mean 4/3
    assert abs(got["a"].spread - (2 + 2 / 3) / (2 + 4)) < 1e-9 and abs(got["a"].spread_ref - (2 + 2 / 3) / (2 + 4)) < 1e-9
    assert got["b"].spread == got["b"].spread_ref == 1.0


def test_records(spark):
    from colloquy.functions import records as R

    texts = spark.createDataFrame([('so: {"a": {"b": 1}} end',), ("no } { json",), ("{broken",), ("[1, {\"x\": 2}] and",), (None,), ("",)], "t string")
    got = [tuple(r) for r in texts.select(R.json_object(F.col("t")), R.json_list(F.col("t"))).collect()]
    assert got == [('{"a": {"b": 1}}', None), (None, None), (None, None), ('{"x": 2}', '[1, {"x": 2}]'), (None, None), (None, None)]
    slots = spark.sql("select map('a', 'x', 'b', null, 'c', 'None') as m union all select map('a', 'x') union all select map()")
    assert [tuple(r) for r in slots.select(R.all_collected(F.col("m")), R.missing_slots(F.col("m"))).collect()] == [(False, ["b", "c"]), (True, []), (True, [])]
    levels = F.array(F.lit(1.0), F.lit(2.0), F.lit(5.0))
    row = one(spark.range(1).select(R.next_lower(F.lit(5.0), levels), R.next_lower(F.lit(1.0), levels), R.is_lowest(F.lit(1.0), levels), R.is_lowest(F.lit(2.0), levels)))
    assert tuple(row) == (2.0, None, True, False)
    picks = spark.range(4000).select(R.weighted_pick(F.array(F.lit("a"), F.lit("b")), F.create_map(F.lit("a"), F.lit(1.5)), F.col("id").cast("string")).alias("p")).groupBy("p").count().collect()
    assert abs({r.p: r["count"] for r in picks}["a"] / 4000 - 0.75) < 0.03
    flat = R.flattened(spark.sql("select 1 as k, struct(2 as a, struct(3 as c) as b) as s"), "s")
    assert flat.columns == ["k", "s_a", "s_b_c"] and tuple(one(flat)) == (1, 2, 3)
