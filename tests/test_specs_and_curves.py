"""Specified values, dates, typed answers, curves, distances, and the readers and writers beside them, against plain versions."""

import json
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import curves, specs
from colloquy.plans import catalog
from colloquy.sources import readers, writers

DATA = "/root/testdata/sf0.001"

SPECS = [
    ("string", ["a", "b"], None, None, None, None, (["a", "b"], None)),
    ("string", [], None, None, None, None, (None, "empty")),
    ("string", ["a", None], None, None, None, None, (None, "type")),
    ("string", None, 1.0, 2.0, None, None, (None, "format")),
    ("int", ["1", "-2"], None, None, None, None, (["1", "-2"], None)),
    ("int", ["1", "2.5"], None, None, None, None, (None, "type")),
    ("int", None, 2.0, 6.0, None, None, (["2", "3", "4", "5"], None)),
    ("int", None, 2.0, 6.0, 3.0, None, (["2", "5", "6"], None)),
    ("int", None, 2.0, 2.0, None, None, ([], None)),
    ("int", None, 2.0, 6.0, 0.5, None, (None, "type")),
    ("int", None, 2.0, None, None, None, (None, "format")),
    ("float", ["1", "2.5", "x"], None, None, None, None, (None, "type")),
    ("float", ["1", "2.5"], None, None, None, None, (["1", "2.5"], None)),
    ("float", None, 0.0, 1.0, 0.25, None, (["0.0", "0.25", "0.5", "0.75", "1.0"], None)),
    ("float", None, 0.0, 1.0, None, 3, (["0.0", "0.5", "1.0"], None)),
    ("float", None, 0.0, 1.0, None, 1, (["0.0"], None)),
    ("float", None, 0.0, 1.0, None, None, (None, "step")),
    ("float", None, 0.0, 1.0, -1.0, None, (None, "step")),
    ("date", ["x"], None, None, None, None, (None, "kind")),
    (None, ["x"], None, None, None, None, (None, "kind")),
]


def test_specified_values(spark):
    df = spark.createDataFrame([(i, *s[:-1]) for i, s in enumerate(SPECS)], "i int, kind string, items array<string>, low double, high double, step double, points int")
    got = df.select("i", specs.spec_values(*(F.col(c) for c in ("kind", "items", "low", "high", "step", "points"))).alias("v")).orderBy("i").collect()
    assert [(r.v["values"], r.v.error) for r in got] == [s[-1] for s in SPECS]
    lists = spark.createDataFrame([(["a", "any(fruit)", "b"], ["pear"]), (["a"], ["pear"]), (["any(x)"], None)], "l array<string>, a array<string>")
    assert [r.v for r in lists.select(specs.listed_items(F.col("l"), F.col("a")).alias("v")).collect()] == [["a", "b", "pear"], ["a"], []]


def plain_dates(start, end, kind, step):
    if kind == "linspace":
        gap = (end - start).days / (step - 1) if step > 1 else 0
        return [start + timedelta(days=int(gap * i)) for i in range(step)]
    out = [start]
    while end > out[-1]:
        out.append(out[-1] + timedelta(days=step * {"day": 1, "month": 30, "year": 365}[kind]))
    return out


def test_date_ranges(spark):
    rows = [(start, start + timedelta(days=days), kind, step) for start in (date(2024, 1, 30), date(2023, 12, 31)) for days in (0, 1, 45, 400) for kind in ("day", "month", "year", "linspace") for step in (1, 2, 7)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a date, b date, kind string, step int")
    got = df.select("i", specs.date_range(F.col("a"), F.col("b"), F.col("kind"), F.col("step"), F.lit("k")).alias("d")).orderBy("i").collect()
    assert [r.d for r in got] == [[d.strftime("%d/%m/%Y") for d in plain_dates(*r)] for r in rows]
    odd = spark.createDataFrame([(date(2024, 1, 1), date(2024, 1, 5), "random", 40), (date(2024, 1, 1), date(2024, 1, 5), "week", 1), (date(2024, 1, 1), date(2024, 1, 5), "day", 0)], "a date, b date, kind string, step int")
    drawn, week, zero = (r.d for r in odd.select(specs.date_range(F.col("a"), F.col("b"), F.col("kind"), F.col("step"), F.lit("k")).alias("d")).collect())
    assert week is None and zero is None and len(drawn) == 40 and set(drawn) == {f"0{i}/01/2024" for i in range(1, 6)}


@pytest.mark.parametrize(
    "text, kind, value",
    [("12", "int", "12"), (" -3 ", "int", "-3"), ("1.5", "int", "1.5"), ("1.5", "float", "1.5"), ("2", "float", "2.0"), ("1e3", "float", "1000.0"), ("x", "float", "x"), ("12 EUR", "money", "12 EUR"), ("", "bool", "False"), ("no", "bool", "True"),
     ("14:05", "time", "14:05:00"), ("2:30 pm", "time", "14:30:00"), ("9 AM", "time", "09:00:00"), ("7pm", "time", "19:00:00"), ("noon", "time", "noon"), ("2024-02-29", "date", "2024-02-29"), ("3/4/2024", "date", "2024-03-04"), ("5 May 2024", "date", "2024-05-05"), ("May 5, 2024", "date", "2024-05-05"), ("soon", "date", "soon"), ("null", "int", "null"), (None, "int", None), ("7", "odd", "7")],
)
def test_typed(spark, text, kind, value):
    assert spark.createDataFrame([(text, kind)], "t string, k string").select(specs.typed(F.col("t"), F.col("k")).alias("v")).first().v == value


def test_curves_on_one_grid(spark, tmp_path):
    random.seed(3)
    rows = [(f"r{r}", "ab"[r % 2], n, float(v)) for r in range(5) for n, v in sorted((random.randrange(1, 100), random.randrange(50)) for _ in range(20))]
    df = spark.createDataFrame(rows, "run string, algo string, n int, v double")
    got = {(r.run, r.n): r.value for r in curves.on_grid(df, "run", "n", "v", 10, 120).collect()}
    want = {}
    for run in {r[0] for r in rows}:
        for g in range(10, 121, 10):
            known = [(n, v) for x, _, n, v in rows if x == run and n <= g]
            want[run, g] = max(known)[1] if known else None
    assert got == want
    found = curves.comparison_curves(df, "algo", "run", "n", "v", 10, 120)
    for r in found.collect():
        values = [want[run, r.n] for run, a in {(x[0], x[1]) for x in rows} if a == r.algo and want[run, r.n] is not None]
        assert r.runs == len(values) and (not values or (r["mean"], r.sigma) == (pytest.approx(np.mean(values)), pytest.approx(np.std(values))))
    writers.comparison_csv(found, str(tmp_path / "c"), "algo", "hv")
    back = {(r.algorithm, r.n): (r["mean"], r.sigma) for r in readers.comparison_csv(spark, str(tmp_path / "c"), "hv").collect()}
    assert back == {(r.algo, r.n): (r["mean"] if r["mean"] is None else pytest.approx(r["mean"]), r.sigma if r.sigma is None else pytest.approx(r.sigma)) for r in found.collect()}
    with pytest.raises(ValueError, match="n_evals"):
        readers.comparison_csv(spark, f"{DATA}/region.parquet", "hv")


def test_pair_distances_by_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [("a", i, v.tolist()) for i, v in enumerate(rng.random((90, 3)))] + [("b", 1, [0.0, 0.0, 0.0]), ("c", 1, None), ("d", 1, [1.0, 1.0, 1.0]), ("d", 2, [1.0, 1.0, 1.0])] + [(None, i, [float(i), 0.0, 0.0]) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, k long, v array<double>")
    got = {r.g: (r.n, r.mean_distance, r.mean_largest) for r in curves.pair_distances(df, "g", "k", "v", block=20).collect()}
    x = np.array([r[2] for r in rows[:90]])
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    assert got["a"] == (90, pytest.approx(d.mean()), pytest.approx(d.max(0).mean()))
    assert got["b"] == (1, 0.0, 0.0) and got["d"] == (2, pytest.approx(0.0, abs=1e-7), pytest.approx(0.0, abs=1e-7)) and "c" not in got


def test_rule_csv_report_and_round_trip(spark, tmp_path):
    stats = spark.createDataFrame([("b", 3, 1, 1, 1, "50.00%"), ("a", 1, 1, 0, 0, "0.00%")], "rule string, checks long, passed long, failed long, na long, fail_rate string")
    writers.rule_csv(stats, str(tmp_path / "rules"))
    (part,) = (tmp_path / "rules").glob("*.csv")
    assert part.read_text().splitlines() == ["rule,checks,pass,fail,not_applicable,fail_rate", "a,1,1,0,0,0.00%", "b,3,1,1,1,50.00%"]
    writers.judge_report(stats.select("rule", "checks"), stats, str(tmp_path / "report"), {"model": "m", "day": "1"})
    (meta,) = (tmp_path / "report" / "metadata").glob("*.json")
    assert json.loads(meta.read_text()) == {"metadata": {"day": "1", "model": "m"}} and spark.read.json(str(tmp_path / "report" / "results")).count() == 2
    rows = spark.createDataFrame([(1, (2, [(0.5, "é")], {"a": None})), (2, None)], "id int, out struct<n:int,turns:array<struct<s:double,t:string>>,m:map<string,string>>")
    assert [tuple(r) for r in writers.round_trip(rows, "out").orderBy("id").collect()] == [tuple(r) for r in rows.orderBy("id").collect()]


def test_majority_labels_and_corpus(spark, tmp_path):
    (tmp_path / "m.csv").write_text('conversation_id,majority_user_clarity\n/x/y/c1.json,2\nC:\\data\\c2.json,1\nc3.json,\n,1\nc2.json,0\n')
    assert sorted(tuple(r) for r in readers.majority_labels(spark, str(tmp_path / "m.csv"), "majority_user_clarity").collect()) == [("c1.json", 2), ("c2.json", 1)]
    (tmp_path / "u.csv").write_text('id,utterance\n1,"find, please"\n2,\n3,go\n4,stop\n')
    (tmp_path / "seeds.json").write_text('["one", "two", null]')
    rows = readers.utterance_corpus(spark, str(tmp_path / "u.csv"), "utterance", str(tmp_path / "seeds.json"))
    assert sorted(tuple(r) for r in rows.collect()) == [("find, please", "corpus"), ("go", "corpus"), ("one", "seed"), ("stop", "corpus"), ("two", "seed")]
    assert readers.utterance_corpus(spark, str(tmp_path / "u.csv"), "utterance", None, 2).count() == 2


def test_sequence_ratio_query(spark):
    """Matching blocks by a plain recursion."""
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}

    def matched(a, b):
        best = (0, 0, 0)
        ends = {}
        for i, x in enumerate(a):
            now = {}
            for j, y in enumerate(b):
                if x == y:
                    now[j] = ends.get(j - 1, 0) + 1
                    if now[j] > best[0]:
                        best = (now[j], i - now[j] + 1, j - now[j] + 1)
            ends = now
        n, i, j = best
        return n + matched(a[:i], b[:j]) + matched(a[i + n :], b[j + n :]) if n else 0

    got = {r.item_id: r.ratio for r in catalog.QUERIES["item_sequence_ratio"](spark, DATA).collect()}
    assert got and set(got) == {i for i in texts if i - 4 in texts}
    short = sorted(got, key=lambda i: len(texts[i]) * len(texts[i - 4]))[:3]
    for i in short:
        a, b = texts[i - 4], texts[i]
        assert 0 <= got[i] <= 1 and (len(b) >= 200 or got[i] == pytest.approx(max(2 * matched(a, b), 2 * matched(b, a)) / (len(a) + len(b)), abs=0.05))


def test_learned_queries(spark):
    rows = catalog.QUERIES["critical_regions"](spark, DATA).collect()
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_quantity", "l_discount", (F.col("l_returnflag") == "R").alias("failed")).collect()
    assert sum(r.n for r in rows) == len(lines) and sum(r.n * r.share for r in rows) == pytest.approx(sum(x.failed for x in lines))
    for r in rows:
        inside = [x for x in lines if r.min_l_quantity <= x.l_quantity <= r.max_l_quantity and r.min_l_discount <= x.l_discount <= r.max_l_discount]
        assert len(inside) == r.n and np.mean([x.failed for x in inside]) == pytest.approx(r.share)
    # of the same numbers of clusters, k-means by plain steps does not beat the query's silhouette by much
    found = catalog.QUERIES["vector_clusters"](spark, DATA).collect()
    assert sum(r.n for r in found) == spark.read.parquet(f"{DATA}/embeddings.parquet").count() and 4 <= len(found) <= 6
    from colloquy.operators import search as S

    scored = spark.createDataFrame([(s / 10, y) for s, y in zip([1, 2, 2, 5, 6, 6, 8, 9, 9, 9], [0, 0, 1, 0, 1, 1, 0, 1, 1, 1])], "score double, label int")
    best = S.best_threshold(scored, "score", "label").first()
    pairs = [(r.score, r.label) for r in scored.collect()]
    f1 = {b: 2 * sum(y for s, y in pairs if s >= b) / (sum(s >= b for s, _ in pairs) + sum(y for _, y in pairs)) for b in {s for s, _ in pairs}}
    assert best.f1 == pytest.approx(max(f1.values())) and f1[best.bound] == pytest.approx(best.f1)
    bound = catalog.QUERIES["fitted_weights"](spark, DATA).first()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id")
    assert bound.f1 >= 2 * docs.filter("quality = 1").count() / (docs.count() + docs.filter("quality = 1").count()) - 1e-6


def test_repeated_answers_that_repeat(spark):
    from colloquy.operators import conversation as C

    log = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "x"), (1, 3, "assistant", "y"), (1, 5, "assistant", "x"), (1, 7, "assistant", "x"), (2, 1, "assistant", "x"), (2, 2, "user", "x")], "conv_id long, turn int, role string, text string")
    assert [tuple(r) for r in C.repeated_answers(log).collect()] == [(1, 1, 3)]


def test_perturbations_keep_what_they_should(spark):
    from colloquy.functions import perturbations as P

    text = "The quick brown foxes, of another house; jump over it at   night with some friends and the dogs eat apples " * 8
    df = spark.createDataFrame([(1, text), (2, text), (3, ""), (4, None), (5, "ab cd xyz")], "id long, text string")
    got = {r.id: r for r in df.select("id", *(f(F.col("text"), F.col("id")).alias(n) for n, f in P.KINDS.items())).collect()}
    words = text.split()
    one = got[1]
    assert all(got[4][n] is None and got[3][n] == "" for n in P.KINDS) and all(got[1][n] != got[2][n] for n in P.KINDS)
    assert len(one.introduce_typos) == len(text) and 0.03 < sum(a != b for a, b in zip(one.introduce_typos, text)) / len(text) < 0.2
    assert 0.8 < len(one.delete_characters) / len(text) < 0.97 and 1.03 < len(one.add_characters) / len(text) < 1.2 and one.add_spaces.replace(" ", "") == text.replace(" ", "")
    for kind in ("swap_characters", "shuffle_characters"):
        new = one[kind].split(" ")
        assert len(new) == len(words) and all(a[0] == b[0] and a[-1] == b[-1] and sorted(a) == sorted(b) for a, b in zip(new, words))
        assert 0 < sum(a != b for a, b in zip(new, words)) < 0.4 * len(words) and got[5][kind] == "ab cd xyz"
    leet = one.to_leet.split(" ")
    assert {b for a, b in zip(words, leet) if a != b} <= {a.translate(str.maketrans("aeioAEIO", "43104310")) for a in words} and leet != words
    gone = list(words)
    for w in one.delete_words.split(" "):
        while gone[0] != w:
            assert gone.pop(0).lower() in P.DELETED
        gone.pop(0)
    some = spark.createDataFrame([(1, "delete_words", "add_spaces"), (2, None, "add_spaces"), (3, "odd", None)], "id long, w string, c string").select("id", P.perturbed(F.lit(text), F.col("w"), F.col("c"), F.col("id")).alias("t")).orderBy("id").collect()
    assert some[0].t.replace(" ", "") == got[1].delete_words.replace(" ", "") and some[1].t == got[2].add_spaces and some[2].t == text
