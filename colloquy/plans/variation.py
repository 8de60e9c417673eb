"""Queries on variation: crossover, mutation and distances of utterances, grids, runs of algorithms and costs of judges."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import features, variation
from colloquy.operators import history as H
from colloquy.operators import search as S

from .history import tests
from .metrics import r6

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
#: Costs of a million tokens read and written, by model (made up).
PRICES = {"small": (0.5, 1.5), "large": (2.5, 10.0)}


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def draw(name):
    return features.keyed_uniform(F.lit(name), F.col("c_custkey").cast("string"))


def score(column="c_acctbal"):
    return (F.col(column) + 1000) / 11000


def crossed_scores(spark, sf_dir):
    """Children of each customer's balance and a keyed score."""
    least, most = variation.crossed(F.col("a"), F.col("b"), F.col("u"), 5)
    rows = table(spark, sf_dir, "customer").select("c_custkey", score().alias("a"), draw("b").alias("b"), draw("u").alias("u"))
    return r6(rows.select("c_custkey", least.alias("least"), most.alias("most")), "least", "most")


def mutated_scores(spark, sf_dir):
    """Each customer's balance after polynomial mutation, and their segment after a choice."""
    index = F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col("c_mktsegment")).cast("int") - 1
    rows = table(spark, sf_dir, "customer").select("c_custkey", score().alias("x"), draw("u").alias("u"), index.alias("i"), draw("c").alias("c"), draw("v").alias("v"))
    return r6(rows.select("c_custkey", variation.mutated(F.col("x"), F.col("u"), 30).alias("score"), variation.choice_mutated(F.col("i"), 5, 4, F.col("c"), F.col("v")).alias("segment")), "score")


def utterance_distances(spark, sf_dir):
    """Each customer against a keyed other one, with a cosine for every third question."""
    one, two = (F.array(score(), F.lit(0.5)), F.array(draw("b"), draw("d"))), (F.array("c_mktsegment", F.lit("x")), F.array(F.lit("BUILDING"), F.lit("x")))
    cosine = F.when(F.col("c_custkey") % 3 == 0, draw("q"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", variation.utterance_distance(cosine, F.lit(None).cast("double"), one, two).alias("d"))
    return r6(rows.select("c_custkey", "d.*"), "question", "ordinal", "categorical", "combined")


def grid_points(spark, sf_dir):
    """A grid of four sizes and prices between those of each brand's parts, and of it the points that are critical: large and cheap."""
    grid = S.grid_between(table(spark, sf_dir, "part"), "p_brand", ["p_size", "p_retailprice"], 4)
    return r6(S.reference_set(grid, (F.col("p_size") > 20) & (F.col("p_retailprice") < 1500)), "p_size", "p_retailprice")


def algorithm_table(spark, sf_dir):
    """Two algorithms' finished runs (all but run 5), with failures told by another oracle: least, mean and most tests, failures and distinct ones."""
    rows = H.relabelled(H.finished(tests(spark, sf_dir).withColumn("state", F.when(F.col("run") == 5, "crashed").otherwise("finished")), "state"), "failed", "failed or value > 400")
    return r6(H.algorithm_table(rows.withColumn("algo", F.col("run") % 2), "algo", "run", "failed", F.struct("event_type", "user_id", "gen")), "mean_tests")


def judge_costs(spark, sf_dir):
    """Calls, tokens (a quarter of the characters) and costs of each model that would judge the turns."""
    rows = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 3 == 0, "large").when(F.col("doc_id") % 3 == 1, "small").otherwise("unknown").alias("model"), F.col("text"), F.lit("good").alias("said"))
    return r6(H.costs(rows, "model", "text", "said", PRICES), "cost")


QUERIES = {f.__name__: f for f in (crossed_scores, mutated_scores, utterance_distances, grid_points, algorithm_table, judge_costs)}

U = "(('0x' || substr(md5('{}:' || c_custkey), 1, 8))::UBIGINT / 4294967296.0)"
SQL = {
    "crossed_scores": f"""
WITH r AS (SELECT c_custkey, (c_acctbal + 1000) / 11000 AS a, {U.format("b")} AS b, {U.format("u")} AS u FROM customer),
s AS (SELECT *, least(a, b) AS l, greatest(a, b) AS h, 2 - (1 + 2 * l / (h - l)) ** -6 AS p, 2 - (1 + 2 * (1 - h) / (h - l)) ** -6 AS q FROM r)
SELECT c_custkey, round(CASE WHEN a = b THEN a ELSE least(greatest((l + h - CASE WHEN u <= 1 / p THEN (u * p) ** (1 / 6.0) ELSE (1 / (2 - u * p)) ** (1 / 6.0) END * (h - l)) / 2, 0), 1) END, 6) AS least,
  round(CASE WHEN a = b THEN b ELSE least(greatest((l + h + CASE WHEN u <= 1 / q THEN (u * q) ** (1 / 6.0) ELSE (1 / (2 - u * q)) ** (1 / 6.0) END * (h - l)) / 2, 0), 1) END, 6) AS most FROM s""",
    "mutated_scores": f"""
WITH r AS (SELECT c_custkey, (c_acctbal + 1000) / 11000 AS x, {U.format("u")} AS u, {U.format("c")} AS c, {U.format("v")} AS v, list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment) - 1 AS i FROM customer)
SELECT c_custkey, round(least(greatest(x + CASE WHEN u <= 0.5 THEN (2 * u + (1 - 2 * u) * (1 - x) ** 31) ** (1 / 31.0) - 1 ELSE 1 - (2 * (1 - u) + 2 * (u - 0.5) * x ** 31) ** (1 / 31.0) END, 0), 1), 6) AS score, CAST(CASE WHEN c < 0.25 THEN floor(v * 5) ELSE i END AS INTEGER) AS segment FROM r""",
    "utterance_distances": f"""
WITH r AS (SELECT c_custkey, sqrt(((c_acctbal + 1000) / 11000 - {U.format("b")}) ** 2 + (0.5 - {U.format("d")}) ** 2) AS e, CAST(c_mktsegment <> 'BUILDING' AS INTEGER) AS m, CASE WHEN c_custkey % 3 = 0 THEN {U.format("q")} ELSE 0 END AS q FROM customer)
SELECT c_custkey, round((1 - q) / 2, 6) AS question, 0.5::DOUBLE AS answer, round(e / 2, 6) AS ordinal, round(m / 2, 6) AS categorical, round((e + m) / 4, 6) AS combined FROM r""",
    "grid_points": """
WITH e AS (SELECT p_brand, min(p_size) AS a, max(p_size) AS b, min(p_retailprice) AS c, max(p_retailprice) AS d FROM part GROUP BY p_brand),
g AS (SELECT p_brand, CAST(i AS INTEGER) AS point, a + (i % 4) * (b - a) / 3.0 AS p_size, c + (i // 4) * (d - c) / 3.0 AS p_retailprice FROM e, range(0, 16) r(i))
SELECT p_brand, point, round(p_size, 6) AS p_size, round(p_retailprice, 6) AS p_retailprice FROM g WHERE p_size > 20 AND p_retailprice < 1500""",
    "algorithm_table": """
WITH t AS (SELECT user_id % 6 AS run, event_type = 'error' OR value > 400 AS failed, event_type, user_id, day(ts) AS gen FROM events WHERE user_id % 6 <> 5),
r AS (SELECT run % 2 AS algo, run, count(*) AS n, count_if(failed) AS f, count(DISTINCT (event_type, user_id, gen)) FILTER (failed) AS d FROM t GROUP BY run)
SELECT algo, count(*) AS runs, min(n) AS min_tests, round(avg(n), 6) AS mean_tests, max(n) AS max_tests, CAST(sum(f) AS BIGINT) AS failures, CAST(sum(d) AS BIGINT) AS distinct_failures FROM r GROUP BY algo""",
    "judge_costs": """
WITH r AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'large' WHEN 1 THEN 'small' ELSE 'unknown' END AS model, length(coalesce(text, '')) // 4 AS n FROM documents)
SELECT model, count(*) AS calls, CAST(sum(n) AS BIGINT) AS tokens_in, count(*) AS tokens_out, round(sum(n) / 1e6 * CASE model WHEN 'large' THEN 2.5 WHEN 'small' THEN 0.5 ELSE 0 END + count(*) / 1e6 * CASE model WHEN 'large' THEN 10.0 WHEN 'small' THEN 1.5 ELSE 0 END, 6) AS cost FROM r GROUP BY model""",
}
