"""Queries on run histories: events are tests, errors are failures, user_id % 6 is the run, days are generations."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import history as H

from .metrics import r6


def tests(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select(
        (F.col("user_id") % 6).alias("run"), "event_id", "ts", F.dayofmonth("ts").alias("gen"), (F.col("event_type") == "error").alias("failed"), "value", "event_type", "user_id",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def running_failures(spark, sf_dir):
    return r6(H.running_counts(tests(spark, sf_dir), "run", ["ts", "event_id"], "failed"), "critical_ratio").select("run", "event_id", "test_size", "failures", "critical_ratio")


def hourly_failures(spark, sf_dir):
    rows = H.running_counts(tests(spark, sf_dir), "run", ["ts", "event_id"], "failed")
    return r6(H.resampled(rows, "run", "ts", "failures"), "value").withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH"))


def found_over_time(spark, sf_dir):
    """Failures of tests without duplicates (the first of each type, user and day) at every 1,200 of 7,200 seconds."""
    rows = tests(spark, sf_dir)
    first = rows.groupBy("run", "event_type", "user_id", "gen").agg(F.min(F.struct("ts", "event_id", "failed")).alias("t")).select("run", "t.*")
    return r6(H.failures_over_time(H.running_counts(first, "run", ["ts", "event_id"], "failed"), "run", 7200, 1200), "budget", "failures")


def extrapolated_failures(spark, sf_dir):
    rows = H.cumulative_by_generation(tests(spark, sf_dir), "run", "gen", "failed").withColumn("failures", F.col("failures").cast("double"))
    return H.extrapolated(rows, "run", "gen", "failures", 3)


def cumulative_generations(spark, sf_dir):
    return H.cumulative_by_generation(tests(spark, sf_dir), "run", "gen", "failed")


def first_critical_generation(spark, sf_dir):
    return H.first_critical(tests(spark, sf_dir), "run", "gen", "failed")


def equal_parts(spark, sf_dir):
    return H.equal_parts(tests(spark, sf_dir), "run", ["ts", "event_id"], 7).groupBy("run", "part").agg(F.count("*").alias("n"), F.count_if("failed").alias("failures"))


def daily(spark, sf_dir):
    rows = tests(spark, sf_dir).groupBy("run", "gen").agg(F.count_if("failed").cast("double").alias("failures"))
    return rows.withColumn("algo", F.col("run") % 2)


def metric_curves(spark, sf_dir):
    return r6(H.curve(daily(spark, sf_dir), "algo", "gen", "failures"), "mean_nonzero", "mean", "std", "sem")


def last_failures(spark, sf_dir):
    rows = daily(spark, sf_dir).withColumn("pair", F.floor(F.col("run") / 2))
    return H.last_values(rows, "algo", "pair", "gen", "failures", [0, 1]).select("pair", F.col("0").alias("algo_0"), F.col("1").alias("algo_1"))


def run_summary(spark, sf_dir):
    """Counts of all and failed tests with and without duplicates (equal type, user and day), their ratio, first failing generation."""
    key = F.struct("event_type", "user_id", "gen")
    return r6(
        tests(spark, sf_dir).groupBy("run").agg(
            F.count("*").alias("n"), F.count_if("failed").alias("failures"), F.count_distinct(key).alias("n_distinct"), F.count_distinct(F.when(F.col("failed"), key)).alias("failures_distinct"),
            (F.count_if("failed") / F.count("*")).alias("ratio"), F.min(F.when(F.col("failed"), F.col("gen"))).alias("first_gen"),
        ), "ratio")


def run_table(spark, sf_dir):
    """Mean and sample deviation over runs (0 for one) of failures and critical ratio for each algorithm."""
    runs = tests(spark, sf_dir).groupBy("run").agg(F.count_if("failed").alias("f"), (F.count_if("failed") / F.count("*")).alias("r")).withColumn("algo", F.col("run") % 2)
    std = lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))
    return r6(runs.groupBy("algo").agg(F.avg("f").alias("failures_mean"), std("f").alias("failures_std"), F.avg("r").alias("ratio_mean"), std("r").alias("ratio_std")), "failures_mean", "failures_std", "ratio_mean", "ratio_std")


def response_times(spark, sf_dir):
    return r6(tests(spark, sf_dir).groupBy("event_type").agg(F.avg("value").alias("mean"), F.max("value").alias("most"), F.min("value").alias("least")), "mean", "most", "least")


def error_checks(spark, sf_dir):
    """For each of four codes: how many runs have it and how often (0 rows of a code count as none)."""
    codes = spark.createDataFrame([(0,), (1,), (2,), (999999,)], "code long")
    rows = tests(spark, sf_dir).filter("failed").groupBy(F.col("k").alias("code")).agg(F.count_distinct("run").alias("runs"), F.count("*").alias("times"))
    return codes.join(rows, "code", "left").na.fill(0)


def token_costs(spark, sf_dir):
    """Cost by type: value / 1000 at the type's rate, with totals (rollup)."""
    rates = spark.createDataFrame([("view", 0.5), ("click", 1.0), ("purchase", 2.5), ("signup", 1.5)], "event_type string, rate double")
    rows = tests(spark, sf_dir).join(F.broadcast(rates), "event_type", "left").withColumn("cost", F.col("value") / 1000 * F.coalesce("rate", F.lit(0.0)))
    return r6(rows.rollup("event_type").agg(F.count("*").alias("calls"), F.sum("cost").alias("cost"), F.avg("value").alias("mean")), "cost", "mean")


def rule_statistics(spark, sf_dir):
    """Checks, passes, failures and not-applicable of three rules on events, with the failing rate as text."""
    from colloquy.operators import rules

    found = rules.property_rules(tests(spark, sf_dir), rules.EVENT_RULES)
    return rules.statistics(found)


def rule_pairs(spark, sf_dir):
    """A metamorphic rule on ordered pairs of tests of one user and day: later ones of the same type don't have a lower id."""
    from colloquy.operators import rules

    return rules.pair_rule(tests(spark, sf_dir), ["user_id", "gen", "event_type"], "event_id", "b.ts >= a.ts", "b.event_id > a.event_id")


QUERIES = {f.__name__: f for f in (running_failures, hourly_failures, found_over_time, extrapolated_failures, cumulative_generations, first_critical_generation, equal_parts, metric_curves, last_failures, run_summary, run_table, response_times, error_checks, token_costs, rule_statistics, rule_pairs)}

T = """
WITH t AS (SELECT user_id % 6 AS run, event_id, ts, CAST(day(ts) AS INTEGER) AS gen, event_type = 'error' AS failed, value, event_type, user_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events),
c AS (SELECT *, count(*) OVER w AS test_size, sum(CAST(failed AS BIGINT)) OVER w AS failures FROM t WINDOW w AS (PARTITION BY run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
g AS (SELECT run, gen, count(*) AS n, count_if(failed) AS f FROM t GROUP BY ALL),
h AS (SELECT run, gen, sum(n) OVER w AS n_eval, sum(f) OVER w AS failures FROM g WINDOW w AS (PARTITION BY run ORDER BY gen))
"""
SQL = {
    "running_failures": T + "SELECT run, event_id, test_size, failures, round(failures / test_size, 6) AS critical_ratio FROM c",
    "hourly_failures": T
    + """, b AS (SELECT run, date_trunc('hour', ts) AS b, arg_min(failures, (ts, failures)) AS v FROM c GROUP BY ALL),
e AS (SELECT run, unnest(generate_series(min(b), max(b), INTERVAL 1 HOUR)) AS b FROM b GROUP BY run),
j AS (SELECT e.run, e.b, v, CASE WHEN v IS NOT NULL THEN epoch(e.b) END AS kt FROM e LEFT JOIN b USING (run, b)),
k AS (SELECT *, last_value(v IGNORE NULLS) OVER p AS pv, last_value(kt IGNORE NULLS) OVER p AS pt, first_value(v IGNORE NULLS) OVER n AS nv, first_value(kt IGNORE NULLS) OVER n AS nt FROM j
      WINDOW p AS (PARTITION BY run ORDER BY b ROWS UNBOUNDED PRECEDING), n AS (PARTITION BY run ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT run, strftime(b, '%Y-%m-%d %H') AS bucket, round(coalesce(CAST(v AS DOUBLE), pv + (nv - pv) * ((epoch(b) - pt) / (nt - pt))), 6) AS value FROM k""",
    "found_over_time": T
    + """, u AS (SELECT run, ts, event_id, failed FROM t QUALIFY row_number() OVER (PARTITION BY run, event_type, user_id, gen ORDER BY ts, event_id) = 1),
q AS (SELECT run, row_number() OVER w AS i, sum(CAST(failed AS BIGINT)) OVER w AS f, count(*) OVER (PARTITION BY run) AS n FROM u WINDOW w AS (PARTITION BY run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
p AS (SELECT run, n, k * 1200.0::DOUBLE AS time, least(greatest(k * 1200 * n / 7200, 1), n)::DOUBLE AS pos FROM (SELECT DISTINCT run, n FROM q), range(0, 7) t(k))
SELECT p.run, time, round(time / 72, 6) AS budget, round(a.f + (b.f - a.f) * (pos - floor(pos)), 6) AS failures FROM p JOIN q a ON a.run = p.run AND a.i = floor(pos) JOIN q b ON b.run = p.run AND b.i = ceil(pos)""",
    "extrapolated_failures": T + ", s AS (SELECT run, gen, failures, failures - lag(failures) OVER (PARTITION BY run ORDER BY gen) AS slope, row_number() OVER (PARTITION BY run ORDER BY gen DESC) AS r FROM h) SELECT run, CAST(gen + k AS INTEGER) AS gen, CAST(failures + coalesce(slope, 0) * k AS DOUBLE) AS failures FROM s, range(1, 4) q(k) WHERE r = 1",
    "cumulative_generations": T + "SELECT run, gen, n_eval, failures FROM h",
    "first_critical_generation": T + "SELECT run, min(gen) AS gen, arg_min(f, gen) AS failures FROM g WHERE f > 0 GROUP BY run",
    "equal_parts": T + ", q AS (SELECT *, floor(count(*) OVER (PARTITION BY run) / 7) AS s, row_number() OVER (PARTITION BY run ORDER BY ts, event_id) - 1 AS p FROM t) SELECT run, CAST(floor(p / s) AS BIGINT) AS part, count(*) AS n, count_if(failed) AS failures FROM q WHERE s > 0 AND floor(p / s) < 7 GROUP BY 1, 2",
    "metric_curves": T + "SELECT run % 2 AS algo, gen, round(avg(nullif(f, 0)), 6) AS mean_nonzero, round(avg(f), 6) AS mean, round(stddev_pop(f), 6) AS std, round(stddev_samp(f) / sqrt(count(f)), 6) AS sem FROM g GROUP BY 1, 2",
    "last_failures": T + ", l AS (SELECT run, CAST(arg_max(f, gen) AS DOUBLE) AS v FROM g GROUP BY run) SELECT CAST(floor(run / 2) AS BIGINT) AS pair, max(v) FILTER (run % 2 = 0) AS algo_0, max(v) FILTER (run % 2 = 1) AS algo_1 FROM l GROUP BY 1",
    "run_summary": T + "SELECT run, count(*) AS n, count_if(failed) AS failures, count(DISTINCT (event_type, user_id, gen)) AS n_distinct, count(DISTINCT (event_type, user_id, gen)) FILTER (failed) AS failures_distinct, round(count_if(failed) / count(*), 6) AS ratio, min(gen) FILTER (failed) AS first_gen FROM t GROUP BY run",
    "run_table": T + ", r AS (SELECT run % 2 AS algo, count_if(failed) AS f, count_if(failed) / count(*) AS r FROM t GROUP BY run) SELECT algo, round(avg(f), 6) AS failures_mean, round(coalesce(stddev_samp(f), 0), 6) AS failures_std, round(avg(r), 6) AS ratio_mean, round(coalesce(stddev_samp(r), 0), 6) AS ratio_std FROM r GROUP BY algo",
    "response_times": T + "SELECT event_type, round(avg(value), 6) AS mean, round(max(value), 6) AS most, round(min(value), 6) AS least FROM t GROUP BY event_type",
    "error_checks": T + "SELECT code, count(DISTINCT run) AS runs, count(k) AS times FROM (VALUES (0::BIGINT), (1), (2), (999999)) v(code) LEFT JOIN (SELECT * FROM t WHERE failed) ON k = code GROUP BY code",
    "token_costs": T + ", r(event_type, rate) AS (VALUES ('view', 0.5::DOUBLE), ('click', 1.0), ('purchase', 2.5), ('signup', 1.5)) SELECT event_type, count(*) AS calls, round(sum(value / 1000 * coalesce(rate, 0)), 6) AS cost, round(avg(value), 6) AS mean FROM t LEFT JOIN r USING (event_type) GROUP BY ROLLUP (event_type)",
    "rule_statistics": T
    + """, r AS (SELECT 'positive_value' AS rule, CASE WHEN event_type NOT IN ('purchase', 'click') THEN 'na' WHEN value > 0 THEN 'pass' ELSE 'fail' END AS o FROM t
UNION ALL SELECT 'small_k', CASE WHEN k IS NULL THEN 'na' WHEN k < 50 THEN 'pass' ELSE 'fail' END FROM t
UNION ALL SELECT 'known_type', CASE WHEN event_type IN ('view', 'signup', 'purchase', 'error', 'click') THEN 'pass' ELSE 'fail' END FROM t),
s AS (SELECT rule, count(*) AS checks, count_if(o = 'pass') AS passed, count_if(o = 'fail') AS failed, count_if(o = 'na') AS na FROM r GROUP BY rule)
SELECT *, CASE WHEN passed + failed > 0 THEN printf('%.2f%%', 100 * failed / (passed + failed)) END AS fail_rate FROM s""",
    "rule_pairs": T + "SELECT count(*) AS checks, count_if(b.event_id > a.event_id) AS passed FROM t a JOIN t b ON a.user_id = b.user_id AND a.gen = b.gen AND a.event_type = b.event_type AND a.event_id <> b.event_id WHERE b.ts >= a.ts",
}
