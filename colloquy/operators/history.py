"""Run histories: running counters, resampling, curves and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def prefix_sums(rows: DataFrame, run: str, order: list[str], values: dict[str, Column], unit: str = "minute") -> DataFrame:
    """Adds, for each of the values, its sum over the run's rows up to this one and (``name_all``) over all of them.

    The first column of ``order`` is a time: rows are sorted within their time unit only, and the sums of the units before are carried
    to them. So a run isn't sorted in one task; per run only one row a unit is. Nulls add nothing.
    """
    slot = F.struct(F.col(run).alias("run"), F.date_trunc(unit, order[0]).alias("unit"))
    rows = rows.withColumn("_slot", slot).withColumns({f"_{n}": F.coalesce(v.cast("long"), F.lit(0)) for n, v in values.items()})
    per = rows.groupBy("_slot").agg(*(F.sum(f"_{n}").alias(n) for n in values))
    whole = Window.partitionBy("_slot.run")
    before = whole.orderBy("_slot.unit").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_slot", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}_before") for n in values), *(F.sum(n).over(whole).alias(f"{n}_all") for n in values))
    so_far = Window.partitionBy("_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(per, "_slot").withColumns({n: F.col(f"_{n}_before") + F.sum(f"_{n}").over(so_far) for n in values})
    return rows.drop("_slot", *(f"_{n}" for n in values), *(f"_{n}_before" for n in values))


def running_counts(rows: DataFrame, run: str, order: list[str], failed: str) -> DataFrame:
    """test_size, failures and critical_ratio after each test of a run; ``order`` starts with a time."""
    rows = prefix_sums(rows, run, order, {"test_size": F.lit(1), "failures": F.col(failed)}).drop("test_size_all", "failures_all")
    return rows.withColumn("critical_ratio", F.col("failures") / F.col("test_size"))


def since_start(rows: DataFrame, run: str, ts: str) -> DataFrame:
    """``rows`` with ``hours`` since the first event of their run."""
    first = rows.groupBy(run).agg(F.min(ts).alias("_first"))
    return rows.join(first, run).withColumn("hours", (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_first").cast("timestamp"))) / 3.6e9).drop("_first")


def resampled(rows: DataFrame, run: str, ts: str, value: str, unit: str = "hour") -> DataFrame:
    """The value at the first event of each time bucket of a run, with buckets in between interpolated in time."""
    first = rows.groupBy(run, F.date_trunc(unit, ts).alias("bucket")).agg(F.min_by(value, F.struct(ts, value)).alias("value"))
    ends = first.groupBy(run).agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    grid = ends.select(run, F.explode(F.expr(f"sequence(a, b, interval 1 {unit})")).alias("bucket"))
    both = grid.join(first, [run, "bucket"], "left")
    known = F.when(F.col("value").isNotNull(), F.struct(F.unix_timestamp("bucket").alias("t"), F.col("value").cast("double").alias("v")))
    order = Window.partitionBy(run).orderBy("bucket")
    both = both.withColumn("p", F.last(known, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("n", F.first(known, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    share = (F.unix_timestamp("bucket") - F.col("p.t")) / F.nullif(F.col("n.t") - F.col("p.t"), F.lit(0))
    return both.select(run, "bucket", F.coalesce("value", F.col("p.v") + (F.col("n.v") - F.col("p.v")) * share).cast("double").alias("value"))


def extrapolated(rows: DataFrame, run: str, step: str, value: str, more: int) -> DataFrame:
    """``more`` further steps of each run along its last slope."""
    last = rows.withColumn("slope", F.col(value) - F.lag(value, 1, None).over(Window.partitionBy(run).orderBy(step)))
    last = last.groupBy(run).agg(F.max_by(F.struct(step, value, "slope"), step).alias("l"))
    k = F.explode(F.sequence(F.lit(1), F.lit(more)))
    out = last.select(run, "l", k.alias("k"))
    return out.select(run, (F.col(f"l.{step}") + F.col("k")).alias(step), (F.col(f"l.{value}") + F.coalesce("l.slope", F.lit(0.0)) * F.col("k")).alias(value))


def cumulative_by_generation(rows: DataFrame, run: str, gen: str, failed: str) -> DataFrame:
    """Tests and failures up to each generation (the archive prefix of each), as running sums of per-generation counts."""
    per = rows.groupBy(run, gen).agg(F.count("*").alias("n"), F.count_if(F.col(failed)).alias("f"))
    so_far = Window.partitionBy(run).orderBy(gen).rowsBetween(Window.unboundedPreceding, 0)
    return per.select(run, gen, F.sum("n").over(so_far).alias("n_eval"), F.sum("f").over(so_far).alias("failures"))


def first_critical(rows: DataFrame, run: str, gen: str, failed: str) -> DataFrame:
    """The first generation of each run with a failure and how many it has."""
    per = rows.filter(F.col(failed)).groupBy(run, gen).agg(F.count("*").alias("n"))
    return per.groupBy(run).agg(F.min(gen).alias(gen), F.min_by("n", gen).alias("failures"))


def equal_parts(rows: DataFrame, run: str, order: list[str], parts: int) -> DataFrame:
    """A pseudo history: each run's tests in ``parts`` equal parts, the remainder left out; ``order`` starts with a time."""
    rows = prefix_sums(rows, run, order, {"_place": F.lit(1)})
    size = F.floor(F.col("_place_all") / parts)
    rows = rows.withColumn("part", F.when(size > 0, F.floor((F.col("_place") - 1) / size))).filter(F.col("part") < parts)
    return rows.drop("_place", "_place_all")


def failures_over_time(counts: DataFrame, run: str, seconds: float, interval: float) -> DataFrame:
    """Failures found at each ``interval`` of a search of ``seconds``, and the share of the budget in percent.

    ``counts`` (running_counts of tests without duplicates) are taken as found at even steps; between two tests the
    number is interpolated, before the first it is that of the first.
    """
    points = F.explode(F.transform(F.sequence(F.lit(0), F.ceil(F.lit(seconds) / interval).cast("int")), lambda i: i * F.lit(float(interval))))
    grid = counts.groupBy(run).agg(F.max("test_size").alias("n")).withColumn("time", points)
    at = F.least(F.greatest(F.col("time") * F.col("n") / seconds, F.lit(1.0)), F.col("n").cast("double"))
    grid = grid.withColumn("at", at).withColumn("test_size", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))))
    found = grid.join(counts.select(run, "test_size", "failures"), [run, "test_size"])
    share = F.when(F.floor("at") == F.ceil("at"), 1.0).when(F.col("test_size") == F.floor("at"), F.ceil("at") - F.col("at")).otherwise(F.col("at") - F.floor("at"))
    return found.groupBy(run, "time").agg((F.max("time") / seconds * 100).alias("budget"), F.sum(F.col("failures") * share).alias("failures"))


def curve(rows: DataFrame, group: str, step: str, value: str) -> DataFrame:
    """Per group and step over runs: mean without zeros, standard error, mean and population deviation."""
    v = F.col(value)
    return rows.groupBy(group, step).agg(
        F.avg(F.nullif(v, F.lit(0).cast("double"))).alias("mean_nonzero"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("sem"),
    )


def last_values(rows: DataFrame, group: str, run: str, step: str, value: str, groups: list) -> DataFrame:
    """The last value of each run, one column a group."""
    last = rows.groupBy(group, run).agg(F.max_by(value, step).alias("v"))
    return last.groupBy(run).pivot(group, groups).agg(F.first("v"))


def finished(tests: DataFrame, state: str, since: str | None = None) -> DataFrame:
    """Tests of finished runs; with ``since`` (a SQL predicate on a run's columns) only of those that it holds for."""
    out = tests.filter(F.col(state) == "finished")
    return out if since is None else out.filter(since)


def relabelled(tests: DataFrame, failed: str, oracle: str) -> DataFrame:
    """The tests with another oracle (a SQL predicate; null is no failure) in place of the stored label."""
    return tests.withColumn(failed, F.coalesce(F.expr(oracle), F.lit(False)))


def algorithm_table(tests: DataFrame, algo: str, run: str, failed: str, same: Column) -> DataFrame:
    """Per algorithm: runs, least, mean and most tests of a run, failures, and failures that differ in ``same`` within a run."""
    runs = tests.groupBy(algo, run).agg(F.count("*").alias("n"), F.count_if(F.col(failed)).alias("f"), F.count_distinct(F.when(F.col(failed), same)).alias("d"))
    return runs.groupBy(algo).agg(
        F.count("*").alias("runs"), F.min("n").alias("min_tests"), F.avg("n").alias("mean_tests"), F.max("n").alias("max_tests"), F.sum("f").alias("failures"), F.sum("d").alias("distinct_failures")
    )


def costs(calls: DataFrame, model: str, read: str, written: str, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """Per model: calls, tokens read and written (a quarter of the characters each), and their cost at prices a million; models without a price cost nothing."""
    tokens = lambda c: F.floor(F.length(F.coalesce(F.col(c), F.lit(""))) / 4)
    per = calls.groupBy(model).agg(F.count("*").alias("calls"), F.sum(tokens(read)).alias("tokens_in"), F.sum(tokens(written)).alias("tokens_out"))
    price = F.create_map(*(x for m, p in prices.items() for x in (F.lit(m), F.array(*map(F.lit, p)))))
    of = lambda i: F.coalesce(F.try_element_at(price, F.col(model))[i], F.lit(0.0))
    return per.withColumn("cost", F.col("tokens_in") / 1e6 * of(0) + F.col("tokens_out") / 1e6 * of(1))
