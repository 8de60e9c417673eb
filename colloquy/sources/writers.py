"""Writers of result tables; every one is a distributed write of a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tests_json(tests: DataFrame, path: str, critical_only: bool = False) -> None:
    """Nested test rows as JSON lines."""
    (tests.filter("is_critical") if critical_only else tests).write.mode("overwrite").json(path)


def compact_json(turns: DataFrame, path: str) -> None:
    """conv_id and a map T1, T2, ... of (question, answer, intent)."""
    entry = F.struct(F.concat(F.lit("T"), F.col("turn_idx") + 1).alias("key"), F.struct("question", "answer", "intent").alias("value"))
    rows = turns.groupBy("conv_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("turn_idx", entry.alias("e"))))["e"]).alias("turns"))
    rows.write.mode("overwrite").json(path)


def fitness_csv(tests: DataFrame, path: str, by_generation: bool = False) -> None:
    """A row a test with one Fitness_ column for each name in the map f (a handful, read from the data)."""
    names = sorted(r[0] for r in tests.select(F.explode(F.map_keys("f"))).distinct().collect())
    columns = [c for c in tests.columns if c not in ("f", "is_critical")]
    rows = tests.select(*columns, *(F.col("f")[n].alias(f"Fitness_{n}") for n in names), F.col("is_critical").cast("int").alias("Critical"))
    writer = rows.write.mode("overwrite").option("header", True)
    (writer.partitionBy("gen") if by_generation else writer).csv(path)


def summary_csv(row: DataFrame, path: str) -> None:
    """One row as Attribute, Value pairs."""
    pairs = F.array(*(F.struct(F.lit(c).alias("Attribute"), F.col(c).cast("string").alias("Value")) for c in row.columns))
    row.select(F.inline(pairs)).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def latex_table(table: DataFrame) -> str:
    """A small aggregate as a LaTeX tabular; over 1,000 rows are an error, not a shorter table."""
    rows = table.limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("a LaTeX table is for aggregates of at most 1,000 rows")
    lines = [" & ".join(table.columns), *(" & ".join("" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v) for v in r) for r in rows)]
    return "\\begin{tabular}{" + "l" * len(table.columns) + "}\n" + " \\\\\n".join(lines) + " \\\\\n\\end{tabular}\n"


def without_nan(rows: DataFrame) -> DataFrame:
    """NaN and infinite doubles as null, for JSON."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return rows.withColumns({c: F.when(~bad(c), F.col(c)) for c, t in rows.dtypes if t in ("double", "float")})


def comparison_csv(curves: DataFrame, path: str, algorithm: str, metric: str) -> None:
    """Curves of a handful of algorithms side by side: <name>_n_evals, <name>_<metric> and <name>_<metric>_sigma of each, a row a point of the grid."""
    names = sorted(r[0] for r in curves.select(algorithm).distinct().collect())
    wide = curves.groupBy("n").pivot(algorithm, names).agg(F.first("mean").alias("mean"), F.first("sigma").alias("sigma"))
    columns = [c for a in names for c in (F.col("n").alias(f"{a}_n_evals"), F.col(f"`{a}_mean`").alias(f"{a}_{metric}"), F.col(f"`{a}_sigma`").alias(f"{a}_{metric}_sigma"))]
    wide.orderBy("n").select(*columns).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def rule_csv(statistics: DataFrame, path: str) -> None:
    """rule, checks, pass, fail, not_applicable and fail_rate of each rule (a row a rule)."""
    names = {"passed": "pass", "failed": "fail", "na": "not_applicable"}
    rows = statistics.withColumnsRenamed(names).select("rule", "checks", "pass", "fail", "not_applicable", "fail_rate")
    rows.orderBy("rule").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def judge_report(scores: DataFrame, items: DataFrame, path: str, metadata: dict[str, str]) -> None:
    """A report folder: the judged items as JSON lines (results), the aggregate rows (metrics) and what describes the run (metadata)."""
    items.write.mode("overwrite").json(f"{path}/results")
    scores.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
    described = F.create_map(*(F.lit(x) for kv in sorted(metadata.items()) for x in kv)) if metadata else F.create_map().cast("map<string,string>")
    scores.sparkSession.range(1).select(described.alias("metadata")).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def round_trip(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` with the struct column ``value`` written as JSON and read again by its own type."""
    return rows.withColumn(value, F.from_json(F.to_json(value), rows.schema[value].dataType))
