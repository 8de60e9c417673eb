"""Curves of several algorithms on one grid, and distances of all pairs by blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

BLOCK = 512


def on_grid(rows: DataFrame, run: str, n: str, value: str, step: int, until: int) -> DataFrame:
    """run, n and value of each run at n = step, 2 step, ... up to ``until``: the last value at or before it (null before the first one).

    Points of the grid are sorted among the values, so nothing is paired; of values at one n the largest counts.
    """
    known = rows.select(run, F.col(n).cast("long").alias("n"), F.struct(F.col(value).cast("double").alias("v")).alias("mark"), F.lit(False).alias("point"))
    grid = rows.select(run).distinct().select(run, F.explode(F.sequence(*(F.lit(x).cast("long") for x in (step, until, step)))).alias("n"), F.lit(None).cast("struct<v:double>").alias("mark"), F.lit(True).alias("point"))
    order = Window.partitionBy(run).orderBy("n", "point", "mark").rowsBetween(Window.unboundedPreceding, 0)
    both = known.unionByName(grid).withColumn("value", F.last("mark", ignorenulls=True).over(order)["v"])
    return both.filter("point").select(run, "n", "value")


def comparison_curves(rows: DataFrame, algorithm: str, run: str, n: str, value: str, step: int, until: int) -> DataFrame:
    """algorithm, n, runs, mean and sigma (of all runs of the algorithm with a value) on one grid."""
    of = rows.select(run, algorithm).distinct()
    curves = on_grid(rows, run, n, value, step, until).join(of, run)
    return curves.groupBy(algorithm, "n").agg(F.count("value").alias("runs"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sigma"))


def pair_distances(rows: DataFrame, by: str, key: str, vec: str, block: int = BLOCK) -> DataFrame:
    """by, n, mean_distance and mean_largest: means over all rows of a group of their mean and largest Euclidean distance to all rows of it, themselves included.

    Rows are packed in blocks of about ``block``; each pair of blocks of a group is a matrix in one task, of which only a sum and a
    maximum for each row leave. The work is that of all pairs, as every row's largest distance needs it. Keys are unique in a group; null vectors are left out.
    """
    rows = rows.select(by, F.col(key).cast("long").alias("key"), F.col(vec).cast("array<double>").alias("vec")).filter(F.col("vec").isNotNull() & F.col("key").isNotNull())
    n = rows.groupBy(by).agg(F.count("*").alias("n"))
    dealt = rows.join(n, by).withColumn("block", F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / block)).cast("int"))
    kind = rows.schema[by]
    # sorted by key, as a group's rows come in any order
    packed = dealt.groupBy(by, "block").agg(F.sort_array(F.collect_list(F.struct("key", "vec"))).alias("rows"))
    one = packed.select(by, F.col("block").alias("a"), F.col("rows").alias("left"))
    two = packed.select(F.col(by).alias("_by"), F.col("block").alias("b"), F.col("rows").alias("right"))
    pairs = one.join(two, F.col(by).eqNullSafe(F.col("_by")) & (F.col("a") <= F.col("b"))).select(by, "a", "b", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                own, a, b, left, right = (row.column(c)[0].as_py() for c in (by, "a", "b", "left", "right"))
                x, y = (np.array([r["vec"] for r in side], float) for side in (left, right))
                d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T, 0))
                if a == b:
                    np.fill_diagonal(d, 0)
                sides = [(left, d.sum(1), d.max(1))] + ([] if a == b else [(right, d.sum(0), d.max(0))])
                for side, sums, most in sides:
                    yield pa.RecordBatch.from_arrays([pa.array([own] * len(side), row.schema.field(by).type), pa.array([r["key"] for r in side], pa.int64()), pa.array(sums), pa.array(most)], [by, "key", "sum", "most"])

    each = pairs.mapInArrow(run, StructType([kind, *StructType.fromDDL("key long, sum double, most double").fields]))
    whole = each.groupBy(by, "key").agg(F.sum("sum").alias("sum"), F.max("most").alias("most"))
    return whole.groupBy(by).agg(F.count("*").alias("n"), (F.sum("sum") / (F.count("*") * F.count("*"))).alias("mean_distance"), F.avg("most").alias("mean_largest"))
