"""Effect sizes, ranks and tests between groups."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window


def average_ranks(values: DataFrame, by: list[str], value: str, n: str) -> DataFrame:
    """Rank from 1 (``rank``), with ties sharing their mean, of the distinct values of each group, of which there are ``n`` each."""
    below = F.sum(n).over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    return values.withColumn("rank", F.coalesce(below, F.lit(0)) + (F.col(n) + 1) / 2)


def effect_class(size: Column, bounds: tuple[float, float, float]) -> Column:
    small, medium, large = bounds
    return F.when(size < small, "negligible").when(size < medium, "small").when(size < large, "medium").otherwise("large")


def group_moments(rows: DataFrame, group: str, value: str) -> DataFrame:
    return rows.groupBy(F.col(group).alias("g")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))


def group_pairs(moments: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Pairs g < h of the (few) rows of a per-group table; columns of the second have the suffix _h."""
    right = moments.select(*(F.col(c).alias(f"{c}_h") for c in moments.columns))
    return moments.join(F.broadcast(right), F.col("g") < F.col("g_h"))


def cohens_d(rows: DataFrame, group: str, value: str) -> DataFrame:
    """g, g_h, d (absolute, pooled sample variance) and its class."""
    pooled = ((F.col("n") - 1) * F.col("var") + (F.col("n_h") - 1) * F.col("var_h")) / (F.col("n") + F.col("n_h") - 2)
    d = F.abs(F.col("mean") - F.col("mean_h")) / F.sqrt(pooled)
    return group_pairs(group_moments(rows, group, value)).select("g", "g_h", d.alias("d"), effect_class(d, (0.2, 0.5, 0.8)).alias("effect"))


def a12(rows: DataFrame, group: str, value: str) -> DataFrame:
    """g, g_h, a: chance that a value of g is above one of g_h (half for ties), from counts of distinct values.

    For each pair of groups the values below are a running sum over the values, so no pairs of rows are made.
    """
    values = rows.groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    groups = values.select("g").distinct()
    pairs = groups.join(F.broadcast(groups.withColumnRenamed("g", "g_h")), F.col("g") < F.col("g_h"))
    left = values.join(F.broadcast(pairs), "g").select("g", "g_h", "v", F.col("n").alias("x"), F.lit(0).alias("y"))
    right = values.withColumnRenamed("g", "g_h").join(F.broadcast(pairs), "g_h").select("g", "g_h", "v", F.lit(0).alias("x"), F.col("n").alias("y"))
    both = left.unionByName(right).groupBy("g", "g_h", "v").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    below = F.coalesce(F.sum("y").over(Window.partitionBy("g", "g_h").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = both.withColumn("won", F.col("x") * (below + F.col("y") / 2)).groupBy("g", "g_h").agg((F.sum("won") / (F.sum("x") * F.sum("y"))).alias("a"))
    return out.select("g", "g_h", "a", effect_class(2 * F.abs(F.col("a") - 0.5), (0.147, 0.33, 0.474)).alias("effect"))


def signed_rank(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Wilcoxon signed-rank of columns x and y in each group: n, w (lesser rank sum), z and two-sided p by the normal approximation with ties."""
    d = pairs.withColumn("d", F.col("x") - F.col("y")).filter("d <> 0")
    # ranks are those of distinct sizes, so that no group's rows are sorted in one task
    sizes = d.groupBy(*by, F.abs("d").alias("size")).agg(F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("up"))
    t = F.col("t")
    out = average_ranks(sizes, by, "size", "t").groupBy(*by).agg(
        F.sum("t").alias("n"),
        F.sum(F.col("rank") * F.col("up")).alias("plus"),
        F.sum(F.col("rank") * (t - F.col("up"))).alias("minus"),
        F.sum(t.cast("double") * (t.cast("double") * t - 1)).alias("ties"),
    )
    # as double: the third power of two million is no long any more
    n, w = F.col("n").cast("double"), F.least("plus", "minus")
    z = (w - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return two_sided(out.select(*by, "n", w.alias("w"), z.alias("z")))


@F.pandas_udf(DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if v is None or math.isnan(v) else math.erfc(abs(v) / math.sqrt(2)))


def two_sided(rows: DataFrame) -> DataFrame:
    return rows.withColumn("p", normal_tail("z"))


def roc_auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """One row: chance that a row of label 1 scores above one of label 0."""
    return a12(rows.select(score, (-F.col(label)).alias("k")), "k", score).select(F.col("a").alias("auc"))
