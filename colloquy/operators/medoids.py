"""Medoids of rows with scores and choices under a mixed distance, and points far from each other.

The distance of two rows is (Euclidean distance of their scores + number of choices that differ) / number of both. It is no inner
product, so centres must be rows. For each group at most ``sample`` rows (all, if there are no more; else the lowest hashes of their keys) make a
distance matrix, on which medoids are built and swapped until no swap makes the sum of distances less, for each number of
clusters; the number with the best silhouette on that matrix stays, the smaller one of equals. All rows are then given to
their nearest medoid by column expressions, whatever the size of the group.

Cases: null scores count as 0.0 and null choices as a choice of their own; a group of one row has one cluster; ties go to the smaller key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
from pyspark.sql.window import Window

SAMPLE = 256


def mixed_matrix(scores: np.ndarray, choices: np.ndarray) -> np.ndarray:
    """Distances of all pairs; choices are codes."""
    n = len(scores)
    square = np.zeros((n, n))
    for x in scores.T:
        square += (x[:, None] - x) ** 2
    differ = np.zeros((n, n))
    for c in choices.T:
        differ += c[:, None] != c
    return (np.sqrt(square) + differ) / max(scores.shape[1] + choices.shape[1], 1)


def build(d: np.ndarray, k: int) -> list[int]:
    """First the row of the least sum of distances, then those that lessen the sum most."""
    chosen = [int(d.sum(1).argmin())]
    nearest = d[chosen[0]].copy()
    while len(chosen) < k:
        gain = np.maximum(nearest - d, 0).sum(1)
        gain[chosen] = -1
        chosen.append(int(gain.argmax()))
        nearest = np.minimum(nearest, d[chosen[-1]])
    return chosen


def swap(d: np.ndarray, chosen: list[int]) -> list[int]:
    """The best exchange of a medoid and another row, while it lessens the sum of distances."""
    chosen = list(chosen)
    while True:
        cost = d[chosen].min(0).sum()
        best = (cost - 1e-12 * max(cost, 1), -1, -1)
        for i in range(len(chosen)):
            rest = chosen[:i] + chosen[i + 1 :]
            others = d[rest].min(0) if rest else np.full(len(d), np.inf)
            sums = np.minimum(d, others).sum(1)
            sums[chosen] = np.inf
            h = int(sums.argmin())
            if sums[h] < best[0]:
                best = (sums[h], i, h)
        if best[1] < 0:
            return chosen
        chosen[best[1]] = best[2]


def silhouette(d: np.ndarray, label: np.ndarray) -> float:
    """Mean silhouette from each row's sums of distances to the clusters; rows alone in a cluster count 0."""
    k = int(label.max()) + 1
    member = np.eye(k)[label]
    size, sums = member.sum(0), d @ member
    own = size[label]
    inside = sums[np.arange(len(d)), label] / np.maximum(own - 1, 1)
    means = np.where(member > 0, np.inf, sums / np.maximum(size, 1))
    outside = means.min(1)
    larger = np.maximum(inside, outside)
    return float(np.where((own > 1) & (larger > 0), (outside - inside) / np.where(larger > 0, larger, 1), 0.0).mean())


def best_medoids(d: np.ndarray, ks: range) -> tuple[list[int], float | None]:
    """Medoids of the number of clusters with the best silhouette, and that silhouette (null for fewer rows than clusters)."""
    best: tuple[list[int], float | None] = (build(d, 1), None)
    for k in ks:
        if 2 <= k <= len(d):
            found = swap(d, build(d, k))
            label = d[found].argmin(0)
            label[found] = np.arange(k)
            value = silhouette(d, label)
            if best[1] is None or value > best[1]:
                best = (found, value)
    return best


def mixed_distance(scores: tuple[Column, Column], choices: tuple[Column, Column]) -> Column:
    far = F.sqrt(F.aggregate(F.zip_with(*scores, lambda x, y: (F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0))) ** 2), F.lit(0.0), lambda s, x: s + x))
    differ = F.size(F.filter(F.zip_with(*choices, lambda x, y: ~x.eqNullSafe(y)), lambda x: x))
    return (far + differ) / F.greatest(F.size(scores[0]) + F.size(choices[0]), F.lit(1))


def medoids(rows: DataFrame, by: str, key: str, scores: str, choices: str, ks: range = range(2, 9), sample: int = SAMPLE) -> DataFrame:
    """by, silhouette, medoids (array of key, scores, choices), and the mean, largest and mean of the largest distances between medoids.

    scores: array of doubles; choices: array of strings; all of a group are of one length.
    """
    order = Window.partitionBy(by).orderBy(F.xxhash64(key), key)
    some = rows.select(by, key, scores, choices).withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= sample).drop("_place")
    fields = rows.schema
    member = StructType([fields[key], fields[scores], fields[choices]])
    measures = [StructField(c, DoubleType()) for c in ("silhouette", "mean_apart", "most_apart", "mean_most_apart")]
    schema = StructType([fields[by], *measures, StructField("medoids", ArrayType(member))])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(key, ignore_index=True)
        x = np.array([[0.0 if v is None else v for v in r] for r in group[scores]], float).reshape(len(group), -1)
        c = np.array([pd.factorize(pd.Series(col, dtype=object), use_na_sentinel=False)[0] for col in zip(*group[choices], strict=True)], int).T.reshape(len(group), -1)
        d = mixed_matrix(np.nan_to_num(x), c)
        found, value = best_medoids(d, ks)
        found = sorted(found)
        between = d[np.ix_(found, found)]
        pairs = between[np.triu_indices(len(found), 1)]
        chosen = [{key: r[key], scores: list(r[scores]), choices: list(r[choices])} for _, r in group.loc[found].iterrows()]
        apart = (pairs.mean(), pairs.max(), between.max(1).mean()) if len(pairs) else (0.0, 0.0, 0.0)
        return pd.DataFrame([(group[by].iloc[0], value, *apart, chosen)], columns=[by, "silhouette", "mean_apart", "most_apart", "mean_most_apart", "medoids"])

    return some.groupBy(by).applyInPandas(run, schema)


def assigned(rows: DataFrame, found: DataFrame, by: str, scores: str, choices: str) -> DataFrame:
    """``rows`` with ``cluster`` (place of the nearest medoid of their group, the first of equals) and ``distance`` to it."""
    both = rows.join(found.select(by, "medoids"), by)
    each = F.transform("medoids", lambda m: mixed_distance((F.col(scores), m[scores]), (F.col(choices), m[choices])))
    both = both.withColumn("_each", each).withColumn("distance", F.array_min("_each"))
    return both.withColumn("cluster", F.array_position("_each", F.col("distance")).cast("int") - 1).drop("_each", "medoids")


def farthest_points(rows: DataFrame, by: str, key: str, vec: str, n: int) -> DataFrame:
    """by and ``picked``: an array of n (all different ones, if fewer) keys and vectors of each group, far from each other.

    The first is the vector of the smallest key, each next one the farthest from its nearest picked one, ties to the smaller key. Each of
    the n rounds is one aggregate: every task sends its farthest row of a group. What is picked is cut from its lineage each round (``spark.checkpoint.dir``).
    """
    from .lineage import cut

    rows = rows.select(by, key, vec).filter(F.col(key).isNotNull() & F.col(vec).isNotNull())
    row = F.struct(F.col(key), F.col(vec))
    square = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x.cast("double"))
    picked = cut(rows.groupBy(by).agg(F.array(F.min_by(row, key)).alias("picked")))
    for _ in range(1, n):
        near = rows.join(picked, by).withColumn("near", F.array_min(F.transform("picked", lambda p: square(F.col(vec), p[vec]))))
        far = near.filter("near > 0").groupBy(by).agg(F.max_by(row, F.struct(F.col("near"), -F.col(key))).alias("far"))
        picked = cut(picked.join(far, by, "left").select(by, F.when(F.col("far").isNull(), F.col("picked")).otherwise(F.concat("picked", F.array("far"))).alias("picked")))
    return picked
