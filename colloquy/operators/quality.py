"""Pareto fronts, indicators and diversity of result sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from colloquy.functions import features


def pareto_front(rows: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Rows that no row of their group beats (both minimised): a sorted sweep instead of pairs. Equal rows stay."""
    before = Window.partitionBy(by).orderBy(x, y).rowsBetween(Window.unboundedPreceding, -1)
    best = F.min(F.struct(F.col(y).alias("y"), F.col(x).alias("x"))).over(before)
    beaten = (best["y"] < F.col(y)) | ((best["y"] == F.col(y)) & (best["x"] < F.col(x)))
    return rows.withColumn("beaten", F.coalesce(beaten, F.lit(False))).filter("not beaten").drop("beaten")


#: Points of a group that are compared in one matrix.
MATRIX = 512


def _fronts(points: np.ndarray) -> np.ndarray:
    """Front number of each point: those that no point left beats go, front by front."""
    out, left, front = np.zeros(len(points), np.int64), np.arange(len(points)), 0
    while len(left):
        p = points[left]
        if len(p) <= MATRIX:
            lost = ((p[:, None] <= p).all(2) & (p[:, None] < p).any(2)).any(0)
        else:
            lost = np.array([((p <= q).all(1) & (p < q).any(1)).any() for q in p])
        out[left[~lost]] = front
        left, front = left[lost], front + 1
    return out


def front_ranks(rows: DataFrame, by: str, objectives: list[str]) -> DataFrame:
    """Front number (0 is the best) of each row within its group, any number of objectives; groups are generations of bounded size.

    Groups are read in batches of many; of each batch the last group waits for the rows that the next one may hold.
    """

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ranked(table: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
            points = np.stack([table.column(o).to_numpy().astype(float) for o in objectives], 1)
            fronts = [_fronts(points[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield from table.append_column("front", pa.array(np.concatenate(fronts), pa.int64())).to_batches()

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            if not table.num_rows:
                continue
            codes = table.column(by).combine_chunks().dictionary_encode("encode").indices.to_numpy()
            cuts = np.append(0, np.flatnonzero(codes[1:] != codes[:-1]) + 1)
            held = table.slice(cuts[-1])
            if len(cuts) > 1:
                yield from ranked(table.slice(0, cuts[-1]), cuts)
        if held is not None and held.num_rows:
            yield from ranked(held, np.array([0, held.num_rows]))

    return rows.repartition(by).sortWithinPartitions(by).mapInArrow(rank, StructType([*rows.schema.fields, StructField("front", LongType())]))


def hypervolume(front: DataFrame, by: str, x: str, y: str, ref: tuple[float, float]) -> DataFrame:
    """Area between a 2-D front and the reference point."""
    points = front.filter((F.col(x) < ref[0]) & (F.col(y) < ref[1])).select(by, x, y).distinct()
    step = F.coalesce(F.lead(x).over(Window.partitionBy(by).orderBy(x)), F.lit(ref[0])) - F.col(x)
    return points.withColumn("area", step * (ref[1] - F.col(y))).groupBy(by).agg(F.sum("area").alias("hypervolume"))


def distances_to(rows: DataFrame, by: str, x: str, y: str, reference: list[tuple[float, float]]) -> DataFrame:
    """Generational distance (mean over rows of the distance to the nearest reference point) and its inverse, for a short reference list."""
    d = [F.sqrt(F.pow(F.col(x) - a, 2) + F.pow(F.col(y) - b, 2)) for a, b in reference]
    nearest = F.least(*d) if len(d) > 1 else d[0]
    least = [F.min(c) for c in d]
    return rows.groupBy(by).agg(F.avg(nearest).alias("gd"), (sum(least[1:], least[0]) / len(d)).alias("igd"))


def survivors(rows: DataFrame, by: str, key: str, objectives: list[str], n: int) -> DataFrame:
    """The first n rows of each generation by front, then larger crowding within it, then key; with front, crowding and place."""
    ranked = crowding(front_ranks(rows, by, objectives), [by, "front"], objectives, key)
    order = Window.partitionBy(by).orderBy("front", F.desc("crowding"), key)
    return ranked.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def spacing(front: DataFrame, by: str, key: str, x: str, y: str) -> DataFrame:
    """n and the deviation of the distances (by sums of gaps) of a front's points to the nearest other one; rows are the distinct points of a front.

    On a front y falls as x grows, so the nearest point is a neighbour by x.
    """
    order = Window.partitionBy(by).orderBy(x, F.desc(y), key)
    gap = F.abs(F.col(x) - F.lag(x).over(order)) + F.abs(F.col(y) - F.lag(y).over(order))
    rows = front.withColumn("_before", gap)
    rows = rows.withColumn("_d", F.least("_before", F.lead("_before").over(order)))
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.coalesce(F.stddev_pop("_d"), F.lit(0.0)).alias("spacing"))


def crowding(rows: DataFrame, by: str | list[str], objectives: list[str], *ties: str) -> DataFrame:
    """Crowding distance in each front: neighbour gaps over the range, infinite at the ends. ``ties`` order equal points."""
    by = [by] if isinstance(by, str) else by
    total = F.lit(0.0)
    for f in objectives:
        order, whole = Window.partitionBy(*by).orderBy(f, *objectives, *ties), Window.partitionBy(*by)
        gap = (F.lead(f).over(order) - F.lag(f).over(order)) / F.nullif(F.max(f).over(whole) - F.min(f).over(whole), F.lit(0.0))
        end = F.lag(f).over(order).isNull() | F.lead(f).over(order).isNull()
        rows = rows.withColumn(f"_{f}", F.when(end, float("inf")).otherwise(F.coalesce(gap, F.lit(0.0))))
        total = total + F.col(f"_{f}")
    return rows.withColumn("crowding", total / len(objectives)).drop(*(f"_{f}" for f in objectives))


def spread(front: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """n, Deb's spread of the distances between neighbours on a front (the outermost ones count as those to its ends), and ``spread_ref``: the
    same with signed deviations and each objective sorted by itself, which literal comparisons need. Both are 1 with fewer than three points."""
    rows = front.withColumn("i", F.row_number().over(Window.partitionBy(by).orderBy(x, y))).withColumn("j", F.row_number().over(Window.partitionBy(by).orderBy(y, x)))
    cut = rows.select(by, F.col("j").alias("i"), F.col(y).alias("cut"))
    order, whole = Window.partitionBy(by).orderBy("i"), Window.partitionBy(by)
    gap = lambda c: F.sqrt(F.pow(F.lead(x).over(order) - F.col(x), 2) + F.pow(F.lead(c).over(order) - F.col(c), 2))
    rows = rows.join(cut, [by, "i"]).withColumn("d", gap(y)).withColumn("e", gap("cut")).withColumn("n", F.count("*").over(whole))
    rows = rows.withColumns({"md": F.avg("d").over(whole), "me": F.avg("e").over(whole)})
    outer, inner = F.col("i").isin(1) | (F.col("i") == F.col("n") - 1), (F.col("i") > 1) & (F.col("i") < F.col("n") - 1)

    def delta(d: str, mean: str, off: Column) -> Column:
        ends = F.sum(F.when(outer, F.col(d)))
        value = (ends + F.sum(F.when(inner, off).otherwise(0.0))) / (ends + (F.count("*") - 1) * F.max(mean))
        return F.when(F.count("*") < 3, 1.0).otherwise(value)

    return rows.groupBy(by).agg(F.count("*").alias("n"), delta("d", "md", F.abs(F.col("d") - F.col("md"))).alias("spread"), delta("e", "me", F.col("e") - F.col("me")).alias("spread_ref"))


def cluster_gini(rows: DataFrame, by: str, cluster: str) -> DataFrame:
    """Gini coefficient of the cluster sizes of each group, from their order: no pairs of clusters are made."""
    sizes = rows.groupBy(by, cluster).agg(F.count("*").alias("n"))
    placed = sizes.withColumn("i", F.row_number().over(Window.partitionBy(by).orderBy("n", cluster)))
    k = F.count("*")
    return placed.groupBy(by).agg((2 * F.sum(F.col("i") * F.col("n")) / (k * F.sum("n")) - (k + 1) / k).alias("gini"))


def grid_cells(rows: DataFrame, by: str, columns: dict[str, tuple[float, float]], bins: int = 10) -> DataFrame:
    """Distinct grid cells hit in each group; bounds by column."""
    cell = F.struct(*(features.bin_index(F.col(c), bins, *b).alias(c) for c, b in columns.items()))
    return rows.groupBy(by).agg(F.count_distinct(cell).alias("cells"))


def heat_map(rows: DataFrame, x: Column, y: Column, failed: Column, bins: int = 5) -> DataFrame:
    return rows.groupBy(features.bin_index(x, bins).alias("i"), features.bin_index(y, bins).alias("j")).agg(F.count("*").alias("total"), F.count_if(failed).alias("failures"))


def coverage_entropy(rows: DataFrame, by: str, cluster: str) -> DataFrame:
    """Coverage (% of all clusters hit) and entropy (% of log2 of their number) of each group."""
    k = rows.agg(F.count_distinct(cluster).alias("k"))
    n = rows.groupBy(by, cluster).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(by))
    out = n.withColumn("h", -p * F.log2(p)).groupBy(by).agg(F.count("*").alias("hit"), F.sum("h").alias("h"))
    return out.join(F.broadcast(k)).select(by, (100 * F.col("hit") / F.col("k")).alias("coverage"), F.when(F.col("k") > 1, 100 * F.col("h") / F.log2("k")).otherwise(0.0).alias("entropy"))


def mean_dissimilarity(vectors: DataFrame, by: str, vec: str) -> DataFrame:
    """Mean of (1 - cosine) / 2 over all pairs of a group, from the sum of unit vectors: |sum|^2 = n + 2 sum of cosines; -1 for fewer than two."""
    from colloquy.functions.vector import norm

    unit = vectors.withColumn("size", norm(F.col(vec))).filter("size > 0").select(by, F.posexplode(F.col(vec)).alias("i", "x"), "size")
    sums = unit.groupBy(by, "i").agg(F.sum(F.col("x").cast("double") / F.col("size")).alias("s"), F.count("*").alias("n"))
    whole = sums.groupBy(by).agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n"))
    n = F.col("n")
    return whole.select(by, F.when(n > 1, (1 - (F.col("q") - n) / (n * (n - 1))) / 2).otherwise(-1.0).alias("dissimilarity"))


def novelty_archive(rows: DataFrame, by: str, order: str, vec: str, threshold: float) -> DataFrame:
    """Keeps, in order, each row farther than ``threshold`` from every row kept before it: a fold over sorted batches, of which only the group's kept vectors are held."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, kept, n = None, np.zeros((0, 0)), 0
        for batch in batches:
            stay = []
            for i, (g, v) in enumerate(zip(batch.column(by).to_pylist(), batch.column(vec).to_pylist(), strict=True)):
                p = np.array(v, float)
                if not n or not (g == group or (g != g and group != group)):
                    group, kept, n = g, np.zeros((16, len(p))), 0
                if not n or np.sqrt(((kept[:n] - p) ** 2).sum(1)).min() > threshold:
                    if n == len(kept):
                        kept = np.concatenate((kept, np.zeros_like(kept)))
                    kept[n], n = p, n + 1
                    stay.append(i)
            yield batch.take(pa.array(stay, pa.int64()))

    return rows.repartition(by).sortWithinPartitions(by, F.asc_nulls_last(order)).mapInArrow(fold, rows.schema)


