"""Duplicates by rounded keys, by tolerances and by turn-wise similarity."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import vector

from .fronts import points_of, runs

#: Width of the strips in which rows meet, in bounds.
STRIP = 4
#: Groups of at most so many rows are worked out together.
FEW = 16


def keep_first(rows: DataFrame, keys: list[Column], order: str) -> DataFrame:
    """The row of the least ``order`` of each set of rows with equal keys."""
    keyed = rows.select("*", *(k.alias(f"_k{i}") for i, k in enumerate(keys)))
    first = keyed.groupBy(*(f"_k{i}" for i in range(len(keys)))).agg(F.min_by(F.struct(*rows.columns), order).alias("row"))
    return first.select("row.*")


def near_links(rows: DataFrame, same: list[str], key: str, within: dict[str, float]) -> DataFrame:
    """key and first of all pairs of rows with first < key, the same ``same`` values, and every column of ``within`` nearer than its bound.

    Only rows of the same strips, four bounds wide, meet; a row that is within a bound of the strip below stands in that one too, so few rows are sent
    twice. Rows with a null, NaN or infinity in these columns are near none.
    """
    bounds = [b for b in within.values() if b <= 0]
    if bounds:
        raise ValueError("bounds are above 0")
    for c in within:
        rows = rows.filter(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")))
    strip = lambda x, bound: F.floor(x / (STRIP * bound))
    cells = {f"_c{i}": c for i, c in enumerate(within)}
    right = rows.select(*same, key, *within)
    for n, c in cells.items():
        # a little more than the bound, for rounding
        right = right.withColumn(n, F.explode(F.sequence(strip(F.col(c) - within[c] * 1.001, within[c]), strip(F.col(c), within[c]))))
    # the same columns on both sides, so that rows are sent once
    left = right.select(*same, F.col(key).alias("first"), *(F.col(c).alias(f"{c}_a") for c in within), *cells)
    near = F.col("first") < F.col(key)
    for n, c in cells.items():
        a, b = F.col(f"{c}_a"), F.col(c)
        # of the strips in which a pair meets, the one of its lesser value counts
        near = near & (F.abs(a - b) < within[c]) & (F.col(n) == strip(F.least(a, b), within[c]))
    return right.join(left, [*same, *cells]).filter(near).select(key, "first")


def near_pairs(rows: DataFrame, same: list[str], key: str, within: dict[str, float]) -> DataFrame:
    """key and first: the least earlier row with the same ``same`` values and every column of ``within`` nearer than its bound."""
    return near_links(rows, same, key, within).groupBy(key).agg(F.min("first").alias("first"))


def keep_apart(rows: DataFrame, same: list[str], key: str, within: dict[str, float]) -> DataFrame:
    """``rows`` (of different keys) taken in order of ``key``: one goes only if an earlier row that stays is near it (see ``near_links``).

    The rows of equal ``same`` come in order and in batches to one task, which holds the kept rows of the last group only, by cells as wide as the bounds.
    Without ``same`` in rounds: a row whose earlier near rows have all gone stays, one with an earlier near row that stays goes. Each round settles the
    least open row of every chain, so there are as many rounds as the longest chain of near rows has links, and links of settled rows leave.
    """
    if same:
        if any(b <= 0 for b in within.values()):
            raise ValueError("bounds are above 0")
        return rows.repartition(*same).sortWithinPartitions(*same, key).mapInArrow(lambda batches: kept_apart(batches, same, key, within), rows.schema)
    from .lineage import cut

    links = cut(near_links(rows, same, key, within))
    gone = None
    while not links.isEmpty():
        open_ = links.select(F.col(key).alias("first")).distinct()
        # rows that nothing before them can remove
        sure = links.join(open_, "first", "left_anti").select("first").distinct()
        lost = cut(links.join(sure, "first", "left_semi").select(key).distinct())
        gone = lost if gone is None else cut(gone.unionByName(lost))
        # what is settled removes nothing any more: links of lost rows in either place, and those of rows that stay
        left = links.join(lost, key, "left_anti").join(lost.withColumnRenamed(key, "first"), "first", "left_anti")
        links = cut(left.select(key, "first"))
    return rows if gone is None else rows.join(gone, key, "left_anti")


def kept_apart(batches: Iterator[pa.RecordBatch], same: list[str], key: str, within: dict[str, float]) -> Iterator[pa.RecordBatch]:
    """What ``keep_apart`` keeps of rows that come by ``same``, then ``key``: small groups of a batch are worked out together, place by place."""
    bounds = np.array(list(within.values()))
    around = list(product((0, -1, 1), repeat=len(bounds)))
    group, cells = None, {}
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        points = points_of(table, list(within))
        # what equals nothing or comes before nothing is near none
        for c in (*same, key):
            points[table.column(c).is_null().to_numpy()] = np.nan
        points[~np.isfinite(points).all(1)] = np.nan
        cuts = runs(table, same)
        sizes, stay = np.diff(cuts), np.ones(len(points), bool)
        # the first group may have begun before, the last may go on
        alone = sizes > FEW
        alone[[0, -1]] = True
        for k in np.flatnonzero(alone):
            name = repr([table.column(c)[cuts[k]].as_py() for c in same])
            if name != group:
                group, cells = name, {}
            for i in range(cuts[k], cuts[k + 1]):
                p = points[i]
                if p[0] != p[0]:
                    continue
                at = tuple(np.floor(p / (bounds * 1.001)).tolist())
                met = [q for move in around for q in cells.get(tuple(map(add, at, move)), ())]
                stay[i] = not met or not (np.abs(np.array(met) - p) < bounds).all(1).any()
                if stay[i]:
                    cells.setdefault(at, []).append(p)
        starts, sizes = cuts[:-1][~alone], sizes[~alone]
        for place in range(1, sizes.max(initial=1)):
            own = starts[sizes > place] + place
            for back in range(1, place + 1):
                stay[own] &= ~(stay[own - back] & (np.abs(points[own] - points[own - back]) < bounds).all(1))
        yield batch.filter(pa.array(stay))


def turnwise_equal(a: DataFrame, b: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Pairs (pair) of conversations with equally many turns whose vectors (pair, turn_idx, vec) all have a cosine over the threshold."""
    both = a.select("pair", "turn_idx", F.col("vec").alias("x")).join(b.select("pair", "turn_idx", F.col("vec").alias("y")), ["pair", "turn_idx"], "full")
    return both.groupBy("pair").agg(F.coalesce(F.bool_and(F.coalesce(vector.cosine(F.col("x"), F.col("y")) > threshold, F.lit(False))), F.lit(False)).alias("equal"))
