"""Variables of test profiles: values by number, orders of dependence, and rows that cover all combinations.

Values: the n-th combination of lists is worked out from n alone, as the digits of a number of mixed radix, so no join grows with
the product. Dependence: each variable may depend on one other; pointers double in each round, so a chain of d variables takes
about log2(d) joins, and what has not ended after as many steps as there are variables runs into a cycle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .lineage import cut


def nth_combination(n: Column, lists: list[Column]) -> Column:
    """Array of one value of each list (arrays of one type): the n-th (from 0, then anew) combination, of which the last list turns fastest."""
    out, rest = [], n.cast("long")
    for values in reversed(lists):
        size = F.nullif(F.size(values).cast("long"), F.lit(0))
        out.append(F.get(values, F.pmod(rest, size).cast("int")))
        rest = F.floor(rest / size)
    return F.array(*reversed(out))


def nth_without_repeats(n: Column, values: Column, *key: Column) -> Column:
    """The n-th (from 0) draw of a list that repeats no value until all have been drawn, then starts in another order, by the key."""
    size = F.nullif(F.size(values).cast("long"), F.lit(0))
    turn = F.floor(n / size)
    drawn = F.transform(values, lambda v, i: F.struct(F.md5(F.concat_ws(":", *key, turn, i).cast("binary")).alias("h"), i.alias("i"), v.alias("v")))
    return F.get(F.array_sort(drawn), F.pmod(n, size).cast("int"))["v"]


def nth_sample(n: Column, values: Column, count: Column, *key: Column) -> Column:
    """The n-th (from 0) draw of ``count`` (all, if there are fewer) different values of a list, in drawn order."""
    drawn = F.transform(values, lambda v, i: F.struct(F.md5(F.concat_ws(":", *key, n, i).cast("binary")).alias("h"), i.alias("i"), v.alias("v")))
    return F.slice(F.transform(F.array_sort(drawn), lambda d: d["v"]), 1, F.least(count, F.size(values)))


def dependency_levels(variables: DataFrame, name: str, master: str) -> DataFrame:
    """name, level (how many variables it depends on, one after the other), root (the last of them), cycle (no, member, behind).

    A name stands once; a null name is left out; a master that is no variable is a root. Variables of a cycle, or that depend on
    one, have no level and no root.
    """
    rows = variables.select(F.col(name).alias("name"), F.col(master).alias("to")).filter("name is not null").dropDuplicates(["name"])
    missing = rows.select(F.col("to").alias("name")).filter("name is not null").distinct().join(rows.select("name"), "name", "left_anti")
    state = cut(rows.unionByName(missing.withColumn("to", F.lit(None).cast(rows.schema["to"].dataType))).withColumn("steps", F.col("to").isNotNull().cast("long")))
    state = state.withColumn("root", F.when(F.col("to").isNull(), F.col("name")))
    n, far = state.count(), 1
    while not (open_ := state.filter("to is not null")).isEmpty() and far <= n:
        # each pointer goes on to where its target's points; those that have come to an end stay
        ahead = state.select(F.col("name").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"), F.col("root").alias("end"))
        moved = open_.drop("root").join(ahead, "to").select("name", F.col("next").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), F.col("end").alias("root"))
        state, far = cut(state.filter("to is null").unionByName(moved)), 2 * far
    # after so many steps each open pointer is in its cycle, and each member of a cycle is the end of one
    members = state.filter("to is not null").select(F.col("to").alias("name")).distinct().withColumn("cycle", F.lit("member"))
    found = state.join(members, "name", "left").join(rows.select("name"), "name", "left_semi")
    level = F.when(F.col("to").isNull(), F.col("steps"))
    return found.select("name", level.alias("level"), "root", F.when(F.col("to").isNull(), "no").otherwise(F.coalesce("cycle", F.lit("behind"))).alias("cycle"))


def covering_rows(sizes: list[int], strength: int, seed: int = 0, tries: int = 8) -> list[tuple[int, ...]]:
    """Rows of value indexes in which each ``strength`` features show all combinations of their values.

    Each new row is the best of ``tries`` keyed ones: it starts from the feature values with most open combinations, and takes, feature by
    feature in a keyed order, the value that closes most of them.
    """
    strength = min(strength, len(sizes))
    if not strength:
        return [tuple(0 for _ in sizes)] if all(sizes) else []
    random = np.random.Generator(np.random.PCG64(seed))
    missing = {c: np.ones([sizes[f] for f in c], bool) for c in combinations(range(len(sizes)), strength)}
    left = sum(m.sum() for m in missing.values())
    rows = []

    def gains(feature: int, row: dict[int, int]) -> np.ndarray:
        """How many open combinations each value of a feature closes, with those of its features that have none yet counted at 1 / 1,000,000."""
        total = np.zeros(sizes[feature])
        for c, open_ in missing.items():
            if feature in c:
                at = tuple(slice(None) if f == feature or f not in row else row[f] for f in c)
                rest = open_[at]
                free = [f for f in c if f == feature or f not in row]
                count = np.moveaxis(rest, free.index(feature), 0).reshape(sizes[feature], -1).sum(1)
                total += count if len(free) == 1 else count * 1e-6
        return total

    def closed(row: dict[int, int]) -> int:
        return sum(int(m[tuple(row[f] for f in c)]) for c, m in missing.items())

    while left:
        best: tuple[int, dict[int, int]] = (-1, {})
        for _ in range(tries):
            row: dict[int, int] = {}
            first = max(missing, key=lambda c: (missing[c].sum(), random.random()))
            for feature in [*first, *(int(f) for f in random.permutation(len(sizes)) if f not in first)]:
                g = gains(feature, row)
                top = np.flatnonzero(g == g.max())
                row[feature] = int(top[random.integers(len(top))])
            best = max(best, (closed(row), row), key=lambda x: x[0])
        if best[0] < 1:
            # an open combination as it is, so that each row closes one
            c = next(c for c, m in missing.items() if m.any())
            best[1].update(zip(c, map(int, np.argwhere(missing[c])[0]), strict=True))
        left -= closed(best[1])
        for c, m in missing.items():
            m[tuple(best[1][f] for f in c)] = False
        rows.append(tuple(best[1][f] for f in range(len(sizes))))
    return rows


def least_strength(sizes: list[int], n: int, seed: int = 0) -> int:
    """The least strength whose rows are more than n; the number of features if none has as many. Strengths that must give more aren't tried."""
    for t in range(1, len(sizes)):
        if np.prod(sorted(sizes)[-t:], dtype=float) > n or len(covering_rows(sizes, t, seed)) > n:
            return t
    return max(1, len(sizes))


def covering_sample(domains: DataFrame, by: str, feature: str, values: str, n: int | None = None, strength: int | None = None, seed: int = 0) -> DataFrame:
    """by, row, features, choice: for each group of features (a bounded list each) rows of values that cover all combinations of ``strength`` features.

    n: how many rows; each covering row is taken as often as needed, and keyed ones of them once less (without ``strength``: the least one that
    has more than n). Groups are worked out side by side.
    """
    kind = domains.schema[values].dataType
    out = StructType([domains.schema[by], StructField("row", IntegerType()), StructField("features", ArrayType(StringType())), StructField("choice", kind)])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(feature, ignore_index=True)
        lists = [list(v) for v in group[values]]
        sizes = [len(v) for v in lists]
        t = strength or least_strength(sizes, n or 1, seed)
        rows = covering_rows(sizes, t, seed)
        if n is not None and rows:
            rows = list(spread(rows, n, seed))
        names = list(group[feature])
        return pd.DataFrame({by: [group[by].iloc[0]] * len(rows), "row": range(len(rows)), "features": [names] * len(rows), "choice": [[v[i] for v, i in zip(lists, r, strict=True)] for r in rows]})

    return domains.groupBy(by).applyInPandas(run, out)


def spread(rows: list[tuple[int, ...]], n: int, seed: int) -> Iterator[tuple[int, ...]]:
    """n rows: each as often, keyed ones once more."""
    order = np.random.Generator(np.random.PCG64(seed)).permutation(len(rows))
    for turn in range(-(-n // len(rows))):
        for i in order[: n - turn * len(rows)]:
            yield rows[i]
