"""Scores of tests and the failure predicates on them."""

from __future__ import annotations

from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARE = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__, "==": Column.__eq__, "!=": Column.__ne__}


def weighted_share(scores: dict[str, float], most: float) -> Column:
    """Sum of score x weight over the greatest possible; columns by weight."""
    return reduce(add, (F.col(c) * w for c, w in scores.items())) / (most * sum(scores.values()))


def field_match(want: Column, got: Column, weights: dict[str, float]) -> Column:
    """Weighted share of equal fields of two structs; null wanted fields aren't scored; nothing wanted is 1."""
    asked = reduce(add, (F.when(want[f].isNotNull(), w).otherwise(0.0) for f, w in weights.items()))
    met = reduce(add, (F.when(want[f].isNotNull() & F.coalesce(want[f] == got[f], F.lit(False)), w).otherwise(0.0) for f, w in weights.items()))
    return F.when(asked > 0, met / asked).otherwise(1.0)


def mean_of_known(values: Column) -> Column:
    """Mean of the non-null entries of an array."""
    known = F.filter(values, lambda x: x.isNotNull())
    return F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(known), F.lit(0))


def signed(values: Column, signs: Column) -> Column:
    """Objectives with those to be maximised multiplied by -1."""
    return F.zip_with(values, signs, lambda x, s: x * s)


def threshold(score: Column, op: str, bound: float) -> Column:
    """Compares the absolute score; op is one of < <= > >= == !=."""
    return COMPARE[op](F.abs(score), F.lit(bound))


def merged(tests: list[Column], how: str = "any") -> Column:
    return reduce(or_ if how == "any" else and_, tests)


def logit_share(yes: Column, no: Column) -> Column:
    return 1 / (1 + F.exp(no - yes))


def critical_conversation(dimensions: Column, efficiency: Column, effectiveness: Column, bounds: tuple[float, float, float] = (0.65, 0.7, 0.75)) -> Column:
    """Whether any of the three scores is below its bound."""
    return merged([threshold(c, "<", b) for c, b in zip((dimensions, efficiency, effectiveness), bounds, strict=True)])


def recounted(
    rows: DataFrame, by: str, asked: Column, critical: Column, scores: tuple[Column, Column, Column], content: float | None = 0.75, efficiency: float | None = 0.65, response: float | None = 0.65, only_response: bool = False
) -> DataFrame:
    """by, tests, failures, real_tests and real_failures: only conversations in which something is asked are real, and a critical one fails again under these bounds.

    scores: of dimensions, efficiency, effectiveness; a score fails at its bound or below (dimensions at ``response``, effectiveness at ``content``), a null
    one doesn't. Without any bound a dimensions score that is null or below 1 fails. only_response: the dimensions score alone decides.
    """
    dimensions, efficient, effective = scores
    at_most = lambda score, bound: F.coalesce(score <= bound, F.lit(False))
    below_one = dimensions.isNull() | (dimensions < 1.0)
    if only_response:
        fails = below_one if response is None else at_most(dimensions, response)
    elif content is None and efficiency is None and response is None:
        fails = below_one
    else:
        tests = [F.lit(False)]
        if content is not None and response is not None:
            tests += [at_most(dimensions, response), at_most(effective, content)]
        if efficiency is not None:
            tests.append(at_most(efficient, efficiency))
        fails = merged(tests)
    real, bad = F.coalesce(asked, F.lit(False)), F.coalesce(critical, F.lit(False))
    return rows.groupBy(by).agg(F.count("*").alias("tests"), F.count_if(bad).alias("failures"), F.count_if(real).alias("real_tests"), F.count_if(real & bad & fails).alias("real_failures"))


def without_duplicates(counts: DataFrame, summary: DataFrame, by: str) -> DataFrame:
    """Real counts less what the summary of a run (n_all, n_all_distinct, n_critical, n_critical_distinct; null: none) tells of duplicates."""
    both = counts.join(summary, by, "left")
    less = lambda a, b: F.coalesce(F.col(a) - F.col(b), F.lit(0))
    return both.select(*counts.columns[:-2], (F.col("real_tests") - less("n_all", "n_all_distinct")).alias("real_tests"), (F.col("real_failures") - less("n_critical", "n_critical_distinct")).alias("real_failures"))
