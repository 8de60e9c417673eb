"""Variation of scores and choices by keyed draws: crossover and mutation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .features import keyed_uniform


def _stretch(u: Column, room: Column, eta: float) -> Column:
    """Spread factor of simulated binary crossover for a draw u, where ``room`` is the free space over the parents' distance."""
    alpha = 2 - F.pow(1 + 2 * room, F.lit(-(eta + 1)))
    return F.when(u <= 1 / alpha, F.pow(u * alpha, F.lit(1 / (eta + 1)))).otherwise(F.pow(1 / (2 - u * alpha), F.lit(1 / (eta + 1))))


def crossed(a: Column, b: Column, u: Column, eta: float, low: float = 0.0, high: float = 1.0) -> tuple[Column, Column]:
    """Simulated binary crossover within bounds: the lesser and the greater child; equal parents stay."""
    least, most = F.least(a, b), F.greatest(a, b)
    # parents that are equal (or one of them unknown) have no gap
    gap = F.nullif(most - least, F.lit(0.0))
    child = lambda sign, room: F.least(F.greatest((least + most + sign * _stretch(u, room / gap, eta) * gap) / 2, F.lit(low)), F.lit(high))
    return F.when(gap.isNull(), a).otherwise(child(-1, least - low)), F.when(gap.isNull(), b).otherwise(child(1, high - most))


def mutated(x: Column, u: Column, eta: float, low: float = 0.0, high: float = 1.0) -> Column:
    """Polynomial mutation within bounds."""
    span, power = high - low, F.lit(eta + 1)
    down = F.pow(2 * u + (1 - 2 * u) * F.pow(1 - (x - low) / span, power), F.lit(1 / (eta + 1))) - 1
    up = 1 - F.pow(2 * (1 - u) + 2 * (u - 0.5) * F.pow(1 - (high - x) / span, power), F.lit(1 / (eta + 1)))
    return F.least(F.greatest(x + F.when(u <= 0.5, down).otherwise(up) * span, F.lit(low)), F.lit(high))


def choice_mutated(index: Column, values: int, features: int, u: Column, v: Column) -> Column:
    """Another index of ``values``, by the draw v, where u says so: with probability 1 / features, at most 0.5."""
    return F.when(u < min(0.5, 1 / features), F.floor(v * values).cast("int")).otherwise(index)


def utterance_distance(question: Column, answer: Column, scores: tuple[Column, Column], choices: tuple[Column, Column]) -> Column:
    """Struct of distances of two utterances: of their questions and answers by cosine (null, of no text, counts as 0), of their score arrays
    (Euclidean over their number), of their choice arrays (share that differs), and the last two added up over the number of all entries."""
    apart = lambda c: (1 - F.coalesce(c, F.lit(0.0))) / 2
    per = lambda total, n: total / F.greatest(n, F.lit(1))
    n, k = F.size(scores[0]), F.size(choices[0])
    far = F.sqrt(F.aggregate(F.zip_with(*scores, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    differ = F.size(F.filter(F.zip_with(*choices, lambda x, y: ~x.eqNullSafe(y)), lambda d: d))
    return F.struct(apart(question).alias("question"), apart(answer).alias("answer"), per(far, n).alias("ordinal"), per(differ, k).alias("categorical"), per(far + differ, n + k).alias("combined"))


def resampled(current: Column, allowed: Column, *key: Column) -> Column:
    """Another choice (array of indexes) of the allowed ones of each feature (array of arrays) that differs from the current one wherever any may.

    Each feature draws from its allowed indexes; if all drew what they had, a keyed one of those that have others takes one of these. So a
    feature to keep has its index alone as allowed, and one that must not rise those up to it. A feature without allowed indexes keeps its own.
    """
    at = lambda name, values, *more: F.get(values, F.floor(keyed_uniform(F.lit(name), *key, *more) * F.size(values)).cast("int"))
    drawn = F.transform(current, lambda c, i: F.coalesce(at("draw", F.get(allowed, i), i.cast("string")), c))
    others = F.transform(current, lambda c, i: F.filter(F.get(allowed, i), lambda a: a != c))
    free = F.filter(F.transform(others, lambda o, i: F.when(F.size(o) > 0, i)), lambda i: i.isNotNull())
    one = at("pick", free)
    moved = F.transform(drawn, lambda d, i: F.when(i == one, at("other", F.get(others, i))).otherwise(d))
    return F.when((drawn == current) & (F.size(free) > 0), moved).otherwise(drawn)
