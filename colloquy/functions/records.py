"""Columns on semi-structured records: flattening, JSON in free text, slots, ordered levels and weighted picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .features import keyed_uniform

#: How a log writes a value that was never given (fixed value).
NOT_GIVEN = "None"
#: Weight of a choice without one of its own (fixed value).
DEFAULT_WEIGHT = 0.5


def flattened(rows: DataFrame, *structs: str) -> DataFrame:
    """Leaves of nested struct columns as columns named by their path, joined by underscores; other columns stay."""

    def leaves(path: list[str], kind) -> list[Column]:
        if isinstance(kind, StructType):
            return [c for f in kind.fields for c in leaves([*path, f.name], f.dataType)]
        return [F.col(".".join(f"`{p}`" for p in path)).alias("_".join(path))]

    return rows.select(*(c for f in rows.schema.fields for c in (leaves([f.name], f.dataType) if f.name in structs else [F.col(f"`{f.name}`")])))


def json_object(text: Column) -> Column:
    """What stands between the first { and the last } of a text, if it is JSON; else null."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(found).isNotNull(), F.nullif(found, F.lit("")))


def json_list(text: Column) -> Column:
    """What stands between the first [ and the last ] of a text, if it is JSON; else null."""
    found = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    return F.when(F.try_parse_json(found).isNotNull(), F.nullif(found, F.lit("")))


def missing_slots(slots: Column) -> Column:
    """Sorted names of a map's slots whose value is null or was never given."""
    return F.array_sort(F.map_keys(F.map_filter(slots, lambda k, v: v.isNull() | (v == NOT_GIVEN))))


def all_collected(slots: Column) -> Column:
    return F.size(missing_slots(slots)) == 0


def next_lower(value: Column, levels: Column) -> Column:
    """The greatest of the levels (an array) below the value; null at the lowest."""
    return F.array_max(F.filter(levels, lambda x: x < value))


def is_lowest(value: Column, levels: Column) -> Column:
    return value <= F.array_min(levels)


def weighted_pick(choices: Column, weights: Column, *key: Column) -> Column:
    """One of the choices (an array; null if empty) by a keyed draw, in proportion to their weights (a map; others have DEFAULT_WEIGHT)."""
    w = F.transform(choices, lambda c: F.coalesce(F.try_element_at(weights, c), F.lit(DEFAULT_WEIGHT)).cast("double"))
    total = F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    bound = keyed_uniform(*key) * total
    upto = F.transform(w, lambda _, i: F.aggregate(F.slice(w, 1, i + 1), F.lit(0.0), lambda a, x: a + x))
    at = F.aggregate(upto, F.lit(1), lambda a, x: a + F.when(x <= bound, 1).otherwise(0))
    return F.when(F.size(choices) > 0, F.try_element_at(choices, F.least(at, F.size(choices))))


def ideal_and_nadir(rows: DataFrame, by: str, objectives: list[str]) -> DataFrame:
    """The best and the worst value of each objective (to minimise) in each group."""
    return rows.groupBy(by).agg(*(f(c).alias(f"{n}_{c}") for c in objectives for n, f in (("ideal", F.min), ("nadir", F.max))))
