"""Feature decoding: category indexes, ordinal scores in equal bins, maps of named values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def category_label(values: Column, index: Column) -> Column:
    """The label at a 0-based index; null outside of the values."""
    return F.when((index >= 0) & (index < F.size(values)), F.try_element_at(values, index.cast("int") + 1))


def ordinal_label(values: Column, score: Column) -> Column:
    """The label of a score in [0, 1]; 1.0 falls into the last bin."""
    return F.element_at(values, F.least(F.floor(score * F.size(values)), F.size(values) - 1).cast("int") + 1)


def label_index(values: Column, label: Column) -> Column:
    """0-based index of a label; null if unknown."""
    return F.nullif(F.array_position(values, label), F.lit(0)) - 1


def label_score(values: Column, label: Column, jitter: Column) -> Column:
    """A score inside of the label's bin; jitter in [0, 1) says where."""
    return (label_index(values, label) + jitter) / F.size(values)


def bin_index(score: Column, bins: int, low: float = 0.0, high: float = 1.0) -> Column:
    """Equal-width bin of a value, the upper edge in the last bin."""
    return F.least(F.floor((score - low) / (high - low) * bins), F.lit(bins - 1)).cast("long")


def named_values(names: Column, values: Column) -> Column:
    return F.map_from_arrays(names, values)


def keyed_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts: the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def map_changes(before: Column, after: Column) -> Column:
    """Entries of ``after`` that are new or differ, and removed ones as null."""
    merged = F.map_zip_with(before, after, lambda k, x, y: F.struct(x.alias("old"), y.alias("new")))
    return F.transform_values(F.map_filter(merged, lambda k, v: ~v["old"].eqNullSafe(v["new"])), lambda k, v: v["new"])
