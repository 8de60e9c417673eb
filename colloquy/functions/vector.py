"""Vector expressions over ARRAY columns (cast to double before arithmetic)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def mse(a: Column, b: Column) -> Column:
    return squared_distance(a, b) / F.least(F.size(a), F.size(b))


def mae(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))) / F.least(F.size(a), F.size(b))


def scaled_distance(a: Column, b: Column, low: Column, high: Column) -> Column:
    """Euclidean distance after scaling each dimension to its bounds, divided by the root of their number."""
    unit = F.zip_with(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.zip_with(high, low, lambda x, y: x - y), lambda d, r: d / r)
    return norm(unit) / F.sqrt(F.size(a))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of 6371.0088 km."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.sqrt(F.least(F.lit(1.0), h)))
