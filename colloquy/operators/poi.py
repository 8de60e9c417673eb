"""Points of interest: structured filters, existence and opening hours."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from colloquy.functions import vector

FIELDS = ("category", "price_level", "rating", "parking", "radius_km", "now")


def open_now(start: Column, end: Column, now: Column) -> Column:
    """Whether 'HH:mm' strings enclose the time; unknown hours are closed."""
    return F.coalesce((start <= now) & (now <= end), F.lit(False))


def price_level(price: Column, bounds: tuple[float, ...]) -> Column:
    """$ to $$$$ by ascending bounds."""
    out = F.lit("$" * (len(bounds) + 1))
    for i in range(len(bounds) - 1, -1, -1):
        out = F.when(price < bounds[i], "$" * (i + 1)).otherwise(out)
    return out


def open_on(hours: Column, day: Column, now: Column) -> Column:
    """Whether a map of weekdays to 'HH:mm-HH:mm' has the time; days without hours, or with others, are closed."""
    ends = F.split(F.try_element_at(hours, day), "-")
    return F.coalesce((F.size(ends) == 2) & (ends[0] <= now) & (now <= ends[1]), F.lit(False))


def alike(wanted: Column, vec: Column, least: float = 0.8) -> Column:
    """Category test by the cosine of two embeddings."""
    return vector.cosine(wanted, vec) >= least


def matches(want: Column, fields: tuple[str, ...] = FIELDS) -> Column:
    """Conjunction of the constraints in the struct ``want`` on the given fields; a null or empty constraint is met by all.

    Rows have category, name, price_level, rating, lat, lng, parking, opens, closes, or (for the field day) hours by weekday.
    """
    near = lambda: vector.haversine_km(F.col("lat"), F.col("lng"), want["lat"], want["lng"]) <= want["radius_km"]
    text = F.lower(F.concat_ws(" ", "category", "name"))
    tests = {
        "category": lambda: F.contains(text, F.lower(want["category"])),
        "name": lambda: F.contains(F.lower("name"), F.lower(want["name"])),
        "cuisine": lambda: F.contains(text, F.lower(want["cuisine"])),
        "price_level": lambda: F.col("price_level") == want["price_level"],
        "rating": lambda: F.col("rating") >= want["rating"],
        "parking": lambda: F.col("parking") == want["parking"],
        "radius_km": near,
        "now": lambda: open_now(F.col("opens"), F.col("closes"), want["now"]),
        "day": lambda: open_on(F.col("hours"), want["day"], want["now"]),
    }
    given = (want[f].isNull() | (want[f].cast("string") == "") | F.coalesce(tests[f](), F.lit(False)) for f in fields)
    return reduce(and_, given)


def counted(pois: DataFrame, wants: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """want_id, n: how many points match each of a few wants."""
    # every want meets every point, as each may match; only counts leave the join
    n = pois.join(F.broadcast(wants), matches(F.col("want"), fields)).groupBy("want_id").agg(F.count("*").alias("n"))
    return wants.select("want_id").join(n, "want_id", "left").na.fill(0, ["n"])


def existence(pois: DataFrame, wants: DataFrame, k: int = 5) -> DataFrame:
    """For each of a few wants (want_id, want): how many points match, and the k best rated (unrated ones last, least id of equals).

    Points meet the wants once; each task sends on a count and at most k points of a want.
    """
    found = pois.join(F.broadcast(wants), matches(F.col("want"))).select("want_id", F.coalesce(F.col("rating").cast("double"), F.lit(float("-inf"))).alias("rating"), "id")
    key, number = wants.schema["want_id"], pois.schema["id"]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            table = pa.Table.from_batches([batch]).sort_by([("want_id", "ascending"), ("rating", "descending"), ("id", "ascending")])
            wanted = table.column("want_id").to_numpy()
            cuts = [*np.flatnonzero(np.append(True, wanted[1:] != wanted[:-1])).tolist(), len(wanted)] if len(wanted) else []
            for a, b in zip(cuts[:-1], cuts[1:]):
                n, top = held.get(wanted[a], (0, []))
                rows = table.slice(a, min(k, b - a))
                top = sorted([*top, *zip(rows.column("rating").to_pylist(), rows.column("id").to_pylist())], key=lambda r: (-r[0], r[1]))[:k]
                held[wanted[a]] = (n + b - a, top)
        for want, (n, top) in held.items():
            columns = ([want] * len(top), [n] + [0] * (len(top) - 1), *map(list, zip(*top)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field("want_id").type, pa.int64(), pa.float64(), batch.schema.field("id").type), strict=True)], ["want_id", "n", "rating", "id"])

    parts = found.mapInArrow(best, StructType([key, StructField("n", LongType()), StructField("rating", DoubleType()), number]))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("rating")).alias("r"), F.col("id"))))
    merged = parts.groupBy("want_id").agg(F.sum("n").alias("n"), F.slice(ordered, 1, k)["id"].alias("ids"))
    out = wants.select("want_id").join(merged, "want_id", "left")
    return out.select("want_id", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) > 0).alias("poi_exists"), F.coalesce(F.array_join(F.transform("ids", lambda x: x.cast("string")), ","), F.lit("")).alias("ids"))
