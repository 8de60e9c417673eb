"""Values of test variables as their specifications give them: lists, ranges, dates; and typed values of what was said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.features import keyed_uniform

DAY = "dd/MM/yyyy"
#: Days of a step of a date range (fixed values).
STEP_DAYS = {"day": 1, "month": 30, "year": 365}


def listed_items(items: Column, answers: Column) -> Column:
    """Items of a list without its any(...) entries, and at the end what was answered for these."""
    plain = F.filter(items, lambda x: ~F.contains(x, F.lit("any(")))
    return F.when(F.size(plain) < F.size(items), F.concat(plain, F.coalesce(answers, F.array().cast("array<string>")))).otherwise(plain)


def spec_values(kind: Column, items: Column, low: Column, high: Column, step: Column, points: Column) -> Column:
    """Struct of values (array of strings; numbers as they are written) and error (null if there is none) of a variable.

    kind: string, int or float. items: a list, or null for a range from ``low`` to ``high``: whole numbers from low on below high, or with a
    ``step`` also high itself; floats with a ``step`` and high, or ``points`` even ones. Errors: empty, type (an item or bound is no such
    number), step (a float range has none), format (neither list nor range), kind.
    """
    listed = items.isNotNull()
    whole = lambda x: x.isNull() | (x == F.floor(x))
    bad_item = F.when(kind == "int", F.exists(items, lambda x: x.isNull() | ~x.rlike(r"^[+-]?[0-9]+$"))).when(kind == "float", F.exists(items, lambda x: x.try_cast("double").isNull())).otherwise(F.exists(items, lambda x: x.isNull()))
    error = (
        F.when(~F.coalesce(kind.isin("string", "int", "float"), F.lit(False)), "kind")
        .when(listed & bad_item, "type")
        .when(listed & (F.size(items) == 0), "empty")
        .when(~listed & ((kind == "string") | low.isNull() | high.isNull()), "format")
        .when(~listed & (kind == "int") & ~(whole(low) & whole(high) & whole(step)), "type")
        .when(~listed & (kind == "float") & step.isNull() & points.isNull(), "step")
        .when(~listed & (step <= 0), "step")
    )
    # how many values are below the upper end
    n = F.greatest(F.ceil((high - low) / F.coalesce(step, F.lit(1.0))), F.lit(0))
    below = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0))), lambda i: low + i * F.coalesce(step, F.lit(1.0)))).otherwise(F.array().cast("array<double>"))
    stepped = F.when(step.isNotNull(), F.concat(below, F.array(high))).otherwise(below)
    even = F.when(points == 1, F.array(low)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(points - 1, F.lit(0))), lambda i: low + i * ((high - low) / (points - 1))))
    number = lambda x: F.when(kind == "int", x.cast("long").cast("string")).otherwise(x.cast("string"))
    ranged = F.transform(F.when((kind == "float") & step.isNull(), even).otherwise(stepped), number)
    return F.struct(F.when(error.isNull(), F.when(listed, items).otherwise(ranged)).alias("values"), error.alias("error"))


def date_range(start: Column, end: Column, kind: Column, step: Column, *key: Column) -> Column:
    """Dates as dd/MM/yyyy. kind day, month (30 days) or year (365 days): from start on by ``step`` of these, until the first one at or after the end;
    linspace: ``step`` even times from start to end; random: ``step`` keyed days from start to end. Null for other kinds, or a step below 1."""
    days = F.datediff(end, start)
    by = step * F.when(kind == "day", STEP_DAYS["day"]).when(kind == "month", STEP_DAYS["month"]).when(kind == "year", STEP_DAYS["year"])
    text = lambda d: F.date_format(d, DAY)
    upto = lambda n: F.sequence(F.lit(0), F.greatest(n.cast("int"), F.lit(0)))
    stepped = F.transform(upto(F.ceil(days / by)), lambda i: text(F.date_add(start, (i * by).cast("int"))))
    even = F.transform(upto(step - 1), lambda i: text(F.date_add(start, F.floor(i * F.when(step > 1, days / (step - 1)).otherwise(0.0)).cast("int"))))
    drawn = F.transform(upto(step - 1), lambda i: text(F.date_add(start, F.floor(keyed_uniform(F.lit("date"), *key, i.cast("string")) * (days + 1)).cast("int"))))
    out = F.when(kind.isin(*STEP_DAYS), stepped).when(kind == "linspace", even).when(kind == "random", drawn)
    return F.when(step >= 1, out)


#: Forms of times and dates that are read (fixed values), tried in this order; slashes have the month first.
TIMES = ["H:mm:ss", "H:mm", "h:mm a", "h a", "h:mma", "ha"]
DATES = ["yyyy-MM-dd", "yyyy/MM/dd", "M/d/yyyy", "d.M.yyyy", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy"]


def typed(text: Column, kind: Column) -> Column:
    """A value of what was said, as text, by its kind: int, float, bool (anything but an empty text is true), time (HH:mm:ss), date (yyyy-MM-dd); other
    kinds, and what can't be read, stay as they are. Null and "null" stay."""
    plain = F.trim(text)
    read = lambda forms: F.coalesce(*(F.try_to_timestamp(F.upper(plain) if "a" in f else plain, F.lit(f)) for f in forms))
    number = F.when(plain.rlike(r"^[+-]?[0-9]+$"), plain.try_cast("long").cast("string"))
    value = (
        F.when(kind == "int", number)
        .when(kind == "float", F.when(plain.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), plain.try_cast("double").cast("string")))
        .when(kind == "bool", F.when(text != "", "True").otherwise("False"))
        .when(kind == "time", F.date_format(read(TIMES), "HH:mm:ss"))
        .when(kind == "date", F.date_format(read(DATES), "yyyy-MM-dd"))
    )
    return F.when(text.isNull() | (text == "null"), text).otherwise(F.coalesce(value, text))
