"""Contents of turns: which fields a user brings up when, what a turn then asks for, and which place a confirmation means.

Contents are maps of field names to values; a null value is a field that isn't asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.functions.features import keyed_uniform

#: The field that every turn has.
ALWAYS = "category"


def asked_fields(content: Column) -> Column:
    """Names of the fields with a value, but for the one that every turn has, in order."""
    return F.array_sort(F.map_keys(F.map_filter(content, lambda k, v: v.isNotNull() & (k != ALWAYS))))


def first_field(content: Column, *key: Column) -> Column:
    """The field that the first turn brings up beside the category: one of those with a value, by the key; null without any."""
    fields = asked_fields(content)
    return F.get(fields, F.floor(keyed_uniform(F.lit("first"), *key) * F.size(fields)).cast("int"))


def next_field(content: Column, used: Column, *key: Column) -> Column:
    """A field with a value that hasn't been brought up yet, by the key; null if all have."""
    left = F.array_except(asked_fields(content), used)
    return F.get(left, F.floor(keyed_uniform(F.lit("next"), *key) * F.size(left)).cast("int"))


def turn_content(content: Column, used: Column, new: Column) -> Column:
    """What a turn asks for: the category (null too), the fields that have been brought up before, and a new one."""
    return F.map_filter(content, lambda k, v: (k == ALWAYS) | (v.isNotNull() & (F.array_contains(used, k) | k.eqNullSafe(new))))


def turn_contents(turns: DataFrame, by: str, order: str, content: str, introduced: str) -> DataFrame:
    """turns with ``used`` (fields brought up before the turn, sorted) and ``turn_content``.

    introduced: the field that the turn brings up, or null; content: the whole content as it is at the turn. A change of the content changes
    the values of fields in use from that turn on.
    """
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.array_sort(F.collect_set(introduced).over(before))
    return turns.withColumn("used", used).withColumn("turn_content", turn_content(F.col(content), F.col("used"), F.col(introduced)))


def requirements(content: Column, new: Column) -> Column:
    """"field: value" lines of a content, in order, the new field's marked."""
    keys = F.array_sort(F.map_keys(F.map_filter(content, lambda k, v: v.isNotNull())))
    line = lambda k: F.concat(k, F.lit(": "), F.try_element_at(content, k), F.when(k.eqNullSafe(new), " (new)").otherwise(""))
    return F.array_join(F.transform(keys, line), "\n")


def confirmed_place(places: Column, selected: Column, confidence: Column) -> Column:
    """The place (of an array of structs with an id) that a confirmation means: the one of the selected id; else, of digits alone, the one at that
    place from 0; the first one for anything else, or if the confidence is low. Null without places."""
    same = F.get(F.filter(places, lambda p: p["id"].cast("string") == selected), F.lit(0))
    index = F.when(selected.rlike("^[0-9]+$"), selected.try_cast("int"))
    found = F.when(F.coalesce(confidence, F.lit("low")) != "low", F.coalesce(same, F.get(places, index)))
    return F.coalesce(found, F.get(places, F.lit(0)))


def selected_tests(tests: DataFrame, mode: str, critical: Column, optimal: Column, feasible: Column | None = None, order: str | None = None, most: int | None = None) -> DataFrame:
    """Tests of a run by mode: all, opt (on the front) or crit (critical), only feasible ones where that is told; the first ``most`` of them by ``order``."""
    modes = {"all": F.lit(True), "opt": optimal, "crit": critical}
    if mode not in modes:
        raise ValueError(f"mode is one of {', '.join(modes)}, not {mode}")
    keep = F.coalesce(modes[mode], F.lit(False)) & (F.lit(True) if feasible is None else F.coalesce(feasible, F.lit(False)))
    rows = tests.filter(keep)
    return rows if most is None else rows.orderBy(order).limit(most)


def extracted_questions(tests: DataFrame, question: str, critical_only: bool, critical: Column, content_fitness: Column) -> DataFrame:
    """Tests with something asked; of critical ones only those whose content fitness is unknown or below 1."""
    rows = tests.withColumn(question, F.trim(F.coalesce(F.col(question), F.lit("")))).filter(F.col(question) != "")
    return rows.filter(F.coalesce(critical, F.lit(False)) & (content_fitness.isNull() | (content_fitness < 1.0))) if critical_only else rows
