"""Text expressions: counting, cleaning, extraction, similarity and keyed perturbations."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .features import keyed_uniform

#: Currency signs, codes and names.
CURRENCIES = [("$", "USD", "dollars"), ("€", "EUR", "euros"), ("£", "GBP", "pounds"), ("¥", "JPY", "yen"), ("₹", "INR", "rupees")]
FUNCTION_WORDS = ["a", "an", "and", "at", "for", "in", "is", "of", "on", "the", "to", "with"]


def word_count(text: Column) -> Column:
    """Runs of ASCII letters and digits; -1 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0))), F.lit(-1))


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\w\s]", "")


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """Word-set similarity; two texts without words are equal."""
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching characters of the longest-matching-block alignment."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def first_float(text: Column) -> Column:
    """The first number of the whole text, commas between digits taken out; a sign counts only before a number with a point, null without a number."""
    plain = F.regexp_replace(text, r"(?<=\d),(?=\d)", "")
    return F.nullif(F.regexp_extract(plain, r"([-+]?\d*\.\d+|\d+)", 1), F.lit("")).try_cast("double")


def currency(text: Column) -> Column:
    """Code of the first sign in the text; without signs of the first code, without codes of the first name (whole words, names in any case)."""

    def first(pattern: str, known: dict[str, str]) -> Column:
        # looked up in a map, as a chain of comparisons searches the text once for each
        codes = F.create_map(*(F.lit(v) for word, code in known.items() for v in (word.lower(), code)))
        return F.try_element_at(codes, F.lower(F.regexp_extract(text, pattern, 1)))

    # the first letters are looked at before what stands before them
    whole = "(?=[%s])(?<![\\p{L}\\p{N}_])(%s)(?![\\p{L}\\p{N}_])"
    words = lambda some: whole % ("".join(sorted({w[0] for w in some})), "|".join(some))
    signs, codes, names = zip(*CURRENCIES, strict=True)
    return F.coalesce(
        first(f"([{''.join(signs)}])", dict(zip(signs, codes, strict=True))),
        first(words(codes), dict(zip(codes, codes, strict=True))),
        first("(?i)" + words(names), dict(zip(names, codes, strict=True))),
    )


def as_bool(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin("true", "yes", "1", "on"), True).when(low.isin("false", "no", "noo", "0", "off"), False)


def listed(items: Column, last: str = "and") -> Column:
    """'a', 'a and b', 'a, b and c'."""
    n = F.size(items)
    head = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n == 0, "").when(n == 1, items[0]).otherwise(F.concat(head, F.lit(f" {last} "), F.element_at(items, -1)))


def leet(text: Column) -> Column:
    return F.translate(text, "aeioAEIO", "43104310")


def drop_words(text: Column, key: Column, share: float = 0.4) -> Column:
    """Leaves out function words whose keyed hash of (key, place) is under ``share``."""
    kept = F.filter(
        F.transform(F.split(text, " "), lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
        lambda x: ~(F.lower(x["w"]).isin(FUNCTION_WORDS) & (keyed_uniform(key.cast("string"), x["i"].cast("string")) < share)),
    )
    return F.array_join(kept["w"], " ")


def swap_inner(text: Column) -> Column:
    """Swaps the second and third letter of words of more than three."""
    return F.regexp_replace(text, r"(\b\w)(\w)(\w)(?=\w)", "$1$3$2")


def perturbed(text: Column, kind: Column, key: Column) -> Column:
    """Applies the perturbation named by ``kind``; others leave the text alone."""
    return F.when(kind == "leet", leet(text)).when(kind == "delete_words", drop_words(text, key)).when(kind == "swap", swap_inner(text)).otherwise(text)


def filled(text: Column, values: Column) -> Column:
    """Replaces {{name}} by the value of each entry of a map."""
    return F.aggregate(F.map_entries(values), text, lambda t, e: F.replace(t, F.concat(F.lit("{{"), e["key"], F.lit("}}")), e["value"]))


def dialogue_turns(text: Column) -> Column:
    """(user, system) pairs of a 'User: ... System: ...' text."""
    parts = F.filter(F.split(text, r"(?:^|\n)User:\s*"), lambda p: F.trim(p) != "")
    return F.transform(parts, lambda p: F.struct(F.trim(F.split_part(p, F.lit("\nSystem:"), F.lit(1))).alias("user"), F.nullif(F.trim(F.split_part(p, F.lit("\nSystem:"), F.lit(2))), F.lit("")).alias("system")))
