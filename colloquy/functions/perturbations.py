"""Keyed perturbations of texts by characters and words, as column expressions: the same key gives the same text in every engine.

Each draw is the md5 of (key, kind, place). Word kinds take words between white space and join them with one blank, as character kinds
keep every character they don't change. Null texts stay null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .features import keyed_uniform

#: Words that word deletion takes out (fixed values): articles, pronouns, prepositions; as written or with a capital.
ARTICLES = "a an the"
PRONOUNS = """
i me my mine myself you your yours yourself yourselves he him his himself she her hers herself it its itself we us our ours ourselves they them their theirs themselves
this that these those who whom whose which what all another any anybody anyone anything both each either everybody everyone everything few many neither nobody none nothing
one other others several some somebody someone something
"""
PREPOSITIONS = """
about above across after against along amid among amongst around as at before behind below beneath beside besides between beyond by concerning considering despite down during
except following for from given in including inside into like minus near notwithstanding of off on onto opposite out outside over past per plus regarding round save since than
through throughout till to toward towards under underneath unlike until up upon versus via with within without
"""
DELETED = [*ARTICLES.split(), *PRONOUNS.split(), *PREPOSITIONS.split()]
#: Letters that leet turns into digits (fixed values).
LEET = {"a": "4", "e": "3", "i": "1", "o": "0"}
#: Probabilities of the kinds (fixed values).
SHARES = {
    "introduce_typos": 0.1, "delete_characters": 0.1, "add_characters": 0.1, "add_spaces": 0.3,
    "swap_characters": 0.2, "shuffle_characters": 0.2, "to_leet": 0.2, "delete_words": 0.4,
}

Draw = Callable[..., Column]


def _draws(kind: str, key: Column) -> Draw:
    return lambda *places: keyed_uniform(key.cast("string"), F.lit(kind), *(p.cast("string") for p in places))


def _letter(u: Column) -> Column:
    return F.char(F.lit(97) + F.floor(u * 26))


def _characters(text: Column, change: Callable[[Column, Column], Column]) -> Column:
    """Each character as change(character, place) of it."""
    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), change), "")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _inner(word: Column, place: Column, draw: Draw, share: float, change: Callable[[Column], Column]) -> Column:
    """A word of more than three characters with its inner ones changed, by a draw."""
    inner = F.split(F.substr(word, F.lit(2), F.length(word) - 2), "")
    changed = F.concat(F.left(word, F.lit(1)), F.array_join(change(F.filter(inner, lambda c: c != "")), ""), F.right(word, F.lit(1)))
    return F.when((F.length(word) > 3) & (draw(place) <= share), changed).otherwise(word)


def introduce_typos(text: Column, key: Column, share: float = SHARES["introduce_typos"]) -> Column:
    draw = _draws("introduce_typos", key)
    return _characters(text, lambda c, i: F.when(draw(i) < share, _letter(draw(i, F.lit("letter")))).otherwise(c))


def delete_characters(text: Column, key: Column, share: float = SHARES["delete_characters"]) -> Column:
    draw = _draws("delete_characters", key)
    return _characters(text, lambda c, i: F.when(draw(i) < share, "").otherwise(c))


def add_characters(text: Column, key: Column, share: float = SHARES["add_characters"]) -> Column:
    draw = _draws("add_characters", key)
    return _characters(text, lambda c, i: F.when(draw(i) < share, F.concat(_letter(draw(i, F.lit("letter"))), c)).otherwise(c))


def add_spaces(text: Column, key: Column, share: float = SHARES["add_spaces"]) -> Column:
    draw = _draws("add_spaces", key)
    return _characters(text, lambda c, i: F.when(draw(i) < share, F.concat(F.lit(" "), c)).otherwise(c))


def swap_characters(text: Column, key: Column, share: float = SHARES["swap_characters"]) -> Column:
    """Two different inner characters change places."""
    draw = _draws("swap_characters", key)

    def swapped(word: Column, i: Column) -> Column:
        def change(inner: Column) -> Column:
            n = F.size(inner)
            a = F.floor(draw(i, F.lit("one")) * n).cast("int")
            b = F.pmod(a + 1 + F.floor(draw(i, F.lit("two")) * (n - 1)).cast("int"), n)
            return F.transform(inner, lambda c, j: F.when(j == a, F.get(inner, b)).when(j == b, F.get(inner, a)).otherwise(c))

        return _inner(word, i, draw, share, change)

    return F.array_join(F.transform(_words(text), swapped), " ")


def shuffle_characters(text: Column, key: Column, share: float = SHARES["shuffle_characters"]) -> Column:
    """The inner characters stand in a drawn order."""
    draw = _draws("shuffle_characters", key)

    def shuffled(word: Column, i: Column) -> Column:
        drawn = lambda inner: F.transform(F.array_sort(F.transform(inner, lambda c, j: F.struct(draw(i, j).alias("u"), j.alias("j"), c.alias("c")))), lambda x: x["c"])
        return _inner(word, i, draw, share, drawn)

    return F.array_join(F.transform(_words(text), shuffled), " ")


def to_leet(text: Column, key: Column, share: float = SHARES["to_leet"]) -> Column:
    draw = _draws("to_leet", key)
    letters = "".join(LEET) + "".join(LEET).upper()
    return F.array_join(F.transform(_words(text), lambda w, i: F.when(draw(i) < share, F.translate(w, letters, "".join(LEET.values()) * 2)).otherwise(w)), " ")


def delete_words(text: Column, key: Column, share: float = SHARES["delete_words"]) -> Column:
    draw = _draws("delete_words", key)
    known = [*DELETED, *(w.capitalize() for w in DELETED)]
    placed = F.transform(_words(text), lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    return F.array_join(F.filter(placed, lambda x: ~(x["w"].isin(known) & (draw(x["i"]) <= share)))["w"], " ")


KINDS = {f.__name__: f for f in (introduce_typos, delete_characters, add_characters, add_spaces, swap_characters, shuffle_characters, to_leet, delete_words)}


def perturbed(text: Column, word_kind: Column, char_kind: Column, key: Column) -> Column:
    """A text perturbed by a word kind and then by a character kind; unknown and null kinds leave it alone."""

    def one(text: Column, kind: Column) -> Column:
        out = text
        for name, change in KINDS.items():
            out = F.when(kind == name, change(text, key)).otherwise(out)
        return out

    return one(one(text, word_kind), char_kind)
