"""Contents of requests and answers: outputs from records, and scores of an output against what was asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from .features import keyed_uniform

#: Kinds of food, words of payment methods, and which fields each system of a car has.
FOODS = ["german", "indian", "italian", "middle_eastern", "french", "chinese", "japanese", "thai", "mexican", "greek", "vietnamese", "turkish", "american"]
PAYMENT_WORDS = {"CASH": ["cash"], "DEBIT": ["debit"], "CREDIT_CARD_MASTER": ["master"], "CREDIT_CARD_VISA": ["visa"], "CONTACTLESS": ["contactless"], "MOBILE_PAYMENT": ["mobile", "phone"]}
CAR_FIELDS = {
    "windows": ["position", "window_state_target"],
    "fog_lights": ["fog_light_position", "onoff_state_target"],
    "ambient_lights": ["onoff_state_target"],
    "head_lights": ["head_lights_mode_target"],
    "reading_lights": ["position", "onoff_state_target"],
    "climate": ["climate_temperature_value_target", "onoff_state_target"],
    "fan": ["onoff_state_target"],
    "seat_heating": ["seat_position", "seat_heating_level_target"],
}
#: Which fields a request to a car's system may have, and which states, each with a value to reach (_target) and one before (_initial) (fixed values).
REQUEST_FIELDS = {
    "windows": (["position"], ["window_state"]),
    "fog_lights": (["fog_light_position"], ["onoff_state"]),
    "ambient_lights": ([], ["onoff_state"]),
    "head_lights": ([], ["onoff_state", "head_lights_mode"]),
    "fan": ([], ["onoff_state"]),
    "reading_lights": (["position"], ["onoff_state"]),
    "climate": ([], ["onoff_state", "climate_temperature_value"]),
    "seat_heating": (["seat_position"], ["onoff_state", "seat_heating_level"]),
}
#: Weights of a car's fields (fixed values): its system, and any other field.
SYSTEM_WEIGHT, FIELD_WEIGHT = 0.5, 0.2
#: What a rating that is one lower than asked for is divided by (fixed value).
RATING_SPAN = 1.5
#: A car's state as JSON.
CAR_STATE = "lights map<string,string>, windows map<string,string>, seat_heating map<string,string>, climate struct<temperature_c:double>"
#: Types of a car's fields, in requests and outputs alike.
CAR_TYPES = {f: "double" if f.startswith("climate") else "string" for f in ["system", *sorted({f for fields in CAR_FIELDS.values() for f in fields})]}

Field = tuple[Column, Column, Column | float]


def share(fields: Iterable[Field]) -> Column:
    """Weighted mean of the scores of those (asked, score, weight) that are asked for; 1 if none is, or if their weights are 0."""
    fields = list(fields)
    weight = reduce(add, (F.when(asked, F.lit(w)).otherwise(0.0) for asked, _, w in fields))
    total = reduce(add, (F.when(asked, score * F.lit(w)).otherwise(0.0) for asked, score, w in fields))
    return F.when(weight > 0, total / weight).otherwise(1.0)


def best(want: Column, outputs: Column, score: Callable[[Column], Column], empty: Column) -> Column:
    """Score of the best of the outputs (an array); ``empty`` if there is none, 1 if nothing was asked for."""
    return F.when(want.isNull(), 1.0).when(F.coalesce(F.size(outputs), F.lit(0)) <= 0, empty).otherwise(F.array_max(F.transform(outputs, score)))


def pays_by(method: Column, offered: Column) -> Column:
    """Whether one of the offered methods names the wanted one; a method without words of its own is met by any."""
    words = F.create_map(*(x for k, v in PAYMENT_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    of = F.try_element_at(words, method)
    return F.exists(offered, lambda o: of.isNull() | F.exists(of, lambda w: F.contains(F.lower(o), w)))


def navigation_fields(want: Column, got: Column, similarity: Callable[[Column, Column], Column], exists: Column, clamped: bool = False) -> dict[str, tuple[Column, Column]]:
    """(asked, score) of each field of a place. ``similarity``: a cosine of two texts (from embeddings, a column expression).

    What an output leaves out counts as met, but for its category if such places exist. A rating below the wanted one
    scores the gap over 1.5, or with ``clamped`` 1 less that.
    """
    nearest = lambda field, texts: F.array_max(F.transform(got[texts], lambda c: (1 + similarity(want[field], c)) / 2))
    none = lambda texts: F.coalesce(F.size(got[texts]), F.lit(0)) <= 0
    unless = lambda missing, test: F.when(missing, 1.0).when(test, 1.0).otherwise(0.0)
    gap = (want["rating"] - got["rating"]) / RATING_SPAN
    scores = {
        "category": F.when(~none("categories"), nearest("category", "categories")).when(exists, 0.0).otherwise(1.0),
        "business_hours_status": unless(got["business_hours_status"].isNull(), F.lower(got["business_hours_status"]) == F.lower(want["business_hours_status"])),
        "payment_method": unless(got["payment_methods"].isNull(), pays_by(want["payment_method"], got["payment_methods"])),
        "fuel_type": unless(got["fuel_types"].isNull(), F.array_contains(got["fuel_types"], want["fuel_type"])),
        "fuel_price": unless(got["fuel_prices"].isNull(), want["fuel_price"] >= F.try_element_at(got["fuel_prices"], want["fuel_type"])),
        "food_type": F.when(none("food_types"), 1.0).otherwise(nearest("food_type", "food_types")),
        "parking": unless(F.lit(False), got["parking"] == want["parking"]),
        "price_range": unless(got["price_range"].isNull(), F.contains(F.lower(got["price_range"]), F.lower(want["price_range"]))),
        "rating": F.when(got["rating"].isNull() | (want["rating"] <= got["rating"]), 1.0).otherwise(F.greatest(1 - gap, F.lit(0.0)) if clamped else gap),
    }
    return {f: (want[f].isNotNull(), s) for f, s in scores.items()}


def navigation_score(want: Column, outputs: Column, weights: dict[str, float], similarity: Callable[[Column, Column], Column], exists: Column, clamped: bool = False) -> Column:
    """Score of the best place; fields without a weight don't count. No place is right if there is none."""

    def one(got: Column) -> Column:
        return share((asked, score, weights.get(f, 0.0)) for f, (asked, score) in navigation_fields(want, got, similarity, exists, clamped).items())

    return best(want, outputs, one, F.when(exists, 0.0).otherwise(1.0))


def car_fields(want: Column, got: Column, suffix: str = "") -> list[Field]:
    """(asked, score, weight) of the fields that the wanted system (else the output's) has. An output without a system isn't wrong."""
    asked_system = want[f"system{suffix}"]
    system = F.coalesce(asked_system, got["system"])
    out = [(F.coalesce(system.isin(*CAR_FIELDS), F.lit(False)) & asked_system.isNotNull(), F.when(got["system"].isNull() | (got["system"] == asked_system), 1.0).otherwise(0.0), SYSTEM_WEIGHT)]
    for f in CAR_TYPES:
        of = [s for s, fields in CAR_FIELDS.items() if f in fields]
        if of:
            value = want[f"{f}{suffix}"]
            out.append((F.coalesce(system.isin(*of), F.lit(False)) & value.isNotNull(), F.when(got[f] == value, 1.0).otherwise(0.0), FIELD_WEIGHT))
    return out


def car_score(want: Column, outputs: Column, changes: Column, two: bool = True) -> Column:
    """Score of the best output for a request of one system or, with fields that end in 2, two. No output is right if no change was asked for."""

    def one(got: Column) -> Column:
        fields = car_fields(want, got)
        if two:
            second = reduce(lambda a, b: a | b, (want[f"{f}2"].isNotNull() for f in CAR_TYPES))
            fields += [(second & asked, score, w) for asked, score, w in car_fields(want, got, "2")]
        return share(fields)

    return best(want, outputs, one, F.when(changes, 0.0).otherwise(1.0))


def place_output(name: Column, category: Column, price_level: Column, parking: Column, rating: Column) -> Column:
    """A place's record as an output: categories at commas, kinds of food that are a category or in the name, parking as a word."""
    categories = F.transform(F.split(F.nullif(category, F.lit("")), ","), lambda c: F.trim(c))
    foods = F.filter(F.array(*map(F.lit, FOODS)), lambda f: F.coalesce(F.array_contains(categories, f), F.lit(False)) | F.coalesce(F.contains(name, f), F.lit(False)))
    return F.struct(
        name.alias("title"), categories.alias("categories"), foods.alias("food_types"), rating.cast("double").alias("rating"), price_level.cast("string").alias("price_range"),
        F.when(parking, "available").otherwise("not_available").alias("parking"),
    )


def one_of(value: Column, *words: str) -> Column:
    """The value in lower case and without outer blanks, if it is one of the words."""
    plain = F.lower(F.trim(value))
    return F.when(plain.isin(*words), plain)


def seat_level(value: Column) -> Column:
    """A seat's heating: a word, or a whole number from 0 to 3 as text."""
    number = value.try_cast("double")
    return F.coalesce(one_of(value, "off", "low", "medium", "high", "1", "2", "3"), F.when(number.isin(0.0, 1.0, 2.0, 3.0), number.cast("int").cast("string")))


def car_output(state: Column, want: Column) -> Column:
    """What the state (JSON) of a car shows of the wanted system at the wanted position; other targets are taken as asked for."""
    car = F.from_json(state, CAR_STATE)
    place = F.lower(F.trim(want["position"]))
    lamp = F.when(place.isin("driver", "passenger", "front", "front_left", "front_right"), "interior_front").when(place.isin("rear", "rear_left", "rear_right", "back"), "interior_rear")
    seat = F.when(place == "driver", "driver").when(place.isin("passenger", "front_passenger"), "front_passenger")
    window = F.when(place.isin("front_left", "front_right", "rear_left", "rear_right"), place)
    at = lambda part, key: F.try_element_at(car[part], key)
    system = want["system"]
    shown = {
        "onoff_state_target": (["reading_lights"], one_of(at("lights", lamp), "on", "off")),
        "window_state_target": (["windows"], one_of(at("windows", window), "open", "closed", "ajar")),
        "head_lights_mode_target": (["head_lights", "headlights"], one_of(at("lights", F.lit("headlights")), "off", "on", "auto")),
        "climate_temperature_value_target": (["climate", "climate_temperature"], car["climate"]["temperature_c"]),
        "seat_heating_level_target": (["seat_heating"], seat_level(at("seat_heating", seat))),
    }
    fields = {"system": system, "position": want["position"], "seat_position": F.lit(None), "fog_light_position": F.when(system == "fog_lights", want["fog_light_position"])}
    for f, (systems, value) in shown.items():
        fields[f] = F.when(system.isin(*systems), value).otherwise(want[f])
    return F.struct(*(fields[f].cast(t).alias(f) for f, t in CAR_TYPES.items()))


def request_fields(system: str) -> set[str]:
    fields, states = REQUEST_FIELDS[system]
    return {*fields, *(f"{s}_{of}" for s in states for of in ("target", "initial"))}


def car_request(want: Column, names: list[str], *key: Column) -> Column:
    """A request to a car (a struct with the fields ``names``; those of a second system end in 2) with what its systems don't have set to null.

    There is a second system only if there is no first one: by the key, any of the systems or none. What is switched off has no other
    state to reach, but for windows.
    """
    every = {f for s in REQUEST_FIELDS for f in request_fields(s)}
    drawn = F.element_at(F.array(*map(F.lit, REQUEST_FIELDS)), F.floor(keyed_uniform(F.lit("system2"), *key) * len(REQUEST_FIELDS)).cast("int") + 1)
    systems = {"": want["system"], "2": F.when(want["system"].isNull(), drawn)}
    out = {}
    for name in names:
        suffix = "2" if name.endswith("2") else ""
        plain, system = name.removesuffix("2"), systems[suffix]
        if plain == "system":
            out[name] = system
        elif plain not in every:
            out[name] = want[name]
        else:
            value = F.when(system.isin(*(s for s in REQUEST_FIELDS if plain in request_fields(s))), want[name])
            onoff = f"onoff_state_target{suffix}"
            if plain.endswith("_target") and plain != "onoff_state_target" and onoff in names:
                # what the systems that aren't windows would be switched to counts only where they have such a state
                off = (want[onoff] == "off") & (system != "windows")
                value = F.when(~F.coalesce(off, F.lit(False)), value)
            out[name] = value
    return F.struct(*(v.alias(n) for n, v in out.items()))


def forgiven(fitness: Column, output: Column, exists: Column, best_value: float = 1.0) -> Column:
    """The fitness, or the best one where there is no output because nothing exists."""
    return F.when(output.isNull() & ~F.coalesce(exists, F.lit(False)), best_value).otherwise(fitness)
