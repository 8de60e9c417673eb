"""Contents: hand-computed scores, missing outputs and odd car states."""

import pytest
from pyspark.sql import functions as F

from colloquy.functions import contents as C
from colloquy.operators import poi
from colloquy.operators import search as S

WANT = "category string, business_hours_status string, payment_method string, fuel_type string, fuel_price double, food_type string, parking string, price_range string, rating double"
GOT = "title string, categories array<string>, food_types array<string>, rating double, price_range string, parking string, business_hours_status string, payment_methods array<string>, fuel_types array<string>, fuel_prices map<string,double>"
EMPTY = dict.fromkeys(f.split()[0] for f in WANT.split(", "))
PLACE = dict.fromkeys(f.split()[0] for f in GOT.split(", "))


def navigation(spark, want, outputs, exists=True, weights=None, clamped=False):
    rows = spark.createDataFrame([(want if want is None else EMPTY | want, outputs and [PLACE | o for o in outputs], exists)], f"want struct<{WANT.replace(' ', ':', -1).replace(',:', ',')}>, got array<struct<{GOT.replace(' ', ':').replace(',:', ',')}>>, there boolean")
    weights = weights or dict.fromkeys(EMPTY, 1.0)
    score = C.navigation_score(F.col("want"), F.col("got"), weights, lambda a, b: F.when(a == b, 1.0).otherwise(0.0), F.col("there"), clamped)
    return rows.select(score.alias("s")).collect()[0].s


def test_navigation_without_request_or_output(spark):
    assert navigation(spark, None, None) == 1
    assert navigation(spark, {"rating": 3.0}, [], True) == 0
    assert navigation(spark, {"rating": 3.0}, None, False) == 1
    assert navigation(spark, {}, [{}]) == 1


def test_navigation_takes_the_best_output(spark):
    want = {"category": "bar", "rating": 4.0, "parking": "available"}
    assert navigation(spark, want, [{"categories": ["pub"], "rating": 4.5, "parking": "not_available"}, {"categories": ["pub", "bar"], "rating": 4.5, "parking": "not_available"}]) == pytest.approx(2 / 3)
    # nothing of the category exists: an output without one isn't wrong
    assert navigation(spark, {"category": "bar"}, [{}], False) == 1
    assert navigation(spark, {"category": "bar"}, [{}], True) == 0


def test_navigation_rating_gap(spark):
    assert navigation(spark, {"rating": 4.0}, [{"rating": 3.4}]) == pytest.approx(0.4)
    assert navigation(spark, {"rating": 4.0}, [{"rating": 3.4}], clamped=True) == pytest.approx(0.6)
    assert navigation(spark, {"rating": 4.0}, [{"rating": 3.4}], weights={"category": 2.0}) == 1


def test_navigation_methods_and_fuel(spark):
    assert navigation(spark, {"payment_method": "MOBILE_PAYMENT"}, [{"payment_methods": ["by Phone"]}]) == 1
    assert navigation(spark, {"payment_method": "DEBIT"}, [{"payment_methods": ["cash"]}]) == 0
    assert navigation(spark, {"payment_method": "BARTER"}, [{"payment_methods": ["cash"]}]) == 1
    assert navigation(spark, {"fuel_type": "diesel", "fuel_price": 1.5}, [{"fuel_types": ["petrol"], "fuel_prices": {"petrol": 1.0}}]) == 0


def car(spark, want, state, changes=True, second=None):
    types = ", ".join(f"{f} {t}" for f, t in C.CAR_TYPES.items())
    both = [(want or {}).get(f) for f in C.CAR_TYPES] + [(second or {}).get(f) for f in C.CAR_TYPES]
    schema = types + ", " + ", ".join(f"{f}2 {t}" for f, t in C.CAR_TYPES.items()) + ", state string"
    rows = spark.createDataFrame([(*both, state)], schema)
    rows = rows.select(F.struct(*(c for c in rows.columns if c != "state")).alias("want"), "state").withColumn("got", C.car_output(F.col("state"), F.col("want")))
    out = F.when(F.col("state").isNull(), F.slice(F.array("got"), 1, 0)).otherwise(F.array("got"))
    return rows.select("got", C.car_score(F.col("want"), out, F.lit(changes)).alias("s")).collect()[0]


def test_car_states(spark):
    window = {"system": "windows", "position": " Front_Left", "window_state_target": "open"}
    assert car(spark, window, '{"windows": {"front_left": " OPEN"}}').s == 1
    assert car(spark, window, '{"windows": {"front_left": "closed"}}').s == pytest.approx(0.7 / 0.9)
    assert car(spark, window, "no json").got.window_state_target is None
    assert car(spark, window, None).s == 0
    assert car(spark, window, None, False).s == 1
    assert car(spark, {"system": "boat"}, "{}").s == 1
    levels = {'"Low"': "low", "3": "3", "4": None, "1.5": None, "2.0": "2", '"warm"': None}
    for given, level in levels.items():
        assert car(spark, {"system": "seat_heating", "position": "driver"}, '{"seat_heating": {"driver": %s}}' % given).got.seat_heating_level_target == level


def test_car_with_two_requests_pools_their_weights(spark):
    fan = {"system": "fan", "onoff_state_target": "on"}
    assert car(spark, fan, "{}", second={"system": "windows", "window_state_target": "open"}).s == pytest.approx(0.7 / 1.4)


def test_place_outputs(spark):
    rows = spark.createDataFrame([("old thai house", "bar, greek", "$", True), (None, "", None, None)], "n string, c string, p string, k boolean")
    a, b = (r.o for r in rows.select(C.place_output(F.col("n"), F.col("c"), F.col("p"), F.col("k"), F.lit(None)).alias("o")).collect())
    assert (a.categories, a.food_types, a.parking) == (["bar", "greek"], ["thai", "greek"], "available")
    assert (b.categories, b.food_types, b.parking) == (None, [], "not_available")


def test_opening_hours_and_embeddings(spark):
    rows = spark.createDataFrame([({"Monday": "09:00-17:00", "Sunday": "closed"}, [1.0, 0.0])], "hours map<string,string>, vec array<double>")
    test = [poi.open_on(F.col("hours"), F.lit(d), F.lit(t)) for d, t in (("Monday", "17:00"), ("Monday", "17:01"), ("Sunday", "10:00"), ("Friday", "10:00"))]
    near = [poi.alike(F.array(*map(F.lit, v)), F.col("vec")) for v in ((0.9, 0.1), (0.1, 0.9))]
    assert tuple(rows.select(*test, *near).collect()[0]) == (True, False, False, False, True, False)


def test_candidate_intents(spark):
    def next_(possible, before=None, unused=None, stop=True, repeat=True, used=(), confirmed=False):
        rows = spark.createDataFrame([(possible, before, unused, stop, repeat, list(used), confirmed)], "p array<string>, b string, u int, s boolean, r boolean, d array<string>, c boolean")
        return rows.select(S.candidate_intents(*map(F.col, "pbusrdc")).alias("x")).collect()[0].x

    assert next_(["start", "ask", "stop"], stop=False) == ["ask"]
    assert next_(["ask"], before="ask") == ["ask"]
    assert next_(["confirmation", "ask"], used=["reject", "reject"]) == ["ask"]
    assert next_(["confirmation", "ask"], used=["reject", "add_preferences"]) == ["confirmation", "ask"]
    assert next_(["reject", "confirmation"], used=["reject", "add_preferences"], confirmed=True) == ["stop"]
    assert next_(["add_preferences", "repeat"], unused=0, repeat=False) == ["stop"]
