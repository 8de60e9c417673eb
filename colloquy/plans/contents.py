"""Queries on contents: places and car states against what was asked for, constraints on places, and intents that may follow."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import contents as C
from colloquy.operators import poi
from colloquy.operators import search as S

from .metrics import r6

SYSTEMS = ["windows", "fog_lights", "head_lights", "reading_lights", "climate", "seat_heating", "fan", "unknown"]
PLACES = ["front_left", "Rear", "driver", "passenger", "nowhere"]
INTENTS = ["start", "add_preferences", "reject", "change_of_mind", "confirmation", "repeat", "ask", "stop"]
WEIGHTS = {"category": 2.0, "business_hours_status": 1.0, "payment_method": 1.0, "fuel_type": 0.5, "fuel_price": 0.5, "food_type": 1.0, "parking": 1.0, "price_range": 1.0, "rating": 1.0}


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, at):
    return F.try_element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def navigation_content(spark, sf_dir):
    """The better of two places that each part stands for, against a request; texts are alike (1) if equal, else not (0)."""
    k = F.col("p_partkey")
    given = lambda n, value: F.when(k % n > 0, value)
    want = F.struct(
        given(4, F.substring_index("p_type", " ", -1)).alias("category"), given(3, F.lit("Open")).alias("business_hours_status"), given(5, pick(["CASH", "CREDIT_CARD_VISA", "OTHER"], k)).alias("payment_method"),
        given(2, F.lit("diesel")).alias("fuel_type"), given(2, F.lit(1.5)).alias("fuel_price"), given(6, F.lit("thai")).alias("food_type"), given(7, F.lit("available")).alias("parking"),
        given(3, F.lit("$$")).alias("price_range"), given(2, F.lit(3.0)).alias("rating"),
    )

    def place(name, category, price, parking, rating, hours, methods, fuels):
        got = C.place_output(name, category, price, parking, rating)
        prices = F.when(fuels.isNotNull(), F.map_from_arrays(fuels, F.transform(fuels, lambda f, i: 1.2 + 0.4 * i)))
        return got.withField("business_hours_status", hours).withField("payment_methods", methods).withField("fuel_types", fuels).withField("fuel_prices", prices)

    one = place(F.col("p_name"), F.regexp_replace("p_type", " ", " , "), F.lit("$$$"), k % 3 == 0, F.col("p_size") / 10, F.lit("open"), F.array(F.lit("Cash only"), F.col("p_brand")), F.array(F.lit("petrol"), F.lit("diesel")))
    two = place(F.lit("A thai place"), F.lit("thai,asian"), F.lit("$"), k % 2 == 0, F.lit(None), F.lit(None), F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>"))
    outputs = F.when(k % 11 == 0, F.slice(F.array(one), 1, 0)).otherwise(F.array(one, two))
    rows = table(spark, sf_dir, "part").select("p_partkey", want.alias("want"), outputs.alias("got"), (k % 22 == 0).alias("there"))
    score = C.navigation_score(F.col("want"), F.col("got"), WEIGHTS, lambda a, b: F.when(F.lower(a) == F.lower(b), 1.0).otherwise(0.0), F.col("there"))
    return r6(rows.select("p_partkey", score.alias("score")), "score")


def car_content(spark, sf_dir):
    """What each customer's car shows, against the two systems that they asked for."""
    k = F.col("c_custkey")
    state = F.concat(
        F.lit('{"lights": {"interior_front": "ON ", "headlights": "auto", "interior_rear": "dim"}, "windows": {"front_left": "'), pick(["Open", "closed", "broken"], k),
        F.lit('"}, "seat_heating": {"driver": '), (k % 5).cast("string"), F.lit(', "front_passenger": "high"}, "climate": {"temperature_c": '), (18 + k % 6).cast("string"), F.lit("}}"),
    )
    def asked(at, suffix):
        given = {
            "system": pick(SYSTEMS, at), "position": pick(PLACES, at / 3), "seat_position": F.when(at % 2 == 0, "driver"), "fog_light_position": F.when(at % 4 == 1, "front"), "window_state_target": F.lit("open"),
            "onoff_state_target": F.lit("on"), "head_lights_mode_target": F.lit("auto"), "climate_temperature_value_target": F.lit(21.0), "seat_heating_level_target": F.lit("2"),
        }
        return [given[f].cast(t).alias(f"{f}{suffix}") for f, t in C.CAR_TYPES.items()]

    second = F.struct(*asked(F.floor(k / 2), ""))
    want = F.struct(*asked(k, ""), *(F.when(k % 3 == 0, second[f]).alias(f"{f}2") for f in C.CAR_TYPES))
    rows = table(spark, sf_dir, "customer").select("c_custkey", want.alias("want"), state.alias("state")).withColumn("got", C.car_output(F.col("state"), F.col("want")))
    out = F.when(k % 13 > 0, F.array("got")).otherwise(F.slice(F.array("got"), 1, 0))
    shown = F.coalesce(*(F.when(F.col("want.system") == s, F.col(f"got.{f}").cast("string")) for s, f in (("windows", "window_state_target"), ("reading_lights", "onoff_state_target"), ("seat_heating", "seat_heating_level_target"), ("climate", "climate_temperature_value_target"))))
    return r6(rows.select("c_custkey", shown.alias("shown"), C.car_score(F.col("want"), out, k % 2 == 0).alias("score")), "score")


def place_constraints(spark, sf_dir):
    """How many parts, taken as places, meet each of three requests for a name, a kind of food and opening hours of a weekday."""
    k = F.col("p_partkey")
    hours = F.when(k % 4 == 0, None).otherwise(F.create_map(F.lit("Monday"), F.format_string("%02d:00-%02d:30", (k % 12).cast("int"), (k % 12 + 9).cast("int"))))
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("category"), hours.alias("hours"))
    wants = [(1, ("STEEL", None, None, None)), (2, (None, None, "Monday", "09:15")), (3, ("o", "Steel", "Monday", "14:00")), (4, (None, None, "Tuesday", "09:15"))]
    return poi.counted(rows, spark.createDataFrame(wants, "want_id int, want struct<name:string,cuisine:string,day:string,now:string>"), ("name", "cuisine", "day"))


def candidate_intents(spark, sf_dir):
    """Which intents may follow in each customer's conversation."""
    k = F.col("c_custkey")
    used = F.slice(F.array(F.lit("reject"), F.lit("change_of_mind")), 1, (k % 3).cast("int"))
    found = S.candidate_intents(F.slice(F.array(*map(F.lit, INTENTS)), (k % 7 + 1).cast("int"), 4), pick(INTENTS, F.floor(k / 7)), F.when(k % 5 > 0, k % 5 - 1), k % 2 == 0, k % 11 > 0, used, k % 4 == 0)
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(found, ",").alias("intents"))


QUERIES = {f.__name__: f for f in (navigation_content, car_content, place_constraints, candidate_intents)}

SQL = {
    "navigation_content": """
WITH p AS (SELECT p_partkey AS k, list_transform(string_split(replace(p_type, ' ', ' , '), ','), lambda c: trim(c)) AS c, split_part(p_type, ' ', -1) AS cat, p_name, p_size / 10 AS r, lower(p_brand) AS brand FROM part),
s AS (SELECT k, 1 AS o, CASE WHEN list_contains(list_transform(c, lambda x: lower(x)), lower(cat)) THEN 1.0 ELSE 0.5 END AS category, 1.0 AS hours, CASE k % 3 WHEN 0 THEN 1.0 WHEN 1 THEN CAST(contains(brand, 'visa') AS INTEGER) ELSE 1.0 END AS pay, 1.0 AS ft, CAST(1.5 >= 1.6 AS INTEGER) AS fp,
    CASE WHEN len(list_filter(['german', 'indian', 'italian', 'middle_eastern', 'french', 'chinese', 'japanese', 'thai', 'mexican', 'greek', 'vietnamese', 'turkish', 'american'], lambda f: list_contains(c, f) OR contains(p_name, f))) = 0 THEN 1.0 WHEN list_contains(c, 'thai') OR contains(p_name, 'thai') THEN 1.0 ELSE 0.5 END AS food,
    CAST(k % 3 = 0 AS INTEGER) AS park, 1.0 AS price, CASE WHEN r >= 3 THEN 1 ELSE (3 - r) / 1.5 END AS rating FROM p
  UNION ALL SELECT k, 2, 0.5, 1, 1, 1, 1, 1, CAST(k % 2 = 0 AS INTEGER), 0, 1 FROM p),
w AS (SELECT *, CAST(k % 4 > 0 AS INTEGER) * 2 AS w1, CAST(k % 3 > 0 AS INTEGER) AS w2, CAST(k % 5 > 0 AS INTEGER) AS w3, CAST(k % 2 > 0 AS INTEGER) AS w4, CAST(k % 6 > 0 AS INTEGER) AS w6, CAST(k % 7 > 0 AS INTEGER) AS w7 FROM s),
t AS (SELECT k, (w1 * category + w2 * hours + w3 * pay + w4 * 0.5 * ft + w4 * 0.5 * fp + w6 * food + w7 * park + w2 * price + w4 * rating) AS a, CAST(w1 + w2 + w3 + w4 + w6 + w7 + w2 + w4 AS DOUBLE) AS b FROM w)
SELECT k AS p_partkey, round(CASE WHEN k % 22 = 0 THEN 0 WHEN k % 11 = 0 THEN 1 ELSE max(CASE WHEN b > 0 THEN a / b ELSE 1 END) END, 6) AS score FROM t GROUP BY k""",
    "car_content": """
WITH c AS (SELECT c_custkey AS k, c_custkey // 2 AS h, ['windows', 'fog_lights', 'head_lights', 'reading_lights', 'climate', 'seat_heating', 'fan', 'unknown'] AS s, ['front_left', 'rear', 'driver', 'passenger', 'nowhere'] AS p FROM customer),
a AS (SELECT k, h, s[k % 8 + 1] AS s1, p[CAST(floor((k / 3) % 5) AS INTEGER) + 1] AS p1, CASE WHEN k % 3 = 0 THEN s[h % 8 + 1] END AS s2, p[CAST(floor((h / 3) % 5) AS INTEGER) + 1] AS p2 FROM c),
g AS (SELECT *, CASE WHEN s1 <> 'windows' THEN 'open' WHEN p1 = 'front_left' THEN (['open', 'closed', NULL])[k % 3 + 1] END AS win, CASE WHEN s1 <> 'reading_lights' OR p1 IN ('front_left', 'driver', 'passenger') THEN 'on' END AS onoff,
  CASE WHEN s1 = 'climate' THEN 18 + k % 6 ELSE 21 END AS temp, CASE WHEN s1 <> 'seat_heating' THEN '2' WHEN p1 = 'driver' AND k % 5 < 4 THEN CAST(k % 5 AS VARCHAR) WHEN p1 = 'passenger' THEN 'high' END AS seat, s1 = 'fog_lights' AND k % 4 = 1 AS fog FROM a),
q AS (SELECT *, unnest([1, 2]) AS i FROM g), r AS (SELECT *, CASE i WHEN 1 THEN s1 ELSE s2 END AS s, CASE i WHEN 1 THEN p1 ELSE p2 END AS p, CASE i WHEN 1 THEN k ELSE h END AS n FROM q),
f AS (SELECT k, i, s, CASE WHEN s IN ('windows', 'fog_lights', 'head_lights', 'reading_lights', 'climate', 'seat_heating', 'fan') THEN 0.5 ELSE 0 END AS w0, CAST(s = s1 AS INTEGER) AS v0,
  CASE WHEN s IN ('windows', 'reading_lights') THEN 0.2 ELSE 0 END AS w1, CAST(p = p1 AS INTEGER) AS v1, CASE WHEN s = 'seat_heating' AND n % 2 = 0 THEN 0.2 ELSE 0 END AS w2, CASE WHEN s = 'fog_lights' AND n % 4 = 1 THEN 0.2 ELSE 0 END AS w3, CAST(fog AS INTEGER) AS v3,
  CASE WHEN s = 'windows' THEN 0.2 ELSE 0 END AS w4, CAST(coalesce(win = 'open', false) AS INTEGER) AS v4, CASE WHEN s IN ('fog_lights', 'reading_lights', 'climate', 'fan') THEN 0.2 ELSE 0 END AS w5, CAST(coalesce(onoff = 'on', false) AS INTEGER) AS v5,
  CASE WHEN s = 'head_lights' THEN 0.2 ELSE 0 END AS w6, CASE WHEN s = 'climate' THEN 0.2 ELSE 0 END AS w7, CAST(temp = 21 AS INTEGER) AS v7, CASE WHEN s = 'seat_heating' THEN 0.2 ELSE 0 END AS w8, CAST(coalesce(seat = '2', false) AS INTEGER) AS v8 FROM r),
t AS (SELECT k, sum(w0 * v0 + w1 * v1 + w3 * v3 + w4 * v4 + w5 * v5 + w6 + w7 * v7 + w8 * v8) AS a, sum(w0 + w1 + w2 + w3 + w4 + w5 + w6 + w7 + w8) AS b FROM f WHERE s IS NOT NULL GROUP BY k)
SELECT k AS c_custkey, CASE s1 WHEN 'windows' THEN win WHEN 'reading_lights' THEN onoff WHEN 'seat_heating' THEN seat WHEN 'climate' THEN temp || '.0' END AS shown, round(CASE WHEN k % 13 = 0 THEN CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END WHEN b > 0 THEN a / b ELSE 1 END, 6) AS score FROM g JOIN t USING (k)""",
    "place_constraints": """
WITH p AS (SELECT lower(p_name) AS n, lower(p_type || ' ' || p_name) AS t, CASE WHEN p_partkey % 4 > 0 THEN printf('%02d:00', p_partkey % 12) END AS o, printf('%02d:30', p_partkey % 12 + 9) AS c FROM part)
SELECT w AS want_id, CASE w WHEN 1 THEN (SELECT count(*) FROM p WHERE contains(n, 'steel')) WHEN 2 THEN (SELECT count(*) FROM p WHERE o <= '09:15' AND '09:15' <= c)
  WHEN 3 THEN (SELECT count(*) FROM p WHERE contains(n, 'o') AND contains(t, 'steel') AND o <= '14:00' AND '14:00' <= c) ELSE 0 END AS n FROM (VALUES (1), (2), (3), (4)) v(w)""",
    "candidate_intents": """
WITH c AS (SELECT c_custkey AS k, ['start', 'add_preferences', 'reject', 'change_of_mind', 'confirmation', 'repeat', 'ask', 'stop'] AS i FROM customer),
f AS (SELECT k, i[(k // 7) % 8 + 1] AS before, list_filter(i[k % 7 + 1:k % 7 + 4], lambda x: x <> 'start' AND (x <> 'stop' OR k % 2 = 0) AND (x <> 'repeat' OR k % 11 > 0) AND (x NOT IN ('reject', 'change_of_mind', 'add_preferences', 'confirmation') OR k % 4 > 0)
  AND (x <> 'confirmation' OR k % 3 = 2) AND (x <> 'add_preferences' OR k % 5 <> 1)) AS l FROM c),
g AS (SELECT k, l, list_filter(l, lambda x: x <> before) AS m FROM f)
SELECT k AS c_custkey, CASE WHEN len(m) > 0 THEN array_to_string(m, ',') WHEN len(l) > 0 THEN array_to_string(l, ',') ELSE 'stop' END AS intents FROM g""",
}
