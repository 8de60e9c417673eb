"""Queries on specified values, typed answers, curves of algorithms and distances of all pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import contents as contents_of
from colloquy.functions import perturbations
from colloquy.operators import curves
from colloquy.operators import history as H
from colloquy.operators import specs as S

from .history import T, tests
from .metrics import r6


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def specified_values(spark, sf_dir):
    """Values of variables that parts specify: lists, ranges by step or number, and wrong ones."""
    k = F.col("p_partkey")
    kind = F.when(k % 4 == 0, "string").when(k % 4 == 1, "int").when(k % 4 == 2, "float").otherwise("date")
    items = F.when(k % 4 == 0, S.listed_items(F.array("p_brand", F.lit("any(brand)"), F.lit("x")), F.array(F.lit("given")))).when(k % 3 == 0, F.array((k % 7).cast("string"), F.when(k % 5 > 0, "12").otherwise("1.5")))
    low, high = (k % 10).cast("double"), (k % 10 + F.col("p_size") % 8).cast("double")
    step = F.when(k % 5 < 2, (1 + k % 2).cast("double")).when(k % 5 == 2, 0.5)
    found = S.spec_values(kind, items, low, high, step, F.when(k % 2 == 0, 3))
    numbers = F.transform("found.values", lambda x: F.coalesce(F.round(x.try_cast("double"), 4).cast("string"), x))
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("found")).select("p_partkey", F.array_join(numbers, ",").alias("values"), "found.error")


def date_ranges(spark, sf_dir):
    """Dates from each order's date on: by days, months, evenly and at random."""
    k = F.col("o_orderkey")
    start = F.to_date("o_orderdate")
    kind = F.when(k % 4 == 0, "day").when(k % 4 == 1, "month").when(k % 4 == 2, "linspace").otherwise("random")
    dates = S.date_range(start, F.date_add(start, (k % 50).cast("int")), kind, F.when(k % 9 > 0, (k % 9).cast("int")).otherwise(0), k.cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(dates, ",").alias("dates"))


def typed_answers(spark, sf_dir):
    """What parts' texts are as numbers, times, dates and truth values."""
    k = F.col("p_partkey")
    said = F.when(k % 6 == 0, (k * 3).cast("string")).when(k % 6 == 1, F.concat((k % 12 + 1).cast("string"), F.lit(":30 pm"))).when(k % 6 == 2, F.concat(F.lit("2024-03-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))).when(k % 6 == 3, F.lit("null")).when(k % 6 == 4, F.col("p_name"))
    kind = F.when(k % 6 == 0, F.when(k % 4 == 0, "float").otherwise("int")).when(k % 6 == 1, "time").when(k % 6 == 2, "date").when(k % 6 == 4, F.when(k % 4 == 0, "bool").otherwise("date")).otherwise("int")
    return table(spark, sf_dir, "part").select("p_partkey", S.typed(said, kind).alias("value"))


def comparison_curves(spark, sf_dir):
    """Failures of two algorithms' runs after each 50 tests: mean and deviation over their runs."""
    rows = H.running_counts(tests(spark, sf_dir), "run", ["ts", "event_id"], "failed").withColumn("algo", F.col("run") % 2)
    return r6(curves.comparison_curves(rows, "algo", "run", "test_size", "failures", 50, 1000), "mean", "sigma")


def vector_distances(spark, sf_dir):
    """Mean and mean largest distance of the vectors of each label to all of that label."""
    return r6(curves.pair_distances(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding"), "mean_distance", "mean_largest")


def forgiven_contents(spark, sf_dir):
    """Scores of parts' contents, which count as best where there is no place to show and none was shown."""
    k = F.col("p_partkey")
    shown = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", contents_of.forgiven((k % 10) / 10, shown, k % 2 == 0).alias("score"))


def perturbed_texts(spark, sf_dir):
    """Each benchmark item after each kind of perturbation."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    each = F.array(*(F.struct(F.lit(n).alias("kind"), f(F.col("text"), F.col("item_id")).alias("text")) for n, f in perturbations.KINDS.items()))
    return rows.select("item_id", F.inline(each))


REQUEST = ["system", "position", "seat_position", "window_state_target", "onoff_state_target", "onoff_state_initial", "climate_temperature_value_target", "politeness", "system2", "position2", "onoff_state_target2"]


def car_requests(spark, sf_dir):
    """Requests of customers to their cars, with only what the systems have."""
    k = F.col("c_custkey")
    systems = F.array(*map(F.lit, contents_of.REQUEST_FIELDS), F.lit(None).cast("string"))
    given = {"system": F.get(systems, (k % 9).cast("int")), "system2": F.lit("fan"), "climate_temperature_value_target": F.lit("21"), "onoff_state_target": F.when(k % 2 == 0, "off").otherwise("on")}
    want = F.struct(*(given.get(n, F.lit(n[:4])).alias(n) for n in REQUEST))
    rows = table(spark, sf_dir, "customer").select("c_custkey", want.alias("want"))
    out = rows.select("c_custkey", contents_of.car_request(F.col("want"), REQUEST, k.cast("string")).alias("r"))
    return out.select("c_custkey", F.concat_ws(",", *(F.coalesce(F.col(f"r.{n}"), F.lit("-")) for n in REQUEST)).alias("request"))


QUERIES = {f.__name__: f for f in (specified_values, date_ranges, typed_answers, comparison_curves, vector_distances, forgiven_contents, car_requests, perturbed_texts)}

def drawn(kind: str, *places: str) -> str:
    return f"(('0x' || substr(md5({" || ':' || ".join(["item_id", repr(kind), *places])}), 1, 8))::UBIGINT / 4294967296.0)"


DELETED = ", ".join(f"'{w}', '{w.capitalize()}'" for w in perturbations.DELETED)
CHARS = {"introduce_typos": "CASE WHEN {u} < 0.1 THEN {x} ELSE {c} END", "delete_characters": "CASE WHEN {u} < 0.1 THEN '' ELSE {c} END", "add_characters": "CASE WHEN {u} < 0.1 THEN {x} || {c} ELSE {c} END", "add_spaces": "CASE WHEN {u} < 0.3 THEN ' ' || {c} ELSE {c} END"}


def by_character(kind: str) -> str:
    letter = f"chr(CAST(97 + floor({drawn(kind, 'i', repr('letter'))} * 26) AS INTEGER))"
    new = CHARS[kind].format(u=drawn(kind, "i"), x=letter, c="text[i + 1]")
    return f"SELECT item_id, '{kind}' AS kind, array_to_string(list_transform(range(length(text)), lambda i: {new}), '') AS text FROM b"


def by_word(kind: str, new: str, keep: str = "true") -> str:
    return f"SELECT item_id, '{kind}' AS kind, array_to_string(list_transform(list_filter(range(len(ws)), lambda i: {keep}), lambda i: {new}), ' ') AS text FROM w"


def inner(kind: str, middle: str) -> str:
    return by_word(kind, f"CASE WHEN length(ws[i + 1]) > 3 AND {drawn(kind, 'i')} <= 0.2 THEN ws[i + 1][1] || array_to_string({middle}, '') || ws[i + 1][-1] ELSE ws[i + 1] END")


ONE = f"CAST(floor({drawn('swap_characters', 'i', repr('one'))} * (length(ws[i + 1]) - 2)) AS BIGINT)"
TWO = f"(({ONE} + 1 + CAST(floor({drawn('swap_characters', 'i', repr('two'))} * (length(ws[i + 1]) - 3)) AS BIGINT)) % (length(ws[i + 1]) - 2))"
SQL = {
    "perturbed_texts": "WITH b AS (SELECT item_id, coalesce(text, '') AS text FROM benchmark), w AS (SELECT item_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws FROM b)\n"
    + "\nUNION ALL ".join(
        [
            *map(by_character, CHARS),
            inner("swap_characters", f"list_transform(range(length(ws[i + 1]) - 2), lambda j: ws[i + 1][CASE j WHEN {ONE} THEN {TWO} WHEN {TWO} THEN {ONE} ELSE j END + 2])"),
            inner("shuffle_characters", f"list_transform(list_sort(list_transform(range(length(ws[i + 1]) - 2), lambda j: {{'u': {drawn('shuffle_characters', 'i', 'j')}, 'j': j, 'c': ws[i + 1][j + 2]}})), lambda x: x.c)"),
            by_word("to_leet", f"CASE WHEN {drawn('to_leet', 'i')} < 0.2 THEN translate(ws[i + 1], 'aeioAEIO', '43104310') ELSE ws[i + 1] END"),
            by_word("delete_words", "ws[i + 1]", f"NOT (ws[i + 1] IN ({DELETED}) AND {drawn('delete_words', 'i')} <= 0.4)"),
        ]
    ),
    "specified_values": """
WITH c AS (SELECT p_partkey AS k, p_brand, CASE p_partkey % 4 WHEN 0 THEN 'string' WHEN 1 THEN 'int' WHEN 2 THEN 'float' ELSE 'date' END AS kind, p_partkey % 10 AS low, p_partkey % 10 + p_size % 8 AS high,
                  CASE WHEN p_partkey % 5 < 2 THEN 1.0 + p_partkey % 2 WHEN p_partkey % 5 = 2 THEN 0.5 END AS step FROM part),
d AS (SELECT *, CASE WHEN kind = 'string' THEN [p_brand, 'x', 'given'] WHEN k % 3 = 0 THEN [CAST(k % 7 AS VARCHAR), CASE WHEN k % 5 > 0 THEN '12' ELSE '1.5' END] END AS items FROM c),
e AS (SELECT *, CASE WHEN kind = 'date' THEN 'kind' WHEN items IS NOT NULL AND kind = 'int' AND k % 5 = 0 THEN 'type' WHEN items IS NULL AND kind = 'int' AND step = 0.5 THEN 'type' WHEN items IS NULL AND kind = 'float' AND step IS NULL AND k % 2 > 0 THEN 'step' END AS error FROM d),
n AS (SELECT *, greatest(CAST(ceil((high - low) / coalesce(step, 1)) AS BIGINT), 0) AS n FROM e),
v AS (SELECT *, CASE WHEN items IS NOT NULL THEN list_transform(items, lambda x: TRY_CAST(x AS DOUBLE)) WHEN kind = 'float' AND step IS NULL THEN list_transform(range(3), lambda i: low + i * ((high - low) / 2.0))
             ELSE list_concat(list_transform(range(n), lambda i: low + i * coalesce(step, 1.0)), CASE WHEN step IS NULL THEN [] ELSE [CAST(high AS DOUBLE)] END) END AS nums FROM n)
SELECT k AS p_partkey, CASE WHEN error IS NULL THEN CASE WHEN kind = 'string' THEN array_to_string(items, ',') ELSE array_to_string(list_transform(nums, lambda x: CAST(round(CAST(x AS DOUBLE), 4) AS VARCHAR)), ',') END END AS values, error FROM v""",
    "date_ranges": """
WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS s, CAST(o_orderkey % 50 AS INTEGER) AS days, CAST(o_orderkey % 9 AS INTEGER) AS step FROM orders),
d AS (SELECT *, CASE k % 4 WHEN 0 THEN list_transform(range(CAST(ceil(days / step) AS BIGINT) + 1), lambda i: CAST(i * step AS INTEGER)) WHEN 1 THEN list_transform(range(CAST(ceil(days / (30.0 * step)) AS BIGINT) + 1), lambda i: CAST(i * step * 30 AS INTEGER))
  WHEN 2 THEN list_transform(range(step), lambda i: CAST(floor(i * CASE WHEN step > 1 THEN days / (step - 1) ELSE 0.0 END) AS INTEGER)) ELSE list_transform(range(step), lambda i: CAST(floor((('0x' || substr(md5('date:' || k || ':' || i), 1, 8))::UBIGINT / 4294967296.0) * (days + 1)) AS INTEGER)) END AS l FROM o WHERE step > 0)
SELECT o.k AS o_orderkey, array_to_string(list_transform(d.l, lambda x: strftime(o.s + x, '%d/%m/%Y')), ',') AS dates FROM o LEFT JOIN d USING (k)""",
    "typed_answers": """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN CASE WHEN p_partkey % 4 = 0 THEN CAST(CAST(p_partkey * 3 AS DOUBLE) AS VARCHAR) ELSE CAST(p_partkey * 3 AS VARCHAR) END WHEN 1 THEN printf('%02d:30:00', (p_partkey % 12 + 1) % 12 + 12)
  WHEN 2 THEN printf('2024-03-%02d', p_partkey % 28 + 1) WHEN 3 THEN 'null' WHEN 4 THEN CASE WHEN p_partkey % 4 = 0 THEN 'True' ELSE p_name END END AS value FROM part""",
    "car_requests": """
WITH c AS (SELECT c_custkey AS k, (['windows', 'fog_lights', 'ambient_lights', 'head_lights', 'fan', 'reading_lights', 'climate', 'seat_heating', NULL])[c_custkey % 9 + 1] AS s, CASE WHEN c_custkey % 2 = 0 THEN 'off' ELSE 'on' END AS o,
  (['windows', 'fog_lights', 'ambient_lights', 'head_lights', 'fan', 'reading_lights', 'climate', 'seat_heating'])[CAST(floor(('0x' || substr(md5('system2:' || c_custkey), 1, 8))::UBIGINT / 4294967296.0 * 8) AS INTEGER) + 1] AS drawn FROM customer),
d AS (SELECT *, CASE WHEN s IS NULL THEN drawn END AS s2 FROM c)
SELECT k AS c_custkey, concat_ws(',', coalesce(s, '-'), CASE WHEN s IN ('windows', 'reading_lights') THEN 'posi' ELSE '-' END, CASE WHEN s = 'seat_heating' THEN 'seat' ELSE '-' END, CASE WHEN s = 'windows' THEN 'wind' ELSE '-' END,
  CASE WHEN s <> 'windows' THEN o ELSE '-' END, CASE WHEN s <> 'windows' THEN 'onof' ELSE '-' END, CASE WHEN s = 'climate' AND o = 'on' THEN '21' ELSE '-' END, 'poli', coalesce(s2, '-'), CASE WHEN s2 IN ('windows', 'reading_lights') THEN 'posi' ELSE '-' END, CASE WHEN s2 <> 'windows' THEN 'onof' ELSE '-' END) AS request FROM d""",
    "forgiven_contents": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 AND p_partkey % 2 = 1 THEN 1.0 ELSE (p_partkey % 10) / 10 END AS score FROM part",
    "comparison_curves": T
    + """, p AS (SELECT r.run, q.n FROM (SELECT DISTINCT run FROM c) r, (SELECT unnest(range(50, 1001, 50)) AS n) q),
v AS (SELECT p.run, p.n, max(CASE WHEN c.test_size <= p.n THEN c.failures END) AS f FROM p JOIN c USING (run) GROUP BY ALL)
SELECT run % 2 AS algo, n, count(f) AS runs, round(avg(f), 6) AS mean, round(stddev_pop(f), 6) AS sigma FROM v GROUP BY 1, 2""",
    "vector_distances": """
WITH d AS (SELECT a.label, a.vec_id, avg(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS m, max(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS x FROM embeddings a JOIN embeddings b USING (label) GROUP BY ALL)
SELECT label, count(*) AS n, round(avg(m), 6) AS mean_distance, round(avg(x), 6) AS mean_largest FROM d GROUP BY label""",
}
