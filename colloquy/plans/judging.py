"""Queries on rule files, fallback counters and constrained resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import variation
from colloquy.operators import conversation as C
from colloquy.operators import dedup, turns
from colloquy.operators import rules as R
from colloquy.operators import scoring as S
from colloquy.sources.readers import rule_fields

from .conversation import PAIRS, pairs

#: Rule files as test profiles have them.
RULE_FILES = [
    """name: short
description: at most four steps
oracle: conversation_length() <= 4
""",
    """name: answers_have_length
when: conversation_length('assistant') > 1
then: length(chatbot_phrases, 'min') > 150 and length(chatbot_phrases, 'max') < 2000
yields: length(chatbot_phrases, 'min')
""",
    "name: no_repeats\nthen: not repeated_answers()\nactive: True\n",
    """name: comma_then_stop   # places of answers with a comma and no stop behind it
if: len(chatbot_returns(',')) > 0
then: >
  len(chatbot_returns(',', '.'))
  == 0
""",
    "name: slots\nthen: data_collected() and 'lang' not in missing_slots()\n",
    "name: asks_less\nif: user_phrases[0] is not None\nthen: len(user_phrases[0]) < len(chatbot_phrases[0]) + len(chatbot_phrases) * 10\n",
    "name: inactive\nthen: 'False'\nactive: False\n",
    "name: same_opening\nconversations: 2\nwhen: conv[0].opening == conv[1].opening and conv[0].opening != ''\nthen: conv[0].steps == conv[1].steps\n",
    "name: enough_long\nconversations: all\nif: conversation_length() > 1\nthen: num_exist('conversation_length() > 2') >= 10 and exists('steps > 1')\n",
    "name: one_opening\nconversations: all\noracle: is_unique('opening')\n",
]


def profiles(spark, sf_dir):
    """Conversations as test logs: steps, phrases of both sides, collected data."""
    log = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("role <> 'system'")
    step = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = log.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(step)), lambda s: F.struct(s["role"].alias("role"), s["text"].alias("text"))).alias("interaction"))
    said = lambda role: F.transform(F.filter("interaction", lambda s: s["role"] == role), lambda s: s["text"])
    rows = rows.withColumns({"file_name": F.concat(F.col("conv_id").cast("string"), F.lit(".yml")), "user_phrases": said("user"), "chatbot_phrases": said("assistant"), "steps": F.size("interaction")})
    seats = F.when(F.col("conv_id") % 3 == 0, F.lit("None")).when(F.col("conv_id") % 5 == 0, F.lit(None)).otherwise(F.lit("2"))
    data = F.create_map(F.lit("lang"), F.lit("en"), F.lit("seats"), seats)
    return rows.withColumns({"data_output": data, "opening": F.coalesce(F.lower(F.substring(F.get("user_phrases", F.lit(0)), 1, 1)), F.lit("")), "judged": F.create_map().cast("map<string,string>")})


def file_rules(spark, sf_dir):
    """Statistics of rules that are read as their files have them: on single conversations, on pairs and on all."""
    return R.file_rule_statistics(profiles(spark, sf_dir), [R.file_rule(rule_fields(f)) for f in RULE_FILES])


def fallback_counters(spark, sf_dir):
    """Counters of fallbacks in a row and what they call for, of turns with short answers or questions back."""
    rows = pairs(spark, sf_dir).withColumn("fallback", F.coalesce(F.length("answer") % 4 != 0, F.lit(True)))
    return C.fallback_counters(rows, F.col("fallback"), 2, 3).select("conv_id", "turn_idx", "repeat_count", "loop_count", "action")


def resampled_choices(spark, sf_dir):
    """Other choices of each part: the first feature stays, the third never rises, and something differs."""
    k = F.col("p_partkey")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.array((k % 4).cast("int"), (k % 5).cast("int"), (F.col("p_size") % 6).cast("int")).alias("current"))
    now = F.col("current")
    allowed = F.array(F.array(now[0]), F.sequence(F.lit(0), F.lit(4)), F.sequence(F.lit(0), now[2]))
    return rows.select("p_partkey", F.array_join("current", ",").alias("now"), F.array_join(variation.resampled(now, allowed, k.cast("string")), ",").alias("other"))


def real_tests(spark, sf_dir):
    """Real tests and failures of each of three groups of conversations, with what a summary says of duplicates (here of texts asked twice)."""
    turns = pairs(spark, sf_dir)
    scores = C.efficiency(turns).withColumn("spoken", F.round(F.least(F.lit(1.0), F.col("n_turns") / 4), 6))
    rows = turns.groupBy("conv_id").agg(F.max(F.coalesce(F.trim("question") != "", F.lit(False))).alias("asked"), F.min_by("question", "turn_idx").alias("first")).join(scores, "conv_id").withColumn("grp", F.col("conv_id") % 3)
    low = F.col("efficiency") < 0.8
    counts = S.recounted(rows, "grp", F.col("asked"), low, (F.col("spoken"), F.col("efficiency"), F.lit(None).cast("double")))
    summary = rows.groupBy("grp").agg(F.count("*").alias("n_all"), F.count_distinct("first").alias("n_all_distinct"), F.count_if(low).alias("n_critical"), F.count_distinct(F.when(low, F.col("first"))).alias("n_critical_distinct"))
    return S.without_duplicates(counts, summary, "grp")


def content_of(k):
    """The whole content of a conversation, by its number."""
    given = {"category": F.lit("restaurant"), "price": F.when(k % 3 > 0, "$$"), "rating": F.when(k % 2 > 0, "4"), "food": F.when(k % 5 > 0, "thai"), "parking": F.when(k % 7 == 0, "yes")}
    return F.create_map(*(x for f, v in given.items() for x in (F.lit(f), v.cast("string"))))


def turn_contents(spark, sf_dir):
    """What each turn asks for: the first brings up one field, every other one a further one in order of names."""
    k = F.col("conv_id")
    rows = pairs(spark, sf_dir).select("conv_id", "turn_idx", content_of(k).alias("content"))
    first = turns.first_field(F.col("content"), k.cast("string"))
    others = F.array_except(turns.asked_fields(F.col("content")), F.array(first))
    rows = rows.withColumn("new", F.when(F.col("turn_idx") == 0, first).when(F.col("turn_idx") % 2 == 0, F.get(others, (F.col("turn_idx") / 2 - 1).cast("int"))))
    found = turns.turn_contents(rows, "conv_id", "turn_idx", "content", "new")
    text = turns.requirements(F.col("turn_content"), F.col("new"))
    return found.select("conv_id", "turn_idx", F.array_join("used", ",").alias("used"), F.replace(text, F.lit("\n"), F.lit("; ")).alias("asked"))


def confirmed_places(spark, sf_dir):
    """Which of three parts, shown as places, a selection by id, by place or by anything else means."""
    k = F.col("p_partkey")
    place = lambda i: F.struct((k * 10 + i).alias("id"), F.concat_ws("-", "p_brand", F.lit(str(i))).alias("name"))
    places = F.when(k % 13 == 0, F.slice(F.array(place(0)), 1, 0)).otherwise(F.array(place(0), place(1), place(2)))
    selected = F.when(k % 4 == 0, (k * 10 + k % 5).cast("string")).when(k % 4 == 1, (k % 5).cast("string")).when(k % 4 == 2, F.lit("that one"))
    said = F.when(k % 3 == 0, "low").when(k % 7 > 0, "high")
    found = turns.confirmed_place(places, selected, said)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", found["name"].alias("place"))


def selected_orders(spark, sf_dir):
    """The first twenty urgent orders, as critical tests, of the feasible ones."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return turns.selected_tests(rows, "crit", F.col("o_orderpriority") == "1-URGENT", F.lit(None), F.col("o_totalprice") > 1000, "o_orderkey", 20)


def apart_lines(spark, sf_dir):
    """Numbered lines of each order that stay when later ones near them in largest quantity and discount go."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg((F.max("l_quantity") / 50).alias("x"), F.max("l_discount").alias("y"))
    return dedup.keep_apart(lines.withColumn("key", F.col("l_orderkey") * 10 + F.col("l_linenumber")), ["l_orderkey"], "key", {"x": 0.3, "y": 0.05}).select("l_orderkey", "l_linenumber")


QUERIES = {f.__name__: f for f in (file_rules, fallback_counters, resampled_choices, real_tests, turn_contents, confirmed_places, selected_orders, apart_lines)}

U = "('0x' || substr(md5({}), 1, 8))::UBIGINT / 4294967296.0"
SQL = {
    "file_rules": """
WITH s AS (SELECT conv_id, role, coalesce(text, '') AS text, turn FROM conversations WHERE role <> 'system'),
c AS (SELECT conv_id, count(*) AS steps, count_if(role = 'assistant') AS n, list(text ORDER BY turn) FILTER (role = 'user') AS u, list(text ORDER BY turn) FILTER (role = 'assistant') AS a FROM s GROUP BY conv_id),
d AS (SELECT *, coalesce(lower(substr(u[1], 1, 1)), '') AS opening FROM c),
o AS (
  SELECT 'short' AS rule, CASE WHEN steps <= 4 THEN 'p' ELSE 'f' END AS r FROM d
  UNION ALL SELECT 'answers_have_length', CASE WHEN n <= 1 THEN 'n' WHEN list_min(list_transform(a, lambda t: length(t))) > 150 AND list_max(list_transform(a, lambda t: length(t))) < 2000 THEN 'p' ELSE 'f' END FROM d
  UNION ALL SELECT 'no_repeats', CASE WHEN len(list_distinct(coalesce(a, []))) = len(coalesce(a, [])) THEN 'p' ELSE 'f' END FROM d
  UNION ALL SELECT 'comma_then_stop', CASE WHEN len(list_filter(coalesce(a, []), lambda t: contains(t, ','))) = 0 THEN 'n' WHEN len(list_filter(a, lambda t: contains(t, ',') AND NOT contains(substr(t, strpos(t, ',') + 1), '.'))) = 0 THEN 'p' ELSE 'f' END FROM d
  UNION ALL SELECT 'slots', CASE WHEN conv_id % 3 = 0 OR conv_id % 5 = 0 THEN 'f' ELSE 'p' END FROM d
  UNION ALL SELECT 'asks_less', CASE WHEN u[1] IS NULL OR a[1] IS NULL THEN 'n' WHEN length(u[1]) < length(a[1]) + 10 * len(a) THEN 'p' ELSE 'f' END FROM d
  UNION ALL SELECT 'one_opening', CASE WHEN count(*) = count(DISTINCT opening) THEN 'p' ELSE 'f' END FROM d
  UNION ALL SELECT 'enough_long', 'n' FROM d WHERE steps <= 1
  UNION ALL SELECT 'enough_long', CASE WHEN count_if(steps > 2) >= 10 THEN 'p' ELSE 'f' END FROM d WHERE steps > 1
  UNION ALL SELECT 'same_opening', CASE WHEN x.opening <> y.opening OR x.opening = '' THEN 'n' WHEN x.steps = y.steps THEN 'p' ELSE 'f' END FROM d x JOIN d y ON x.conv_id <> y.conv_id),
t AS (SELECT rule, count(*) AS checks, count_if(r = 'p') AS passed, count_if(r = 'f') AS failed, count_if(r = 'n') AS na FROM o GROUP BY rule)
SELECT rule, CAST(checks AS BIGINT) AS checks, CAST(passed AS BIGINT) AS passed, CAST(failed AS BIGINT) AS failed, CAST(na AS BIGINT) AS na, printf('%.2f%%', CASE WHEN passed + failed > 0 THEN 100.0 * failed / (passed + failed) ELSE 0.0 END) AS fail_rate FROM t""",
    "fallback_counters": PAIRS
    + """, fb AS (SELECT conv_id, turn_idx, coalesce(length(answer) % 4 <> 0, true) AS f FROM t),
isl AS (SELECT *, sum(CAST(NOT f AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn_idx) AS g FROM fb),
lc AS (SELECT *, CAST(sum(CAST(f AS INTEGER)) OVER (PARTITION BY conv_id, g ORDER BY turn_idx) AS BIGINT) AS loop_count FROM isl),
en AS (SELECT *, coalesce(max(loop_count) OVER (PARTITION BY conv_id ORDER BY turn_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 3 AS ended FROM lc)
SELECT conv_id, turn_idx, loop_count % 2 AS repeat_count, loop_count, CASE WHEN NOT f THEN 'none' WHEN loop_count % 2 = 0 THEN 'change_topic' ELSE 'rephrase' END AS action FROM en WHERE NOT ended""",
    "turn_contents": PAIRS
    + f"""
, c AS (SELECT conv_id AS k, turn_idx AS i, [CASE WHEN conv_id % 5 > 0 THEN 'food' END, CASE WHEN conv_id % 7 = 0 THEN 'parking' END, CASE WHEN conv_id % 3 > 0 THEN 'price' END, CASE WHEN conv_id % 2 > 0 THEN 'rating' END] AS f,
   {{'food': 'thai', 'parking': 'yes', 'price': '$$', 'rating': '4'}} AS v FROM t),
g AS (SELECT k, i, list_filter(f, lambda x: x IS NOT NULL) AS f FROM c),
h AS (SELECT *, f[CAST(floor(({U.format("'first:' || k")}) * len(f)) AS INTEGER) + 1] AS first FROM g),
o AS (SELECT *, list_filter(f, lambda x: x <> first) AS others FROM h),
n AS (SELECT *, CASE WHEN i = 0 THEN first WHEN i % 2 = 0 THEN others[i // 2] END AS new FROM o),
u AS (SELECT *, list_sort(list_filter(list(new) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lambda x: x IS NOT NULL)) AS used FROM n)
SELECT k AS conv_id, i AS turn_idx, coalesce(array_to_string(used, ','), '') AS used,
       array_to_string(list_transform(list_sort(list_distinct(list_filter(['category'] || coalesce(used, []) || [new], lambda x: x IS NOT NULL))), lambda x: x || ': ' || CASE x WHEN 'category' THEN 'restaurant' WHEN 'food' THEN 'thai' WHEN 'parking' THEN 'yes' WHEN 'price' THEN '$$' ELSE '4' END || CASE WHEN x = new THEN ' (new)' ELSE '' END), '; ') AS asked FROM u""",
    "confirmed_places": """
SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_brand || '-' || CASE WHEN p_partkey % 3 = 0 OR p_partkey % 7 = 0 THEN 0 WHEN p_partkey % 4 IN (0, 1) AND p_partkey % 5 < 3 THEN p_partkey % 5 ELSE 0 END END AS place FROM part""",
    "selected_orders": "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 1000 ORDER BY o_orderkey LIMIT 20",
    "apart_lines": """
WITH RECURSIVE l AS (SELECT l_orderkey AS k, l_linenumber AS n, max(l_quantity) / 50 AS x, max(l_discount) AS y FROM lineitem GROUP BY ALL),
o AS (SELECT k, list({'n': n, 'x': x, 'y': y} ORDER BY n) AS ls FROM l GROUP BY k),
s AS (SELECT k, ls, 1 AS i, [ls[1]] AS kept FROM o
  UNION ALL SELECT k, ls, i + 1, CASE WHEN len(list_filter(kept, lambda p: abs(p.x - ls[i + 1].x) < 0.3 AND abs(p.y - ls[i + 1].y) < 0.05)) > 0 THEN kept ELSE list_append(kept, ls[i + 1]) END FROM s WHERE i < len(ls))
SELECT k AS l_orderkey, unnest(list_transform(kept, lambda p: p.n)) AS l_linenumber FROM s WHERE i = len(ls)""",
    "real_tests": PAIRS
    + """, q AS (SELECT conv_id, bool_or(coalesce(trim(question) <> '', false)) AS asked, arg_min(question, turn_idx) AS first FROM t GROUP BY conv_id),
s AS (SELECT conv_id % 3 AS grp, asked, first, eff, round(least(1.0, n_turns / 4), 6) AS spoken, eff < 0.8 AS low FROM q JOIN e USING (conv_id))
SELECT grp, count(*) AS tests, count_if(low) AS failures, count_if(asked) - (count(*) - count(DISTINCT first)) AS real_tests,
       count_if(asked AND low AND (spoken <= 0.65 OR eff <= 0.65)) - (count_if(low) - count(DISTINCT CASE WHEN low THEN first END)) AS real_failures FROM s GROUP BY grp""",
    "resampled_choices": f"""
WITH c AS (SELECT p_partkey AS k, [CAST(p_partkey % 4 AS BIGINT), p_partkey % 5, p_size % 6] AS now FROM part),
a AS (SELECT *, [[now[1]], range(0, 5), range(0, now[3] + 1)] AS al FROM c),
d AS (SELECT *, list_transform([0, 1, 2], lambda i: al[i + 1][CAST(floor(({U.format("'draw:' || k || ':' || i")}) * len(al[i + 1])) AS INTEGER) + 1]) AS drawn,
             list_transform([1, 2, 3], lambda i: list_filter(al[i], lambda x: x <> now[i])) AS others FROM a),
p AS (SELECT *, list_filter([1, 2, 3], lambda i: len(others[i]) > 0) AS free FROM d),
q AS (SELECT *, free[CAST(floor(({U.format("'pick:' || k")}) * len(free)) AS INTEGER) + 1] AS one, {U.format("'other:' || k")} AS v FROM p)
SELECT k AS p_partkey, array_to_string(now, ',') AS now,
       array_to_string(CASE WHEN drawn = now AND len(free) > 0 THEN list_transform([1, 2, 3], lambda i: CASE WHEN i = one THEN others[i][CAST(floor(v * len(others[i])) AS INTEGER) + 1] ELSE drawn[i] END) ELSE drawn END, ',') AS other FROM q""",
}
