"""Queries on conversation logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import text
from colloquy.operators import conversation as C

from . import contents

#: Which user intents may follow a system intent (fixed values of these queries).
EDGES = [("inform", "confirm"), ("inform", "refine"), ("followup", "answer"), ("reject", "refine"), ("reject", "stop"), ("failure", "repeat"), ("reject_and_followup", "answer")]


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.turn_pairs(log(spark, sf_dir)).withColumn("intent", C.answer_intent(F.col("answer")))


def turn_pairs(spark, sf_dir):
    return pairs(spark, sf_dir).drop("intent")


def conversation_efficiency(spark, sf_dir):
    rows = C.efficiency(pairs(spark, sf_dir))
    return rows.select("conv_id", "n_turns", F.round("efficiency", 6).alias("efficiency"), (F.col("efficiency") < 0.65).alias("is_critical"))


def efficiency_summary(spark, sf_dir):
    """Failures and their share for each of three groups of conversations: mean and sample deviation of efficiency, 0 for one."""
    rows = C.efficiency(pairs(spark, sf_dir)).withColumn("grp", F.col("conv_id") % 3)
    return rows.groupBy("grp").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("efficiency") < 0.65).alias("failures"),
        F.round(F.avg("efficiency"), 6).alias("mean"),
        F.round(F.coalesce(F.stddev_samp("efficiency"), F.lit(0.0)), 6).alias("std"),
    )


def dialogue_text(spark, sf_dir):
    return C.dialogue(log(spark, sf_dir))


def intent_history(spark, sf_dir):
    rows = C.intent_history(pairs(spark, sf_dir))
    return rows.select("conv_id", F.array_join(F.transform(F.map_entries("history"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("history"))


def utterance_counts(spark, sf_dir):
    return C.utterance_counts(pairs(spark, sf_dir))


def role_lengths(spark, sf_dir):
    return C.lengths_by_role(log(spark, sf_dir))


def phrase_lengths(spark, sf_dir):
    return C.phrase_lengths(log(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


def unique_answers(spark, sf_dir):
    return C.unique_answers(log(spark, sf_dir))


def repeated_answers(spark, sf_dir):
    return C.repeated_answers(log(spark, sf_dir))


def fallback_streaks(spark, sf_dir):
    return C.fallback_streaks(pairs(spark, sf_dir))


def session_state(spark, sf_dir):
    """Constraint carried through a session; an answer of length 0 modulo 5 is a change of mind that resets it."""
    n = F.length("answer")
    rows = pairs(spark, sf_dir).withColumn("reset", F.coalesce(n % 5 == 0, F.lit(False))).withColumn("seen", F.when(n % 3 == 0, n))
    return C.turn_state(rows, "seen").select("conv_id", "turn_idx", "segment", "state")


def allowed_intents(spark, sf_dir):
    edges = spark.createDataFrame(EDGES, "intent string, next_intent string")
    return C.intent_edges(pairs(spark, sf_dir), edges).withColumn("allowed", F.array_join("allowed", ","))


def pattern_check(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn_idx", C.pattern_after(F.col("answer"), F.lit(" the "), F.lit("?")).alias("holds"))


def parsed_dialogue(spark, sf_dir):
    """Dialogue texts split into turns again."""
    rows = pairs(spark, sf_dir).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn_idx", F.concat(F.lit("User: "), F.col("question"), F.coalesce(F.concat(F.lit("\nSystem: "), F.col("answer")), F.lit(""))).alias("t")))).alias("ts"))
    rows = rows.select("conv_id", F.posexplode(text.dialogue_turns(F.array_join(F.col("ts.t"), "\n"))).alias("turn_idx", "p"))
    return rows.select("conv_id", F.col("turn_idx").cast("long").alias("turn_idx"), F.length("p.user").alias("n_user"), F.length("p.system").alias("n_system"))


def effectiveness(spark, sf_dir):
    """Each turn asks for the content of a part (but for every ninth conversation); the scores are those of navigation_content."""
    n = spark.read.parquet(f"{sf_dir}/part.parquet").count()
    asked = F.when(F.col("conv_id") % 9 != 0, (F.col("conv_id") * 7 + F.col("turn_idx")) % n + 1)
    rows = pairs(spark, sf_dir).withColumn("p_partkey", asked).join(contents.navigation_content(spark, sf_dir), "p_partkey", "left")
    return C.effectiveness(rows, F.col("intent") != "followup", F.col("score")).withColumn("effectiveness", F.round("effectiveness", 6))


PAIRS = """
WITH l AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, turn, text AS question, CASE WHEN nr = 'assistant' THEN nt END AS answer, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS turn_idx FROM l WHERE role = 'user'),
t AS (SELECT *, CASE WHEN answer IS NULL THEN NULL WHEN length(answer) < 60 THEN 'reject' WHEN contains(answer, '?') THEN 'followup' WHEN length(answer) % 7 = 0 THEN 'failure' WHEN length(answer) % 7 = 1 THEN 'reject_and_followup' ELSE 'inform' END AS intent FROM p),
f AS (SELECT *, coalesce(intent IN ('reject', 'reject_and_followup', 'failure'), false) AS failed FROM t),
e AS (SELECT conv_id, count(*) AS n_turns, 1 - avg(CAST(failed AS INTEGER)) AS eff FROM f GROUP BY conv_id)
"""

QUERIES = {f.__name__: f for f in (turn_pairs, conversation_efficiency, efficiency_summary, dialogue_text, intent_history, utterance_counts, role_lengths, phrase_lengths, unique_answers, repeated_answers, fallback_streaks, session_state, allowed_intents, pattern_check, parsed_dialogue, effectiveness)}

SQL = {
    "turn_pairs": PAIRS + "SELECT conv_id, turn, question, answer, turn_idx FROM p",
    "conversation_efficiency": PAIRS + "SELECT conv_id, n_turns, round(eff, 6) AS efficiency, eff < 0.65 AS is_critical FROM e",
    "efficiency_summary": PAIRS + "SELECT conv_id % 3 AS grp, count(*) AS n, count_if(eff < 0.65) AS failures, round(avg(eff), 6) AS mean, round(coalesce(stddev_samp(eff), 0), 6) AS std FROM e GROUP BY 1",
    "dialogue_text": "SELECT conv_id, string_agg(upper(role[1]) || role[2:] || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS dialogue FROM conversations GROUP BY conv_id",
    "intent_history": PAIRS + "SELECT conv_id, coalesce(string_agg('T' || (turn_idx + 1) || '=' || intent, ',' ORDER BY turn_idx) FILTER (intent IS NOT NULL), '') AS history FROM t GROUP BY conv_id",
    "utterance_counts": PAIRS + "SELECT conv_id, count_if(trim(question) <> '') + count(answer) AS n_utterances FROM p GROUP BY conv_id",
    "role_lengths": "SELECT conv_id, count_if(role = 'user') AS n_user, count_if(role = 'assistant') AS n_assistant, count_if(role = 'system') AS n_system FROM conversations GROUP BY conv_id",
    "phrase_lengths": "SELECT role, min(length(text)) AS shortest, max(length(text)) AS longest, round(avg(length(text)), 6) AS mean FROM conversations GROUP BY role",
    "unique_answers": "SELECT conv_id, max(n) = 1 AS all_unique FROM (SELECT conv_id, text, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY ALL) GROUP BY conv_id",
    "repeated_answers": "SELECT conv_id, min(turn) AS first_turn, count(*) AS times FROM conversations WHERE role = 'assistant' GROUP BY conv_id, text HAVING count(*) > 1",
    "fallback_streaks": PAIRS + ", i AS (SELECT *, sum(CAST(NOT failed AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn_idx) AS g FROM f) SELECT conv_id, max(r) AS longest_streak FROM (SELECT conv_id, g, count_if(failed) AS r FROM i GROUP BY ALL) GROUP BY conv_id",
    "session_state": PAIRS
    + ", s AS (SELECT *, sum(CAST(coalesce(length(answer) % 5 = 0, false) AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn_idx) AS segment, CASE WHEN length(answer) % 3 = 0 THEN length(answer) END AS seen FROM p) SELECT conv_id, turn_idx, segment, last_value(seen IGNORE NULLS) OVER (PARTITION BY conv_id, segment ORDER BY turn_idx) AS state FROM s",
    "allowed_intents": PAIRS
    + f", g(intent, n) AS (VALUES {', '.join(map(str, EDGES))}) SELECT conv_id, turn_idx, coalesce(string_agg(DISTINCT n, ',' ORDER BY n), '') AS allowed FROM t LEFT JOIN g USING (intent) GROUP BY conv_id, turn_idx",
    "pattern_check": PAIRS + "SELECT conv_id, turn_idx, contains(answer, ' the ') AND NOT contains(substr(answer, strpos(answer, ' the ') + 5), '?') AS holds FROM p",
    "parsed_dialogue": PAIRS + "SELECT conv_id, CAST(turn_idx AS BIGINT) AS turn_idx, length(trim(question, ' ' || chr(10))) AS n_user, nullif(length(trim(answer, ' ' || chr(10))), 0) AS n_system FROM p",
    "effectiveness": PAIRS
    + f", n AS ({contents.SQL['navigation_content']}), a AS (SELECT *, CASE WHEN conv_id % 9 <> 0 THEN (conv_id * 7 + turn_idx) % (SELECT count(*) FROM part) + 1 END AS p_partkey FROM t)"
    + " SELECT conv_id, round(coalesce(avg(CASE WHEN intent <> 'followup' THEN coalesce(score, 1.0) END), 1.0), 6) AS effectiveness FROM a LEFT JOIN n USING (p_partkey) GROUP BY conv_id",
}
