"""Operators on conversation logs (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: System intents that count as a failed turn.
FAILED = ("reject", "reject_and_followup", "failure")


def turn_pairs(log: DataFrame) -> DataFrame:
    """Each user row with the assistant row right after it (null if unanswered); orphan assistant rows and system rows drop out."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = log.filter("role <> 'system'").select(
        "conv_id", "turn", "role", F.col("text").alias("question"), F.when(F.lead("role").over(order) == "assistant", F.lead("text").over(order)).alias("answer")
    )
    rows = rows.filter("role = 'user'").drop("role")
    return rows.withColumn("turn_idx", F.row_number().over(order) - 1)


def answer_intent(answer: Column) -> Column:
    """A stand-in label for an answer: by fixed words and length; null for no answer."""
    return (
        F.when(answer.isNull(), None)
        .when(F.length(answer) < 60, "reject")
        .when(answer.contains("?"), "followup")
        .when(F.length(answer) % 7 == 0, "failure")
        .when(F.length(answer) % 7 == 1, "reject_and_followup")
        .otherwise("inform")
    )


def efficiency(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, efficiency: 1 - share of turns whose intent failed."""
    failed = F.coalesce(F.col("intent").isin(*FAILED), F.lit(False)).cast("double")
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.coalesce(1 - F.avg(failed), F.lit(1.0)).alias("efficiency"))


def effectiveness(turns: DataFrame, relevant: Column, score: Column) -> DataFrame:
    """conv_id, effectiveness: mean score of the turns whose intent counts, of which those without a score (nothing was asked for) count 1; 1 without any."""
    counted = F.when(F.coalesce(relevant, F.lit(False)), F.coalesce(score, F.lit(1.0)))
    return turns.groupBy("conv_id").agg(F.coalesce(F.avg(counted), F.lit(1.0)).alias("effectiveness"))


def dialogue(log: DataFrame) -> DataFrame:
    """conv_id, dialogue: 'Role: text' lines in order of turns."""
    line = F.concat(F.initcap("role"), F.lit(": "), F.coalesce("text", F.lit("")))
    rows = log.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
    return rows.select("conv_id", F.array_join(F.col("lines.line"), "\n").alias("dialogue"))


def numbered_dialogue(log: DataFrame) -> DataFrame:
    """conv_id, dialogue: "n - role : text" lines of all steps in order, numbered from 1."""
    rows = log.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("steps"))
    line = lambda s, i: F.concat((i + 1).cast("string"), F.lit(" - "), s["role"], F.lit(" : "), s["text"])
    return rows.select("conv_id", F.array_join(F.transform("steps", line), "\n").alias("dialogue"))


def intent_history(turns: DataFrame) -> DataFrame:
    """conv_id, history: map of T1, T2, ... to the intents of turns that have one."""
    entry = F.when(F.col("intent").isNotNull(), F.struct("turn_idx", F.struct(F.concat(F.lit("T"), F.col("turn_idx") + 1).alias("key"), F.col("intent").alias("value")).alias("e")))
    return turns.groupBy("conv_id").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))["e"]).alias("history"))


def utterance_counts(turns: DataFrame) -> DataFrame:
    asked = F.count_if(F.trim("question") != "")
    return turns.groupBy("conv_id").agg((asked + F.count("answer")).alias("n_utterances"))


def lengths_by_role(log: DataFrame) -> DataFrame:
    return log.groupBy("conv_id").agg(*(F.count_if(F.col("role") == r).alias(f"n_{r}") for r in ("user", "assistant", "system")))


def phrase_lengths(log: DataFrame) -> DataFrame:
    n = F.length("text")
    return log.groupBy("role").agg(F.min(n).alias("shortest"), F.max(n).alias("longest"), F.avg(n).alias("mean"))


def unique_answers(log: DataFrame) -> DataFrame:
    """conv_id and whether no assistant text repeats in it."""
    rows = log.filter("role = 'assistant'").groupBy("conv_id", "text").agg(F.count("*").alias("n"))
    return rows.groupBy("conv_id").agg((F.max("n") == 1).alias("all_unique"))


def repeated_answers(log: DataFrame) -> DataFrame:
    """Texts that an assistant gives more than once in a conversation: first turn and count."""
    return log.filter("role = 'assistant'").groupBy("conv_id", "text").agg(F.min("turn").alias("first_turn"), F.count("*").alias("times")).filter("times > 1").drop("text")


def fallback_streaks(turns: DataFrame) -> DataFrame:
    """Longest run of failed turns of each conversation (gaps and islands)."""
    order = Window.partitionBy("conv_id").orderBy("turn_idx")
    failed = F.coalesce(F.col("intent").isin(*FAILED), F.lit(False))
    rows = turns.withColumn("failed", failed).withColumn("island", F.sum((~failed).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("conv_id", "island").agg(F.count_if("failed").alias("run"))
    return runs.groupBy("conv_id").agg(F.max("run").alias("longest_streak"))


def fallback_counters(turns: DataFrame, fallback: Column, repeats: int = 3, limit: int = 9) -> DataFrame:
    """Turns with two counters of fallbacks in a row: ``repeat_count``, which starts again after ``repeats``, and ``loop_count``; the ``action`` that they
    call for (rephrase, change_topic, none); turns after the one at which loop_count reaches ``limit`` are gone, as the conversation has ended there.

    Any other answer sets both to 0, so both follow from the place in a run of fallbacks.
    """
    order = Window.partitionBy("conv_id").orderBy("turn_idx")
    rows = turns.withColumn("_f", F.coalesce(fallback, F.lit(False)))
    rows = rows.withColumn("_island", F.sum((~F.col("_f")).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    part = Window.partitionBy("conv_id", "_island").orderBy("turn_idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("loop_count", F.sum(F.col("_f").cast("long")).over(part))
    ended = F.coalesce(F.max(F.col("loop_count") >= limit).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    rows = rows.withColumn("_ended", ended).filter("not _ended").withColumn("repeat_count", F.col("loop_count") % repeats)
    action = F.when(~F.col("_f"), "none").when(F.col("repeat_count") == 0, "change_topic").otherwise("rephrase")
    return rows.withColumn("action", action).drop("_f", "_island", "_ended")


def turn_state(turns: DataFrame, state: str) -> DataFrame:
    """The last non-null ``state`` up to each turn, started anew where ``reset`` is true."""
    order = Window.partitionBy("conv_id").orderBy("turn_idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.withColumn("segment", F.sum(F.col("reset").cast("int")).over(order))
    part = Window.partitionBy("conv_id", "segment").orderBy("turn_idx").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("state", F.last(state, ignorenulls=True).over(part))


def pattern_after(text: Column, what: Column, and_not: Column) -> Column:
    """Whether a text has ``what`` and no ``and_not`` behind it."""
    at = F.instr(text, what)
    return (at > 0) & (F.position(and_not, text, at + F.length(what)) == 0)


def intent_edges(turns: DataFrame, edges: DataFrame) -> DataFrame:
    """Allowed follow-up intents of each turn's answer: a join with the edge table (intent, next_intent)."""
    return turns.join(F.broadcast(edges), "intent", "left").groupBy("conv_id", "turn_idx").agg(F.sort_array(F.collect_set("next_intent")).alias("allowed"))
