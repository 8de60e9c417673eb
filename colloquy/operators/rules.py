"""Declarative rules on logs: SQL predicates, or rule files whose expressions are compiled to columns; nothing is evaluated as Python."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.expressions import Rules, paired_names


@dataclass(frozen=True)
class Rule:
    """``when``: which rows the rule is for; ``then``: what must hold."""

    name: str
    then: str
    when: str = "true"


#: Rules of the query rule_statistics.
EVENT_RULES = [
    Rule("positive_value", "value > 0", "event_type in ('purchase', 'click')"),
    Rule("small_k", "k < 50", "k is not null"),
    Rule("known_type", "event_type in ('view', 'signup', 'purchase', 'error', 'click')"),
]


def property_rules(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """rule, outcome (pass, fail, na) of each rule on each row, in one pass."""
    outcomes = [F.struct(F.lit(r.name).alias("rule"), F.when(~F.coalesce(F.expr(r.when), F.lit(False)), "na").when(F.expr(r.then), "pass").otherwise("fail").alias("outcome")) for r in rules]
    return rows.select(F.inline(F.array(*outcomes)))


def statistics(found: DataFrame) -> DataFrame:
    """Checks, passes, failures, not applicable, and the failing rate as text with two digits."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    out = found.groupBy("rule").agg(F.count("*").alias("checks"), n("pass").alias("passed"), n("fail").alias("failed"), n("na").alias("na"))
    judged = F.col("passed") + F.col("failed")
    return out.withColumn("fail_rate", F.when(judged > 0, F.format_string("%.2f%%", 100 * F.col("failed") / judged)))


def pair_rule(rows: DataFrame, same: list[str], key: str, when: str, then: str) -> DataFrame:
    """Checks and passes of a rule on ordered pairs (a, b) of different rows that agree in ``same``; only counts leave the join."""
    a, b = rows.alias("a"), rows.alias("b")
    on = F.col(f"a.{key}") != F.col(f"b.{key}")
    for c in same:
        on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return a.join(b, on).filter(when).agg(F.count("*").alias("checks"), F.count_if(F.expr(then)).alias("passed"))


def global_rule(rows: DataFrame, condition: str, least: int = 1) -> DataFrame:
    """Whether at least ``least`` rows meet the condition, and how many do."""
    n = F.count_if(F.expr(condition))
    return rows.agg(n.alias("n"), (n >= least).alias("holds"))


@dataclass(frozen=True)
class FileRule:
    """A rule as its file has it, in the language of colloquy.functions.expressions; conversations: 1, 2 (pairs) or "all"."""

    name: str
    then: str
    when: str = "True"
    if_: str = "True"
    conversations: int | str = 1
    active: bool = True
    description: str = ""
    yields: str | None = None


def file_rule(fields: dict[str, str]) -> FileRule:
    """A rule of the fields of its file; ``oracle`` is another name of ``then``."""
    then = fields.get("oracle", fields.get("then"))
    if not fields.get("name") or not then:
        raise ValueError(f"a rule needs a name and a then: {fields}")
    many = fields.get("conversations", "1").lower()
    return FileRule(
        fields["name"], then, fields.get("when", "True"), fields.get("if", "True"), many if many == "all" else int(many),
        fields.get("active", "true").lower() in ("true", "yes", "on"), fields.get("description", ""), fields.get("yields"),
    )


def rule_outcomes(rows: DataFrame, rules: list[FileRule]) -> DataFrame:
    """The rules on one conversation: file_name, rule, outcome (pass, fail, na) and message (what a failed rule yields), in one pass over ``rows``.

    A rule isn't applicable where its when or if don't hold or its then has no value.
    """
    known = Rules(rows)
    found = []
    for r in rules:
        applies = F.coalesce(known.truth(r.when) & known.truth(r.if_), F.lit(False))
        verdict = known.verdict(r.then)
        outcome = F.when(~applies | verdict.isNull(), "na").when(verdict, "pass").otherwise("fail")
        message = F.when(outcome == "fail", known._value(known._parse(r.yields)).cast("string")) if r.yields else F.lit(None).cast("string")
        found.append(F.struct(F.lit(r.name).alias("rule"), outcome.alias("outcome"), message.alias("message")))
    return rows.select("file_name", F.inline(F.array(*found)))


def pair_statistics(rows: DataFrame, rule: FileRule) -> DataFrame:
    """rule, passed, failed, na of a rule on ordered pairs of different rows.

    Its when or if must make something of both equal. Rows that agree in all that the rule looks at are one with a count, and these
    are joined on what is equal; pairs that are not joined count as not applicable, by their number alone.
    """
    used = sorted({n for source in (rule.when, rule.if_, rule.then) for n in paired_names(source)})
    few = rows.select(*used).groupBy(*used).agg(F.count("*").alias("_n"))
    # as maps can't be grouped
    maps = any(t.startswith("map") for c, t in rows.select(*used).dtypes)
    few = (rows.select(*used).withColumn("_n", F.lit(1).cast("long")).withColumn("_id", F.monotonically_increasing_id()) if maps else few.withColumn("_id", F.struct(*used)))
    a, b = few.alias("a"), few.alias("b")
    # only the types of the columns are asked of this one
    known = Rules(a.join(b, F.lit(True)), ("a", "b"))
    equal = [e for source in (rule.when, rule.if_) for e in known.equalities(source)]
    if not equal:
        raise ValueError(f"the rule {rule.name} on pairs makes nothing of them equal")
    on = equal[0][0] == equal[0][1]
    for x, y in equal[1:]:
        on = on & (x == y)
    # a then without a value fails, as pairs have it
    holds = F.coalesce(known.verdict(rule.then), F.lit(False))
    pairs = F.col("a._n") * (F.col("b._n") - F.col("a._id").eqNullSafe(F.col("b._id")).cast("long"))
    count = lambda c: F.coalesce(F.sum(c), F.lit(0))
    judged = a.join(b, on).filter(known.truth(rule.when) & known.truth(rule.if_)).agg(count(pairs).alias("judged"), count(F.when(holds, pairs)).alias("passed"))
    total = rows.agg((F.count("*") * (F.count("*") - 1)).alias("pairs"))
    return judged.join(F.broadcast(total)).select(F.lit(rule.name).alias("rule"), "passed", (F.col("judged") - F.col("passed")).alias("failed"), (F.col("pairs") - F.col("judged")).alias("na"))


def whole_statistics(rows: DataFrame, rule: FileRule) -> DataFrame:
    """rule, passed, failed, na of a rule on all conversations for which when and if hold: one verdict."""
    known = Rules(rows)
    rows = rows.withColumn("_fits", F.coalesce(known.truth(rule.when) & known.truth(rule.if_), F.lit(False)))
    n = rows.agg(F.count_if(~F.col("_fits")).alias("na"))
    fits = rows.filter("_fits")
    out = fits.agg(Rules(fits, whole=True).truth(rule.then).alias("holds"))
    holds = F.coalesce("holds", F.lit(False))
    return out.join(F.broadcast(n)).select(F.lit(rule.name).alias("rule"), holds.cast("long").alias("passed"), (~holds).cast("long").alias("failed"), "na")


def file_rule_statistics(rows: DataFrame, rules: list[FileRule]) -> DataFrame:
    """rule, checks, passed, failed, na, fail_rate (text with two digits) of the active rules of any kind."""
    active = [r for r in rules if r.active]
    single = [r for r in active if r.conversations == 1]
    n = lambda o: F.count_if(F.col("outcome") == o)
    parts = [rule_outcomes(rows, single).groupBy("rule").agg(n("pass").alias("passed"), n("fail").alias("failed"), n("na").alias("na"))] if single else []
    parts += [whole_statistics(rows, r) if r.conversations == "all" else pair_statistics(rows, r) for r in active if r.conversations != 1]
    if not parts:
        return rows.sparkSession.createDataFrame([], "rule string, checks long, passed long, failed long, na long, fail_rate string")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    judged = F.col("passed") + F.col("failed")
    rate = F.format_string("%.2f%%", F.when(judged > 0, 100 * F.col("failed") / judged).otherwise(0.0))
    return out.select("rule", (judged + F.col("na")).alias("checks"), "passed", "failed", "na", rate.alias("fail_rate"))
