"""Operators around the search for failing tests: variation, selection, coverage and learned regions."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.functions import features


def constrained(rows: DataFrame, kind: str, fields: list[str], allowed: dict[str, list[str]]) -> DataFrame:
    """Sets fields to null that the row's kind doesn't allow; kinds without a rule allow all."""
    out = {}
    for f in fields:
        bad = [k for k, names in allowed.items() if f not in names]
        out[f] = F.when(~F.coalesce(F.col(kind).isin(bad), F.lit(False)), F.col(f)) if bad else F.col(f)
    return rows.withColumns(out)


def uncovered_pairs(rows: DataFrame, a: str, b: str, most: int = 10_000) -> DataFrame:
    """Pairs of values of two features that no row has; nulls are no values. The second feature has at most ``most`` values, else the query fails.

    Each value of the first feature has the set of values that it is seen with; what is missing from all of them leaves as rows.
    """
    known = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    every = rows.agg(F.collect_set(b).alias("_all"))
    every = every.select(F.when(F.size("_all") <= most, F.col("_all")).otherwise(F.raise_error(F.lit(f"{b} has over {most} values")).cast(every.schema["_all"].dataType)).alias("_all"))
    seen = known.groupBy(a).agg(F.collect_set(b).alias("_seen"))
    lone = rows.filter(F.col(a).isNotNull()).select(a).distinct()
    # the side that is sent is one row
    both = lone.join(seen, a, "left").join(F.broadcast(every))
    return both.select(a, F.explode(F.array_except("_all", F.coalesce("_seen", F.array().cast(every.schema["_all"].dataType)))).alias(b))


def grid(spark: SparkSession, bounds: dict[str, tuple[float, float]], n: int) -> DataFrame:
    """Points at n (two or more) even steps of each axis: the digits of a row's number, so that no join is needed."""
    rows = spark.range(n ** len(bounds))
    at = lambda i: F.pmod(F.floor(F.col("id") / n**i), F.lit(n))
    return rows.select(*((F.lit(low) + at(i) * F.lit((high - low) / (n - 1))).alias(axis) for i, (axis, (low, high)) in enumerate(bounds.items())))


def grid_between(rows: DataFrame, by: str, columns: list[str], n: int) -> DataFrame:
    """Points at n (two or more) even steps between the least and the largest value of each column in each group, with their number: the digits of it are the steps."""
    ends = rows.groupBy(by).agg(*(F.struct(F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high")).alias(c) for c in columns))
    each = ends.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(n ** len(columns) - 1))))
    step = lambda i: F.pmod(F.floor(F.col("point") / n**i), F.lit(n))
    return each.select(by, "point", *((F.col(f"{c}.low") + step(i) * (F.col(f"{c}.high") - F.col(f"{c}.low")) / (n - 1)).alias(c) for i, c in enumerate(columns)))


def reference_set(points: DataFrame, critical: Column) -> DataFrame:
    """The critical ones of grid points: what a search is held against."""
    return points.filter(F.coalesce(critical, F.lit(False)))


def tournament(rows: DataFrame, group: str, key: str, rank: str, crowding: str) -> DataFrame:
    """Neighbours in a keyed shuffle of each group meet in pairs; the better rank wins, then the larger crowding, then the lesser key."""
    order = Window.partitionBy(group).orderBy(features.keyed_uniform(F.lit("t"), F.col(key).cast("string")), key)
    paired = rows.withColumn("match", F.floor((F.row_number().over(order) - 1) / 2))
    better = F.struct(-F.col(rank), F.col(crowding), -F.col(key))
    return paired.groupBy(group, "match").agg(F.max_by(key, better).alias("winner"))


def constrained_tournament(rows: DataFrame, group: str, key: str, violation: str, objectives: list[str], rank: str, crowding: str, how: str = "rank") -> DataFrame:
    """group, match, winner: neighbours in a keyed shuffle meet in pairs; one without an opponent wins.

    If either breaks a constraint, the smaller violation wins. Else by ``how``: rank (the lesser rank) or dominance (the one whose
    objectives, all minimised, beat the other's); then the larger crowding; then, and between equal violations, a keyed draw.
    """
    if how not in ("rank", "dominance"):
        raise ValueError(f"tournaments go by rank or dominance, not {how}")
    draw = features.keyed_uniform(F.lit("t"), F.col(key).cast("string"))
    paired = rows.withColumn("match", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(draw, key)) - 1) / 2))
    one = F.struct(features.keyed_uniform(F.lit("w"), F.col(key).cast("string")).alias("u"), F.col(key).alias("k"), F.col(violation).alias("v"), F.col(rank).alias("r"), F.col(crowding).alias("c"), F.array(*(F.col(o).cast("double") for o in objectives)).alias("f"))
    # in order of their draws, so that a wins what nothing else decides
    both = paired.groupBy(group, "match").agg(F.sort_array(F.collect_list(one)).alias("p")).withColumns({"a": F.get("p", F.lit(0)), "b": F.get("p", F.lit(1))})
    a, b = F.col("a"), F.col("b")
    beats = lambda x, y: F.forall(F.zip_with(x["f"], y["f"], lambda p, q: p <= q), lambda t: t) & F.exists(F.zip_with(x["f"], y["f"], lambda p, q: p < q), lambda t: t)
    first = F.when(a["r"] < b["r"], a["k"]).when(b["r"] < a["r"], b["k"]) if how == "rank" else F.when(beats(a, b), a["k"]).when(beats(b, a), b["k"])
    crowded = F.when(b["c"] > a["c"], b["k"]).otherwise(a["k"])
    broken = (a["v"] > 0) | (b["v"] > 0)
    winner = F.when(b.isNull(), a["k"]).when(broken, F.when(b["v"] < a["v"], b["k"]).otherwise(a["k"])).otherwise(F.coalesce(first, crowded))
    return both.select(group, "match", winner.alias("winner"))


def allowed_intents(turns: DataFrame, max_repeats: int = 2) -> Column:
    """Ordered rules on columns turn_idx, intent, before, repeats, confirmed; one label for the next intent."""
    return (
        F.when(F.col("turn_idx") == 0, "start")
        .when(F.col("intent") == "stop", "none")
        .when(F.col("confirmed"), "stop")
        .when(F.col("repeats") >= max_repeats, "stop")
        .when(F.col("intent") == F.col("before"), "other")
        .when(F.col("intent").isNull(), "repeat")
        .otherwise("any")
    )


#: Intents that no longer make sense once a conversation is confirmed, and those that bring in a further feature (fixed values).
BEFORE_CONFIRMATION = ["change_of_mind", "reject", "reject_clarify", "add_preferences"]
NEEDS_FEATURE = ["add_preferences", "reject_clarify"]


def candidate_intents(possible: Column, before: Column, unused: Column, may_stop: Column, may_repeat: Column, used: Column, confirmed: Column) -> Column:
    """Those of the possible intents (an array) that may come next.

    Never the start; a stop or a repeat only if allowed; a confirmation once, after two different intents of
    BEFORE_CONFIRMATION (``used``), and none of these after it; none that needs a feature if no ``unused`` one is left (null: unknown);
    the intent ``before`` only if nothing else is left; a stop if nothing at all is.
    """

    def fits(intent: Column) -> Column:
        return (
            (intent != "start")
            & ((intent != "stop") | may_stop)
            & ((intent != "repeat") | may_repeat)
            & (~intent.isin(*BEFORE_CONFIRMATION, "confirmation") | ~confirmed)
            & ((intent != "confirmation") | (F.size(F.array_distinct(used)) >= 2))
            & (~intent.isin(*NEEDS_FEATURE) | (F.coalesce(unused, F.lit(1)) > 0))
        )

    allowed = F.filter(possible, fits)
    other = F.filter(allowed, lambda i: ~i.eqNullSafe(before))
    return F.when(F.size(other) > 0, other).when(F.size(allowed) > 0, allowed).otherwise(F.array(F.lit("stop")))


def logistic_weights(rows: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Score and label of each row by a logistic regression on the columns."""
    data = VectorAssembler(inputCols=columns, outputCol="_x").transform(rows.withColumn("_y", F.col(label).cast("double")))
    model = LogisticRegression(featuresCol="_x", labelCol="_y", probabilityCol="_p", predictionCol="_l", rawPredictionCol="_r", regParam=0.01).fit(data)
    return model.transform(data).withColumn("score", vector_to_array("_p")[1]).drop("_x", "_y", "_p", "_l", "_r")


def best_threshold(rows: DataFrame, score: str, label: str) -> DataFrame:
    """The score bound (score >= bound is positive) of the best F1, from running counts over distinct scores (round them first: they go to one task); ties go to the higher recall."""
    per = rows.groupBy(score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("p"))
    down = Window.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    total = rows.agg(F.sum(F.col(label).cast("long")).alias("all"))
    swept = per.withColumn("given", F.sum("n").over(down)).withColumn("tp", F.sum("p").over(down)).join(F.broadcast(total))
    f1 = 2 * F.col("tp") / (F.col("given") + F.col("all"))
    return swept.agg(F.max_by(F.struct(F.col(score).alias("bound"), f1.alias("f1")), F.struct(f1, F.col("tp"))).alias("b")).select("b.*")


def clusters(rows: DataFrame, vec: str, ks: range, seed: int = 7) -> DataFrame:
    """Cluster of each row by k-means, with the k of the best silhouette."""
    data = rows.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>"))).cache()
    best = None
    for k in ks:
        out = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(data).transform(data)
        quality = ClusteringEvaluator(featuresCol="_v", predictionCol="cluster").evaluate(out)
        if best is None or quality > best[0]:
            best = quality, out
    return best[1].drop("_v")


def critical_regions(rows: DataFrame, columns: list[str], failed: str, depth: int = 3) -> DataFrame:
    """Leaves of an entropy tree: bounds of each column, rows and share of failures."""
    data = VectorAssembler(inputCols=columns, outputCol="_x").transform(rows.withColumn("_y", F.col(failed).cast("double")))
    model = DecisionTreeClassifier(featuresCol="_x", labelCol="_y", leafCol="leaf", impurity="entropy", maxDepth=depth, minInstancesPerNode=10, seed=7).fit(data)
    bounds = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    return model.transform(data).groupBy(F.col("leaf").cast("long").alias("leaf")).agg(F.count("*").alias("n"), F.avg("_y").alias("share"), *bounds)


def replayed_state(rows: DataFrame, key: str, order: list[str], kind: str, value: str, set_kind: str, add_kind: str) -> DataFrame:
    """A number that ``set_kind`` rows set and ``add_kind`` rows change, after each row; other kinds leave it alone."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_segment", F.count_if(F.col(kind) == set_kind).over(w))
    part = Window.partitionBy(key, "_segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("state", F.sum(F.when(F.col(kind).isin(set_kind, add_kind), F.col(value)).otherwise(0.0)).over(part)).drop("_segment")
