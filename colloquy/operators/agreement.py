"""Agreement of raters on a long table ratings(item, rater, label), and classification scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def counts(ratings: DataFrame) -> DataFrame:
    """item, label, n: how many raters gave an item a label."""
    return ratings.filter("label is not null").groupBy("item", "label").agg(F.count("*").alias("n"))


def majority(ratings: DataFrame, tie: str = "min") -> DataFrame:
    """item, label (most votes; of tied labels the least for tie min, the greatest for max; for error a tie fails the query), share of votes, whether raters differ."""
    if tie not in ("min", "max", "error"):
        raise ValueError(f"ties go to min, max or error, not {tie}")
    by = counts(ratings)
    least, most = F.max_by("label", F.struct("n", -F.col("label"))), F.max_by("label", F.struct("n", F.col("label")))
    failed = F.raise_error(F.concat(F.lit("tie in the votes on item "), F.col("item").cast("string"))).cast(ratings.schema["label"].dataType)
    label = {"min": least, "max": most, "error": F.when(least == most, least).otherwise(failed)}[tie]
    out = by.groupBy("item").agg(label.alias("label"), F.max("n").alias("top"), F.sum("n").alias("votes"), F.count("*").alias("labels"))
    return out.select("item", "label", (F.col("top") / F.col("votes")).alias("share"), (F.col("labels") > 1).alias("disagree"))


def with_label(rows: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """``rows`` with the label of their key; a key without one fails the query, with its name."""
    missing = F.raise_error(F.concat(F.lit("no label for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(labels.schema[label].dataType)
    return rows.join(labels.select(key, F.col(label).alias("_label")), key, "left").withColumn(label, F.when(F.col("_label").isNull(), missing).otherwise(F.col("_label"))).drop("_label")


def complete(ratings: DataFrame, raters: int) -> DataFrame:
    """Ratings of items that every rater has labelled (the inner merge of the raters' tables)."""
    have = ratings.filter("label is not null").groupBy("item").agg(F.count_distinct("rater").alias("n")).filter(F.col("n") == raters)
    return ratings.join(have.select("item"), "item", "left_semi")


def fleiss_kappa(ratings: DataFrame) -> DataFrame:
    """One row: kappa (1.0 if chance agreement is 1), for items of equally many raters."""
    by = counts(ratings)
    item = by.groupBy("item").agg(F.sum("n").alias("r"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"))
    observed = item.agg(F.avg(F.col("pairs") / (F.col("r") * (F.col("r") - 1))).alias("po"))
    share = by.groupBy("label").agg(F.sum("n").alias("n")).agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("pe"))
    # both sides are one row
    return observed.join(F.broadcast(share)).select(F.when(F.col("pe") == 1, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def cohen_kappa(pairs: DataFrame) -> DataFrame:
    """One row: kappa of the columns a and b (1.0 if chance agreement is 1)."""
    cells = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left, right = cells.groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("x")), cells.groupBy(F.col("b").alias("k")).agg(F.sum("n").alias("y"))
    chance = left.join(right, "k").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    po, pe = F.col("same") / F.col("t"), F.coalesce("xy", F.lit(0)) / (F.col("t") * F.col("t"))
    return total.join(F.broadcast(chance)).select(F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def krippendorff_alpha(ratings: DataFrame, level: str = "nominal") -> DataFrame:
    """One row: alpha with nominal or interval differences, from label counts (no pairs of ratings are made)."""
    by = counts(ratings)
    unit = by.withColumn("m", F.sum("n").over(Window.partitionBy("item"))).filter("m > 1")
    x, n = F.col("label").cast("double"), F.col("n")
    if level == "nominal":
        differ = F.col("m") * F.col("m") - F.col("s2n")
        one = unit.groupBy("item", "m").agg(F.sum(n * n).alias("s2n")).select("m", (differ / (F.col("m") - 1)).alias("d"))
        whole = unit.groupBy("label").agg(F.sum("n").alias("n")).agg((F.sum("n") * F.sum("n") - F.sum(n * n)).alias("dt"), F.sum("n").alias("t"))
    else:
        # sum over pairs of (x - y)^2 is 2 (n sum x^2 - (sum x)^2)
        spread = 2 * (F.sum(n) * F.sum(n * x * x) - F.sum(n * x) * F.sum(n * x))
        one = unit.groupBy("item", "m").agg(spread.alias("s")).select("m", (F.col("s") / (F.col("m") - 1)).alias("d"))
        whole = unit.agg(spread.alias("dt"), F.sum("n").alias("t"))
    seen = one.agg(F.sum("d").alias("do"))
    return seen.join(F.broadcast(whole)).select(F.when(F.col("dt") == 0, 1.0).otherwise(1 - (F.col("do") / F.col("t")) / (F.col("dt") / (F.col("t") * (F.col("t") - 1)))).alias("alpha"))


def krippendorff_ordinal(ratings: DataFrame) -> DataFrame:
    """One row: alpha with ordinal differences (ratings up to and between two labels, less half of theirs, squared).

    Labels are a scale of a few values; items go through counts of (label, label) cells, not through pairs of ratings.
    """
    unit = counts(ratings).withColumn("m", F.sum("n").over(Window.partitionBy("item"))).filter("m > 1")
    scale = unit.groupBy("label").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy("label")))
    x = scale.select(F.col("label").alias("x"), F.col("n").alias("nx"), F.col("upto").alias("ux"))
    y = scale.select(F.col("label").alias("y"), F.col("n").alias("ny"), F.col("upto").alias("uy"))
    between = F.col("uy") - F.col("ux") + F.col("nx") - (F.col("nx") + F.col("ny")) / 2
    differ = x.join(y, F.col("x") < F.col("y")).select("x", "y", "nx", "ny", F.pow(between, 2).alias("d"))
    left = unit.select("item", "m", F.col("label").alias("x"), F.col("n").alias("a"))
    right = unit.select("item", F.col("label").alias("y"), F.col("n").alias("b"))
    cells = left.join(right, "item").filter("x < y").groupBy("x", "y").agg(F.sum(2 * F.col("a") * F.col("b") / (F.col("m") - 1)).alias("w"))
    whole = differ.join(cells, ["x", "y"], "left").agg(F.sum(F.coalesce("w", F.lit(0.0)) * F.col("d")).alias("do"), F.sum(2 * F.col("nx") * F.col("ny") * F.col("d")).alias("de"))
    total = scale.agg(F.sum("n").alias("t"))
    return whole.join(F.broadcast(total)).select(F.when(F.col("de").isNull() | (F.col("de") == 0), 1.0).otherwise(1 - (F.col("do") / F.col("t")) / (F.col("de") / (F.col("t") * (F.col("t") - 1)))).alias("alpha"))


def majority_or_mean(ratings: DataFrame) -> DataFrame:
    """item, label of most votes (where several have most: the mean of all votes, rounded half to even), tied."""
    by = counts(ratings)
    per = by.groupBy("item").agg(F.max("n").alias("top"), F.bround(F.sum(F.col("label") * F.col("n")) / F.sum("n"), 0).cast("int").alias("mean"))
    best = by.join(per, "item").filter("n = top").groupBy("item", "mean").agg(F.count("*").alias("k"), F.min("label").alias("label"))
    return best.select("item", F.when(F.col("k") == 1, F.col("label")).otherwise(F.col("mean")).cast("int").alias("label"), (F.col("k") > 1).alias("tied"))


def class_scores(pairs: DataFrame) -> DataFrame:
    """One row for columns expected and produced: accuracy, precision, recall and F1 weighted by expected labels, macro F1 (0 where undefined)."""
    cells = pairs.groupBy("expected", "produced").agg(F.count("*").alias("n"))
    hit = F.when(F.col("expected") == F.col("produced"), F.col("n")).otherwise(0)
    left = cells.groupBy(F.col("expected").alias("k")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    right = cells.groupBy(F.col("produced").alias("k")).agg(F.sum("n").alias("given"))
    both = left.join(right, "k", "full").na.fill(0, ["support", "tp", "given"])
    p = F.when(F.col("given") > 0, F.col("tp") / F.col("given")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    w = lambda c: F.sum(F.col("support") * c) / F.sum("support")
    return both.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), w(p).alias("precision"), w(r).alias("recall"), w(f).alias("f1"), F.avg(f).alias("macro_f1"))
