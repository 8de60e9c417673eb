"""Filter interaction audit: what each filter removes in every order of the filters.

A document is the set (mask) of the filters that it fails. In an order of the filters it is removed at the
first step whose filter is in the mask. Orders are numbered by their Lehmer rank, that is alphabetically, so all
orders that begin with the same filters are one interval of ranks, and the ranks at which a mask is removed at
a step, or meets one of its filters after that, are a few disjoint intervals (``mask_intervals``). The
number of documents of a mask is added at the start of each interval and taken off at its end; running sums over
the ranks give every order at once. Documents are read once, as flags; from then on there are at most
32 rows (for five filters) a part.

Cases: null text counts as empty; a null part is the empty string; repeated rows are rows of their own; a null
doc_id has no labels and is no earlier copy, and rows with one have none before them; of several labels of a
doc_id any 1 counts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, n_partitions

FILTERS = "ABCDE"
SIZES = ("n", "good", "toxic")


def mask_intervals(letters: str) -> Iterator[tuple[int, int, bool, int, int]]:
    """(mask, step, first, lo, hi): the orders of ranks lo to hi - 1 meet a filter of the mask at the step; ``first``: it removes."""
    k = len(letters)

    def walk(mask: int, left: str, lo: int, removed: bool) -> Iterator[tuple[int, bool, int, int]]:
        width = factorial(len(left) - 1) if left else 0
        for i, c in enumerate(left):
            at = lo + i * width
            fails = mask >> letters.index(c) & 1
            if fails:
                yield k - len(left) + 1, not removed, at, at + width
            yield from walk(mask, left[:i] + left[i + 1 :], at, removed or bool(fails))

    for mask in range(1, 1 << k):
        last = None
        for step, first, lo, hi in sorted(walk(mask, letters, 0, False)):
            # neighbours are one interval
            if last and last[:2] == (step, first) and last[3] == lo:
                last = (*last[:3], hi)
                continue
            if last:
                yield (mask, *last)
            last = (step, first, lo, hi)
        yield (mask, *last)


def filter_audit(flags: DataFrame, letters: str = FILTERS) -> DataFrame:
    """part, filter_order, step and the counts of every order of the filters.

    flags: part, mask (bit i: fails letters[i]), n, good, toxic: numbers of documents, in any number of rows a part and mask.
    """
    spark = flags.sparkSession
    k, orders = len(letters), ["".join(p) for p in permutations(letters)]
    # read twice below
    counts = materialize(flags.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in SIZES)))
    single = [F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)).alias(c) for i, c in enumerate(letters)]
    parts = counts.groupBy("part").agg(F.sum("n").alias("total"), F.array(*single).alias("single"))
    # a row for each end of an interval: bounded by the filters (for five, some 5,300)
    ends = [(m, s, first, at, sign) for m, s, first, lo, hi in mask_intervals(letters) for at, sign in ((lo, 1), (hi, -1)) if at < len(orders)]
    steps = spark.createDataFrame(ends, "mask int, step int, first boolean, rank int, sign long")
    change = [F.sum(F.when(F.col("first"), F.col("sign") * F.col(c)).otherwise(0)).alias(c) for c in SIZES]
    changes = counts.join(F.broadcast(steps), "mask").groupBy("part", "step", "rank").agg(*change, F.sum(F.when(~F.col("first"), F.col("sign") * F.col("n")).otherwise(0)).alias("late"))
    grid = parts.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k)))).withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1))))
    by_rank = Window.partitionBy("part", "step").orderBy("rank")
    summed = {c: F.coalesce(F.sum(c).over(by_rank), F.lit(0)) for c in (*SIZES, "late")}
    order = F.array(*map(F.lit, orders))[F.col("rank")]
    by_step = Window.partitionBy("part", "rank").orderBy("step")
    return (
        grid.join(changes, ["part", "step", "rank"], "left")
        .select("part", "step", "rank", "total", "single", *(v.alias(c) for c, v in summed.items()))
        .withColumn("filter_order", order)
        .withColumn("letter", F.substr("filter_order", F.col("step"), F.lit(1)))
        .select(
            "part",
            "filter_order",
            "step",
            (F.col("total") - F.sum("n").over(by_step)).alias("kept"),
            F.col("n").alias("removed"),
            F.col("late").alias("redundant"),
            F.col("single")[F.instr(F.lit(letters), F.col("letter")) - 1].alias("unique_fails"),
            F.col("good").alias("good_lost"),
            F.col("toxic").alias("toxic_lost"),
            F.sum("n").over(Window.partitionBy("part", "letter")).alias("shapley"),
        )
    )


def text_mask(text: Column) -> Column:
    """Bits 0 to 3 of a text that isn't null: few words, repeated words, capitals, signs."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    tests = (
        n < 100,
        F.lit(100) * distinct < F.lit(80) * n,
        F.lit(100) * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > F.lit(10) * F.length(text),
        text.rlike("[#$%&*|]"),
    )
    return reduce(Column.bitwiseOR, (F.when(t, F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(tests)))


def document_flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic of ``docs`` (doc_id, text, lang), grouped; bit 4: a smaller doc_id has the same text.

    Texts are told apart by their SHA-256 and never shuffled. Copies of a text are counted by part and label
    before they meet, so a text that a third of all rows have is a few rows for each task.
    """
    salts = n_partitions(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = (
        docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text_mask(text).alias("mask"))
        .groupBy("doc_id", "part", "digest", "mask")
        .agg(F.count("*").alias("n"))
        # null ids match no label; they are spread by their texts
        .withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(salts))).otherwise(0))
    )
    known = labels.groupBy("doc_id").agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic")))).withColumn("salt", F.lit(0).cast("long"))
    least = F.min("least").over(Window.partitionBy("digest"))
    groups = (
        rows.join(known, ["doc_id", "salt"], "left")
        .groupBy("digest", "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
            F.min("doc_id").alias("least"),
            F.coalesce(F.min_by("n", "doc_id"), F.lit(0)).alias("n_least"),
        )
        .withColumn("first", F.col("nameless") + F.when(F.col("least") == least, F.col("n_least")).otherwise(0))
    )
    sides = F.array(
        F.struct(F.col("mask"), F.col("first").alias("n")),
        F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("first")).alias("n")),
    )
    split = groups.select("part", F.col("good").alias("is_good"), F.col("toxic").alias("is_toxic"), F.inline(sides))
    return split.filter("n > 0").select("part", "mask", "n", (F.col("is_good") * F.col("n")).alias("good"), (F.col("is_toxic") * F.col("n")).alias("toxic"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(document_flags(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")))


SQL = r"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
                  list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
e AS (SELECT text, min(doc_id) AS least FROM t GROUP BY text),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b,
             100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 10 * length(t.text) AS c,
             regexp_matches(t.text, '[#$%&*|]') AS d, coalesce(t.doc_id > least, false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
      FROM t JOIN e USING (text) LEFT JOIN l ON t.doc_id = l.doc_id),
m AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails,
             count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order
      FROM (SELECT unnest(['A','B','C','D','E']) AS c) a, (SELECT unnest(['A','B','C','D','E']) AS c) b, (SELECT unnest(['A','B','C','D','E']) AS c) c, (SELECT unnest(['A','B','C','D','E']) AS c) d, (SELECT unnest(['A','B','C','D','E']) AS c) e
      WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM o),
x AS (SELECT part, filter_order, step, filter_order[step] AS letter, fails, n, good, toxic,
             contains(fails, filter_order[step]) AS here, length(translate(filter_order[1:step - 1], fails, '')) < step - 1 AS before FROM m, s),
r AS (SELECT part, filter_order, step, letter,
             CAST(sum(CASE WHEN here OR before THEN 0 ELSE n END) AS BIGINT) AS kept, CAST(sum(CASE WHEN here AND NOT before THEN n ELSE 0 END) AS BIGINT) AS removed,
             CAST(sum(CASE WHEN here AND before THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN fails = letter THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
             CAST(sum(CASE WHEN here AND NOT before THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN here AND NOT before THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
      FROM x GROUP BY ALL)
SELECT * EXCLUDE (letter), CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r
"""
