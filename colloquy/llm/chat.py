"""Chat formatting: collapse of cumulative snapshots, then ChatML rendering.

A logged conversation that is a prefix of a longer one (a snapshot taken before the last turns) is
dropped, of equal ones the smallest conv_id stays. Turn prefixes are told apart by rolling hashes:
the running sums of two 64-bit hashes of (position, role, text). Sums split: a conversation is dealt
in segments of ``SEGMENT`` turn numbers, each segment is summed alone and gets the totals of the
segments before it, so a huge conversation isn't one task's work. An anti-join of the distinct whole
hashes with the distinct proper prefixes leaves the maximal conversations.

Texts are shuffled once to put turns in order and once to render those that stay; all in between is
on rows of hashes.

Cases: null role or text counts as empty; null conv_id is one conversation; null turns sort first;
ties in turn sort by role and text; an exactly repeated row counts once. A rendered conversation
longer than ``SEGMENT`` turns comes in parts (part 0, 1, ...) to be concatenated in order. The string
``<|im_`` inside a role or text is written ``< |im_``. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize

SEGMENT = 256
#: Segments (some 50 bytes each) of conversations to keep that may be broadcast; with more, the texts are shuffled once more.
SMALL = 1_000_000
KEY = ["conv", "seg"]


def ordered_turns(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv (a struct of conv_id), seg, rn (place in the segment, from 1), role, text and two hashes h1 and h2 of these."""
    rows = conversations.select(
        F.struct("conv_id").alias("conv"),
        F.coalesce(F.floor(F.col("turn") / segment), F.lit(-(2**62))).alias("seg"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = Window.partitionBy(*KEY).orderBy("turn", "role", "text")
    rows = rows.withColumn("rn", F.dense_rank().over(order)).withColumn("again", F.row_number().over(order) > 1)
    rows = rows.withColumn("again", F.col("again") & (F.lag("rn").over(order) == F.col("rn"))).filter("not again")
    return rows.select(*KEY, "rn", "role", "text", *(F.xxhash64(F.lit(seed), "role", "text").alias(h) for seed, h in ((1, "h1"), (2, "h2"))))


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """conv, seg, pos (from 1), n_turns, and the rolling prefix hashes a and b."""
    whole = Window.partitionBy("conv")
    before = whole.orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    sizes = turns.groupBy(*KEY).agg(F.count("*").alias("n"))
    sizes = sizes.select(*KEY, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"), F.sum("n").over(whole).alias("n_turns"))
    rows = turns.select(*KEY, "rn", "h1", "h2").join(sizes, KEY).withColumn("pos", F.col("skip") + F.col("rn"))
    rows = materialize(rows.select(*KEY, "pos", "n_turns", *(F.xxhash64(F.lit(seed), "pos", "h1", "h2").cast("decimal(20,0)").alias(c) for seed, c in ((3, "a"), (4, "b")))))
    sums = rows.groupBy(*KEY).agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    zero = F.lit(0).cast("decimal(38,0)")
    sums = sums.select(*KEY, *(F.coalesce(F.sum(s).over(before), zero).cast("decimal(38,0)").alias(s) for s in ("sa", "sb")))
    run = Window.partitionBy(*KEY).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = materialize(rows.join(sums, KEY).select(*KEY, "pos", "n_turns", *((F.col(f"s{c}") + F.sum(c).over(run)).cast("decimal(38,0)").alias(c) for c in ("a", "b"))))
    discard(rows)
    return out


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """conv and n_copies (equal conversations) of those that are no proper prefix of another."""
    whole = prefixes.filter("pos = n_turns").groupBy("pos", "a", "b").agg(F.min("conv.conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = prefixes.filter("pos < n_turns").select("pos", "a", "b").distinct()
    return whole.join(proper, ["pos", "a", "b"], "left_anti").select(F.struct("conv_id").alias("conv"), "n_copies")


def render(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """ChatML text for each conv_id and part of ``turns`` (conv, pos, role, text, n_turns, n_copies)."""
    safe = lambda c: F.replace(F.col(c), F.lit("<|im_"), F.lit("< |im_"))
    chunk = F.concat(F.lit("<|im_start|>"), safe("role"), F.lit("\n"), safe("text"), F.lit("<|im_end|>\n"))
    parts = turns.groupBy("conv", F.floor((F.col("pos") - 1) / segment).alias("part")).agg(
        F.max("n_turns").alias("n_turns"), F.max("n_copies").alias("n_copies"), F.sort_array(F.collect_list(F.struct("pos", chunk.alias("chunk")))).alias("chunks")
    )
    return parts.select(F.col("conv.conv_id").alias("conv_id"), "part", "n_turns", "n_copies", F.array_join(F.col("chunks.chunk"), "").alias("rendered"))


def format_chats(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    turns = materialize(ordered_turns(conversations, segment))
    prefixes = turn_prefixes(turns)
    own = prefixes.groupBy(*KEY).agg((F.min("pos") - 1).alias("skip"), F.max("n_turns").alias("n_turns"))
    kept = materialize(own.join(maximal_conversations(prefixes), "conv"))
    discard(prefixes)
    rows = turns.join(F.broadcast(kept) if kept.count() <= SMALL else kept, KEY)
    return render(rows.withColumn("pos", F.col("skip") + F.col("rn")), segment)


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = r"""
WITH d AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
r AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
             md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY turn NULLS FIRST, role, text) OVER w) AS h
      FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (SELECT n, h, min(conv_id) AS conv_id, count(*) AS n_copies FROM r WHERE pos = n GROUP BY n, h),
k AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.pos = f.n AND r.h = f.h AND r.n > f.n))
SELECT r.conv_id, CAST(floor((r.pos - 1) / 256) AS BIGINT) AS part, k.n AS n_turns, k.n_copies,
       string_agg('<|im_start|>' || replace(role, '<|im_', '< |im_') || chr(10) || replace(text, '<|im_', '< |im_') || '<|im_end|>' || chr(10), '' ORDER BY r.pos) AS rendered
FROM r JOIN k ON r.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY r.conv_id, part, k.n, k.n_copies
"""
