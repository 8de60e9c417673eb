"""Document fingerprints by SpotSigs, DataFrame functions only.

Common words (articles, forms of "be", prepositions and the like) are anchors. A signature is an anchor and the ``CHAIN`` content words
that follow it; before each content word up to ``SKIP`` anchors are passed over, and an anchor that doesn't reach them gives none. A text
without signatures has one of all its words, a text without words one of itself, an empty text none. The set of a
text's distinct signatures is its fingerprint. Chains stand in the prose of a text rather than in headings, menus or lists, and
each has a bounded reach, so the work is in proportion to the text.

Two sets are compared by their Jaccard index, pruned: sets lie in partitions by their length, whose bounds grow by 1 / ``least``
(``partition_of``); sets of partitions that aren't neighbours can't reach ``least`` and count as 0 without a look at them, as do sets that the
lengths or the ranges of their signatures rule out; equal sets count as 1. Only the others are intersected. With ``least`` 0, as in the
query, nothing but certain results is pruned and every likeness is exact.

For the next document of each one (by descending doc_id), texts are dealt by ranges of (doc_id, hash of the text), whose bounds are from a
sample that grows with the number of tasks; the first text of a range is sent to the range before it as well. Texts are shuffled once.

Cases: null text counts as empty; rows that share an id stay rows of their own, in the order of their texts' hashes, descending; null ids come
last; one document is its own next one; two empty sets are of likeness 1; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lowest, materialize, n_partitions

CHAIN, SKIP = 2, 3
#: Sampled keys for each task.
SAMPLE = 16
#: Anchors (fixed values): common words of English, German, French and Spanish.
ANCHORS = """
a an the this that these those is are was were be been am has have had do does did can could will would should may might must
of to in for on with as at by from it he she they we you i and or but not if so than then there
der die das den dem des ein eine einer eines einem einen und oder aber nicht ist sind war waren hat haben wird werden kann
in im zu zum zur von vom mit auf für an am bei aus nach als auch sich es er sie wir ihr
le la les l un une des du de d et ou mais ne pas est sont était étaient a ont au aux en dans par pour sur avec que qui ce cette se il elle ils
el los las lo un una unos unas y o pero no es son era eran ha han al del en con por para su sus se que como más
""".split()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), for which value is worked out once."""
    return F.transform(F.array(value), use)[0]


def spots(text: Column, chain: int = CHAIN, skip: int = SKIP) -> Column:
    """Distinct signatures (16 hexadecimal digits) of a text that isn't null, in order."""
    next_word = r"(?: #[^ ]++){0,%d}+ [^# ][^ ]*+" % skip

    def chains(plain: Column) -> Column:
        # " #the word word #of word "
        marked = F.regexp_replace(plain, f"(?<= )(?=(?:{'|'.join(sorted(set(ANCHORS)))}) )", "#")
        found = F.regexp_extract_all(marked, F.lit(f"(?=(#[^ ]++(?:{next_word}){{{chain}}}))#"), F.lit(1))
        whole = F.when(plain != "  ", F.array(plain)).when(text != "", F.array(text)).otherwise(F.array().cast("array<string>"))
        return let(found, lambda x: F.when(F.size(x) > 0, F.transform(x, lambda c: F.regexp_replace(c, " #[^ ]+", ""))).otherwise(whole))

    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    return F.array_sort(F.array_distinct(F.transform(let(plain, chains), lambda c: F.substring(F.md5(c.cast("binary")), 1, 16))))


def partition_of(size: Column, least: float) -> Column:
    """Partition of a set by its length: sets whose Jaccard index reaches ``least`` are of the same or neighbouring ones."""
    return F.floor(F.ln(F.greatest(size, F.lit(1))) / -math.log(least) + 1e-9)


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard index of two sorted arrays of distinct strings; 0 where it is known to be less than ``least``."""
    n, m = F.size(a), F.size(b)
    small, large = F.least(n, m), F.greatest(n, m)
    apart = (small == 0) | (a[0] > b[m - 1]) | (b[0] > a[n - 1])
    if least > 0:
        apart = apart | (F.abs(partition_of(n, least) - partition_of(m, least)) > 1) | (small < least * large)
    index = let(F.size(F.array_intersect(a, b)), lambda shared: shared / (n + m - shared))
    return F.when(a == b, 1.0).when(apart, 0.0).otherwise(let(index, lambda x: F.when(x >= least, x).otherwise(0.0)))


def first_above(bounds: list[Row], key: Column) -> Column:
    """How many of the descending bounds are at or above the key: in two steps, of about the root of their number."""
    width = max(1, math.isqrt(len(bounds)))
    as_struct = [F.struct(F.lit(r.doc_id).cast("long").alias("doc_id"), F.lit(r.h).cast("long").alias("h")) for r in bounds]
    groups = [F.array(*as_struct[i : i + width]) for i in range(0, len(as_struct), width)]
    if not groups:
        return F.lit(0)
    heads = F.array(*as_struct[::width])
    over = lambda found: F.size(F.filter(found, lambda x: x >= key))
    which = over(heads)
    return F.when(which == 0, 0).otherwise((which - 1) * width + over(F.element_at(F.array(*groups), F.greatest(which, F.lit(1)))))


def with_next(docs: DataFrame, value: Callable[[Column], Column], name: str = "next") -> DataFrame:
    """doc_id, text, value(text) of every row of ``docs`` (doc_id, text), and text and value of the next row by descending doc_id (after the last the first), as columns ``name``_text and ``name``_value."""
    tasks = n_partitions(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    key = F.struct("doc_id", F.xxhash64("text").alias("h"))
    keys = materialize(rows.select(key.alias("key")).select("key.*"))
    n = keys.count()
    sample = sorted(lowest(keys, "doc_id", "h", k=SAMPLE * tasks, n=n), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h), reverse=True)
    bounds = sample[SAMPLE::SAMPLE] if n > SAMPLE * tasks else [sample[len(sample) * i // tasks] for i in range(1, tasks) if len(sample) >= tasks]
    part = first_above(bounds, F.struct("doc_id", "h"))
    # the first key of each part: as many rows as there are tasks
    firsts = keys.withColumn("part", part).groupBy("part").agg(F.max(F.struct("doc_id", "h")).alias("key")).select("part", "key.*").orderBy(F.desc("doc_id"), F.desc("h")).collect()
    to = {(r.doc_id, r.h): firsts[i - 1].part for i, r in enumerate(firsts)}
    given = docs.sparkSession.createDataFrame([(*k, p) for k, p in to.items()], "first_id long, first_h long, part int")
    dealt = rows.select("doc_id", "text", F.xxhash64("text").alias("h"))
    heads = dealt.join(F.broadcast(given), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))).dropDuplicates(["part"])
    both = dealt.select("doc_id", "h", "text", part.cast("int").alias("part"), F.lit(False).alias("head")).unionByName(heads.select("doc_id", "h", "text", "part", F.lit(True).alias("head")))
    order = Window.partitionBy("part").orderBy("head", F.desc("doc_id"), F.desc("h"))
    near = both.repartitionById(max(1, len(bounds) + 1), F.col("part")).select("*", value(F.col("text")).alias("value"))
    return near.select("doc_id", "text", "value", "head", F.lead("text").over(order).alias(f"{name}_text"), F.lead("value").over(order).alias(f"{name}_value")).filter("not head").drop("head")


def document_fingerprints(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_chars, edited (its text, the last half of which is replaced by the start of the next document),
    spots and edited_spots (the sets), near_edited and near_next (likeness to the edited text and to the next document)."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    rows = with_next(docs, spots).select("doc_id", n.cast("long").alias("n_chars"), F.col("value").alias("spots"), "next_value", edited.alias("edited"))
    rows = rows.withColumn("edited_spots", spots(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", "edited", "spots", "edited_spots",
        likeness(F.col("spots"), F.col("edited_spots"), least).alias("near_edited"),
        likeness(F.col("spots"), F.col("next_value"), least).alias("near_next"),
    )


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.array_join("spots", "").alias("fingerprint"),
        F.array_join("edited_spots", "").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
o AS (SELECT doc_id, text, n, coalesce(lead(text) OVER (ORDER BY doc_id DESC NULLS LAST), first_value(text) OVER (ORDER BY doc_id DESC NULLS LAST)) AS next FROM d),
t AS (SELECT row_number() OVER () AS k, doc_id, n, text, next, substr(text, 1, n - n // 2) || substr(next, 1, n // 2) AS edited FROM o),
x AS (SELECT k, 0 AS kind, text AS s FROM t UNION ALL SELECT k, 1, edited FROM t UNION ALL SELECT k, 2, next FROM t),
w AS (SELECT k, kind, s, regexp_extract_all(lower(s), '[\p{L}\p{N}]+') AS ws FROM x),
u AS (SELECT k, kind, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
a AS (SELECT k, kind, word, i, word IN (ANCHOR_WORDS) AS anchor FROM u),
c AS (SELECT k, kind, word, i, lead(word) OVER p AS word2, lead(i) OVER p AS i2 FROM a WHERE NOT anchor WINDOW p AS (PARTITION BY k, kind ORDER BY i)),
g AS (SELECT k, kind, word, i, anchor, count(CASE WHEN NOT anchor THEN 1 END) OVER (PARTITION BY k, kind ORDER BY i) AS before FROM a),
n AS (SELECT k, kind, word, i, i2, word2, row_number() OVER (PARTITION BY k, kind ORDER BY i) AS before FROM c),
q AS (SELECT DISTINCT g.k, g.kind, substr(md5('#' || g.word || ' ' || n.word || ' ' || n.word2), 1, 16) AS sig
      FROM g JOIN n ON g.k = n.k AND g.kind = n.kind AND n.before = g.before + 1
      WHERE g.anchor AND n.i - g.i <= 4 AND n.i2 - n.i <= 4),
f AS (SELECT k, kind, list_sort(list(sig)) AS sigs FROM q GROUP BY ALL),
e AS (SELECT w.k, w.kind, CASE WHEN f.sigs IS NOT NULL THEN f.sigs WHEN len(ws) > 0 THEN [substr(md5(' ' || array_to_string(ws, ' ') || ' '), 1, 16)] WHEN s <> '' THEN [substr(md5(s), 1, 16)] ELSE [] END AS sigs
      FROM w LEFT JOIN f USING (k, kind))
SELECT t.doc_id, t.n AS n_chars, sha256(t.edited) AS edited_sha256, array_to_string(a.sigs, '') AS fingerprint, array_to_string(b.sigs, '') AS edited_fingerprint,
       CASE WHEN a.sigs = b.sigs THEN 1.0::DOUBLE ELSE len(list_intersect(a.sigs, b.sigs))::DOUBLE / len(list_distinct(a.sigs || b.sigs)) END AS near_edited,
       CASE WHEN a.sigs = c.sigs THEN 1.0::DOUBLE ELSE len(list_intersect(a.sigs, c.sigs))::DOUBLE / len(list_distinct(a.sigs || c.sigs)) END AS near_next
FROM t JOIN e a ON t.k = a.k AND a.kind = 0 JOIN e b ON t.k = b.k AND b.kind = 1 JOIN e c ON t.k = c.k AND c.kind = 2
""".replace("ANCHOR_WORDS", ", ".join(f"'{w}'" for w in ANCHORS))
