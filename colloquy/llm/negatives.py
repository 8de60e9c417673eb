"""Hard-negative mining: bands of scores below an anchor's positives, found by segment summaries.

A vector is cut into 1, 4 and 16 (``LEVELS``) segments of neighbouring components. With the mean m and the deviation d
(the length of what is left once the mean is taken off) of each segment of w components, the inner product of x and y lies within

    sum over segments of  w m_x m_y  -  d_x d_y   and   sum of  w m_x m_y  +  d_x d_y,

and finer segments give narrower bounds. A pair that the bounds of a level rule out is never looked at again; what is left
after the finest level is scored exactly, in whole numbers.

1. Rows, in order of (label, id), are packed in blocks of ``ROWS`` with their summaries; so are the anchors (``ANCHORS`` a block).
2. Positives: each block of anchors meets the blocks that hold its labels; bounds are held against the anchor's k-th best score so far.
3. Negatives: each block of anchors, now with its positives, meets all blocks. A positive score p asks for the best scores in
   [low p, high p]; upper bounds are held against the k-th best so far in that band (or its low end), lower bounds against its high end.
   Each task sends on at most k rows a band; the best k of these are the result.

A block of anchors is some MB, so the rows are sent once for each ``ANCHORS`` anchors, in parts of ``GROUP`` blocks, each a task of bounded size
whatever the labels: a label that holds most rows is many blocks. On vectors without structure bounds rule out little, and most pairs are
scored exactly, in blocks.

Cases: rows with a null id, label or vector or a null, NaN or infinite component take no part. Shorter vectors count as filled with
zeros. Rows with the anchor's id are none of its positives or negatives; other repeated rows are rows of their own; equal
anchor rows (id, label, vector) are one anchor. Anchors without positives have no rows. Scores past 64 bits saturate. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, n_partitions, pack, unpack
from .topk import LEAST, NO_ID, merge_best, products

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
LEVELS = (1, 4, 16)
ROWS = 4096
ANCHORS = 16384
GROUP = 16
#: Anchors that are scored at a time; up to which share of pairs left they are worked out one by one.
STEP = 256
SPARSE = 0.05


def labelled(embeddings: DataFrame, moved: int = 7, labels: int = 10) -> DataFrame:
    """vec_id, label, vec (whole numbers) of the rows that take part; the labels of ids divisible by ``moved`` go up by one."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % moved == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")).cast("long")
    vec = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long"))
    some = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    return embeddings.filter(some & finite).select("vec_id", label.alias("label"), vec.alias("vec"))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The lists of an Arrow column as rows, filled with zeros."""
    column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def summaries(vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level the means (times the root of the segment's width) and deviations, rows x segments."""
    width = vectors.shape[1]
    whole = vectors.astype(float)
    out = []
    for n in LEVELS:
        cuts = np.linspace(0, width, min(n, width) + 1).astype(int)
        size = np.diff(cuts)
        mean = np.add.reduceat(whole, cuts[:-1], 1) / size
        rest = np.add.reduceat((whole - np.repeat(mean, size, 1)) ** 2, cuts[:-1], 1)
        out.append(((mean * np.sqrt(size)).astype(np.float32), np.sqrt(rest).astype(np.float32)))
    return out


class Block:
    """Ids, labels and vectors of some rows, and the summaries of their segments."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.labels = ids, labels
        self.vectors = signed(vectors)
        self.norm = np.sqrt((vectors.astype(float) ** 2).sum(1))
        self.levels = summaries(vectors)


def signed(values: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest signed type."""
    most = int(max(values.max(initial=0), -(values.min(initial=0) + 1)))
    return values.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(t).max))


def wanted_pairs(anchors: Block, own: slice, rows: Block, alive: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the pairs of ``alive`` (anchors of ``own`` x rows) with scores from ``low`` to ``high`` (by anchor)."""
    # room for summaries of 24 bits
    slack = 1e-6 * anchors.norm[own]
    above, below = np.where(low == LEAST, -np.inf, low), np.where(high == NO_ID, np.inf, high)
    for (mean, dev), (row_mean, row_dev) in zip(anchors.levels, rows.levels, strict=True):
        left = np.count_nonzero(alive)
        if left > SPARSE * alive.size:
            middle = mean[own].astype(float) @ row_mean.T.astype(float)
            reach = dev[own].astype(float) @ row_dev.T.astype(float)
            reach += slack[:, None] * rows.norm + 1e-6
            alive &= (middle + reach >= above[:, None]) & (middle - reach <= below[:, None])
        elif left:
            a, r = np.nonzero(alive)
            middle = (mean[own][a].astype(float) * row_mean[r]).sum(1)
            reach = (dev[own][a].astype(float) * row_dev[r]).sum(1) + slack[a] * rows.norm[r] + 1e-6
            alive[a, r] = (middle + reach >= above[a]) & (middle - reach <= below[a])
    if np.count_nonzero(alive) > SPARSE * alive.size:
        scores = products(anchors.vectors[own], rows.vectors)
        a, r = np.nonzero(alive & (scores >= low[:, None]) & (scores <= high[:, None]))
        return a, r, scores[a, r]
    a, r = np.nonzero(alive)
    scores = pair_products(anchors.vectors[own][a], rows.vectors[r])
    fits = (scores >= low[a]) & (scores <= high[a])
    return a[fits], r[fits], scores[fits]


def pair_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole inner products of rows of a with the same rows of b."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    if most < 2**62:
        return (a.astype(np.int64) * b.astype(np.int64)).sum(1)
    return np.clip((a.astype(object) * b.astype(object)).sum(1), LEAST + 1, NO_ID).astype(np.int64)


def pack_blocks(per: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for i, table in enumerate(filled(batches, per)):
            labels = table["label"].to_numpy()
            data = pack(Block(table["vec_id"].to_numpy(), labels, matrix(table["vec"], width)))
            columns = ([part], [(part << 32) + i], [np.unique(labels)], [data])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()), strict=True)], ["part", "block", "labels", "data"])

    return run


def filled(batches: Iterator[pa.RecordBatch], per: int) -> Iterator[pa.Table]:
    """The rows of the batches, ``per`` at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        while sum(b.num_rows for b in held) >= per:
            table = pa.Table.from_batches(held)
            yield table.slice(0, per)
            held = table.slice(per).to_batches()
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def find_positives(k: int):
    def run(parts: pa.Table, asked: pa.Table) -> pa.Table:
        (anchors,) = unpack(asked["data"][0].as_py())
        scores, found = np.full((len(anchors.ids), k), LEAST, np.int64), np.full((len(anchors.ids), k), NO_ID, np.int64)
        for data in parts["data"]:
            (rows,) = unpack(data.as_py())
            for at in range(0, len(anchors.ids), STEP):
                own = slice(at, at + STEP)
                alive = (anchors.labels[own, None] == rows.labels) & (anchors.ids[own, None] != rows.ids)
                if alive.any():
                    a, r, s = wanted_pairs(anchors, own, rows, alive, scores[own, -1], np.full(alive.shape[0], NO_ID))
                    merge_best(scores, found, at + a, s, rows.ids[r])
        a, i = np.nonzero(found != NO_ID)
        return pa.table({"block": pa.array(np.full(len(a), asked["block"][0].as_py()), pa.int64()), "at": pa.array(a, pa.int32()), "vec_id": pa.array(found[a, i]), "score": pa.array(scores[a, i])})

    return run


def with_positives(k: int):
    def run(found: pa.Table, asked: pa.Table) -> pa.Table:
        (anchors,) = unpack(asked["data"][0].as_py())
        ids, scores = np.zeros((len(anchors.ids), k), np.int64), np.zeros((len(anchors.ids), k), np.int64)
        known = np.zeros((len(anchors.ids), k), bool)
        at, rank = found["at"].to_numpy(), found["rank"].to_numpy() - 1
        ids[at, rank], scores[at, rank], known[at, rank] = found["vec_id"].to_numpy(), found["score"].to_numpy(), True
        return pa.table({"block": asked["block"], "data": pa.array([pack(anchors, ids, scores, known)], pa.binary())})

    return run


def find_negatives(k: int, low: int, high: int):
    def run(parts: pa.Table, asked: pa.Table) -> pa.Table:
        anchors, ids, scores, known = unpack(asked["data"][0].as_py())
        m, bands = known.shape
        # in Python's whole numbers, which don't overflow
        least = np.array([[-(-low * p // 100) for p in row] for row in scores.tolist()], np.int64).reshape(m, bands)
        most = np.array([[high * p // 100 for p in row] for row in scores.tolist()], np.int64).reshape(m, bands)
        known &= least <= most
        best, found = np.full((m * bands, k), LEAST, np.int64), np.full((m * bands, k), NO_ID, np.int64)
        for data in parts["data"]:
            (rows,) = unpack(data.as_py())
            for at in range(0, m, STEP):
                own = slice(at, at + STEP)
                some = known[own]
                alive = (anchors.labels[own, None] != rows.labels) & (anchors.ids[own, None] != rows.ids) & some.any(1)[:, None]
                if not alive.any():
                    continue
                reached = np.maximum(least[own], best[:, -1].reshape(m, bands)[own])
                a, r, s = wanted_pairs(anchors, own, rows, alive, np.where(some, reached, NO_ID).min(1), np.where(some, most[own], LEAST).max(1))
                for p in range(bands):
                    fits = some[a, p] & (s >= reached[a, p]) & (s <= most[own][a, p])
                    merge_best(best, found, (at + a[fits]) * bands + p, s[fits], rows.ids[r[fits]])
        b, i = np.nonzero(found != NO_ID)
        a, p = b // bands, b % bands
        columns = (anchors.ids[a], ids[a, p], found[b, i], scores[a, p], best[b, i])
        keys = {"block": pa.array(np.full(len(b), asked["block"][0].as_py()), pa.int64()), "band": pa.array(b, pa.int32())}
        return pa.table(keys | {n: pa.array(c, pa.int64()) for n, c in zip(("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"), columns, strict=True)})

    return run


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the rows (vec_id, label, vec) and anchors (the same columns).

    low, high: the ends of the band of negative scores, in hundredths of the positive score.
    """
    spark = rows.sparkSession
    n, width = rows.agg(F.count("*"), F.max(F.size("vec"))).first()
    parts = max(1, -(-n // (ROWS * GROUP)), min(n_partitions(spark), -(-n // 1024)))
    schema = "part int, block long, labels array<long>, data binary"
    packed = materialize(rows.repartitionByRange(parts, "label", "vec_id").mapInArrow(pack_blocks(ROWS, max(width or 0, 1)), schema), blobs=True)
    asked = anchors.select("vec_id", "label", "vec").distinct()
    asked = materialize(asked.repartitionByRange(max(1, -(-asked.count() // ANCHORS)), "label", "vec_id").mapInArrow(pack_blocks(ANCHORS, max(width or 0, 1)), schema), blobs=True)
    # blocks and parts that share a label
    meet = materialize(packed.select("part", F.explode("labels").alias("label")).distinct().join(asked.select("block", F.explode("labels").alias("label")), "label").select("part", "block").distinct())
    near = packed.select("part", "data").join(meet, "part").groupBy("part", "block").cogroup(asked.select("block", "data").join(meet.toDF("part", "block"), "block").groupBy("part", "block"))
    best = Window.partitionBy("block", "at").orderBy(F.desc("score"), "vec_id")
    found = near.applyInArrow(find_positives(positives), "block long, at int, vec_id long, score long").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= positives)
    known = found.groupBy("block").cogroup(asked.select("block", "data").groupBy("block")).applyInArrow(with_positives(positives), "block long, data binary")
    known = materialize(known, blobs=True)
    asked_of = known.toDF("block", "data").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    spread = packed.select("part", "data").join(asked_of.select("part", "block").toDF("part", "block"), "part")
    types = ", ".join(f"{c} long" for c in ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"))
    some = spread.groupBy("part", "block").cogroup(asked_of.groupBy("part", "block")).applyInArrow(find_negatives(negatives, low, high), f"block long, band int, {types}")
    best = Window.partitionBy("block", "band").orderBy(F.desc("negative_score"), "negative_id")
    ranked = some.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return hard_negatives(rows, rows.filter("vec_id % 100 = 0"))


SQL = """
WITH v AS (SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.vec, c.vec) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER best <= 10
"""
