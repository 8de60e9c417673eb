"""Exact top-k inner-product search with M-trees.

Components are turned into floor(256 * x). Largest inner product is made nearest neighbour by one more
component, sqrt(M^2 - |x|^2) (0 in queries; M is the largest norm in a tree), a metric in which
d^2 = |q|^2 + M^2 - 2 q.x. Candidates are range-partitioned by (nearest of ``PIVOTS`` sampled vectors,
id), which also splits a region that holds most of the rows; each partition is bulk-loaded
into paged M-trees: a page has a centre, a covering radius and its distance to the parent page's
centre; leaf entries have theirs to the leaf's centre. Queries are packed in blocks of ``BLOCK``;
each meets each tree. A query always opens its pending page of the least lower bound and ends when
that is beyond its k-th distance; entries that |d(q, parent) - d(parent, entry)| already rules out
are never compared. Its first k-th score comes from the bounded sample, so far trees end at the root. A block of queries is some MB and
searched ``STEP`` queries at a time, so the trees are sent once for ``BLOCK`` queries.

Every score is an exact whole number; bounds leave room for rounding and never cut ties.

Cases: null vectors and vectors with null, NaN or infinite components, and rows with a null id, take
no part. Shorter vectors count as filled with zeros. Rows with the query's id aren't its candidates;
repeated candidate rows are ranked as rows of their own; equal query rows are asked once. Scores past
64 bits saturate. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lowest, materialize, pack, unpack

K = 5
PIVOTS = 64
SAMPLE = 1024
TREE = 8192
PAGE = 512
FANOUT = 16
BLOCK, STEP = 16384, 1024
LEAST, NO_ID = -(2**63), 2**63 - 1


def quantised(embeddings: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vec = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long"))
    return embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select("vec_id", vec.alias("vec"))


def matrix(rows: list, width: int | None = None) -> np.ndarray:
    width = max(map(len, rows), default=0) if width is None else width
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole inner products of the rows of a and b, shorter rows filled with zeros."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(width, 1)
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return np.clip(a.astype(object) @ b.T.astype(object), LEAST + 1, NO_ID).astype(np.int64).reshape(len(a), len(b))


class MTree:
    """A bulk-loaded M-tree. Pages are numbered so that children come after their parent."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        square = (vectors.astype(np.float64) ** 2).sum(1)
        self.norm = math.sqrt(square.max(initial=0))
        points = np.column_stack([vectors, np.sqrt(np.maximum(square.max(initial=0) - square, 0))])
        self.center, self.radius, self.parent_distance, self.children, self.leaf = [], [], [], [], []
        order, away = [], []
        todo = [(np.arange(len(ids)), None, -1)]
        while todo:
            rows, middle, parent = todo.pop(0)
            page = len(self.center)
            middle = rows[0] if middle is None else middle
            far = distance(points[rows], points[middle])
            self.center.append(int(middle))
            self.radius.append(float(far.max()))
            self.parent_distance.append(float(distance(points[middle], points[self.center[parent]])) if parent >= 0 else 0.0)
            self.children.append([])
            self.leaf.append((0, 0))
            if parent >= 0:
                self.children[parent].append(page)
            if len(rows) <= PAGE:
                by = np.argsort(far, kind="stable")
                self.leaf[page] = (len(order), len(order) + len(rows))
                order.extend(rows[by].tolist())
                away.extend(far[by].tolist())
            else:
                todo += [(part, mid, page) for mid, part in split(points, rows)]
        self.ids, self.vectors, self.away = ids[order], vectors[order], np.array(away)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.center = place[self.center]
        self.radius, self.parent_distance = np.array(self.radius), np.array(self.parent_distance)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """For each query its k best (scores, ids; LEAST and NO_ID where there are fewer), and how many inner products were taken.

        floor: for each query a score that k candidates are known to reach.
        """
        m, pages = len(queries), len(self.center)
        square = (queries.astype(np.float64) ** 2).sum(1)
        whole = square + self.norm**2
        slack = 1e-7 * (np.sqrt(square) + self.norm) + 1e-9
        scores, found = np.full((m, k), LEAST, np.int64), np.full((m, k), NO_ID, np.int64)
        reach = lambda q: np.sqrt(np.maximum(whole[q] - 2.0 * np.maximum(scores[q, -1], floor[q]), 0)) + slack[q]
        to_distance = lambda q, s: np.sqrt(np.maximum(whole[q, None] - 2.0 * s, 0))
        middle = np.zeros((m, pages))
        bound = np.full((m, pages), np.inf)
        every = np.arange(m)
        middle[:, 0] = to_distance(every, products(queries, self.vectors[self.center[:1]]))[:, 0]
        bound[:, 0] = np.maximum(middle[:, 0] - self.radius[0], 0)
        taken, active = m, every
        while len(active):
            page = bound[active].argmin(1)
            go = bound[active, page] <= reach(active)
            active, page = active[go], page[go]
            for p in np.unique(page).tolist():
                own = active[page == p]
                bound[own, p] = np.inf
                near = reach(own)[:, None]
                if self.children[p]:
                    kids = np.array(self.children[p])
                    might = np.abs(middle[own, p][:, None] - self.parent_distance[kids]) - self.radius[kids] <= near
                    rows, some = might.any(1), might.any(0)
                    q, kids, might = own[rows], kids[some], might[rows][:, some]
                    if not might.size:
                        continue
                    taken += int(might.sum())
                    d = to_distance(q, products(queries[q], self.vectors[self.center[kids]]))
                    middle[np.ix_(q, kids)] = d
                    bound[np.ix_(q, kids)] = np.where(might, np.maximum(d - self.radius[kids], 0), np.inf)
                else:
                    lo, hi = self.leaf[p]
                    might = np.abs(middle[own, p][:, None] - self.away[lo:hi]) <= near
                    rows, some = might.any(1), might.any(0)
                    q, at, might = own[rows], np.arange(lo, hi)[some], might[rows][:, some]
                    might &= query_ids[q][:, None] != self.ids[at]
                    if not might.size:
                        continue
                    taken += int(might.sum())
                    s = products(queries[q], self.vectors[at])
                    might &= s >= np.maximum(scores[q, -1], floor[q])[:, None]
                    new, entry = np.nonzero(might)
                    merge_best(scores, found, q[new], s[new, entry], self.ids[at[entry]])
        return scores, found, taken


def merge_best(scores: np.ndarray, found: np.ndarray, q: np.ndarray, s: np.ndarray, ids: np.ndarray) -> None:
    """Puts new (query, score, id) entries into the queries' best lists, in place."""
    if not len(q):
        return
    k = scores.shape[1]
    own = np.flatnonzero(np.bincount(q, minlength=len(scores)))
    q = np.concatenate((np.repeat(own, k), q))
    s, ids = np.concatenate((scores[own].ravel(), s)), np.concatenate((found[own].ravel(), ids))
    order = np.lexsort((ids, -(s + 1), q))
    q, s, ids = q[order], s[order], ids[order]
    first = np.searchsorted(q, own)
    at = first[:, None] + np.arange(k)
    scores[own], found[own] = s[at], ids[at]


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(-1))


def split(points: np.ndarray, rows: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Up to FANOUT parts around points far from each other; equal points in even parts."""
    n = min(FANOUT, -(-len(rows) // PAGE))
    seeds, nearest, owner = [rows[0]], distance(points[rows], points[rows[0]]), np.zeros(len(rows), np.int64)
    while len(seeds) < n and nearest.max() > 0:
        seeds.append(rows[nearest.argmax()])
        d = distance(points[rows], points[seeds[-1]])
        owner[d < nearest] = len(seeds) - 1
        nearest = np.minimum(nearest, d)
    if len(seeds) == 1:
        return [(part[0], part) for part in np.array_split(rows, n)]
    return [(seed, rows[owner == i]) for i, seed in enumerate(seeds)]


def routed(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square = (pivots.astype(np.float64) ** 2).sum(1)
        for batch in batches:
            vectors = matrix(batch.column("vec").to_pylist(), pivots.shape[1])
            cell = (square - 2.0 * products(vectors, pivots)).argmin(1) if len(vectors) else np.zeros(0)
            yield batch.append_column("cell", pa.array(cell, pa.int32()))

    return run


def build_trees(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids, rows = [], []

        def tree() -> pa.RecordBatch:
            data = pack(MTree(np.array(ids[:TREE], np.int64), matrix(rows[:TREE])))
            del ids[:TREE], rows[:TREE]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([data], pa.binary())], ["part", "tree"])

        for batch in batches:
            for i, row, n in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "vec", "copies")), strict=True):
                ids += [i] * min(n, k + 1)
                rows += [row] * min(n, k + 1)
            while len(ids) >= TREE:
                yield tree()
        if ids:
            yield tree()

    return run


def pack_queries(sample_ids: np.ndarray, sample: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        ids, queries = np.array([r["vec_id"] for r in rows], np.int64), matrix([r["vec"] for r in rows])
        floor = np.full(len(ids), LEAST, np.int64)
        if len(sample_ids) > k:
            for at in range(0, len(ids), STEP):
                own = slice(at, at + STEP)
                floor[own] = np.partition(np.where(ids[own, None] != sample_ids, products(queries[own], sample), LEAST), -k, 1)[:, -k]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([pack(ids, queries, floor)], pa.binary())], ["block", "queries"])

    return run


def search_pairs(k: int):
    def run(trees: pa.Table, blocks: pa.Table) -> pa.Table:
        out = []
        for data in trees["tree"].to_pylist():
            (tree,) = unpack(data)
            for packed in blocks["queries"].to_pylist():
                every = unpack(packed)
                for at in range(0, len(every[0]), STEP):
                    ids, queries, floor = (x[at : at + STEP] for x in every)
                    scores, found, _ = tree.search(ids, queries, floor, k)
                    q, r = np.nonzero((found != NO_ID) & (scores >= floor[:, None]))
                    out.append((ids[q], found[q, r], scores[q, r]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), (pa.array(c, pa.int64()) for c in columns), strict=True)))

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates (vec_id, vec) of largest inner product for each row of ``queries`` (vec_id, vec).

    Only the sample (``SAMPLE`` rows) goes to the driver.
    """
    rows = materialize(candidates.groupBy("vec_id", "vec").agg(F.count("*").alias("copies")))
    n = rows.count()
    sample = lowest(rows, "vec_id", "vec", k=SAMPLE, n=n)
    vectors = matrix([r.vec for r in sample])
    parts = max(1, -(-n // TREE))
    trees = materialize(
        rows.mapInArrow(routed(vectors[:PIVOTS] if n else np.zeros((1, 0), np.int64)), "vec_id long, vec array<long>, copies long, cell int")
        .repartitionByRange(parts, "cell", "vec_id")
        .mapInArrow(build_trees(k), "part int, tree binary")
    )
    asked = materialize(queries.distinct())
    n_blocks = max(1, -(-asked.count() // BLOCK))
    blocks = asked.repartition(n_blocks).mapInArrow(pack_queries(np.array([r.vec_id for r in sample], np.int64), vectors, k), "block int, queries binary")
    spread = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    asked = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found = spread.groupBy("part", "block").cogroup(asked.groupBy("part", "block")).applyInArrow(search_pairs(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(rows, rows.filter("vec_id % 50 = 0"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.vec AS DOUBLE[]), CAST(c.vec AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
