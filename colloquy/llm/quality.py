"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. A line's features are shares of kinds of characters, repeated words and
lengths, and those of the lines before and after it; neighbouring labels are tied by transition
weights. In training all lines of a document have its label. The score of a document is the mean of
its lines' forward-backward marginals of good, weighted by their lengths in bytes.

The model is fitted on the driver on a bounded sample: at most ``sample`` labelled documents of at
most ``max_bytes`` bytes and ``max_lines`` lines, lowest hashes first, as far as they have no more than ``all_lines`` lines together. Every document is scored, whole, where it is read.

Cases: null and empty texts are one empty line with a score of its own; texts without a byte weigh
their lines equally; with no labels every score is 0.5. Null labels and ids don't train; equal labels of a
doc_id train once, different ones once each; of rows that share an id those of the lowest hashes train, ``sample`` at most. A null id counts as
held out. An empty table gives no rows; a column score of the input is replaced; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, pack, texts_of, unpack

CHUNK = 1 << 20
LOWER, UPPER, DIGIT, SPACE, STOP, SHOUT, PIPE, SIGN, REST = range(9)
KIND = np.full(256, REST, np.uint8)
KIND[[*range(97, 123), *range(128, 256)]] = LOWER
KIND[65:91] = UPPER
KIND[48:58] = DIGIT
KIND[[9, 32]] = SPACE
KIND[[ord(c) for c in ".,;:'\"-()?"]] = STOP
KIND[ord("!")] = SHOUT
KIND[ord("|")] = PIPE
KIND[[ord(c) for c in "*#$%&@=+<>{}[]\\/^_~`"]] = SIGN
LEVELS = (0.01, 0.05, 0.2)


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of the texts, their sizes in bytes, and the documents' bounds in lines."""
    breaks = np.flatnonzero(data == 10)
    # a line starts at each document and after each line break
    starts = np.concatenate((offsets[:-1], breaks + 1))
    doc = np.concatenate((np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1))
    order = np.lexsort((starts, doc))
    starts, doc = starts[order], doc[order]
    bounds = np.searchsorted(doc, np.arange(len(offsets)))
    last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    ends = np.where(last, offsets[doc + 1], np.append(starts[1:] - 1, 0))
    sizes = ends - starts
    n = len(starts)
    # line breaks and nothing else are outside of lines; bytes are in text order, as are lines
    line = np.repeat(np.arange(n), np.append(starts[1:], len(data)) - starts)
    counts = np.bincount(line * 9 + KIND[data], minlength=9 * n).reshape(n, 9).astype(np.float64) if n else np.zeros((0, 9))
    counts[:, REST] -= (~last).astype(np.float64)
    repeated, words = repeats(data, line, n)
    size = np.maximum(sizes, 1)[:, None]
    letters = np.maximum(counts[:, [LOWER]] + counts[:, [UPPER]], 1)
    ratio = np.hstack([counts[:, [UPPER]] / letters, counts[:, [DIGIT, STOP, SHOUT, PIPE, SIGN, REST]] / size, (repeated / np.maximum(words, 1))[:, None]])
    own = np.hstack([ratio, *(ratio > level for level in LEVELS), np.log1p(sizes)[:, None] / 10, np.log1p(words)[:, None] / 10, (sizes == 0)[:, None], (sizes / np.maximum(words, 1) > 12)[:, None]])
    around = np.hstack([ratio, *(ratio > level for level in LEVELS[1:])])
    before, after = np.zeros_like(around), np.zeros_like(around)
    if n:
        before[1:] = np.where(last[:-1, None], 0, around[:-1])
        after[:-1] = np.where(last[:-1, None], 0, around[1:])
    return np.hstack([np.ones((n, 1)), own, before, after]).astype(np.float32), sizes, bounds


def repeats(data: np.ndarray, line: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of each line, and those among them that equal the word before (by length and sums of codes)."""
    if not len(data):
        return np.zeros(n), np.zeros(n)
    inside = data > 32
    turn = np.append(True, (inside[1:] != inside[:-1]) | (line[1:] != line[:-1]))
    starts = np.flatnonzero(turn & inside)
    if not len(starts):
        return np.zeros(n), np.zeros(n)
    ends = np.flatnonzero(np.append(turn[1:], True) & inside) + 1
    codes = np.random.Generator(np.random.PCG64(5)).integers(1, 2**32, 256, np.uint64)
    sums = np.append(np.uint64(0), np.cumsum(codes[data]))
    code, of = sums[ends] - sums[starts], line[starts]
    same = np.append(False, (code[1:] == code[:-1]) & (of[1:] == of[:-1]) & (np.diff(ends - starts) == 0))
    return np.bincount(of[same], minlength=n).astype(np.float64), np.bincount(of, minlength=n).astype(np.float64)


def forward_backward(good: np.ndarray, bounds: np.ndarray, move: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Marginals of good for every line; with ``pairs`` also the expected counts of each transition.

    good: the lines' scores for good (bad has 0). move: 2 x 2 scores of neighbouring labels.
    """
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    first, sizes = bounds[:-1][order], sizes[order]
    emit = np.stack([np.zeros(len(good)), good], 1)
    ahead, back = emit.copy(), np.zeros_like(emit)
    longest = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(longest), "left")
    for t in range(1, longest):
        at = first[: live[t]] + t
        from_ = ahead[at - 1]
        for s in (0, 1):
            ahead[at, s] += np.logaddexp(from_[:, 0] + move[0, s], from_[:, 1] + move[1, s])
    for t in range(longest - 1, 0, -1):
        at = first[: live[t]] + t
        to = emit[at] + back[at]
        for s in (0, 1):
            back[at - 1, s] = np.logaddexp(to[:, 0] + move[s, 0], to[:, 1] + move[s, 1])
    odds = (ahead + back)[:, 1] - (ahead + back)[:, 0]
    share = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
    if not pairs:
        return share, None
    inner = np.ones(len(good), bool)
    inner[bounds[:-1][np.diff(bounds) > 0]] = False
    at = np.flatnonzero(inner)
    joint = ahead[at - 1][:, :, None] + move + (emit + back)[at][:, None, :]
    joint -= joint.max((1, 2), keepdims=True)
    joint = np.exp(joint)
    return share, (joint / joint.sum((1, 2), keepdims=True)).sum(0)


def fit(x: np.ndarray, bounds: np.ndarray, labels: np.ndarray, steps: int = 400, rate: float = 0.15, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights and transition scores of greatest penalised likelihood, by Adam."""
    weights = np.zeros(x.shape[1] + 4)
    if not len(labels):
        return weights[4:], weights[:4].reshape(2, 2)
    sizes = np.diff(bounds)
    y = np.repeat(labels, sizes).astype(np.float64)
    moves = np.zeros((2, 2))
    for s in (0, 1):
        moves[s, s] = np.maximum(sizes[labels == s] - 1, 0).sum()
    x64 = x.astype(np.float64)
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        share, joint = forward_backward(x64 @ weights[4:], bounds, weights[:4].reshape(2, 2), pairs=True)
        slope = np.concatenate(((moves - joint).ravel(), x64.T @ (y - share))) / len(labels) - decay * weights
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        weights += rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return weights[4:], weights[:4].reshape(2, 2)


def train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text", CHUNK):
        x, _, bounds = line_features(*texts_of(batch, "text"))
        rows = [pack(x[bounds[i] : bounds[i + 1]]) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(rows, pa.binary())], ["label", "x"])


def score_rows(weights: np.ndarray, move: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK):
            x, sizes, bounds = line_features(*texts_of(batch, "text"))
            share, _ = forward_backward(x.astype(np.float64) @ weights, bounds, move)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            weight = np.where(np.bincount(doc, sizes, batch.num_rows)[doc] > 0, sizes, 1)
            score = np.bincount(doc, weight * share, batch.num_rows) / np.bincount(doc, weight, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), pa.array(np.clip(score, 0, 1))], [*batch.schema.names, "score"])

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 3000, max_bytes: int = 1 << 16, max_lines: int = 2000, all_lines: int = 400_000) -> tuple[np.ndarray, np.ndarray]:
    """The model, from labels (doc_id, quality) of documents that aren't held out."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id").alias("id"), F.col("quality").alias("label")).orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    # at most ``sample`` rows of two numbers
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    fits = docs.select("doc_id", "text", n_lines.alias("n_lines")).filter((F.octet_length("text") <= max_bytes) & (F.col("n_lines") <= max_lines))
    rows = fits.join(F.broadcast(known), F.col("doc_id") == F.col("id")).select("label", "text", "id", "n_lines", F.xxhash64("id", "text").alias("key"))
    # where ids repeat there may be more rows than labels
    total = last = 0
    for r in rows.select("key", "n_lines").orderBy("key").limit(sample).collect():
        total += r.n_lines
        if total > max(all_lines, r.n_lines):
            break
        last = r.key
    rows = rows.filter(F.col("key") <= last).dropDuplicates(["key", "label"]).select("label", "text")
    found = rows.mapInArrow(train_rows, "label int, x binary").collect()
    found.sort(key=lambda r: (r.label, bytes(r.x)))
    parts = [unpack(r.x)[0] for r in found]
    x = np.concatenate(parts) if parts else np.zeros((0, line_features(np.zeros(0, np.uint8), np.zeros(1, np.int64))[0].shape[1]))
    return fit(x, np.cumsum([0, *map(len, parts)]), np.array([r.label for r in found], np.int64))


def score_quality(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The columns of ``docs`` and score."""
    from pyspark.sql.types import DoubleType, StructType

    docs = docs.drop("score")
    schema = StructType([*docs.schema.fields]).add("score", DoubleType())
    return docs.mapInArrow(score_rows(*model), schema)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
