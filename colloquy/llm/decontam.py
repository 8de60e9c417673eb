"""Benchmark decontamination with an FM-index for each shard of the training documents.

A shard is a run of whole documents of about ``SHARD_BYTES``, read where Spark's scan puts it; there
is no shuffle. Its words become symbols: the benchmark's words are 1, 2, ..., any other word and the
end of a document is 0. All zeros count as different, so no match crosses them. The suffixes are
sorted by prefix doubling in which only still tied suffixes go on; the Burrows-Wheeler transform
is held in a wavelet matrix. Benchmark windows are searched backwards, all at once; occurrences are
located by walking to a sampled suffix position. Overlapping occurrences merge into removal spans.

The benchmark goes to the tasks as numbers of words, in blocks of about ``block_bytes`` of text (an item that occurs twice once; a longer item is a
block by itself), some 20 bytes for each of its words. A shard is indexed once and all blocks are searched on that index; their hits meet there, so no
text is shuffled and no row needs a key, for one block as for many. Of a benchmark of more than ``PASS_BYTES`` so much is searched at a time: the
documents and the hits so far are written between passes.

Cases: null text has no words, null or wordless items no windows; repeated rows and ids stay rows of
their own; an item id that occurs twice counts once; null item ids match but are not listed or
counted. Words are told apart by 64-bit hashes. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import chunks, materialize, texts_of

SHARD_BYTES = 2 << 20
PASS_BYTES = 64 << 20
#: Windows that are searched at a time.
SEARCH = 1 << 16
WINDOW = 13
SAMPLE = 16
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Bytes of words after A-Z are lower-cased (fixed values): digits, a-z and all of non-ASCII characters.
WORD = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
WORD_PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOUND = "n_words long, ends array<int>, hits array<int>, items array<string>"


def byte_codes(seed: int) -> np.ndarray:
    """A 64-bit number for each byte; A-Z have those of a-z."""
    codes = np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, 256, np.uint64)
    codes[65:91] = codes[97:123]
    return codes


def words_of(data: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start, end and hash of each word of the texts data[offsets[i]:offsets[i + 1]]."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    is_word = WORD[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = is_word.copy()
    start[1:] &= ~is_word[:-1] | first[1:n]
    end = is_word.copy()
    end[:-1] &= ~is_word[1:] | first[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    power = np.full(n, BASE)
    power[0] = 1
    power = np.cumprod(power)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes[data] * power, out=sums[1:])
    # the hash is without the power at which the word stands
    hashes = (sums[ends] - sums[starts]) * inverse_power(starts)
    return starts, ends, hashes ^ (hashes >> np.uint64(29))


def inverse_power(at: np.ndarray) -> np.ndarray:
    """BASE ** -at modulo 2 ** 64, by squaring."""
    out, square, at = np.ones(len(at), np.uint64), BASE_INVERSE, at.copy()
    with np.errstate(over="ignore"):
        while at.any():
            out = np.where(at & 1, out * square, out)
            square, at = square * square, at >> 1
    return out


class Vocabulary:
    """Numbers (from 1) of the benchmark's words, by their hashes."""

    def __init__(self, words: dict[str, int]) -> None:
        self.codes = byte_codes(8)
        joined = "\n".join(words).encode()
        _, _, hashes = words_of(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]), self.codes)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.symbols = (order + 1).astype(np.int32)
        self.n_symbols = len(words) + 1

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.symbols[at], 0).astype(np.int64)


class Patterns:
    """The distinct windows of a block of benchmark items, as places in the items' words, and the items of each.

    vocabulary: numbers of words, to which new words are added.
    """

    def __init__(self, items: list[tuple[object, str | None]], vocabulary: dict[str, int], window: int = WINDOW) -> None:
        upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        places: dict[tuple[int, ...], int] = {}
        of: dict[int, set] = defaultdict(set)
        flat: list[int] = []
        for item, text in items:
            words = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in WORD_PATTERN.findall((text or "").translate(upper))]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                of[places.setdefault(tuple(words[i : i + window]), len(flat) + i)].add(item)
            flat += words
        self.window = window
        self.flat = np.array(flat, np.int32)
        self.starts = np.fromiter(places.values(), np.int32, len(places))
        self.sizes = np.fromiter(map(len, places), np.int32, len(places))
        listed = [sorted(str(x) for x in of[p] if x is not None) for p in self.starts.tolist()]
        self.names = sorted({x for own in listed for x in own})
        number = {x: i for i, x in enumerate(self.names)}
        self.cuts = np.cumsum([0, *map(len, listed)]).astype(np.int32)
        self.owners = np.array([number[x] for own in listed for x in own], np.int32)

    def rows(self, lo: int, hi: int) -> np.ndarray:
        """Windows lo to hi as rows of symbols, right-aligned."""
        at = np.arange(self.window) - self.window + self.sizes[lo:hi, None]
        return np.where(at >= 0, self.flat[np.maximum(self.starts[lo:hi, None] + at, 0)], 0).astype(np.int64)

    def items(self, windows: np.ndarray) -> list[str]:
        owners = np.unique(np.concatenate([self.owners[self.cuts[w] : self.cuts[w + 1]] for w in windows.tolist()]))
        return [self.names[i] for i in owners.tolist()]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array of ``text`` (its last symbol is 0), where each 0 is a symbol of its own, by position."""
    n = len(text)
    zeros = np.cumsum(text == 0)
    rank = np.where(text == 0, zeros - 1, text + zeros[-1])
    bits = max(1, int(rank.max()).bit_length())
    step = min(n, max(1, 63 // bits))
    key = np.zeros(n, np.int64)
    for i in range(step):
        key <<= bits
        key[: n - i] |= rank[i:]
    order = np.argsort(key)
    rank, tied = named(order, key[order], np.zeros(n, np.int64), 0)
    while len(tied):
        group = rank[tied]
        after = rank[np.minimum(tied + step, n - 1)]
        by = np.lexsort((after, group))
        tied, group, after = tied[by], group[by], after[by]
        # the ranks of a group's members start at the group's rank, its place in the order
        new = np.ones(len(tied), bool)
        new[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        head = np.ones(len(tied), bool)
        head[1:] = group[1:] != group[:-1]
        index = np.arange(len(tied))
        place = group + index - np.maximum.accumulate(np.where(head, index, 0))
        order[place] = tied
        rank[tied] = place[np.maximum.accumulate(np.where(new, index, 0))]
        alone = new & np.append(new[1:], True)
        tied = tied[~alone]
        step *= 2
    return order


def named(order: np.ndarray, keys: np.ndarray, rank: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks (equal keys share that of the first) by position, and the positions that share one."""
    new = np.ones(len(order), bool)
    new[1:] = keys[1:] != keys[:-1]
    rank[order] = base + np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return rank, order[~(new & np.append(new[1:], True))]


class FMIndex:
    """Wavelet-matrix FM-index over a shard's symbols."""

    def __init__(self, text: np.ndarray, n_symbols: int) -> None:
        order = suffix_order(text)
        before = text[order - 1]
        before[order == 0] = 0
        self.first = np.zeros(n_symbols + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=n_symbols), out=self.first[1:])
        self.bwt = before
        kept = (order % SAMPLE == 0) | (before == 0)
        self.kept, self.kept_rank = kept, np.cumsum(kept) - 1
        self.positions = order[kept]
        self.levels = []
        left = before
        for bit in range(max(1, (n_symbols - 1).bit_length()) - 1, -1, -1):
            one = (left >> bit & 1).astype(bool)
            zeros = np.zeros(len(left) + 1, np.int32)
            np.cumsum(~one, out=zeros[1:])
            self.levels.append((bit, zeros))
            left = np.concatenate((left[~one], left[one]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each place."""
        lo, hi = np.zeros(len(at), np.int64), at
        for bit, zeros in self.levels:
            one, all_zeros = (symbol >> bit & 1).astype(bool), zeros[-1]
            zl, zh = zeros[lo], zeros[hi]
            lo, hi = np.where(one, all_zeros + lo - zl, zl), np.where(one, all_zeros + hi - zh, zh)
        return hi - lo

    def search(self, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each pattern with occurrences: its index and the range of its suffixes."""
        index = np.arange(len(rows))
        lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), self.first[-1])
        done: list = []
        for i in range(rows.shape[1]):
            symbol = rows[index, rows.shape[1] - 1 - i]
            lo = self.first[symbol] + self.rank(symbol, lo)
            hi = self.first[symbol] + self.rank(symbol, hi)
            found, last = hi > lo, sizes[index] == i + 1
            done.append((index[found & last], lo[found & last], hi[found & last]))
            index, lo, hi = index[found & ~last], lo[found & ~last], hi[found & ~last]
            if not len(index):
                break
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes by their rows."""
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        index = np.arange(len(rows))
        while len(index):
            kept = self.kept[rows]
            out[index[kept]] = self.positions[self.kept_rank[rows[kept]]] + steps[index[kept]]
            index, rows = index[~kept], rows[~kept]
            symbol = self.bwt[rows]
            rows = self.first[symbol] + self.rank(symbol, rows)
            steps[index] += 1
        return out


class Shard:
    """Words of some documents and their FM-index."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary) -> None:
        self.starts, self.ends, hashes = words_of(data, offsets, vocabulary.codes)
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        self.index = None
        if len(self.starts) and vocabulary.n_symbols > 1:
            # a 0 stands after each document's last word
            place = np.arange(len(self.starts)) + self.doc
            text = np.zeros(place[-1] + 2, np.int64)
            text[place] = vocabulary.encode(hashes)
            self.index = FMIndex(text, vocabulary.n_symbols)
            self.word_of = np.zeros(len(text), np.int64)
            self.word_of[place] = np.arange(len(self.starts))

    def search(self, patterns: Patterns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words windows of a block hit, and the (document, window) pairs that occur."""
        depth = np.zeros(len(self.starts) + 1, np.int64)
        pairs = [np.zeros((0, 2), np.int64)]
        for at in range(0, len(patterns.starts) if self.index else 0, SEARCH):
            to = min(at + SEARCH, len(patterns.starts))
            which, lo, hi = self.index.search(patterns.rows(at, to), patterns.sizes[at:to])
            n = hi - lo
            rows = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            word, window = self.word_of[self.index.locate(rows)], at + np.repeat(which, n)
            np.add.at(depth, word, 1)
            np.add.at(depth, word + patterns.sizes[window], -1)
            found = np.unique(self.doc[word] * len(patterns.starts) + window)
            pairs.append(np.stack([found // len(patterns.starts), found % len(patterns.starts)], 1))
        found = np.concatenate(pairs)
        return np.cumsum(depth[:-1]) > 0, found[:, 0], found[:, 1]


def find_hits(vocabulary, blocks: list, keep: list[str], again: bool):
    """vocabulary, blocks: broadcast variables. keep: columns to carry along. again: hits of an earlier pass are there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", SHARD_BYTES):
            data, offsets = texts_of(batch, "text")
            shard, n = Shard(data, offsets, vocabulary.value), batch.num_rows
            cuts = np.searchsorted(shard.doc, np.arange(n + 1))
            hit, items = np.zeros(len(shard.starts), bool), [set() for _ in range(n)]
            if again:
                for d, (words, own) in enumerate(zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True)):
                    hit[cuts[d] + np.array(words, np.int64)] = True
                    items[d].update(own)
            for block in blocks:
                found, docs, windows = shard.search(block.value)
                hit |= found
                for d in np.unique(docs).tolist():
                    items[d].update(block.value.items(windows[docs == d]))
            bounds, words = [[]] * n, [[]] * n
            for d in np.unique(shard.doc[hit]).tolist():
                own = slice(cuts[d], cuts[d + 1])
                words[d] = np.flatnonzero(hit[own]).astype(np.int32)
                bounds[d] = (np.stack([shard.starts[own], shard.ends[own]], 1)[words[d]].ravel() - offsets[d]).astype(np.int32)
            out = (np.diff(cuts), bounds, words, [sorted(x) for x in items])
            types = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], [*keep, "n_words", "ends", "hits", "items"])

    return run


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = 1 << 20, keep: list[str] | None = None, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Per row of ``docs``: the columns in ``keep`` (doc_id), n_words, n_hit, items (sorted ids), spans (byte ranges to remove), contaminated."""
    spark = docs.sparkSession
    bench = benchmark.select("item_id", "text").distinct()
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // block_bytes
    keep = keep or ["doc_id"]
    carried = list(dict.fromkeys([*keep, "text"]))
    raw, each = docs.select(*carried), max(1, pass_bytes // block_bytes)
    for first in range(0, blocks, each):
        words: dict[str, int] = {}
        sent = []
        for i in range(first, min(first + each, blocks)):
            own = bench if blocks == 1 else bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i)
            sent.append(spark.sparkContext.broadcast(Patterns([tuple(r) for r in own.collect()], words, window)))
        last = first + each >= blocks
        names = keep if last else carried
        schema = StructType([*docs.select(*names).schema.fields, *StructType.fromDDL(FOUND).fields])
        raw = raw.mapInArrow(find_hits(spark.sparkContext.broadcast(Vocabulary(words)), sent, names, first > 0), schema)
        if not last:
            raw = materialize(raw)
    n_hit = F.size("hits").cast("long")
    # a span goes on while the next hit word is the next word
    spans = F.expr(
        """aggregate(sequence(0, size(hits) - 1), array(named_struct('start', 0, 'end', 0)),
             (a, i) -> if(i > 0 and hits[i] = hits[i - 1] + 1,
               concat(slice(a, 1, size(a) - 1), array(named_struct('start', a[size(a) - 1].start, 'end', ends[2 * i + 1]))),
               concat(a, array(named_struct('start', ends[2 * i], 'end', ends[2 * i + 1])))),
             a -> slice(a, 2, size(a) - 1))"""
    )
    none = F.array().cast("array<struct<start:int,end:int>>")
    return raw.select(
        *keep,
        "n_words",
        n_hit.alias("n_hit"),
        "items",
        F.when(n_hit > 0, spans).otherwise(none).alias("spans"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated"
    )


SQL = r"""
WITH w AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bi AS (SELECT item_id, ws, least(len(ws), 13) AS l, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, l, array_to_string(ws[i:i + l - 1], ' ') AS g FROM bi),
dp AS (SELECT k, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM w, (SELECT DISTINCT l FROM bw) WHERE len(ws) >= l),
dg AS (SELECT k, i, l, array_to_string(ws[i:i + l - 1], ' ') AS g FROM dp),
o AS (SELECT k, i, dg.l, item_id FROM dg JOIN bw USING (l, g)),
h AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + l)) AS p FROM o) GROUP BY k),
t AS (SELECT k, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT k, item_id FROM o) GROUP BY k)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN h USING (k) LEFT JOIN t USING (k)
"""
