"""SentencePiece (BPE with byte fallback) encoding with seeded merge-dropout, and decoding.

A text is cut into units that no piece of the vocabulary crosses: white space marks followed by other
characters. A unit's agenda always takes the pair of neighbouring symbols that merges to the piece
of the best score (leftmost of equals). Each candidate merge is skipped for good if a hash keyed by
(seed, document, place, unit, left, middle and right end) falls under ``dropout``: each occurrence of
a word draws for itself. ``SLICE`` occurrences at a time run their agendas side by side in arrays;
units over ``LONG`` characters use a heap. With dropout 0 each distinct unit of a chunk runs once and the ids are the
library's, but for U+2581 in a text: the library decodes that to a space; here it is written in byte
pieces, so every text decodes to itself.

Cases: null and empty texts have no ids and decode to the empty text; repeated rows and null or
repeated ids stay rows of their own; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import chunks

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
CHUNK = 1 << 20
LONG = 48
SLICE = 1 << 15
SHARE = np.uint64(0xD6E8FEB86659FD93)
NONE = np.int32((1 << 31) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (multiply and shift)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * SHARE
        x = (x ^ (x >> np.uint64(29))) * SHARE
        return x ^ (x >> np.uint64(32))


class Pieces:
    """The tables of a model: pieces of characters, merges of two pieces and bytes of pieces."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id_of = {sp.id_to_piece(i): i for i in normal}
        bytes_of = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_ids = np.array([bytes_of[b] for b in range(256)], np.int32)
        # rank 0 is the best score; equal scores share a rank
        scores = sorted({sp.get_score(i) for i in normal}, reverse=True)
        ranks = {s: r for r, s in enumerate(scores)}
        self.rank = np.full(n + 1, NONE, np.int32)
        for i in normal:
            self.rank[i] = ranks[sp.get_score(i)]
        chars = {ord(p): i for p, i in self.id_of.items() if len(p) == 1}
        self.char_ids = np.full(max(chars) + 2, -1, np.int32)
        self.char_ids[list(chars)] = list(chars.values())
        self.merges = {(a, b): i for p, i in self.id_of.items() for k in range(1, len(p)) if (a := self.id_of.get(p[:k])) is not None and (b := self.id_of.get(p[k:])) is not None}
        # open addressing on left * 2^20 + right
        self.bits = max(4, (4 * len(self.merges)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        self.probes = 1
        for (a, b), i in self.merges.items():
            key, probe = (a << 20) + b, 1
            slot = int(self.slots(np.array([key], np.int64))[0])
            while self.keys[slot] >= 0:
                slot, probe = (slot + 1) % len(self.keys), probe + 1
            self.keys[slot], self.values[slot] = key, i
            self.probes = max(self.probes, probe)
        whole = set(normal)
        byte_of = {i: b for b, i in bytes_of.items()}
        raw = [bytes([byte_of[i]]) if sp.is_byte(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() if i in whole else b"" for i in range(n)]
        self.raw_start = np.cumsum([0, *map(len, raw)])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * SHARE) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the pieces that pairs merge to, or -1."""
        keys = (left.astype(np.int64) << 20) + right
        keys[(left < 0) | (right < 0)] = -2
        slot = self.slots(keys)
        out = np.full(len(keys), -1, np.int32)
        todo = np.arange(len(keys))
        for _ in range(self.probes):
            there = self.keys[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (there >= 0)
            todo, slot = todo[on], (slot[on] + 1) % len(self.keys)
            if not len(todo):
                break
        return out


@lru_cache(2)
def load(name: str) -> Pieces:
    import public_tokenizers

    return Pieces(public_tokenizers.path(name))


def skipped(salt: np.ndarray, left: np.ndarray, middle: np.ndarray, right: np.ndarray, dropout: float) -> np.ndarray:
    spans = (left.astype(np.uint64) << np.uint64(42)) ^ (middle.astype(np.uint64) << np.uint64(21)) ^ right.astype(np.uint64)
    return (mixed(salt ^ mixed(spans)) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < dropout


class Units:
    """What distinct units start with: code points, symbols, candidate merges of each symbol with the next and their order, a hash."""

    def __init__(self, units: list[str], pieces: Pieces) -> None:
        self.points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        self.starts = np.cumsum([0, *map(len, units)])
        self.sizes = np.diff(self.starts)
        place = np.arange(len(self.points)) - np.repeat(self.starts[:-1], self.sizes)
        each = mixed((self.points.astype(np.uint64) << np.uint64(32)) ^ place.astype(np.uint64))
        self.hash = np.add.reduceat(each, self.starts[:-1]) if len(units) else each
        self.left = place.astype(np.int32)
        self.sym = pieces.char_ids[np.minimum(self.points, len(pieces.char_ids) - 1)]
        self.new, self.key = np.full(len(place), -1, np.int32), np.full(len(place), NONE)
        if len(place):
            self.new[:-1] = pieces.merged(self.sym[:-1], self.sym[1:])
            self.new[self.starts[1:] - 1] = -1
            at = np.flatnonzero(self.new >= 0)
            self.key[at] = pieces.rank[self.new[at]] * (LONG + 1) + self.left[at]


def segment(units: list[str], drawn: np.ndarray, pieces: Pieces, dropout: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units one after the other, and the units' bounds (n + 1). drawn: a whole number that each unit's skips are keyed by."""
    return segment_of(Units(units, pieces), np.arange(len(units)), drawn, pieces, dropout, seed)


def segment_of(units: Units, which: np.ndarray, drawn: np.ndarray, pieces: Pieces, dropout: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """segment() of occurrences of distinct units."""
    with np.errstate(over="ignore"):
        salt = mixed(units.hash[which] + mixed(drawn.astype(np.uint64) + np.uint64(seed % 2**64) * SHARE))
    sizes = units.sizes[which].astype(np.int32)
    starts = np.append(0, np.cumsum(sizes, dtype=np.int64))
    own = np.repeat(np.arange(len(which), dtype=np.int32), sizes)
    from_ = np.repeat(units.starts[:-1][which] - starts[:-1], sizes) + np.arange(starts[-1])
    done: list = []
    far = np.flatnonzero(sizes > LONG)
    for u in far.tolist():
        ids, at = agenda(units.sym[from_[starts[u] : starts[u + 1]]], int(salt[u]), pieces, dropout)
        done.append((np.full(len(ids), u, np.int32), np.array(at, np.int32), np.array(ids, np.int32)))
    keep = sizes[own] <= LONG if len(far) else slice(None)
    unit, at = own[keep], from_[keep]
    sym, left, new, key = units.sym[at], units.left[at], units.new[at], units.key[at]
    if dropout:
        at = np.flatnonzero(new >= 0)
        off = at[skipped(salt[unit[at]], left[at], left[at] + 1, left[at] + 2, dropout)]
        new[off], key[off] = -1, NONE

    def propose(at: np.ndarray) -> None:
        """Works out the merges of the symbols at these places with the next ones."""
        new[at], key[at] = -1, NONE
        at = at[at + 1 < len(unit)]
        at = at[unit[at] == unit[at + 1]]
        to = pieces.merged(sym[at], sym[at + 1])
        at, to = at[to >= 0], to[to >= 0]
        if dropout:
            inside = np.minimum(at + 2, len(unit) - 1)
            right = np.where((at + 2 < len(unit)) & (unit[inside] == unit[at]), left[inside], sizes[unit[at]])
            on = ~skipped(salt[unit[at]], left[at], left[at + 1], right, dropout)
            at, to = at[on], to[on]
        new[at], key[at] = to, pieces.rank[to] * (LONG + 1) + left[at]

    while len(unit):
        head = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        best = np.repeat(np.minimum.reduceat(key, head), np.diff(np.append(head, len(unit))))
        going = best < NONE
        at = np.flatnonzero(going & (key == best))
        done.append((unit[~going], left[~going], sym[~going]))
        sym[at] = new[at]
        going[at + 1] = False
        place = (np.cumsum(going) - 1)[at]
        unit, left, sym, new, key = unit[going], left[going], sym[going], new[going], key[going]
        former = place[place > 0] - 1
        propose(np.concatenate((place, former[unit[former] == unit[former + 1]])))
    unit, left, sym = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int32),) * 3
    whole = np.full(starts[-1], -2, np.int32)
    whole[starts[unit] + left] = sym
    at = np.flatnonzero(whole > -2)
    unit, sym = own[at], whole[at]
    # symbols that are no pieces are single characters: their bytes
    lost = np.flatnonzero(sym < 0)
    if len(lost):
        raw = [chr(p).encode() for p in units.points[from_[at[lost]]].tolist()]
        n = np.ones(len(sym), np.int64)
        n[lost] = list(map(len, raw))
        first = np.cumsum(n) - n
        sym, unit = np.repeat(sym, n), np.repeat(unit, n)
        for at, some in zip(first[lost].tolist(), raw, strict=True):
            sym[at : at + len(some)] = pieces.byte_ids[list(some)]
    return sym, np.append(0, np.cumsum(np.bincount(unit, minlength=len(which))))


def agenda(char: np.ndarray, salt: int, pieces: Pieces, dropout: float) -> tuple[list[int], list[int]]:
    """One unit's ids and their first characters, with a heap of candidate merges."""
    n = len(char)
    sym, end, before, after = char.tolist(), list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list = []

    def add(some: list[int]) -> None:
        for i in some:
            j = after[i] if i >= 0 else n
            new = pieces.merges.get((sym[i], sym[j])) if j < n else None
            if new is not None and not (dropout and skipped(*(np.array([x], np.uint64) for x in (salt, i, j, end[j])), dropout)[0]):
                heapq.heappush(heap, (int(pieces.rank[new]), i, j, end[j], sym[i], sym[j], new))

    if dropout:
        new = pieces.merged(char[:-1], char[1:])
        at = np.flatnonzero(new >= 0)
        at = at[~skipped(np.full(len(at), salt, np.uint64), at, at + 1, at + 2, dropout)]
        heap = [(int(pieces.rank[new[i]]), i, i + 1, i + 2, sym[i], sym[i + 1], int(new[i])) for i in at.tolist()]
        heapq.heapify(heap)
    else:
        add(list(range(n - 1)))
    alive = [True] * n
    while heap:
        _, i, j, stop, a, b, new = heapq.heappop(heap)
        if not (alive[i] and alive[j] and after[i] == j and sym[i] == a and sym[j] == b and end[j] == stop):
            continue
        sym[i], end[i], alive[j], after[i] = new, stop, False, after[j]
        if after[j] < n:
            before[after[j]] = i
        add([before[i], i])
    at = [i for i in range(n) if alive[i]]
    return [sym[i] for i in at], at


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[starts[i] : starts[i] + sizes[i]] one after the other."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def encode_texts(texts: list[str], keys: np.ndarray, pieces: Pieces, dropout: float = 0.1, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other and the texts' bounds. keys: a whole number for each text."""
    local: dict = defaultdict(count().__next__)
    index: list[int] = []
    sizes = []
    for text in texts:
        before = len(index)
        if text:
            for i, part in enumerate(text.split(SPACE)):
                if i:
                    index.append(local[None])
                marked = part.replace(" ", SPACE)
                index.extend(map(local.__getitem__, UNIT.findall(marked if i else SPACE + marked)))
        sizes.append(len(index) - before)
    # a U+2581 of the text itself stands in for no unit
    units, mark = Units([n or SPACE for n in local], pieces), local.get(None, -1)
    which, ends = np.array(index, np.int64), np.append(0, np.cumsum(sizes))
    if not dropout:
        ids, bounds = segment_some(units, np.arange(len(local)), mark, np.zeros(len(local), np.uint64), pieces, dropout, seed)
        n = np.diff(bounds)[which]
        return gather(ids, bounds[:-1][which], n), np.append(0, np.cumsum(n))[ends]
    place = np.arange(len(which)) - np.repeat(ends[:-1], sizes)
    doc = np.repeat(mixed(np.asarray(keys).astype(np.uint64)), sizes)
    drawn = mixed(doc ^ mixed(place.astype(np.uint64) ^ np.uint64(seed % 2**64)))
    some = [segment_some(units, which[a : a + SLICE], mark, drawn[a : a + SLICE], pieces, dropout, seed) for a in range(0, max(len(which), 1), SLICE)]
    n = np.concatenate([np.diff(bounds) for _, bounds in some])
    return np.concatenate([ids for ids, _ in some]), np.append(0, np.cumsum(n))[ends]


def segment_some(units: Units, which: np.ndarray, mark: int, drawn: np.ndarray, pieces: Pieces, dropout: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """segment_of(), where the unit ``mark`` stands for a U+2581 of the text itself."""
    full = which != mark
    ids, bounds = segment_of(units, which[full], drawn[full], pieces, dropout, seed)
    if full.all():
        return ids, bounds
    sizes = np.full(len(which), 3)
    sizes[full] = np.diff(bounds)
    out = np.zeros(sizes.sum(), np.int32)
    mine = np.repeat(full, sizes)
    out[mine] = ids
    out[~mine] = np.tile(pieces.byte_ids[list(SPACE.encode())], int((~full).sum()))
    return out, np.append(0, np.cumsum(sizes))


def decode_ids(ids: np.ndarray, bounds: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the texts' bounds."""
    sizes = np.diff(pieces.raw_start)[ids]
    data = gather(pieces.raw, pieces.raw_start[ids], sizes)
    ends = np.append(0, np.cumsum(sizes))[bounds]
    # the mark before the first unit is not in the text
    first = ends[:-1][np.diff(ends) > 0]
    keep = np.ones(len(data), bool)
    keep[first] = False
    return data[keep], ends - np.append(0, np.cumsum(np.diff(ends) > 0))


def encode_batches(name: str, dropout: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(name)
        for batch in chunks(batches, "text", CHUNK):
            keys = np.array(batch.column("doc_id").fill_null(-1).to_pylist(), np.int64)
            ids, bounds = encode_texts(batch.column("text").to_pylist(), keys, pieces, dropout, seed)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return run


def decode_batches(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(name)
        for batch in batches:
            column = batch.column("ids").fill_null([]) if batch.column("ids").null_count else batch.column("ids")
            data, bounds = decode_ids(column.flatten().to_numpy(), np.append(0, np.cumsum(column.value_lengths().to_numpy())), pieces)
            texts = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts.cast(pa.string())], ["doc_id", "text"])

    return run


def check_batches(name: str, dropout: float, seed: int):
    """Encodes, decodes the ids and compares with the text."""
    encode = encode_batches(name, dropout, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK):
            (out,) = encode(iter([batch]))
            (back,) = decode_batches(name)(iter([out]))
            same = pc.equal(batch.column("text").fill_null(""), back.column("text"))
            yield pa.RecordBatch.from_arrays([*out.columns, pc.list_value_length(out.column("ids")).cast(pa.int64()), same], ["doc_id", "ids", "n_ids", "lossless"])

    return run


def encode(docs: DataFrame, dropout: float = 0.1, seed: int = 0, name: str = MODEL) -> DataFrame:
    """doc_id, ids of every row of ``docs`` (doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(encode_batches(name, dropout, seed), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, name: str = MODEL) -> DataFrame:
    """doc_id, text of every row of ``encoded`` (doc_id, ids)."""
    return encoded.select("doc_id", "ids").mapInArrow(decode_batches(name), "doc_id long, text string")


def round_trip(docs: DataFrame, dropout: float = 0.1, seed: int = 0, name: str = MODEL) -> DataFrame:
    """doc_id, ids, n_ids, and lossless: whether decoding the ids gave the text."""
    return docs.select("doc_id", "text").mapInArrow(check_batches(name, dropout, seed), "doc_id long, ids array<int>, n_ids long, lossless boolean")


def op2_sentencepiece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
