"""Repeated-substring removal by a distributed difference-cover suffix sort of bounded depth.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else, too; so only the order of suffixes by their
first ``length`` bytes matters, and equal prefixes stand next to each other in it.

1. Equal whole texts are found by a 128-bit digest; one of each stays in play, the rest are known.
2. A filter: two equal strings have an offset d < v at which both have a place of a difference cover modulo v (q + 1
   residues of v = q^2 + q + 1). Samples at these places are named by a 64-bit fingerprint of the length - v + 1 bytes that
   equal strings then share; a suffix stays in play if one of its first v places has a name that occurs elsewhere. Chance equals
   only keep more in play.
3. Of the suffixes in play those at places 1 and 2 modulo 3 (the difference cover of triples) are sorted: first by a triple of words
   of 6 bytes, in ranges between sampled bounds; the rank among distinct triples is the suffix's name. Then names are recursed
   on: triples of names, at most a name's reach apart, are sorted and named again, so names stand for 18, 54, 162 and 396 bytes (in
   general, up to the last multiple of 6 that is 2 or more below ``length``). All are exact ranks; no two strings share one.
4. The remaining suffixes (places 0 modulo 3) are merged with them: any two kinds have a distance of 1 or 2 at which both are
   at a sorted place, so bytes up to there, the rank there and the bytes after its reach decide. In each range the three sorted
   lists are merged, and adjacent prefixes are compared in the same terms, which is equality of their bytes.
5. Bytes covered by repeated strings are removed.

Texts are packed in blocks. Per step a block sends each distinct key once to the key's range and gets back its rank or one
bit, so a string that occurs everywhere is no hot key; there are as many ranges as bytes ask for. A suffix goes out of play once none
of its names is shared. Every step is a table in the shared folder, deleted when the next is written.

Cases: null and empty texts have no bytes and keep nothing (the digest of the empty string); texts
shorter than ``length`` lose nothing; repeated rows are copies of each other; null and repeated ids
stay rows of their own; an empty table gives no rows; other columns are ignored. The text that is left is without characters of
which only a part is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, discard, lowest, materialize, n_partitions, narrow, pack, texts_of, unpack
from .pieces import mixed

BLOCK = 2 << 20
LENGTH = 400
BASE = 0x9E3779B97F4A7C15
#: Bytes of text, and suffixes in play, for each range of names.
RANGE_BYTES, RANGE_SUFFIXES = 32 << 20, 3 << 20
#: Ranges are resolved in so many turns, so that only a part of the requests is shuffled at a time.
TURNS = 2
#: Rows of 16 keys each that bound the ranges: so many, or a quarter of the ranges if that is more (about four times as many go to the driver).
BOUNDS = 2048
#: Rows between steps: what a block keeps, its runs of bytes in play, its sample of keys, or (bucket 0 and on) requests or replies of a range.
ROWS = "block long, bucket int, n long, data binary"
KEEPS, TEXTS, SAMPLES = -1, -2, -3
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"


@lru_cache
def difference_cover(length: int) -> tuple[int, tuple[int, ...]]:
    """v and D for strings of ``length`` bytes: a perfect difference set of the largest v below three quarters of it."""
    for q in (13, 11, 7, 5, 3, 2):
        v = q * q + q + 1
        if v > max(7, length * 4 // 5):
            continue
        # powers of x modulo a cubic over GF(q); those on a plane give the set for a suitable cubic
        for c in range(1, q):
            for b in range(q):
                for a in range(q):
                    x, cover = (1, 0, 0), []
                    for i in range(v):
                        if x[2] == 0:
                            cover.append(i)
                        x = (c * x[2] % q, (x[0] + b * x[2]) % q, (x[1] + a * x[2]) % q)
                    if len(cover) == q + 1 and len({(s - t) % v for s in cover for t in cover}) == v:
                        return v, tuple(cover)
    return 1, (0,)


@lru_cache(1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes' codes, and powers of the base and of its inverse modulo 2^64."""
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 2**64), np.uint64)
    up[:1] = down[:1] = 1
    return np.random.Generator(np.random.PCG64(10)).integers(1, 2**63, 256, np.uint64), np.cumprod(up), np.cumprod(down)


def digests(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    raw = data.tobytes()
    return np.frombuffer(b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)), np.uint64).reshape(-1, 2)


class Block:
    """The texts of a block."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int) -> None:
        self.data, self.offsets, self.length = data, offsets, length
        self.v, self.cover = difference_cover(length)

    def docs_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, "right") - 1

    def texts_of(self, active: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
        """Where the active texts of ``least`` bytes or more begin and end."""
        own = np.flatnonzero(active & (np.diff(self.offsets) >= least))
        return zip(self.offsets[own].tolist(), self.offsets[own + 1].tolist(), strict=True)

    def fingerprints(self, at: np.ndarray, size: int) -> np.ndarray:
        n = len(self.data)
        codes, up, down = powers((n >> 18) + 1 << 18)
        sums = np.zeros(n + 1, np.uint64)
        np.take(codes, self.data, out=sums[1:])
        sums[1:] *= up[:n]
        np.cumsum(sums, out=sums)
        return mixed((sums[at + size] - sums[at]) * down[at])[:, None]

    def samples(self, active: np.ndarray) -> np.ndarray:
        size = self.length - self.v + 1
        tile = np.zeros(len(self.data) + self.v, bool)
        for c in self.cover:
            tile[c :: self.v] = True
        out = np.zeros(len(self.data), bool)
        for a, b in self.texts_of(active, size):
            out[a : b - size + 1] = tile[: b - size + 1 - a]
        return np.flatnonzero(out)

    def in_play(self, active: np.ndarray, samples: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """Starts of whole strings in active texts, one of whose first v places is a sample of a shared name."""
        n = len(self.data)
        seen = np.zeros(n + self.v + 1, np.int32)
        seen[samples[shared] + 1] = 1
        np.cumsum(seen, out=seen)
        out = np.zeros(n, bool)
        for a, b in self.texts_of(active, self.length):
            c = b - self.length + 1
            np.greater(seen[a + self.v : c + self.v], seen[a:c], out=out[a:c])
        return np.flatnonzero(out)

    def spans(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the maximal runs of bytes that strings at these (sorted) starts cover."""
        if not len(starts):
            return starts, starts
        new = np.append(True, (starts[1:] > starts[:-1] + self.length) | (np.diff(self.docs_of(starts)) != 0))
        last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)
        return starts[new], starts[last] + self.length


@lru_cache
def reach(length: int) -> list[int]:
    """How many bytes the names of each level stand for: multiples of 6, so that triples stay at places of the same kind."""
    last = (length - 2) // 6 * 6
    levels = next(k for k in range(99) if 24 * 3**k >= last)
    # the shortest words, of at most 8 bytes, that need no more levels
    out = [-(-last // (6 * 3**levels)) * 6]
    while out[-1] < last:
        out.append(min(3 * out[-1], last))
    return out


@lru_cache(2)
def counted(n: int) -> np.ndarray:
    return (np.arange(n) % 3).astype(np.uint8)


def thirds(offsets: np.ndarray) -> np.ndarray:
    """Each byte's place in its run modulo 3."""
    n = int(offsets[-1])
    back = np.repeat((-offsets[:-1] % 3).astype(np.uint8), np.diff(offsets))
    return np.array([0, 1, 2, 0, 1], np.uint8)[counted((n >> 18) + 1 << 18)[:n] + back]


def sorted_places(starts: np.ndarray, sampled: np.ndarray, level: int, length: int) -> np.ndarray:
    """Which places (``sampled``: 1 and 2 modulo 3) have a name of ``level`` that the names of the last level at the starts, or 1 or 2 after them, are made of."""
    n, depths = len(sampled), reach(length)
    need = np.zeros(n + 2, bool)
    for i in range(3):
        need[starts + i] = True
    need = need[:n] & sampled
    for k in range(len(depths) - 1, level, -1):
        step = (depths[k] - depths[k - 1]) // 2
        wider = need.copy()
        for i in (1, 2):
            wider[i * step :] |= need[: max(n - i * step, 0)]
        need = wider
    return need


def numbers(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` (at most 8) bytes at each of these places as a number, in the order of the bytes."""
    out = np.zeros(len(at), np.uint64)
    for i in range(size):
        out <<= np.uint64(8)
        out |= data[at + i]
    return out


def words(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    size = reach(length)[0] // 3
    return np.stack([numbers(data, at + i * size, size) for i in range(3)], 1)


def ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the values, which of them in that order differ from the one before, and the rank among distinct values of each."""
    order = np.argsort(values)
    s = values[order]
    new = np.append(True, s[1:] != s[:-1])[: len(s)]
    group = np.empty(len(s), np.uint64)
    group[order] = np.cumsum(new) - 1
    return order, new, group


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ranked() of keys (rows): columns are packed in one number, as ranks where they are too wide."""
    width = lambda c: int(c.max()).bit_length() if len(c) else 0
    columns = list(keys.T)
    if sum(map(width, columns)) > 64:
        columns = [ranked(c)[2] for c in columns]
    out = columns[0]
    for c in columns[1:]:
        if width(out) + width(c) > 64:
            out = ranked(out)[2]
        out = (out << np.uint64(width(c))) | c
    order, new, group = ranked(out)
    return order, new, group.astype(np.int64)


def squeezed(keys: np.ndarray) -> list[np.ndarray]:
    """Sorted keys as byte planes, which compress; of the first column those of its differences."""
    columns = [np.diff(keys[:, 0], prepend=np.uint64(0)), *keys.T[1:]]
    return [np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T) for c in columns]


def unsqueezed(planes: list[np.ndarray]) -> np.ndarray:
    columns = [np.ascontiguousarray(p.T).view(np.uint64).ravel() for p in planes]
    return np.stack([np.cumsum(columns[0], dtype=np.uint64), *columns[1:]], 1)


def table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    types = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
    return pa.table({name.split()[0]: pa.array([r[i] for r in rows], t) for i, (name, t) in enumerate(zip(ROWS.split(", "), types, strict=True))})


def cuts_of(keys: np.ndarray, bounds: np.ndarray | int) -> np.ndarray:
    """Where in sorted distinct keys the ranges start and end: between ``bounds`` (keys), or of as many even ranges of the first column's hashes."""
    if isinstance(bounds, int):
        number = ((keys[:, 0] >> np.uint64(32)) * np.uint64(bounds) >> np.uint64(32)).astype(np.int64)
        return np.searchsorted(number, np.arange(bounds + 1))
    low, high = (np.searchsorted(keys[:, 0], bounds[:, 0], side) for side in ("left", "right"))
    for i in np.flatnonzero(low < high).tolist():
        a, b = low[i], high[i]
        for c in (1, 2):
            part = keys[a:b, c]
            a, b = a + np.searchsorted(part, bounds[i, c], "left"), a + np.searchsorted(part, bounds[i, c], "right")
        low[i] = a
    return np.concatenate(([0], low, [len(keys)]))


def ask(block: int, keys: np.ndarray, bounds: np.ndarray | int | None, names: np.ndarray | None = None) -> tuple[list[tuple], np.ndarray]:
    """Requests with each distinct key once and a flag if the block has it twice, by ranges, and the number of its distinct key for each key.

    Keys of ``names`` (in order) are given by number; their range is the upper half of the name.
    """
    order, new, group = grouped(keys)
    first = np.flatnonzero(new)
    some, twice = keys[order[first]], np.diff(np.append(first, len(order))) > 1
    if names is not None:
        some = names[some.astype(np.int64)]
        parts = slices(some[:, 0] >> np.uint64(32))
    else:
        cuts = cuts_of(some, bounds)
        parts = [(r, cuts[r], cuts[r + 1]) for r in np.flatnonzero(np.diff(cuts)).tolist()]
    return [(block, r, int(z - a), pack(squeezed(some[a:z]), np.packbits(twice[a:z]))) for r, a, z in parts], narrow(group)


def slices(number: np.ndarray) -> list[tuple[int, int, int]]:
    """Each of the (sorted) numbers and where its run begins and ends."""
    which, at = np.unique(number, return_index=True)
    return list(zip(which.tolist(), at.tolist(), [*at.tolist()[1:], len(number)]))


def gathered(requests: pa.Table) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray, np.ndarray]:
    """The requests (block, range), in order, their keys and flags in one, and where each begins and ends."""
    rows = sorted(zip(requests["block"].to_pylist(), requests["bucket"].to_pylist(), requests["data"].to_pylist(), strict=True))
    parts = [(unsqueezed(planes), bits) for planes, bits in (unpack(data) for _, _, data in rows)]
    twice = np.concatenate([np.unpackbits(bits, count=len(keys)).astype(bool) for keys, bits in parts])
    return [r[:2] for r in rows], np.concatenate([keys for keys, _ in parts]), twice, np.cumsum([0, *(len(keys) for keys, _ in parts)])


def shared_keys(requests: pa.Table) -> pa.Table:
    """Bits for each key of a range: it is elsewhere or twice; the block is the first that has it."""
    rows, keys, twice, cuts = gathered(requests)
    order, new, group = grouped(keys)
    shared = (np.bincount(group) > 1) | (np.bincount(group, twice) > 0)
    first = np.zeros(len(group), bool)
    if len(order):
        first[np.minimum.reduceat(order, np.flatnonzero(new))] = True  # blocks come in order
    return table([(*row, int(b - a), pack(np.packbits(shared[group[a:b]]), np.packbits(first[a:b]))) for row, a, b in zip(rows, cuts[:-1], cuts[1:], strict=True)])


def ranked_keys(requests: pa.Table) -> pa.Table:
    """The rank of each triple among the distinct ones of its range, after the number of the range, and whether it is elsewhere or twice."""
    rows, keys, twice, cuts = gathered(requests)
    group = grouped(keys - np.append(keys[:, 0].min(), np.zeros(2, np.uint64)))[2]
    names, shared = (np.uint64(rows[0][1]) << np.uint64(32)) + group.astype(np.uint64), ((np.bincount(group) > 1) | (np.bincount(group, twice) > 0))[group]
    return table([(*row, int(b - a), pack(squeezed(names[a:b, None]), np.packbits(shared[a:b]))) for row, a, b in zip(rows, cuts[:-1], cuts[1:], strict=True)])


def answers(rows: pa.Table) -> list[tuple]:
    """The replies to a block, by range: how many keys, and what of each."""
    found = sorted(zip(rows["bucket"].to_pylist(), rows["n"].to_pylist(), rows["data"].to_pylist(), strict=True))
    return [(n, *unpack(data)) for r, n, data in found if r >= 0]


def bits_of(rows: pa.Table, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of a block's keys: shared, and its block is the first to have it."""
    bits = [[np.zeros(0, np.uint8)] + [np.unpackbits(x[i], count=x[0]) for x in answers(rows)] for i in (1, 2)]
    return tuple(np.concatenate(b).astype(bool)[group] for b in bits)


def names_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The names of a block's distinct keys, in order, and which of them are shared."""
    found = answers(rows)
    names = np.concatenate([np.zeros(0, np.uint64), *(unsqueezed(planes)[:, 0] for _, planes, _ in found)])
    return names, np.concatenate([np.zeros(0, np.uint8), *(np.unpackbits(bits, count=n) for n, _, bits in found)]).astype(bool)


def kept_of(rows: pa.Table, bucket: int = KEEPS) -> tuple:
    return unpack(next(data for r, data in zip(rows["bucket"].to_pylist(), rows["data"].to_pylist(), strict=True) if r == bucket))


def pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId() << 32
    for i, batch in enumerate(chunks(batches, "text", BLOCK)):
        data, offsets = texts_of(batch, "text")
        texts = pack(batch.column("doc_id").to_pylist(), data, offsets)
        yield pa.RecordBatch.from_arrays([pa.array([task + i], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([texts], pa.binary())], ["block", "bytes", "texts"])


def ask_copies(ranges: int):
    """Step 1: the texts by their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, texts in zip(batch.column("block").to_pylist(), batch.column("texts").to_pylist(), strict=True):
                _, data, offsets = unpack(texts)
                rows, group = ask(number, digests(data, offsets), ranges)
                yield from table([(number, KEEPS, 0, pack(group)), *rows]).to_batches()

    return run


def opened(blocks: pa.Table, length: int) -> tuple[int, list, Block]:
    ids, data, offsets = unpack(blocks["texts"][0].as_py())
    return blocks["block"][0].as_py(), ids, Block(data, offsets, length)


def ask_samples(ranges: int, length: int):
    """Step 2: a block's samples by their fingerprints."""

    def run(blocks: pa.Table, rows: pa.Table) -> pa.Table:
        number, _, block = opened(blocks, length)
        copied, first = bits_of(rows, *kept_of(rows))
        asked, group = ask(number, block.fingerprints(block.samples(first), length - block.v + 1), ranges)
        return table([(number, KEEPS, 0, pack(copied, first, group)), *asked])

    return run


def keep_in_play(length: int):
    """After step 2: the starts in play in the runs of bytes that their strings cover, these runs (texts of their own from here on), and some keys."""

    def run(blocks: pa.Table, rows: pa.Table) -> pa.Table:
        number, _, block = opened(blocks, length)
        copied, first, group = kept_of(rows)
        starts = block.in_play(first, block.samples(first), bits_of(rows, group)[0])
        begin, end = block.spans(starts)
        offsets = np.append(0, np.cumsum(end - begin))
        moved = begin - offsets[:-1]
        here = starts - moved[np.searchsorted(begin, starts, "right") - 1]
        kept = (number, KEEPS, len(starts), pack((copied, moved), offsets, mask_of(here, offsets)))
        if not len(starts):
            return table([kept])
        texts = block.data[np.arange(offsets[-1]) + np.repeat(moved, end - begin)]
        some = mixed(np.arange(16, dtype=np.uint64) + np.uint64(number << 8)) % np.uint64(len(starts))
        return table([kept, (number, TEXTS, 0, pack(texts)), (number, SAMPLES, 0, pack(words(texts, here[some.astype(np.int64)], length)))])

    return run


def mask_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    mask = np.zeros(int(offsets[-1]), bool)
    mask[starts] = True
    return np.packbits(mask)


def starts_of(offsets: np.ndarray, play: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(play, count=int(offsets[-1])))


def has_texts(rows: pa.Table) -> bool:
    return TEXTS in rows["bucket"].to_pylist()


def ask_words(bounds: np.ndarray, length: int):
    """Step 3: the triples of words at the sorted places."""

    def run(rows: pa.Table) -> pa.Table:
        number = rows["block"][0].as_py()
        of, offsets, play = kept_of(rows)
        if not has_texts(rows):
            return table([(number, KEEPS, 0, pack(of, offsets, play, np.zeros(0, np.uint8)))])
        places = np.flatnonzero(sorted_places(starts_of(offsets, play), thirds(offsets) > 0, 0, length))
        asked, group = ask(number, words(kept_of(rows, TEXTS)[0], places, length), bounds)
        return table([(number, KEEPS, 0, pack(of, offsets, play, group)), *asked])

    return run


def alive(starts: np.ndarray, places: np.ndarray, shared: np.ndarray, n: int) -> np.ndarray:
    """Starts with a shared name at or right after them; without one no other suffix has the same first bytes."""
    hit = np.zeros(n, bool)
    hit[places[shared]] = True
    return starts[hit[starts] | hit[starts + 1] | hit[starts + 2]]


def ask_names(level: int, length: int):
    """Step 3, recursion: triples of the names of the level before, which come as replies."""

    def run(rows: pa.Table) -> pa.Table:
        number = rows["block"][0].as_py()
        of, offsets, play, group = kept_of(rows)
        depths, starts, sampled = reach(length), starts_of(offsets, play), thirds(offsets) > 0
        names, shared = names_of(rows)
        before = sorted_places(starts, sampled, level - 1, length)
        starts = alive(starts, np.flatnonzero(before), shared[group], len(before))
        index, after = np.cumsum(before, dtype=np.int32) - 1, np.flatnonzero(sorted_places(starts, sampled, level, length))
        step = (depths[level] - depths[level - 1]) // 2
        keys = np.stack([group[index[after + i * step]].astype(np.uint64) for i in range(3)], 1)
        asked, group = ask(number, keys, None, names)
        return table([(number, KEEPS, 0, pack(of, offsets, mask_of(starts, offsets), group)), *asked])

    return run


def ask_merge(bounds: np.ndarray, length: int):
    """Step 4: the suffixes in play of each kind (place modulo 3): their first 2 bytes, the 2 names at sorted places among these and
    the next, and the bytes after the reach of a name at their start, as sorted distinct lists in ranges."""

    def run(rows: pa.Table) -> pa.Table:
        number = rows["block"][0].as_py()
        of, offsets, play, group = kept_of(rows)
        starts, third = starts_of(offsets, play), thirds(offsets)
        names, shared = names_of(rows)
        before = sorted_places(starts, third > 0, len(reach(length)) - 1, length)
        starts = alive(starts, np.flatnonzero(before), shared[group], len(before))
        texts = kept_of(rows, TEXTS)[0] if has_texts(rows) else np.zeros(0, np.uint8)
        index, depth = np.cumsum(before, dtype=np.int32) - 1, reach(length)[-1]
        groups, parts = [], {}
        for kind, (a, b) in enumerate(NAMED):
            own = starts[third[starts] == kind]
            columns = (numbers(texts, own, 2), *(names[group[index[own + i]]] for i in (a, b)), numbers(texts, own + depth, length - depth))
            order, new, number_of = grouped(merge_keys(kind, columns, OWN[kind], length))
            one = order[new]
            twice = np.bincount(number_of, minlength=len(one)) > 1
            groups.append(narrow(number_of))
            # kinds 1 and 2 are in the range of their own name, kind 0 in that of their words
            at = columns[1][one] >> np.uint64(32) if kind else np.repeat(np.arange(len(bounds) + 1), np.diff(cuts_of(words(texts, own[one], length), bounds)))
            for r, x, y in slices(at):
                parts.setdefault(r, {})[kind] = (*(c[one[x:y]] for c in columns), twice[x:y])
        asked = [(number, KEEPS, 0, pack(of, offsets, mask_of(starts, offsets), *groups))]
        for r, lists in parts.items():
            lists = [lists.get(kind, (*(np.zeros(0, np.uint64),) * 4, np.zeros(0, bool))) for kind in range(3)]
            asked.append((number, r, 0, pack(*((squeezed(np.stack(x[:4], 1)), np.packbits(x[4]), len(x[4])) for x in lists))))
        return table(asked)

    return run


#: For each kind of place (modulo 3), how far behind a start its two names are, and with which kind a kind shares the distance that orders its own list.
NAMED = ((1, 2), (0, 1), (0, 2))
OWN = (1, 2, 1)


def merge_keys(kind: int, columns: tuple, other: int, length: int) -> np.ndarray:
    """Of suffixes of a kind, what orders them among themselves and those of another kind by their first ``length`` bytes."""
    two, near, far, after = columns
    distance = {(0, 1): 1, (0, 2): 2, (1, 2): 0}[min(kind, other), max(kind, other)]
    name = near if NAMED[kind][0] == distance else far
    first = (two >> np.uint64(8), two)[distance - 1] if distance else np.zeros(len(two), np.uint64)
    size = length - reach(length)[-1] - distance
    return np.stack([first, name, after & np.uint64((1 << 8 * size) - 1)], 1)


def merged(length: int):
    """Step 4: merges a range's three sorted lists and compares neighbours. Bits for each suffix: another one, of any kind, has the same first bytes."""

    def run(requests: pa.Table) -> pa.Table:
        rows = sorted(zip(requests["block"].to_pylist(), requests["bucket"].to_pylist(), requests["data"].to_pylist(), strict=True))
        lists = [unpack(data) for _, _, data in rows]
        kinds, shared, groups = [], [], []
        for kind in range(3):
            columns = np.concatenate([unsqueezed(x[kind][0]) for x in lists]).T
            twice = np.concatenate([np.unpackbits(x[kind][1], count=x[kind][2]) for x in lists])
            order, new, group = grouped(merge_keys(kind, columns, OWN[kind], length))
            kinds.append(tuple(c[order[new]] for c in columns))
            shared.append((np.bincount(group) > 1) | (np.bincount(group, twice) > 0) if len(group) else np.zeros(0, bool))
            groups.append(group)
        place, ranks = [np.arange(len(s)) for s in shared], {}
        for x, y in ((0, 1), (0, 2), (1, 2)):
            both = np.concatenate((merge_keys(x, kinds[x], y, length), merge_keys(y, kinds[y], x, length)))
            a, b = np.split(grouped(both)[2], [len(shared[x])])
            place[x] += np.searchsorted(b, a, "left")
            place[y] += np.searchsorted(a, b, "right")
            ranks[x, y] = a, b
        kind, index = np.zeros(sum(map(len, shared)), np.int8), np.zeros(sum(map(len, shared)), np.int64)
        for k in range(3):
            kind[place[k]], index[place[k]] = k, np.arange(len(place[k]))
        for (x, y), (a, b) in ranks.items():
            at = np.flatnonzero((kind[:-1] == x) & (kind[1:] == y))
            at = at[a[index[at]] == b[index[at + 1]]]
            shared[x][index[at]] = shared[y][index[at + 1]] = True
        out, cuts = [], [np.cumsum([0, *(x[k][2] for x in lists)]) for k in range(3)]
        for i, (number, r, _) in enumerate(rows):
            bits = [np.packbits(shared[k][groups[k][cuts[k][i] : cuts[k][i + 1]]]) for k in range(3)]
            out.append((number, r, 0, pack(*((b, lists[i][k][2]) for k, b in enumerate(bits)))))
        return table(out)

    return run


def cut_texts(length: int):
    """Step 5."""

    def run(blocks: pa.Table, rows: pa.Table) -> pa.Table:
        _, ids, block = opened(blocks, length)
        (copied, moved), offsets, play, *groups = kept_of(rows)
        starts = starts_of(offsets, play)
        hit, third = np.zeros(len(starts), bool), thirds(offsets)[starts]
        replies = [x[1:] for x in answers(rows)]
        for kind, group in enumerate(groups):
            bits = np.concatenate([np.zeros(0, np.uint8), *(np.unpackbits(x[kind][0], count=x[kind][1]) for x in replies)]).astype(bool)
            hit[third == kind] = bits[group]
        found = starts[hit]
        return documents(block, ids, copied, found + moved[np.searchsorted(offsets, found, "right") - 1])

    return run


def documents(block: Block, ids: list, copied: np.ndarray, starts: np.ndarray) -> pa.Table:
    sizes = np.diff(block.offsets)
    starts = starts[~copied[block.docs_of(starts)]]
    first, last = block.spans(starts)
    of = block.docs_of(first)
    cuts = np.searchsorted(of, np.arange(len(sizes) + 1))
    removed = np.bincount(of, last - first, len(sizes)).astype(np.int64)
    whole = copied & (sizes >= block.length)
    raw, kept = block.data.tobytes(), []
    for d in range(len(sizes)):
        at, parts = int(block.offsets[d]), []
        if not whole[d]:
            for a, b in zip(first[cuts[d] : cuts[d + 1]].tolist(), last[cuts[d] : cuts[d + 1]].tolist(), strict=True):
                parts.append(raw[at:a])
                at = b
            parts.append(raw[at : int(block.offsets[d + 1])])
        kept.append(b"".join(parts))
    columns = (
        ids, sizes, np.where(whole, sizes, removed), np.where(whole, 1, np.diff(cuts)),
        [hashlib.sha256(k).hexdigest() for k in kept], [k.decode(errors="ignore") for k in kept],
    )
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.table({n.split()[0]: pa.array(c, t) for n, c, t in zip(RESULT.split(", "), columns, types, strict=True)})


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and text (what is left) of every row of ``docs`` (doc_id, text). ``length`` is 8 or more."""
    spark = docs.sparkSession
    written = lambda rows: materialize(rows, blobs=True)
    blocks = written(docs.select("doc_id", "text").mapInArrow(pack_blocks, "block long, bytes long, texts binary"))
    total = blocks.agg(F.sum("bytes")).first()[0] or 0
    ranges = max(n_partitions(spark), -(-total // RANGE_BYTES))
    tasks = max(n_partitions(spark), -(-total // (8 * BLOCK)))
    with_texts = lambda rows, step, schema=ROWS: blocks.groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(step, schema)
    kept = lambda rows, kind=KEEPS: rows.filter(F.col("bucket") == kind)

    def asking(rows: DataFrame) -> DataFrame:
        return materialize(rows.withColumn("turn", F.when(F.col("bucket") >= 0, F.col("bucket") % TURNS).otherwise(KEEPS)), blobs=True, by="turn")

    def resolved(asked: DataFrame, resolve) -> tuple[DataFrame, list[DataFrame]]:
        """What the blocks keep and the replies to what they ask, and the tables that hold it."""
        replies = []
        for turn in range(TURNS):
            replies.append(written(asked.filter(F.col("turn") == turn).drop("turn").groupBy("bucket").applyInArrow(resolve, ROWS)))
            discard(asked, part=f"turn={turn}")
        return reduce(DataFrame.unionByName, [asked.filter(F.col("turn") == KEEPS).drop("turn"), *replies]), [asked, *replies]

    def stepped(rows: DataFrame, old: list[DataFrame], step, resolve) -> tuple[DataFrame, list[DataFrame]]:
        # what a block keeps is small, but takes long
        asked = asking(rows.repartition(tasks, "block").groupBy("block").applyInArrow(step, ROWS))
        discard(*old)
        return resolved(asked, resolve)

    rows, old = resolved(asking(blocks.mapInArrow(ask_copies(ranges), ROWS)), shared_keys)
    asked = asking(with_texts(rows, ask_samples(ranges, length)))
    discard(*old)
    rows, old = resolved(asked, shared_keys)
    play = written(with_texts(rows, keep_in_play(length)))
    discard(*old)

    in_play = play.agg(F.sum("n")).first()[0] or 0
    ranges = max(n_partitions(spark), -(-in_play // RANGE_SUFFIXES))
    some = grouped_rows([unpack(r.data)[0] for r in lowest(kept(play, SAMPLES).select("block", "data"), "block", k=max(BOUNDS, ranges // 4))])
    bounds = some[np.unique(np.arange(1, ranges) * len(some) // ranges)] if len(some) else some
    rows, old = stepped(play.filter(F.col("bucket") != SAMPLES), [], ask_words(bounds, length), ranked_keys)
    for level in range(1, len(reach(length))):
        rows, old = stepped(rows, old, ask_names(level, length), ranked_keys)
    rows, _ = stepped(rows.unionByName(kept(play, TEXTS)), [*old, play], ask_merge(bounds, length), merged(length))
    return with_texts(rows, cut_texts(length), RESULT)


def grouped_rows(samples: list[np.ndarray]) -> np.ndarray:
    """The distinct keys, in order."""
    keys = np.concatenate([np.zeros((0, 3), np.uint64), *samples])
    order, new, _ = grouped(keys)
    return keys[order[new]]


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
