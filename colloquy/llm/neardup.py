"""Near-duplicate classes of documents by weighted DartMinHash, banding and exact checks.

Documents are multisets of ``SHINGLE``-word shingles (a-z lower-cased words; fewer words make one shingle): the weight of
a shingle is how often it occurs, or 1 with ``weights="distinct"``. Two documents are linked if their weighted
Jaccard similarity (sum of least weights over sum of greatest weights) is at least 0.8; classes are the connected
components of all links.

1. Texts of equal words are one node (a 128-bit digest).
2. Signatures: hashed darts fall on (weight, rank) regions of each element, the same for every
   document: layer n of an element holds weights [2^n - 1, 2^(n+1) - 1) and gets darts at exponential
   gaps of rank. Those under the document's weight and rank limit hit one of ``COORDS`` coordinates; the
   earliest dart of each stays. The rank limit is k (ln k + 3) / weight, doubled while a coordinate is empty.
3. ``BANDS`` bands of ``COORDS / BANDS`` coordinates make buckets. Each member of a bucket is checked exactly
   against the bucket's least member; components follow.
4. In a bucket of three or more whose members then still have several components, every pair that
   isn't yet connected and involves a node outside the bucket's largest component is checked, in pairs
   of chunks of bounded size. So no link between two members of a bucket is lost, and equal or
   connected ones are never expanded into pairs.

Checks compare 64-bit names of (shingle, which occurrence it is), distinct within a document, so that a count of equal names is
the sum of least weights. They are made only for nodes in checks; a bit filter of bounded size keeps others from being shuffled.
At similarity 0.8 a pair shares a bucket with probability 1 - (1 - 0.8^4)^16 > 0.9997. Keys that hold many rows (a text,
bucket, class or centre of a star) are joined apart from the others or dealt in chunks (``skew_join``, ``MEMBERS``).

Cases: texts without words are linked only to equal texts (null counts as empty); a repeated row is a
copy; the class id is the least doc_id (null only if all are); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, discard, materialize, skew_join, texts_of
from .decontam import byte_codes, words_of
from .pieces import mixed

SHINGLE = 5
COORDS, BANDS = 64, 16
CHUNK_BYTES = 1 << 20
#: Sets compared with each other or with one more set in a group of a task.
MEMBERS = 128
#: Bits of the filter for each wanted node, and most bits in all (16 MB); a fuller filter lets more sets be shuffled.
NODE_BITS, FILTER_BITS = 16, 1 << 27
#: Rows that leave_one() may broadcast (17 bytes each).
SMALL = 2_000_000


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Distinct (document, shingle) pairs in order, how often each occurs, and a digest for each document."""
    n = len(offsets) - 1
    starts, _, words = words_of(data, offsets, byte_codes(6))
    words = mixed(words)
    doc = np.searchsorted(offsets, starts, "right") - 1
    sizes = np.bincount(doc, minlength=n)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(words)) - first[doc]
    full = np.zeros(len(words), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            # past a short document's end nothing is added
            inside = np.minimum(np.arange(len(words)) + k, max(len(words) - 1, 0))
            full = full * np.uint64(0x9E3779B97F4A7C15) + np.where(place + k < sizes[doc], words[inside], np.uint64(0))
        at = np.flatnonzero((place + SHINGLE <= sizes[doc]) | (place == 0))
        parts = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
        for i, salt in enumerate((3, 7)):
            if len(words):
                each = mixed(words ^ mixed(place.astype(np.uint64) * np.uint64(2) + np.uint64(salt << 40)))
                some = sizes > 0
                parts[i][some] = mixed(np.add.reduceat(each, first[some]))
    digests = np.stack(parts, 1)
    keys = [digests[d].tobytes() if sizes[d] else hashlib.blake2b(data[offsets[d] : offsets[d + 1]].tobytes(), digest_size=16).digest() for d in range(n)]
    shingle, doc = mixed(full[at]), doc[at]
    order = np.lexsort((shingle, doc))
    shingle, doc = shingle[order], doc[order]
    new = np.append(True, (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1]))[: len(doc)]
    index = np.flatnonzero(new)
    return doc[index], shingle[index], np.diff(np.append(index, len(doc))), keys


def uniform(x: np.ndarray) -> np.ndarray:
    """Of hashes: numbers in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int = COORDS, seed: int = 0) -> np.ndarray:
    """n x k ids of the earliest darts; rows of documents without elements are 0. Weights are over 0."""
    out = np.zeros((n, k), np.uint64)
    weight = weight.astype(np.float64)
    # one entry for each element and layer that its weight reaches
    layers = np.floor(np.log2(weight + 1)).astype(np.int64)
    layers += (2.0**layers - 1) < weight
    entry = np.repeat(np.arange(len(doc)), layers)
    layer = np.arange(len(entry)) - np.repeat(np.cumsum(layers) - layers, layers)
    key = mixed(element[entry] ^ mixed(layer.astype(np.uint64) + np.uint64((seed + 1) << 32)))
    total = np.bincount(doc, weight, n)
    limit = np.zeros(n)
    limit[total > 0] = k * (np.log(k) + 3) / total[total > 0]
    todo = total > 0
    while todo.any():
        own = np.flatnonzero(todo[doc[entry]])
        rank, hits = np.zeros(len(own)), []
        throw = 0
        while len(own):
            dart = mixed(key[own] + np.uint64(throw * 0x9E3779B97F4A7C15 % 2**64))
            width = 2.0 ** layer[own]
            rank = rank - np.log(uniform(mixed(dart ^ np.uint64(1)))) / width
            near = rank <= limit[doc[entry[own]]]
            own, rank, dart, width = own[near], rank[near], dart[near], width[near]
            lies = width - 1 + uniform(mixed(dart ^ np.uint64(2))) * width <= weight[entry[own]]
            hits.append((doc[entry[own]][lies], (mixed(dart[lies] ^ np.uint64(3)) % np.uint64(k)).astype(np.int64), rank[lies], dart[lies]))
            throw += 1
        d, coord, rank, dart = (np.concatenate(x) for x in zip(*hits, strict=True))
        cell = d * k + coord
        order = np.lexsort((rank, cell))
        cell, dart = cell[order], dart[order]
        first = np.append(True, cell[1:] != cell[:-1])[: len(cell)]
        filled = np.bincount(cell[first] // k, minlength=n) == k
        done = first & filled[cell // k]
        out.ravel()[cell[done]] = dart[done]
        todo &= ~filled
        limit = np.where(todo, 2 * limit, limit)
    return out


def band_hashes(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = signature.shape[1] // bands
    out = np.zeros((len(signature), bands), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(rows):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + signature[:, i::rows])
        return mixed(out + np.arange(bands, dtype=np.uint64))


def sign(weights: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK_BYTES):
            n = batch.num_rows
            doc, element, count, keys = shingles(*texts_of(batch, "text"))
            found = signatures(doc, element, count if weights == "counts" else np.ones(len(doc)), n)
            hashes = band_hashes(found).view(np.int64)
            some = np.bincount(doc, minlength=n) > 0
            sizes = np.where(some, BANDS, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(hashes[some].ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fp"), pa.array(keys, pa.binary()), lists], ["doc_id", "fp", "node", "bands"])

    return run


def occurrences(element: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sorted distinct names of the occurrences: of an element with weight c, c names."""
    which = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    names = np.repeat(element, count)
    more = which > 0
    names[more] = mixed(names[more] ^ mixed(which[more].astype(np.uint64)))
    return np.unique(names)


def sets_of(bits, weights: str):
    """Names of the occurrences in texts whose node may be wanted. bits: broadcast bit filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted_bits = bits.value
        for batch in chunks(batches, "text", CHUNK_BYTES):
            doc, element, count, keys = shingles(*texts_of(batch, "text"))
            slots = (np.frombuffer(b"".join(keys), np.uint64)[::2] % np.uint64(len(wanted_bits) * 8)).astype(np.int64)
            wanted = np.flatnonzero(wanted_bits[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1)
            cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            parts = [slice(cuts[d], cuts[d + 1]) for d in wanted.tolist()]
            rows = [occurrences(element[p], count[p] if weights == "counts" else np.ones(p.stop - p.start, np.int64)).tobytes() for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array([keys[d] for d in wanted.tolist()], pa.binary()), pa.array(rows, pa.binary())], ["node", "names"])

    return run


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted arrays have Jaccard similarity 0.8 or more."""
    if min(len(a), len(b)) * 5 < max(len(a), len(b)) * 4:
        return False
    both = np.sort(np.concatenate((a, b)), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 5 * shared >= 4 * (len(a) + len(b) - shared)


def check_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of rows (a, chunk, side, node, names) sorted by these: side 0 is the centre a itself, side 1 what to check against it."""
    key = centre = None
    for batch in batches:
        found = []
        # the sets are views of the batch's own bytes
        data, offsets = texts_of(batch, "names")
        for i, (a, chunk, side, node) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "chunk", "side", "node")), strict=True)):
            names = data[offsets[i] : offsets[i + 1]].view(np.uint64)
            if side == 0:
                key, centre = (a, chunk), names.copy()
            elif key == (a, chunk) and similar(centre, names):
                found.append((a, node))
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.binary()) for i in (0, 1)], ["a", "b"])


def check_chunks(table: pa.Table) -> pa.Table:
    """Links between a chunk of minor members and another chunk, none between nodes already connected."""
    rows = {(r["side"], r["node"]): r for r in table.to_pylist()}
    left = [r for (side, _), r in rows.items() if side == 0]
    right = [r for (side, _), r in rows.items() if side == 1]
    root: dict = {}

    def find(x: bytes) -> bytes:
        while root.get(x, x) != x:
            x = root[x]
        return x

    out = []
    sets = {r["node"]: np.frombuffer(r["names"], np.uint64) for r in rows.values()}
    for x in left:
        for y in right:
            a, b = find(x["comp"]), find(y["comp"])
            if a != b and similar(sets[x["node"]], sets[y["node"]]):
                root[max(a, b)] = min(a, b)
                out.append((min(x["node"], y["node"]), max(x["node"], y["node"])))
    return pa.table({"a": pa.array([o[0] for o in out], pa.binary()), "b": pa.array([o[1] for o in out], pa.binary())})


def bit_filter(nodes: DataFrame, n: int) -> np.ndarray:
    """A filter of at most FILTER_BITS bits for n nodes; it only ever lets too many through."""
    size = min(FILTER_BITS, max(1 << 16, 1 << (NODE_BITS * n).bit_length()))
    byte = lambda i: F.conv(F.substring(F.hex("node"), 1 + 2 * i, 2), 16, 10).cast("long")
    slot = F.pmod(byte(0) + byte(1) * 256 + byte(2) * 65536 + byte(3) * 16777216, F.lit(size))
    rows = nodes.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / 32768).alias("part")).agg(F.bitmap_construct_agg((F.col("slot") % 32768)).alias("bits")).collect()
    bits = np.zeros((size // 32768, 4096), np.uint8)
    for r in rows:
        bits[r.part] = np.packbits(np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), bitorder="little"))
    return bits.ravel()


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for the links (a, b), a < b, by alternating large and small stars."""
    edges = materialize(links.select("a", "b").distinct())
    done = edges.isEmpty()
    while not done:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: greater neighbours of a node are linked to its least neighbour
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m")))
        large = materialize(skew_join(both, least, ["a"], "n").filter("b > a").select(F.col("m").alias("a"), "b").filter("a < b").distinct())
        # small star: a node and its lesser neighbours are linked to the least of them
        small = materialize(large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n")))
        linked = skew_join(large, small, ["b"], "n")
        new = linked.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(linked.select(F.col("m").alias("a"), "b")).filter("a < b").distinct()
        new = materialize(new)
        done = new.join(edges, ["a", "b"], "left_anti").isEmpty() and edges.join(new, ["a", "b"], "left_anti").isEmpty()
        discard(edges, least, large, small)
        edges = new
    out = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    out.written = edges.written
    return out


def near_duplicates(docs: DataFrame, weights: str = "counts") -> DataFrame:
    """doc_id, fp (xxhash64 of the text), class_id, class_size, kept for every row of ``docs`` (doc_id, text); one row of each class is kept."""
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("fp"))
    signed = texts.mapInArrow(sign(weights), "doc_id long, fp long, node binary, bands array<long>").withColumn("row", F.monotonically_increasing_id())
    signed = materialize(signed)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    nodes = materialize(signed.groupBy("node").agg(F.first("bands").alias("bands"), F.count("*").alias("copies"), first))
    members = nodes.select("node", F.posexplode("bands").alias("band", "hash"))
    buckets = materialize(members.groupBy("band", "hash").agg(F.min("node").alias("least"), F.count("*").alias("size")).filter("size > 1"))
    members = materialize(skew_join(members, buckets, ["band", "hash"], "size"))

    wanted = materialize(members.select("node").distinct())
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted, wanted.count()))
    sets = texts.mapInArrow(sets_of(bits, weights), "node binary, names binary").groupBy("node").agg(F.first("names").alias("names"))
    sets = materialize(sets)
    links = star_checked(members.filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct(), sets)
    found = components(links)

    # buckets of three or more that still have several components
    placed = members.filter("size > 2").select("band", "hash", "node").join(found, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    placed = materialize(placed)
    per = placed.groupBy("band", "hash", "comp").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("s"))
    open_ = per.groupBy("band", "hash").agg(F.max(F.struct("n", "comp")).alias("main"), F.count("*").alias("comps"), F.sum("n").alias("n"), F.sum("s").alias("s")).filter("comps > 1")
    # buckets of the same members are checked once
    open_ = materialize(open_.groupBy("n", "s").agg(F.min(F.struct("band", "hash", "main")).alias("one")).select("one.band", "one.hash", "one.main", "n"))
    more = materialize(cross_checked(placed, open_, sets))
    if not more.isEmpty():
        discard(found)
        found = components(links.unionByName(more))

    of = materialize(nodes.select("node", "copies", "first").join(found, "node", "left").withColumn("root", F.coalesce("root", "node")))
    roots = materialize(of.groupBy("root").agg(F.min("first").alias("least"), F.sum("copies").alias("class_size"), F.count("*").alias("n")))
    of = materialize(skew_join(of.select("node", "root", "copies"), roots, ["root"], "n").select("node", "copies", "least", "class_size"))
    discard(nodes, buckets, members, wanted, sets, links, found, placed, open_, more, roots)
    rows = skew_join(signed.select("doc_id", "fp", "row", "node"), of, ["node"], "copies")
    return rows.select("doc_id", "fp", F.col("least.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("least.row")).alias("kept"))


def dealt(column: str, n: str) -> F.Column:
    """Which of the chunks of about MEMBERS a row of a group of n is in."""
    return F.pmod(F.xxhash64(column), F.ceil(F.col(n) / MEMBERS))


def star_checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are similar. The pairs of a node a are dealt in chunks, each with a's set."""
    pairs = materialize(pairs)
    degrees = materialize(pairs.groupBy("a").agg(F.count("*").alias("n")))
    placed = materialize(skew_join(pairs, degrees, ["a"], "n").select("a", dealt("b", "n").alias("chunk"), "b"))
    centres = placed.select("a", "chunk", F.lit(0).alias("side"), F.col("a").alias("node")).distinct()
    both = centres.unionByName(placed.select("a", "chunk", F.lit(1).alias("side"), F.col("b").alias("node"))).join(sets, "node")
    links = materialize(both.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "side").select("a", "chunk", "side", "node", "names").mapInArrow(check_stars, "a binary, b binary"))
    discard(pairs, degrees, placed)
    return links


def cross_checked(placed: DataFrame, open_: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among the members (band, hash, node, comp) of open buckets (band, hash, main, n) outside of the largest component, and between these and all others."""
    key = ["band", "hash"]
    rows = skew_join(placed, open_, key, "n").withColumn("n_minor", F.col("n") - F.col("main.n"))
    cut = lambda n: F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / MEMBERS) - 1)
    left = rows.filter("comp <> main.comp").select(*key, "node", "comp", dealt("node", "n_minor").alias("i"), F.explode(cut("n")).alias("j"), F.lit(0).alias("side"))
    right = rows.select(*key, "node", "comp", F.explode(cut("n_minor")).alias("i"), dealt("node", "n").alias("j"), F.lit(1).alias("side"))
    both = left.unionByName(right).join(sets, "node")
    return both.groupBy(*key, "i", "j").applyInArrow(check_chunks, "a binary, b binary").distinct()


def leave_one(docs: DataFrame, marked: DataFrame, small: int = SMALL) -> DataFrame:
    """The rows of ``docs`` that ``marked`` (near_duplicates of them) keeps.

    Only the keys of rows that go (and of those that are there twice, of which one stays) meet the texts: they are broadcast
    up to ``small`` of them, else the texts are shuffled once.
    """
    keys = marked.groupBy("doc_id", "fp").agg(F.max("kept").alias("stays"), F.count("*").alias("n")).filter("not stays or n > 1")
    keys = materialize(keys.select(F.col("doc_id").alias("of_id"), F.col("fp").alias("of_fp"), "stays"))
    side = (lambda df: F.broadcast(df)) if keys.count() <= small else (lambda df: df)
    rows = docs.withColumn("of", F.xxhash64("text"))
    same = rows["doc_id"].eqNullSafe(F.col("of_id")) & (rows["of"] == F.col("of_fp"))
    out = rows.join(side(keys), same, "left_anti")
    twice = keys.filter("stays")
    if not twice.isEmpty():
        out = out.unionByName(rows.join(side(twice), same, "left_semi").dropDuplicates(["doc_id", "of"]))
    return out.select(docs.columns)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "class_size", "kept")
