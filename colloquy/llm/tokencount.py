"""Token counts per document without token ids.

1. Documents are taken in blocks of about ``BLOCK_BYTES``. A block splits its texts at the added
   tokens and into pre-tokens, and counts each pre-token per document. The distinct pre-tokens with
   their (document, frequency) lists are dealt by a hash of the pre-token to ``buckets``. A slice is a
   run of at most ``SLICE_TASKS * SLICE_BLOCKS`` blocks (8 GB of text).
2. A bucket of a slice encodes each distinct pre-token once, multiplies its number of pieces into the
   frequency lists of the slice's blocks and returns a partial sum for each document.
3. The partial sums are added up by block.

What is shuffled is one compressed value for each block and bucket, not one row a word. A pre-token
that is in every document has one list a block and lies in one bucket of every slice, so no group
grows with the corpus. Sending the pieces of a pre-token from one place to all slices would cost the
rows that encoding it once a slice saves.

Cases: null text counts as empty (0 bytes, 0 tokens); repeated rows and repeated or null ids stay
rows of their own; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, narrow, pack, unpack

BLOCK_BYTES = 16 << 20
BUCKETS = 64
SLICE_TASKS, SLICE_BLOCKS = 64, 8
#: The byte-level pre-tokenizer's pattern (a fixed value of the vocabulary file).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters outside of these ranges may have other classes in the library's Unicode tables than in
#: the regex module's; texts with such go through the library's own (slower) pre-tokenizer.
OTHER = "[^\\x00-\\u0557\\u2010-\\u206f\\u3041-\\u9fff\\uac00-\\ud7a3]"


@lru_cache(1)
def load(name: str):
    """The tokenizer, a function that lists a text's pre-tokens, and the pattern of the added tokens (or None)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    added = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
    words, other = regex.compile(PATTERN), regex.compile(OTHER)

    def pre_tokens(text: str) -> list[str]:
        if other.search(text):
            return [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return words.findall(text)

    return tokenizer, pre_tokens, regex.compile("|".join(map(regex.escape, added))) if added else None


def split_blocks(name: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, words, added = load(name)
        task = TaskContext.get().partitionId()
        for i, batch in enumerate(chunks(batches, "text", BLOCK_BYTES)):
            slice_ = (task // SLICE_TASKS << 32) + i // SLICE_BLOCKS
            yield from block_rows((task << 32) + i, slice_, batch, words, added, buckets)

    return run


def block_rows(block: int, slice_: int, batch: pa.RecordBatch, words, added, buckets: int) -> Iterator[pa.RecordBatch]:
    import numpy as np

    local: dict = defaultdict(count().__next__)
    tokens, freqs, sizes, extra, n_bytes = [], [], [], [], []
    for text in batch.column("text").to_pylist():
        text = text or ""
        n_bytes.append(len(text.encode()))
        parts = added.split(text) if added else [text]
        extra.append(len(parts) - 1)
        found = Counter(words(text)) if len(parts) == 1 else Counter(w for p in parts for w in words(p))
        tokens.extend([local[w] for w in found])
        freqs.extend(found.values())
        sizes.append(len(found))
    token, freq = np.array(tokens, np.int64), np.array(freqs, np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    names = list(local)
    bucket = np.fromiter((zlib.crc32(w.encode()) % buckets for w in names), np.int64, len(names))
    order = np.lexsort((doc, token, bucket[token])) if len(token) else np.zeros(0, np.int64)
    token, freq, doc = token[order], freq[order], doc[order]
    cuts = np.searchsorted(bucket[token], np.arange(buckets + 1))
    rows = [(block, slice_, block % buckets, True, pack(batch.column("doc_id").to_pylist(), np.array(n_bytes), np.array(extra)))]
    for b in np.unique(bucket).tolist():
        lo, hi = cuts[b], cuts[b + 1]
        ids, uses = np.unique(token[lo:hi], return_counts=True)
        rows.append((block, slice_, b, False, pack([names[t] for t in ids.tolist()], narrow(uses), narrow(doc[lo:hi]), narrow(freq[lo:hi]), len(sizes))))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()), strict=True)], ["block", "slice", "bucket", "head", "data"])


def count_bucket(name: str):
    def run(table: pa.Table) -> pa.Table:
        import numpy as np

        tokenizer, _, _ = load(name)
        heads, parts = [], []
        for block, head, data in zip(table["block"].to_pylist(), table["head"].to_pylist(), table["data"].to_pylist(), strict=True):
            (heads if head else parts).append((block, data))
        parts = [(block, *unpack(data)) for block, data in parts]
        known = list({w for _, names, *_ in parts for w in names})
        encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        pieces: dict = {}
        for i in range(0, len(known), 20_000):
            some = known[i : i + 20_000]
            pieces.update(zip(some, map(len, encode(some, add_special_tokens=False)), strict=True))
        out = [(block, True, data) for block, data in heads]
        for block, names, uses, doc, freq, n in parts:
            each = np.repeat(np.fromiter((pieces[w] for w in names), np.int64, len(names)), uses)
            out.append((block, False, pack(narrow(np.bincount(doc, each * freq, n).astype(np.int64)))))
        return pa.table({c: pa.array(v, t) for c, v, t in zip(("block", "head", "data"), zip(*out, strict=True), (pa.int64(), pa.bool_(), pa.binary()), strict=True)})

    return run


def sum_block(table: pa.Table) -> pa.Table:
    import numpy as np

    total = 0
    for head, data in zip(table["head"].to_pylist(), table["data"].to_pylist(), strict=True):
        if head:
            ids, n_bytes, extra = unpack(data)
            total = total + extra
        else:
            total = total + unpack(data)[0].astype(np.int64)
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(n_bytes, pa.int64()), "n_tokens": pa.array(total, pa.int64())})


def token_counts(docs: DataFrame, name: str = "byte_bpe_50k.json", limit: int = 512, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs`` (doc_id, text)."""
    return (
        docs.select("doc_id", "text")
        .mapInArrow(split_blocks(name, buckets), "block long, slice long, bucket int, head boolean, data binary")
        .groupBy("slice", "bucket")
        .applyInArrow(count_bucket(name), "block long, head boolean, data binary")
        .groupBy("block")
        .applyInArrow(sum_block, "doc_id long, n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
