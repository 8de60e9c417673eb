"""Shared helpers: materialised intermediates, joins with hot keys and bounded Arrow chunks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 8 << 20


#: A key is hot with over this many rows and over one of HOT_KEYS parts of all; so fewer than HOT_KEYS keys are.
HOT_ROWS, HOT_KEYS = 256, 2048
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
READ_ROWS = "spark.sql.parquet.columnarReaderBatchSize"
BLOB_GROUP = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    # one process on one machine, as in tests
    found = "file://" + tempfile.mkdtemp(prefix="colloquy-")
    spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame, blobs: bool = False, by: str | None = None) -> DataFrame:
    """Cuts the lineage: writes ``df`` as a Parquet table in the shared folder and reads it back. Its shuffle files go once it is written.

    ``blobs``: rows hold up to some MB that are compressed already, so fewer of them are read and written at a time.
    ``by``: a column whose values have folders of their own, which discard() can delete one by one.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/colloquy-{uuid.uuid4().hex}"
    conf = {CLEANUP: "true"} | ({READ_ROWS: "128"} if blobs else {})
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        writer = df.write.option("compression", "uncompressed").option("parquet.block.size", BLOB_GROUP) if blobs else df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    table = spark.read.schema(df.schema).parquet(path)
    table.written = path
    return table


def discard(*tables: DataFrame, part: str = "") -> None:
    """Deletes materialised tables (or one folder of each) that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{table.written}/{part}")
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def skew_join(big: DataFrame, small: DataFrame, keys: list[str], rows: str) -> DataFrame:
    """Inner join on keys that are unique in ``small`` and never null; ``rows`` is small's column of how many rows of ``big`` have the key.

    Hot keys go to every task: there are fewer than ``HOT_KEYS``. All others are shuffled, and none has more
    than one of ``HOT_KEYS`` parts of the rows.
    """
    total = small.agg(F.sum(rows)).first()[0] or 0
    hot = small.filter(F.col(rows) > max(HOT_ROWS, total // HOT_KEYS))
    if hot.isEmpty():
        return big.join(small, keys)
    rest = big.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(small, keys)
    return big.join(F.broadcast(hot), keys).unionByName(rest)


def n_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def lowest(rows: DataFrame, *hashed: str, k: int, n: int | None = None) -> list:
    """The k rows of the lowest hashes of the columns ``hashed``. About 4 k rows go to the driver, however many tasks read them."""
    n = rows.count() if n is None else n
    key = F.xxhash64(*hashed)
    some = rows.filter(key <= int(-(2**63) + 2**64 * (4 * k / n))) if n > 4 * k else rows
    return some.orderBy(key, *hashed).limit(k).collect()


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that ``column`` holds about ``limit`` bytes a chunk; a longer row is alone."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = total = 0
        for i, n in enumerate(lengths):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)
        # a worker lives on through many stages
        pa.default_memory_pool().release_unused()


def texts_of(batch: pa.RecordBatch, column: str) -> tuple[memoryview, "object"]:
    """The bytes of a string or binary column as one array, and its offsets (n + 1); null is empty."""
    import numpy as np

    col = batch.column(column)
    col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "").cast(pa.large_binary())
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pack(*values: object) -> bytes:
    """Compressed bytes of numpy arrays and plain values, for binary columns between our own stages."""
    import pickle

    import zstandard

    return zstandard.compress(pickle.dumps(values, 5), 1)


def unpack(data: bytes) -> tuple:
    import pickle

    import zstandard

    return pickle.loads(zstandard.decompress(data))


def narrow(values):
    """The same whole numbers (none negative) in the smallest unsigned type."""
    import numpy as np

    values = np.asarray(values)
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))
