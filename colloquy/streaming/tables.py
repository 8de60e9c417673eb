"""Per-generation tables of a running search: each micro-batch is written once, however often it is run again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Callback = Callable[[DataFrame, int], None]


def merged(*callbacks: Callback) -> Callback:
    """One callback for foreachBatch that calls all in order, on a batch that is computed once."""

    def call(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for callback in callbacks:
                callback(batch, batch_id)
        finally:
            batch.unpersist()

    return call


def table_callback(path: str, summary: Callable[[DataFrame], DataFrame]) -> Callback:
    """Writes ``summary(batch)`` to the Parquet table at ``path``, in the batch's own folder (batch=...): a batch that runs again after a failure
    or a restart from its checkpoint replaces what it wrote, so no row is there twice."""

    def call(batch: DataFrame, batch_id: int) -> None:
        summary(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return call


def generation_summary(batch: DataFrame, run: str = "run", failed: str = "failed") -> DataFrame:
    """Tests, failures and their share of each run in a batch."""
    out = batch.groupBy(run).agg(F.count("*").alias("tests"), F.count_if(F.col(failed)).alias("failures"))
    return out.withColumn("critical_ratio", F.col("failures") / F.col("tests"))


def running_table(path: str, spark, run: str = "run") -> DataFrame:
    """The table so far, with totals up to each batch: test_size, failures and critical_ratio by run."""
    from pyspark.sql.window import Window

    order = Window.partitionBy(run).orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    rows = spark.read.parquet(path).withColumns({"test_size": F.sum("tests").over(order), "total_failures": F.sum("failures").over(order)})
    return rows.select(run, "batch", "test_size", F.col("total_failures").alias("failures"), (F.col("total_failures") / F.col("test_size")).alias("critical_ratio"))
