"""Cuts the lineage of tables that loops carry from round to round."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint in the folder of spark.checkpoint.dir, which driver and executors share."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        # one process on one machine, as in tests
        context.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="colloquy-"))
    return df.checkpoint()
