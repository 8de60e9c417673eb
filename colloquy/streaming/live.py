"""Live monitoring of runs with Structured Streaming (extensions of the batch operators)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_failures(events: DataFrame) -> DataFrame:
    """Counters of each run, for update mode."""
    return events.groupBy("run").agg(F.count("*").alias("test_size"), F.count_if("failed").alias("failures"))


def failures_per_window(events: DataFrame, length: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Tests and failures of each run and tumbling window; rows later than ``late`` are dropped by the watermark."""
    counted = events.withWatermark("ts", late).groupBy("run", F.window("ts", length).alias("w")).agg(F.count("*").alias("tests"), F.count_if("failed").alias("failures"))
    return counted.select("run", F.col("w.start").alias("start"), "tests", "failures")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events of each user by gaps of inactivity."""
    counted = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def session_constraints(turns: DataFrame, max_turns: int = 20) -> DataFrame:
    """Per user: turns so far and the last non-null constraint; starts anew after ``max_turns``. For update mode."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, None)
        for frame in frames:
            for value in frame.sort_values("ts")["constraint"]:
                n, last = (1, None) if n >= max_turns else (n + 1, last)
                last = value if value is not None else last
        state.update((n, last))
        yield pd.DataFrame({"user_id": [key[0]], "n_turns": [n], "constraint": [last]})

    return turns.groupBy("user_id").applyInPandasWithState(step, "user_id long, n_turns long, constraint string", "n long, last string", "update", GroupStateTimeout.NoTimeout)
