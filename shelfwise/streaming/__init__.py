"""Incremental ingestion."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def new_keys(stream: DataFrame, key: str, ts: str, delay: str = "1 day") -> DataFrame:
    """The first row of each key in a stream; keys are forgotten once the watermark has passed them."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, key: str, ts: str, width: str, delay: str) -> DataFrame:
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, width), key).count()


def admitted(stream: DataFrame, key: str, ts: str, most: int = 5, seconds: int = 60) -> DataFrame:
    """(key, ts, allowed): a sliding-window rate limit in which rejected events don't count."""

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for frame in frames:
            out = []
            for at in frame[ts].sort_values():
                held = [t for t in held if at.timestamp() - t < seconds]
                out.append((keys[0], at, len(held) < most))
                if out[-1][2]:
                    held.append(at.timestamp())
            yield pd.DataFrame(out, columns=["key", "ts", "allowed"])
        state.update((held,))

    plain = stream.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias(ts))
    return plain.groupBy("key").applyInPandasWithState(step, "key long, ts timestamp, allowed boolean", "held array<double>", "append", GroupStateTimeout.NoTimeout)
