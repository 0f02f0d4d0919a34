"""State as tables: retention, expiry, reviews, rate limits, consecutive misses."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

c = F.col


def newest(df: DataFrame, *order: Column, keep: int) -> DataFrame:
    """First-in first-out retention: a top-k, which each task cuts before anything moves."""
    return df.orderBy(*order).limit(keep)


def expired(df: DataFrame, at: str, now: str, days: int) -> DataFrame:
    return df.filter(c(at) < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


def recent_count(df: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """How many events of the key the last `seconds` hold, this one included (whole seconds)."""
    at = F.unix_timestamp(c(ts).cast("timestamp"))
    return df.withColumn("recent", F.count("*").over(W.partitionBy(key).orderBy(at).rangeBetween(-(seconds - 1), 0)))


def admitted(df: DataFrame, key: str, order: str, ts: str, most: int = 5, seconds: int = 60) -> DataFrame:
    """(key, order, allowed): a sliding-window rate limit in which rejected events don't count; the batch form of `streaming.admitted`.

    A key's events come in order and only the last `most` admitted times are held, however many there are.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            out = []
            for k, at in zip(batch["key"].to_pylist(), batch["at"].to_pylist()):
                if k != last:
                    last, held = k, []
                held = [x for x in held if at - x < seconds]
                out.append(len(held) < most)
                if out[-1]:
                    held.append(at)
            yield pa.RecordBatch.from_arrays([batch["key"], batch["place"], pa.array(out, pa.bool_())], ["key", "place", "allowed"])

    plain = df.select(c(key).cast("long").alias("key"), c(order).cast("long").alias("place"), F.unix_timestamp(c(ts).cast("timestamp")).alias("at"))
    judged = plain.repartition("key").sortWithinPartitions("key", "at", "place").mapInArrow(step, "key long, place long, allowed boolean")
    return judged.select(c("key").alias(key), c("place").alias(order), "allowed")


def before_misses(df: DataFrame, key: str, order: str, hit: Column, misses: int = 2) -> DataFrame:
    """A key's rows up to the first run of `misses` misses (the run itself is out)."""
    w = W.partitionBy(key).orderBy(order)
    run = F.when(hit, 0).otherwise(1)
    stop = sum((F.lag(run, k, 0).over(w) for k in range(misses)), F.lit(0)) == misses
    marked = df.withColumn("_stop", stop.cast("int"))
    ahead = F.max("_stop").over(w.rowsBetween(W.unboundedPreceding, misses - 1))
    return marked.withColumn("_over", ahead).filter("_over = 0").drop("_stop", "_over")


def upsert(table: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The table after changes of the same columns; a key's last change holds."""
    last = changes.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).filter("_r = 1").drop("_r")
    return table.join(last, key, "left_anti").unionByName(last, allowMissingColumns=True)
