"""Rows by key: distinct, last wins, best per key, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """Each key with its first position and how often it occurs."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("first_at"), F.count("*").alias("n"))


def best(df: DataFrame, keys: list[str], *order: Column, k: int = 1) -> DataFrame:
    """The k first rows of each key; Spark cuts each task's groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def lookup(rows: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """A left join by a column of the same name; the optimizer picks the strategy from the sizes."""
    return rows.join(index, key, "left")


def page(df: DataFrame, offset: int, limit: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def in_range(df: DataFrame, order: str, first: int, last: int) -> DataFrame:
    """Rows first to last (from 1, both included) in an order. A task holds `last` rows at most, so this is for ranges near the start."""
    return df.orderBy(order).offset(first - 1).limit(last - first + 1)


def sampled(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows that depend on the seed alone."""
    return df.withColumn("draw", F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")).cast("binary"))).orderBy("draw", key).limit(n)


def specific(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The wanted rows that exist, and the wanted keys that don't."""
    have = df.join(wanted, key, "left_semi").select(key, F.lit(True).alias("known"))
    return have.unionByName(wanted.join(df, key, "left_anti").select(key, F.lit(False).alias("known")))
