"""Documents to packed training windows, stage by stage.

Each stage takes what the one before has kept, as a Parquet table read again, and returns the columns of documents; the
last returns the pieces of the packed windows. A stage's table is deleted when its successor's is written; the last table
is what the result reads, and holds no personal data that the stage before it has found.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm import common, exact_dedup, near_copies, packing, pii, quality
from shelfwise.llm.queries import RANKS, TOKENIZER

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    common.tune(spark)
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    common.tune(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more."""
    common.tune(spark)
    return near_copies.drop(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kind."""
    common.tune(spark)
    return pii.redact(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, as pieces of windows of 2048 tokens."""
    common.tune(spark)
    return packing.pack(docs, TOKENIZER, RANKS)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good_quality),
    ("exact_dedup", drop_exact_copies),
    ("simhash", drop_near_copies),
    ("pii", redact_personal_data),
    ("packing", pack_windows),
]

#: No SQL expresses the classifier, the fingerprints or the packing; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
