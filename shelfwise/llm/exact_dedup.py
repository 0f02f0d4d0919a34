"""Exact dedup with a heavy-hitter split (operator 9).

Each row's normalised text is digested once, and only (doc_id, digest) goes on. A Misra-Gries summary of each task, merged
level by level, names every digest that holds more than 1 / (counters + 1) of all rows. Those candidates are counted
exactly, and their winners (at most `counters` rows) are broadcast, so that their copies are decided where they lie. All
other digests are shuffled; no group of them exceeds that share.

Defined cases: a null text is an empty one, and empty texts are equal to each other; the largest doc_id of a group stays,
a null doc_id only if the group has no other; doc_id may be text that holds a whole number (one that can't be cast to a long is
an error of the cast); rows that repeat with the same doc_id and text are one document to
`resolve` (all are marked as kept) and `drop_copies` leaves one of them; an empty table gives an empty result; further
columns are ignored by `resolve` and returned by `drop_copies`.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: How many digests a summary holds at most.
COUNTERS = 1000


def digest(text: str | None) -> bytes:
    """SHA-256 of the text in UTF-8 after lower-casing A-Z only (bytes.lower leaves all other bytes)."""
    return hashlib.sha256((text or "").encode().lower()).digest()


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([digest(x) for x in batch["text"].to_pylist()], pa.binary())], ["doc_id", "digest"])

    return common.id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, digest binary")


def cut_down(counts: dict[bytes, int], most: int) -> dict[bytes, int]:
    """The Misra-Gries step for many counters at once: subtract the (most + 1)-th largest count from all, keep what is above zero."""
    if len(counts) <= most:
        return counts
    less = sorted(counts.values(), reverse=True)[most]
    return {k: n - less for k, n in counts.items() if n > less}


def summaries(batches: Iterator[pa.RecordBatch], most: int) -> dict[bytes, int]:
    held: Counter = Counter()
    for batch in batches:
        held.update(dict(zip(batch["digest"].to_pylist(), batch["n"].to_pylist())) if "n" in batch.schema.names else Counter(batch["digest"].to_pylist()))
        if len(held) > 8 * most:
            held = Counter(cut_down(held, most))
    return cut_down(held, most)


def heavy_candidates(digested: DataFrame, most: int = COUNTERS, fan_in: int = 32) -> DataFrame:
    """At most `most` digests; every digest with over 1 / (most + 1) of the rows is one of them. fan_in summaries are merged at a time.

    A shuffle parts the levels: each task summarises its own rows, and only summaries move.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = summaries(batches, most)
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["digest", "n"])

    level = digested.select("digest").mapInArrow(run, "digest binary, n long")
    parts = digested.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // fan_in)
        level = level.repartition(parts).mapInArrow(run, "digest binary, n long")
    return level


def winners(digested: DataFrame, most: int = COUNTERS) -> DataFrame:
    """Exact (digest, keep_id, group_size) of the heavy candidates that do repeat: at most `most` rows."""
    named = [bytes(r[0]) for r in heavy_candidates(digested, most).collect()]
    schema = "digest binary"
    held = digested.sparkSession.createDataFrame([(x,) for x in named], schema)
    return (
        digested.join(F.broadcast(held), "digest", "left_semi")
        .groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
    )


def resolve(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = COUNTERS) -> DataFrame:
    """Per row doc_id, keep_id, group_size, kept and text_sha256."""
    digested = common.stored(digests(docs, id_col, text_col), "digests")
    rows = winners(digested, most).collect()  # at most `most` of them
    held = digested.sparkSession.createDataFrame(rows, "digest binary, keep_id long, group_size long")
    near = digested.join(F.broadcast(held), "digest")
    rest = digested.join(F.broadcast(held.select("digest")), "digest", "left_anti")
    sums = rest.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    decided = near.unionByName(rest.join(sums.hint("shuffle_hash"), "digest"))
    return decided.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = COUNTERS) -> DataFrame:
    """docs without the copies, all columns as they were.

    Copies of heavy digests go where they are read. Only the ids and digests of the others are grouped; a doc_id that
    loses is taken out by an anti join on (id, digest), in which the texts move but once.
    """
    spark, columns = docs.sparkSession, docs.columns
    digested = common.stored(digests(docs, id_col, text_col), "digests")
    rows = winners(digested, most).collect()
    keep = {bytes(r[0]): r[1] for r in rows}
    held = spark.sparkContext.broadcast(keep)
    key, copy, number = "__digest", "__copy", "__id"
    while {key, copy, number} & set(columns):
        key, copy, number = "_" + key, "_" + copy, "_" + number
    schema = T.StructType([*docs.schema.fields, T.StructField(number, T.LongType()), T.StructField(key, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [digest(x) for x in batch.column(columns.index(text_col)).to_pylist()]
            ids = batch.column(len(columns)).to_pylist()  # as numbers, whatever type the id column has
            stays = pa.array([d not in held.value or held.value[d] == i for d, i in zip(own, ids)], pa.bool_())
            whole = pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.binary())], [*batch.schema.names, key])
            yield whole.filter(stays)

    tagged = docs.withColumn(number, F.col(id_col).cast("long")).mapInArrow(run, schema)
    light = digested.join(F.broadcast(spark.createDataFrame(rows, "digest binary, keep_id long, group_size long").select("digest")), "digest", "left_anti")
    best = light.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n")).filter("n > 1")
    # what repeats with one id, and what lost: both are found by digest, and the texts are shuffled once by it
    marked = tagged.join(best.select(F.col("digest").alias(key), F.col("keep_id").alias(copy)), key, "left")
    alone = marked.filter(F.col(copy).isNull() | F.col(number).eqNullSafe(F.col(copy)))
    twice = digested.groupBy("doc_id", "digest").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count() > 0
    if twice:
        alone = alone.dropDuplicates([number, key])
    return alone.select(*columns)
