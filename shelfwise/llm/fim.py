"""Fill-in-the-middle transformation (operator 13).

A text is decoded once into a numpy array of code points. Where the class of neighbouring code points changes from a word
to white space a unit begins, so the units' boundaries are the places that `flatnonzero` gives; ranks drawn from a hash of
the id choose two of them, and the three slices are encoded again around their marks.

Defined cases: a null text is an empty one; an empty text and one that holds a mark stay plain; a text without white space
is one unit, one of white space only too; a null id is hashed as empty text; repeated rows each give their own row; an
empty table gives an empty result; further columns are ignored, whatever their names. Work is done row by row within
Arrow batches, nothing is shuffled, and memory is a few times the longest text of a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: int | None, seed: int = 42) -> list[int]:
    """Four unsigned numbers of 32 bits, from the seed and the id alone."""
    hexed = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(hexed[k : k + 8], 16) for k in range(0, 32, 8)]


def boundaries(points: np.ndarray) -> np.ndarray:
    """Where units begin, and the end: n + 1 places for n units. A unit is white space and the word after it, or what white space is last."""
    if not len(points):
        return np.zeros(1, np.int64)
    blank = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    begins = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    return np.concatenate(([0], begins, [len(points)]))


def transform_text(text: str, doc_id: int | None, rate: int = 50, spm_rate: int = 80, seed: int = 42) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars and output of one text; rates are percentages."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = boundaries(points)
    n = len(at) - 1
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not n or h3 % 100 >= rate or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    low, high = (int(at[k]) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = (points[a:b].tobytes().decode("utf-32-le") for a, b in ((0, low), (low, high), (high, None)))
    if h4 % 100 < spm_rate:
        return n, "spm", low, high - low, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", low, high - low, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 50, spm_rate: int = 80, seed: int = 42) -> DataFrame:
    """Per row doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output, the transformed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch["doc_id"], [transform_text(x, i, rate, spm_rate, seed) for x, i in zip(batch["text"].to_pylist(), batch["doc_id"].to_pylist())]
            n, form, prefix, middle, output = zip(*found) if found else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return common.id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def restored(form: Column, output: Column) -> Column:
    """The text again, from form and output alone. No piece holds a mark and no mark overlaps another, so splitting at marks gives back the pieces."""
    part = F.split(output, "|".join(MARKS))
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def digest_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The transformed rows with SHA-256 digests in place of the texts."""
    done = transform(docs, id_col, text_col)
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("form"), F.col("output"))).alias("restored_sha256"))
