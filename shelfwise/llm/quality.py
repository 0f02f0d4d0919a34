"""Quality classifier on supervised subword embeddings (operator 2).

A text's features are its words, its bigrams of words, and the character n-grams inside each word and its borders, hashed
to buckets; bigrams that repeat a word share one bucket, as their words are mostly unseen. Each bucket has a learned vector; a document is the average of its features' vectors, and a softmax layer gives the two labels'
probabilities. Vectors and layer are trained together by stochastic gradient descent in numpy.

Fit takes at most `most` labelled documents (those with the smallest hash of doc_id), so what reaches the driver is bounded:
`most` rows, each of at most 2^17 + 1 distinct buckets and their counts, which tasks have made and compressed; training opens
one document at a time. Scoring needs the trained model only as one number a bucket
(vector times the layer's difference), broadcast once; its size doesn't depend on the data.

Defined cases: a null or empty text has no features and gets the layer's bias alone; texts are scored whole; a doc_id
labelled twice counts with its lower label; labels that are null or lack a document are left out; without labels every
score is 0.5; with one label only, scores tend to it; rows that repeat get equal scores; an empty table gives an empty
result; further columns are ignored by `score_documents` and returned by `keep_good`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS_LOG2 = 17
ODD = np.uint64(0x9E3779B97F4A7C15)
#: The bucket of bigrams of one word twice, beyond those of the hash: they share a vector, whatever the word.
SAME = np.uint64(1 << BUCKETS_LOG2)
#: Scores from here on count as label 1.
THRESHOLD = 0.3


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as many as the longest text so far needs."""

    base = 0x100000001B3

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.up.size:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (np.full(size, b, np.uint64) for b in (self.base, pow(self.base, -1, 1 << 64)))
            self.up[0] = self.down[0] = 1
            self.up, self.down = np.cumprod(self.up, dtype=np.uint64), np.cumprod(self.down, dtype=np.uint64)
        return self.up[:n], self.down[:n]


_powers = Powers()


def features(text: str, sizes: tuple[int, ...] = (2, 3, 4)) -> np.ndarray:
    """The bucket of each word and of each character n-gram that has no white space inside it (at its ends it marks a word's border)."""
    if not text:
        return np.empty(0, np.int64)
    chars = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    white = (chars == 32) | ((chars >= 9) & (chars <= 13))
    chars[white] = 32
    shift = np.uint64(64 - BUCKETS_LOG2)
    out = []
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    begin, end = edge[0::2], edge[1::2]
    if begin.size:
        up, down = _powers.get(chars.size + 1)
        total = np.cumsum(np.append(np.uint64(0), chars * up[: chars.size]), dtype=np.uint64)
        words = (total[end] - total[begin]) * down[begin]
        out.append((words ^ words >> np.uint64(29)) * ODD >> shift)
        pairs = words[:-1] * np.uint64(0xD6E8FEB86659FD93) ^ words[1:]
        out.append(np.where(words[1:] == words[:-1], SAME, (pairs ^ pairs >> np.uint64(32)) * ODD >> shift))
    code = chars[:-1] << np.uint64(16) ^ chars[1:]
    broken = np.zeros(chars.size - 1, bool)
    for n in range(2, max(sizes) + 1):
        if n > 2:
            if code.size < 2:
                break
            broken = broken[:-1] | white[n - 2 : white.size - 1]
            code = code[:-1] * np.uint64(0x100000001B3) ^ chars[n - 1 :]
        elif n == 2:
            broken = white[:-1] & white[1:]
        if n in sizes:
            out.append((code[~broken] * ODD + np.uint64(n)) * ODD >> shift)
    return np.concatenate(out).astype(np.int64) if out else np.empty(0, np.int64)


@dataclass
class Model:
    weight: np.ndarray  # one number a bucket
    bias: float

    def score(self, text: str) -> float:
        """Goes through a long text's features at once; a million characters take some 100 MB."""
        f = features(text)
        return float(1 / (1 + np.exp(-(self.weight[f].mean(dtype=np.float64) if f.size else 0.0) - self.bias)))


def pack(buckets: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending distinct buckets as steps, and their counts, compressed."""
    return zlib.compress(np.diff(buckets, prepend=0).astype("<u4").tobytes() + counts.astype("<u4").tobytes(), 1)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, counts = np.frombuffer(zlib.decompress(packed), "<u4").astype(np.int64).reshape(2, -1)
    return np.cumsum(steps), counts.astype(float)


def train(rows: list[tuple[int, bytes]], dim: int = 8, epochs: int = 5, rate: float = 0.4, seed: int = 1) -> Model:
    """rows: label and packed buckets with counts. A step moves a document's average by the rate times its gradient, whatever its length."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, ((1 << BUCKETS_LOG2) + 1, dim)).astype(np.float32)
    layer, bias = np.zeros((dim, 2)), np.zeros(2)
    made = [(y, p) for y, p in rows if unpack(p)[0].size]
    if not rows:
        return Model(np.zeros((1 << BUCKETS_LOG2) + 1, np.float32), 0.0)
    steps, done = epochs * max(1, len(made)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(made)):
            y, packed = made[k]
            u, w = unpack(packed)
            w /= w.sum()
            hidden = w @ vectors[u]
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            lr = rate * (1 - done / steps)
            done += 1
            vectors[u] -= np.outer(lr * w / (w @ w), layer @ p).astype(np.float32)
            layer -= lr * np.outer(hidden, p)
            bias -= lr * 0.1 * p
    if not made:
        bias[1] = np.log((sum(y for y, _ in rows) + 1) / (sum(1 - y for y, _ in rows) + 1))
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(
    docs: DataFrame, labels: DataFrame, most: int = 3000, id_col: str = "doc_id", text_col: str = "text", mod: int = 5
) -> Model:
    """Learns `quality` from at most `most` labelled documents, of those whose crc32(doc_id) mod `mod` is not 0."""
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
        .filter("doc_id is not null and y in (0, 1)").filter(common.id_remainder(mod) != 0)
        .groupBy("doc_id").agg(F.min("y").alias("y"))
    )
    # labels without a document don't count against `most`
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    rows = usable.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    chosen = docs.sparkSession.createDataFrame(rows, "doc_id long, y int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [pack(*np.unique(features(x), return_counts=True)) for x in common.texts_of(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["y"], pa.array(packed, pa.binary())], ["doc_id", "y", "packed"])

    # of rows that repeat an id, one: so that `most` bounds what comes to the driver
    held = common.id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = held.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, packed binary").collect()
    rows.sort(key=lambda r: r.doc_id)
    return train([(r.y, bytes(r.packed)) for r in rows])


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", mod: int = 5) -> DataFrame:
    """Per row doc_id, held_out, score and predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([sent.value.score(x) for x in common.texts_of(batch["text"])], pa.float64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], scores], ["doc_id", "held_out", "score"])

    marked = common.id_and_text(docs, id_col, text_col).withColumn("held_out", common.id_remainder(mod) == 0)
    scored = marked.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that are predicted good, all columns as they were."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([sent.value.score(x) >= THRESHOLD for x in common.texts_of(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
