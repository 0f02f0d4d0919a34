"""Lexical retrieval packing (operator 7).

Term statistics (documents, document frequencies, mean length) are those of the whole table. A document's two terms of the
greatest BM25 weight are its route: documents of one route, and of few-document routes side by side, make a shard of about
a megabyte of text, so that lexical neighbours meet; a route of more text is parted by its second term, and what is still
larger by a hash. A shard has a BM25 index over its documents' token ids: a seed document opens a window, and the unused
neighbours that the index returns for it fill the window greedily, best first. A document that doesn't fit is cut where the
window ends, and its rest opens the next one. So every window is full but the shard's last, which is split into windows
whose lengths are powers of two; these need no padding.

Term weights have the idf log((n - df + 0.5) / (df + 0.5)), taken as zero where it is negative, so a term of over half of
all documents adds nothing and its postings aren't kept.

Defined cases: a null or empty text is the end id alone; texts of any length are cut freely; a seed without neighbours
takes the next unused document; ties in the score go to the smaller doc_id; rows that repeat are packed each; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import common
from .bpe import PATTERN

WINDOW = 2048
END = 1


@cache
def encoder(path: str) -> tiktoken.Encoding:
    """The vocabulary as ranks, with the end-of-text string as the id after the last; its ids are those of the same vocabulary's JSON file."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


@cache
def slower(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@cache
def held_as(ranks: str) -> str:
    """The type that holds an id or the end id in the fewest bytes."""
    with open(ranks, "rb") as f:
        return "<u2" if sum(1 for _ in f) < 1 << 16 else "<u4"


def encode(path: str, ranks: str, text: str) -> np.ndarray:
    """Ids of the vocabulary file at `path`; `ranks` is the same vocabulary as ranks, for the faster library.

    That library refuses white space of some 500 000 characters on end; such a text is encoded with the file itself.
    """
    try:
        return encoder(ranks).encode_to_numpy(text, allowed_special="all")
    except ValueError:
        return np.array(slower(path).encode(text, add_special_tokens=False).ids, np.uint32)


@dataclass
class Corpus:
    """Term statistics: documents, mean length, document frequency by id."""

    n: int
    mean: float
    df: np.ndarray

    @property
    def idf(self) -> np.ndarray:
        return np.maximum(np.log((self.n - self.df + 0.5) / (self.df + 0.5)), 0)

    @classmethod
    def of(cls, tokens: list[np.ndarray]) -> Corpus:
        return cls(len(tokens), float(np.mean([t.size for t in tokens])), np.bincount(np.concatenate([np.unique(t) for t in tokens])))


def weights(idf: np.ndarray, tf: np.ndarray, size: np.ndarray | int, mean: float, k1: float = 1.2, b: float = 0.75) -> np.ndarray:
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean))


class Index:
    """BM25 postings of a shard, with the statistics of the corpus (of the shard itself where none are given)."""

    def __init__(self, tokens: list[np.ndarray], corpus: Corpus | None = None):
        corpus = corpus or Corpus.of(tokens)
        n = len(tokens)
        found = [np.unique(t, return_counts=True) for t in tokens]
        terms = np.concatenate([u for u, _ in found])
        docs = np.repeat(np.arange(n, dtype=np.int32), [u.size for u, _ in found])
        tf = np.concatenate([c for _, c in found]).astype(np.float32)
        size = np.array([t.size for t in tokens], np.float32)
        df, idf = np.bincount(terms), corpus.idf
        keep = (idf[terms] > 0) & (df[terms] > 1)
        order = np.argsort(terms[keep], kind="stable")
        terms, self.docs, tf = terms[keep][order], docs[keep][order], tf[keep][order]
        self.weight = weights(idf[terms], tf, size[self.docs], corpus.mean).astype(np.float32)
        used, start = np.unique(terms, return_index=True)
        self.start = np.zeros(df.size + 1, np.int64)
        self.count = np.zeros(df.size + 1, np.int64)
        self.start[used], self.count[used] = start, np.diff(np.append(start, terms.size))
        self.own = [u[self.count[u] > 0] for u, _ in found]
        self.n = n

    def neighbours(self, seed: int) -> np.ndarray:
        """All documents that share a kept term with the seed, best first."""
        start, count = self.start[self.own[seed]], self.count[self.own[seed]]
        total = int(count.sum())
        if not total:
            return np.empty(0, np.int64)
        at = np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(total)
        scores = np.bincount(self.docs[at], weights=self.weight[at], minlength=self.n)
        hit = np.flatnonzero(scores > 0)
        return hit[np.argsort(-scores[hit], kind="stable")]


def fill(sizes: list[int], neighbours, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece. neighbours(seed) gives the order in which to look for company."""
    pieces, used, upto = [], [False] * len(sizes), 0
    sequence, offset, queue, seed = 0, 0, iter(()), -1

    def place(doc: int) -> int:
        """Puts a document, window after window; returns the last document that began a window."""
        nonlocal sequence, offset
        start, opened = 0, -1
        while start < sizes[doc]:
            n = min(window - offset, sizes[doc] - start)
            if offset == 0:
                opened = doc
            pieces.append((doc, start, n, sequence, offset))
            start, offset = start + n, offset + n
            if offset == window:
                sequence, offset = sequence + 1, 0
        used[doc] = True
        return opened

    while True:
        doc = next((d for d in queue if not used[d]), -1)
        if doc < 0:
            while upto < len(sizes) and used[upto]:
                upto += 1
            if upto == len(sizes):
                break
            doc = upto
            if offset == 0:
                seed = -1
        opened = place(doc)
        if (opened == doc and offset) or seed < 0:
            seed = doc
            queue = iter(neighbours(doc).tolist()) if offset else iter(())
        if offset == 0:
            seed, queue = -1, iter(())
    # the last window: pieces cut at the ends of powers of two
    if offset:
        last = [p for p in pieces if p[3] == sequence]
        pieces = pieces[: len(pieces) - len(last)]
        ends, at = [], 0
        for bit in reversed(range(window.bit_length())):
            if offset >> bit & 1:
                at += 1 << bit
                ends.append(at)
        for doc, start, n, _, begin in last:
            while n:
                k = next(i for i, e in enumerate(ends) if begin < e)
                m = min(n, ends[k] - begin)
                pieces.append((doc, start, m, sequence + k, begin - (ends[k - 1] if k else 0)))
                start, n, begin = start + m, n - m, begin + m
    return pieces


def tokenised(plain: DataFrame, path: str, ranks: str, kind: str = "<u4") -> DataFrame:
    """(doc_id, size, tokens): bytes of text, and the ids as bytes, each a number of `kind`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.append(encode(path, ranks, t), np.uint32(END)).astype(kind).tobytes() for t in common.texts_of(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["size"], pa.array(tokens, pa.binary())], ["doc_id", "size", "tokens"])

    return plain.withColumn("size", F.octet_length("text").cast("long")).mapInArrow(run, "doc_id long, size long, tokens binary")


def tokens_of(column: pa.ChunkedArray | pa.Array, kind: str = "<u4") -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def statistics(held: DataFrame, kind: str = "<u4") -> Corpus:
    """Over all rows: a task hands on a row for each id of the vocabulary that it saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(1, np.int64), 0, 0
        for batch in batches:
            for t in tokens_of(batch["tokens"], kind):
                own = np.unique(t)
                if own[-1] >= df.size:
                    df = np.append(df, np.zeros(int(own[-1]) + 1 - df.size, np.int64))
                df[own] += 1
                n, total = n + 1, total + t.size
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, [-1, -2])), pa.array(np.append(df[seen], [n, total]))], ["term", "n"])

    rows = held.select("tokens").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    count = {r.term: r.n for r in rows}
    n, total = count.pop(-1, 0), count.pop(-2, 0)
    df = np.zeros(max(count, default=0) + 1, np.int64)
    df[list(count)] = list(count.values())
    return Corpus(n, total / max(n, 1), df)


def route(tokens: np.ndarray, corpus: Corpus, idf: np.ndarray) -> tuple[int, int]:
    """The two terms of greatest weight among those that other documents have too; -1 for want of one."""
    terms, tf = np.unique(tokens, return_counts=True)
    weight = np.where(corpus.df[terms] > 1, weights(idf[terms], tf, tokens.size, corpus.mean), 0)
    best = np.argsort(-weight, kind="stable")[:2]
    first, second = [*(int(terms[k]) if weight[k] > 0 else -1 for k in best), -1, -1][:2]
    return first, second


def routed(held: DataFrame, corpus: Corpus, kind: str = "<u4") -> DataFrame:
    """With the route's terms."""
    given = held.sparkSession.sparkContext.broadcast((corpus, corpus.idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([route(t, *given.value) for t in tokens_of(batch["tokens"], kind)], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own[:, 0]), pa.array(own[:, 1])], [*batch.schema.names, "first", "second"])

    return held.mapInArrow(run, "doc_id long, size long, tokens binary, first long, second long")


def shards_of(routes: DataFrame, shard_bytes: int) -> DataFrame:
    """routes with their shard. The driver holds a row for each term and about four for each shard."""
    by_first = {r["first"]: r["size"] for r in routes.groupBy("first").agg(F.sum("size").alias("size")).collect()}
    many = {t: -(-4 * n // shard_bytes) for t, n in by_first.items() if n > shard_bytes}
    spark = routes.sparkSession
    hot = F.broadcast(spark.createDataFrame(sorted(many.items()), "first long, parts long"))
    parted = routes.join(hot, "first", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("second"), F.col("parts")), F.lit(0))).drop("parts")
    sizes = parted.groupBy("first", "part").agg(F.sum("size").alias("size")).collect()
    plan, shard, full = {}, 0, 0
    for r in sorted(sizes, key=lambda r: (r["first"], r["part"])):
        pieces = -(-r["size"] // shard_bytes) if r["size"] > shard_bytes else 1
        if full and full + r["size"] > shard_bytes:
            shard, full = shard + 1, 0
        plan[r["first"], r["part"]] = shard, pieces
        shard, full = (shard + pieces, 0) if pieces > 1 else (shard, full + r["size"])
    given = spark.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = []
            for i, x, *key in zip(*(batch[c].to_pylist() for c in ("doc_id", "tokens", "first", "part"))):
                start, pieces = given.value[tuple(key)]
                own.append(start + (xxhash.xxh64_intdigest(f"{i} ".encode() + x) % pieces if pieces > 1 else 0))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["tokens"], pa.array(own, pa.int64())], ["doc_id", "tokens", "shard"])

    return parted.mapInArrow(run, "doc_id long, tokens binary, shard long")


def pack(docs: DataFrame, path: str, ranks: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 1_000_000) -> DataFrame:
    """path: a vocabulary file, ranks: the same as ranks. Per piece doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset."""
    if window < 2:
        raise ValueError("a window has two ids at least")
    kind = held_as(ranks)
    held = common.stored(tokenised(common.id_and_text(docs, id_col, text_col), path, ranks, kind), "tokens")
    corpus = statistics(held, kind)
    given = docs.sparkSession.sparkContext.broadcast(corpus)
    routes = common.stored(routed(held, corpus, kind), "routes")
    common.forget(held)
    dealt = shards_of(routes, shard_bytes)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending")])
        tokens = tokens_of(table["tokens"], kind)
        index = Index(tokens, given.value)
        first = table["shard"][0].as_py() << 32
        rows = fill([t.size for t in tokens], index.neighbours, window)
        doc, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*rows))
        crc = [zlib.crc32(tokens[d][s : s + n].astype("<u4").tobytes()) for d, s, n, _, _ in rows]
        sizes = np.array([t.size for t in tokens], np.int64)
        return pa.table(
            [table["doc_id"].combine_chunks().take(pa.array(doc)), *map(pa.array, (start, length, np.array(crc, np.int64), sizes[doc], sequence + first, offset))],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )

    return dealt.groupBy("shard").applyInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
