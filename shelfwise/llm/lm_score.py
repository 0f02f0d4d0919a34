"""Language-model scoring by a weighted backoff automaton (operator 1).

The model is an n-gram model whose probabilities back off exactly:

    p(w | h) = (c(hw) + k p(w | h')) / (c(h) + k)      p(w) = (c(w) - d) / N, unknown words as one: d V / N

so state h has an arc for every seen word and one failure arc of weight k / (c(h) + k) to h', its longest proper suffix.
A text is scored by one traversal from left to right: the arc of the next word is taken if the state has it, else the
failure arc, down to the empty context, which has an arc for every word; the arc leads to the state of the longest context
that the model knows, and log-probabilities add up on the way.

Counts are kept by a 64-bit hash of the n-gram, so the model needs no central table: rows are packed into blocks where they
are read, each block asks the shards of the hash range for the counts of its own n-grams, a shard adds up what all blocks
have counted and answers, and each block then builds just that part of the automaton which its texts can reach.

A message goes from a block to a shard only if it carries n-grams, so messages never outnumber the distinct n-grams of
blocks. A frequent n-gram is one entry for each block. Two n-grams share a hash with a chance of n^2 / 2^65.

Defined cases: a null or empty text is the end token alone; long texts stay whole; rows that repeat count and are scored
each; a null id hashes as an empty one and belongs to the training part; without training texts every token is unknown
and score and base_score are 0; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: No word can contain white space, so these are none.
END, BEGIN = b"\n", b" "
DISCOUNT = 0.75
#: k for contexts of one word, two words and so on.
WEIGHTS = (40.0, 8.0, 4.0)


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shard_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Shards are ranges of the hash, so a sorted array of keys falls into runs."""
    return ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def pack(x: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes; sorted keys are passed as differences."""
    raw = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = 8
    while used > 1 and not raw[used - 1].any():
        used -= 1
    return bytes([used]) + zlib.compress(raw[:used].tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel()


def squeezed(texts: list[str]) -> bytes:
    """Texts as a compressed Arrow stream."""
    batch, sink = pa.record_batch([pa.array(texts, pa.string())], ["text"]), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def spread(data: bytes) -> list[str]:
    return pa.ipc.open_stream(data).read_all()["text"].to_pylist()


class Block:
    """Tokens and n-gram hashes of a block of texts."""

    def __init__(self, texts: list[str], order: int):
        known: dict[bytes, int] = {END: 0}
        ids, self.sizes = [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            words = text.encode().lower().split()
            words.append(END)
            self.sizes[k] = len(words)
            for w in set(words):
                if w not in known:
                    known[w] = len(known)
            ids.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
        hashes = np.array([word_hash(w) for w in known], np.uint64)
        self.ids = np.concatenate([*ids, np.empty(0, np.int32)])
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        place = np.arange(self.ids.size) - np.repeat(self.starts, self.sizes)
        gram = hashes[self.ids] if self.ids.size else np.empty(0, np.uint64)
        #: by order: the hash of the n-gram that ends at each token; contexts reach back to BEGIN and no further
        self.grams = [gram]
        begin = np.uint64(word_hash(BEGIN))
        for n in range(1, order):
            before = np.where(place >= n, np.roll(gram, n), begin)
            longer = stir(self.grams[-1] * np.uint64(0x9E3779B97F4A7C15) + stir(before) + np.uint64(n))
            # an n-gram that would start before BEGIN adds nothing to the shorter one
            self.grams.append(np.where(place >= n - 1, longer, self.grams[-1]) if n > 1 else longer)
        self.place = place
        #: by order: the distinct n-grams, one token at which each ends, and the n-gram of every token
        self.distinct, self.ends_at, self.at = zip(*[np.unique(g, return_index=True, return_inverse=True) for g in self.grams])

    def counts(self, training: np.ndarray) -> list[np.ndarray]:
        """By order: how often each distinct n-gram occurs in the training texts of the block."""
        own = np.repeat(training, self.sizes)
        return [np.bincount(at[own], minlength=d.size) for d, at in zip(self.distinct, self.at)]


ROOT, START = 0, 1


class Automaton:
    """States, arcs and failure arcs of the contexts that a block can reach.

    State 0 is the empty context, 1 that of a text's beginning; the contexts of n words follow, numbered like the block's
    distinct n-grams. A state that was never seen in training has no arcs, and a failure arc of weight 1.
    """

    def __init__(self, block: Block, totals: list[np.ndarray], n_tokens: int, n_types: int, n_texts: int):
        order = len(block.grams)
        n_words = block.distinct[0].size
        base = 2 + np.concatenate([[0], np.cumsum([d.size for d in block.distinct])])  # of contexts of one word, of two, ...
        counts = totals[0].astype(float)
        p = np.where(counts > 0, counts - DISCOUNT, DISCOUNT * n_types) / n_tokens if n_tokens else np.ones(n_words)
        #: by state and word, as one number: log10 probability and next state
        self.arcs: dict[int, tuple[float, int]] = {}
        #: by state: what the failure arc adds, and where it leads
        self.weight, self.down = [0.0, self.failing(np.array([n_texts]), 1)[0]], [ROOT, ROOT]
        self.begin = START if order > 1 else ROOT
        self.words, token_p = n_words, p[block.at[0]]
        self.add(np.zeros(n_words, np.int64), np.arange(n_words), p, base[0] + np.arange(n_words) if order > 1 else np.zeros(n_words, np.int64))
        for n in range(1, order):
            ends = block.ends_at[n]
            own = ends[block.place[ends] >= n - 1]  # others are shorter n-grams, from the beginning of a text
            first = block.place[own] == 0
            seen = totals[n][block.at[n][own]].astype(float)
            context = np.where(first, START, base[n - 1] + block.at[n - 1][own - 1])
            held = np.where(first, n_texts, totals[n - 1][block.at[n - 1][own - 1]]).astype(float)
            k = WEIGHTS[min(n, len(WEIGHTS)) - 1]
            longer = (seen + k * token_p[own]) / (held + k)
            known = seen > 0
            to = base[n] + block.at[n][own] if n + 1 < order else base[n - 1] + block.at[n - 1][own]
            self.add(context[known], block.at[0][own][known], longer[known], to[known])
            # contexts of n words, and what they fail to
            self.weight += self.failing(totals[n - 1], n)
            shorter = block.ends_at[n - 1]
            self.down += (base[n - 2] + block.at[n - 2][shorter] if n > 1 else np.zeros(shorter.size, np.int64)).tolist()
            if n + 1 < order:  # the probability of the longest n-gram at each token, for the next order
                by_gram = np.zeros(block.distinct[n].size)
                by_gram[block.at[n][own]] = longer
                token_p = np.where(block.place >= n - 1, by_gram[block.at[n]], token_p)

    @staticmethod
    def failing(count: np.ndarray, n: int) -> list[float]:
        k = WEIGHTS[min(n, len(WEIGHTS)) - 1]
        return np.log10(k / (count + k)).tolist()

    def add(self, state: np.ndarray, word: np.ndarray, p: np.ndarray, to: np.ndarray) -> None:
        self.arcs.update(zip((state.astype(np.int64) * self.words + word).tolist(), zip(np.log10(p).tolist(), to.tolist())))

    def score(self, words: list[int]) -> float:
        """The log10 probability of a text: one traversal that carries the state."""
        arcs, weight, down, n = self.arcs.get, self.weight, self.down, self.words
        total, state = 0.0, self.begin
        for word in words:
            arc = arcs(state * n + word)
            while arc is None:
                total += weight[state]
                state = down[state]
                arc = arcs(state * n + word)
            total += arc[0]
            state = arc[1]
        return total


#: Bytes of text in a block, and in a shard's share of all n-grams.
BLOCK_BYTES, SHARD_BYTES = 3_000_000, 8_000_000


def packed_blocks(marked: DataFrame) -> DataFrame:
    """(block, ids, held, texts and sums) of rows packed where they are read, so that no id or text gathers rows in one block.

    The texts of a block are compressed together, as they are stored and shuffled once.
    """
    names = ["block", "ids", "held", "texts", "bytes", "train_texts", "train_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, held, texts, size = [], [], [], 0

        def out() -> pa.RecordBatch:
            tokens = sum(len(t.encode().split()) + 1 for t, h in zip(texts, held) if not h)
            values = [number, ids, held, squeezed(texts), size, len(held) - sum(held), tokens]
            types = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

        for batch in batches:
            for i, text, out_of in zip(batch["doc_id"].to_pylist(), common.texts_of(batch["text"]), batch["held_out"].to_pylist()):
                ids.append(i)
                held.append(out_of)
                texts.append(text)
                size += len(text.encode())
                if size > BLOCK_BYTES:
                    yield out()
                    number += 1
                    ids, held, texts, size = [], [], [], 0
        if ids:
            yield out()

    return marked.select("doc_id", "text", "held_out").mapInArrow(run, "block long, ids array<long>, held array<boolean>, texts binary, bytes long, train_texts long, train_tokens long")


def score_documents(docs: DataFrame, order: int = 2, id_col: str = "doc_id", text_col: str = "text", held_mod: int = 7, held_rest: int = 2) -> DataFrame:
    """Per row doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    The model learns from the rows that aren't held out. base_score is the add-one unigram score of the same text.
    """
    marked = common.id_and_text(docs, id_col, text_col).withColumn("held_out", common.id_remainder(held_mod) == held_rest)
    dealt = common.stored(packed_blocks(marked), "blocks")
    n_bytes, n_texts, n_tokens = (x or 0 for x in dealt.agg(*(F.sum(c) for c in ("bytes", "train_texts", "train_tokens"))).first())
    shards = 1 + n_bytes // SHARD_BYTES

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        for batch in batches:
            for number, texts, held in zip(*(batch[c].to_pylist() for c in ("block", "texts", "held"))):
                block, rows = Block(spread(texts), order), []
                for n, (keys, counts) in enumerate(zip(block.distinct, block.counts(~np.array(held, bool)))):
                    own = shard_of(keys, shards)
                    cuts = np.flatnonzero(np.diff(own)) + 1
                    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), keys.size]):
                        rows.append((int(own[a]), number, n, pack(np.diff(keys[a:b], prepend=np.uint64(0))), pack(counts[a:b])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["shard", "block", "n", "keys", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        orders, totals, types = table["n"].to_numpy(), [b""] * table.num_rows, np.zeros(table.num_rows, np.int64)
        packed, counted = table["keys"], table["counts"]
        for n in np.unique(orders):
            rows = np.flatnonzero(orders == n).tolist()
            keys = [np.cumsum(unpack(packed[r].as_py()), dtype=np.uint64) for r in rows]
            _, at = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(at, weights=np.concatenate([unpack(counted[r].as_py()) for r in rows]))
            if n == 0:
                types[rows[0]] = int((total > 0).sum())
            total = total[at]
            ends = np.cumsum([k.size for k in keys])
            for r, a, b in zip(rows, [0, *ends.tolist()], ends.tolist()):
                totals[r] = pack(total[a:b])
        return pa.table([table["block"], table["n"], table["shard"], pa.array(totals, pa.binary()), pa.array(types)], names=["block", "n", "shard", "totals", "types"])

    asked = dealt.select("block", "texts", "held").mapInArrow(ask, "shard int, block long, n int, keys binary, counts binary")
    told = common.stored(asked.groupBy("shard").applyInArrow(answer, "block long, n int, shard int, totals binary, types long"), "answers")
    n_types = told.agg(F.sum("types")).first()[0] or 0

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        own = spread(texts["texts"][0].as_py())
        block = Block(own, order)
        parts = sorted(zip(answers["n"].to_pylist(), answers["shard"].to_pylist(), answers["totals"].to_pylist()))
        totals = [np.concatenate([unpack(x) for m, _, x in parts if m == n]) for n in range(order)]
        automaton, ids = Automaton(block, totals, n_tokens, n_types, n_texts), block.at[0].tolist()
        scores = [automaton.score(ids[a:b]) for a, b in zip(block.starts.tolist(), block.ends.tolist())]
        count = totals[0][block.at[0]].astype(float)
        base = np.log10((count + 1) / (n_tokens + n_types + 1))
        return pa.table(
            [
                texts["ids"].combine_chunks().flatten(), texts["held"].combine_chunks().flatten(), pa.array(block.sizes), pa.array(np.add.reduceat((count > 0).astype(np.int64), block.starts)),
                pa.array(np.full(len(own), n_tokens)), pa.array(np.add.reduceat(base, block.starts)), pa.array(scores, pa.float64()),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return (
        dealt.select("block", "ids", "held", "texts").groupBy("block").cogroup(told.select("block", "n", "shard", "totals").groupBy("block"))
        .applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    )
