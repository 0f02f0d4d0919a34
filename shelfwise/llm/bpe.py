"""Byte-level BPE encoding and decoding (operator 10).

A word's adjacent pair ranks are the leaves of a segment tree whose root is the leftmost pair of lowest rank. A merge
changes three leaves; each change goes up the tree in logarithmic time; the word is done when the root is empty. Words of
a batch that have similar lengths are merged side by side, one tree a row.

Defined cases: a null text is an empty one and has no ids; texts are encoded whole, whatever their length; a special
token's string in a text becomes its id; rows that repeat are encoded again, each for itself; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

NONE = np.int64(1 << 62)
#: Fixed value: how byte-level BPE of this kind cuts text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A space with no white space on either side: no word of PATTERN goes over it from the left, and the part after it begins with it.
_CUT = regex.compile(r"(?<=\S)(?= \S)", regex.V1)


def byte_alphabet() -> dict[int, str]:
    """The visible character by which a vocabulary file writes each byte: Latin-1's visible ones for themselves, the others from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


#: White space other than spaces and line feeds.
_ODD = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class Bpe:
    """A vocabulary, and a bounded cache of what parts of texts become: two generations of at most `cache` entries."""

    def __init__(self, path: str, cache: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_char = byte_alphabet()
        to_byte = {c: b for b, c in to_char.items()}
        vocab = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            if token not in self.special:
                self.bytes_of[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.length_of = np.array([len(b) for b in self.bytes_of], np.int64)
        self.decimal = [str(i) for i in range(len(self.bytes_of))]
        self.of_byte = np.array([vocab[to_char[b]] for b in range(256)], np.int32)
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = np.append(keys[order], np.int64(1) << 61), np.append(order, 0).astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.rank_of = {int(k): i for i, k in enumerate(keys)}
        self.words = regex.compile(PATTERN)
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.most, self.new, self.old = cache, {}, {}

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it doesn't merge."""
        key = a.astype(np.int64) << 20 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge_one(self, word: bytes) -> list[int]:
        """The tree in plain Python: for a word alone of its length."""
        n = len(word)
        sym: list[int] = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        size = 1 << max(1, (n - 1).bit_length())
        none = int(NONE)
        tree, after, before, rank_of = [none] * (2 * size), list(range(1, n + 1)), list(range(-1, n - 1)), self.rank_of

        def leaf(k: int) -> int:
            r = rank_of.get(sym[k] << 20 | sym[after[k]]) if after[k] < n else None
            return none if r is None else r * size + k

        def put(k: int, value: int) -> None:
            i = size + k
            tree[i] = value
            while i > 1:
                i >>= 1
                least = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == least:
                    break
                tree[i] = least

        for k in range(n - 1):
            tree[size + k] = leaf(k)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        while (root := tree[1]) != none:
            k = root % size
            gone = after[k]
            sym[k], sym[gone], after[k] = int(self.merged[root // size]), -1, after[gone]
            if after[k] < n:
                before[after[k]] = k
            put(gone, none)
            put(k, leaf(k))
            if before[k] >= 0:
                put(before[k], leaf(before[k]))
        return [s for s in sym if s >= 0]

    def merge_rows(self, sym: np.ndarray) -> np.ndarray:
        """The same for many words at once: sym has a word's bytes as ids in each row, then -1; it is changed in place."""
        n, size = sym.shape
        shift = size.bit_length() - 1
        after = np.broadcast_to(np.arange(1, size + 1, dtype=np.int32), (n, size)).copy()
        before = np.broadcast_to(np.arange(-1, size - 1, dtype=np.int32), (n, size)).copy()
        last = (sym >= 0).sum(1) - 1
        after[np.arange(n), last] = size
        tree = np.full((n, 2 * size), NONE)
        rank = self._pairs(sym[:, :-1], np.maximum(sym[:, 1:], 0))
        rank[sym[:, 1:] < 0] = NONE
        tree[:, size : 2 * size - 1] = np.where(rank == NONE, NONE, rank << shift | np.arange(size - 1))
        width = size
        while width > 1:
            tree[:, width // 2 : width] = np.minimum(tree[:, width : 2 * width : 2], tree[:, width + 1 : 2 * width : 2])
            width //= 2
        flat, sym_, after_, before_ = tree.ravel(), sym.ravel(), after.ravel(), before.ravel()

        def put(rows: np.ndarray, pos: np.ndarray, values: np.ndarray | np.int64) -> None:
            at, node = rows * (2 * size), size + pos
            flat[at + node] = values
            for _ in range(shift):
                node = node >> 1
                low = at + 2 * node
                flat[at + node] = np.minimum(flat[low], flat[low + 1])

        rows = np.flatnonzero(tree[:, 1] < NONE)
        while rows.size:
            root, base = tree[rows, 1], rows * size
            pos = root & (size - 1)
            made = self.merged[root >> shift]
            gone = after_[base + pos].astype(np.int64)
            follow = after_[base + gone].astype(np.int64)
            sym_[base + pos], sym_[base + gone], after_[base + pos] = made, -1, follow
            has = follow < size
            before_[(base + follow)[has]] = pos[has]
            put(rows, gone, NONE)
            right = np.full(rows.size, NONE)
            r = self._pairs(made[has], sym_[(base + follow)[has]])
            right[has] = np.where(r == NONE, NONE, r << shift | pos[has])
            put(rows, pos, right)
            prior = before_[base + pos].astype(np.int64)
            if (has := prior >= 0).any():
                r = self._pairs(sym_[(base + prior)[has]], made[has])
                put(rows[has], prior[has], np.where(r == NONE, NONE, r << shift | prior[has]))
            rows = rows[tree[rows, 1] < NONE]
        return sym

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as the bytes of <u4."""
        out: list = [None] * len(words)
        sizes = np.array([len(w) for w in words])
        for size in (2 << k for k in range(64)):
            if size // 2 > sizes.max(initial=0):
                break
            own = np.flatnonzero((sizes <= size) & (sizes > (size // 2 if size > 2 else 0)))
            if own.size < 12 or size > 256:
                for k in own:
                    out[k] = np.array(self.merge_one(words[k]), "<u4").tobytes()
                continue
            for a in range(0, own.size, 200_000 // size + 1):
                part = own[a : a + 200_000 // size + 1]
                raw = np.frombuffer(b"".join([words[k].ljust(size, b"\0") for k in part]), np.uint8).reshape(-1, size)
                sym = np.where(np.arange(size) < sizes[part, None], self.of_byte[raw], -1).astype(np.int32)
                if size > 1:
                    self.merge_rows(sym)
                raw_ids, ends = sym[sym >= 0].astype("<u4").tobytes(), (4 * np.cumsum((sym >= 0).sum(1))).tolist()
                for k, a4, b4 in zip(part.tolist(), [0, *ends], ends):
                    out[k] = raw_ids[a4:b4]
        return out

    @staticmethod
    def _parts(text: str) -> list[str]:
        """The text cut where no word goes over the cut: at each space, if no other white space is beside one."""
        if not text:
            return []
        if "  " in text or " \n" in text or "\n " in text or text[0].isspace() or text[-1].isspace() or _ODD.search(text):
            return _CUT.split(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def _cut(self, part: str) -> list[str]:
        """The words of a part; a word alone, or with a stop or comma after it, needs no pattern."""
        body = part[1:] if part[0] == " " else part
        if body.isalpha():
            return [part]
        if body[-1:] in (".", ",") and body[:-1].isalpha():
            return [part[:-1], part[-1]]
        return self.words.findall(part)

    def _lacking(self, parts: set[str]) -> set[str]:
        """Those that aren't cached; what only the old generation has moves on to the new one."""
        lacking = parts.difference(self.new)
        for p in lacking.intersection(self.old):
            self.new[p] = self.old[p]
        return lacking.difference(self.new)

    def _learn(self, parts: set[str]) -> None:
        lacking = list(self._lacking(parts))
        cut = [self._cut(p) for p in lacking]
        words = list(self._lacking({w for ws in cut for w in ws}))
        new = self.new
        new.update(zip(words, self.encode_words([w.encode() for w in words])))  # a word is a part, too
        for p, ws in zip(lacking, cut):
            if len(ws) > 1:
                new[p] = b"".join([new[w] for w in ws])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as <u4. Works through about a million characters at a time."""
        out = []
        for a, b in common.slices([len(t) for t in texts], 1_000_000):
            out += self._encode(texts[a:b])
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        segments: list[tuple[int, str | int]] = []
        for k, text in enumerate(texts):
            at = 0
            if self.split and any(s in text for s in self.special):
                for m in self.split.finditer(text):
                    segments += [(k, text[at : m.start()]), (k, self.special[m[0]])]
                    at = m.end()
            segments.append((k, text[at:]))
        cut = [s if isinstance(s, int) else self._parts(s) for _, s in segments]
        self._learn(set().union(*[c for c in cut if isinstance(c, list)]))
        cached = self.new.__getitem__
        raw: list[list[bytes]] = [[] for _ in texts]
        for (k, _), c in zip(segments, cut):
            raw[k].append(c.to_bytes(4, "little") if isinstance(c, int) else b"".join(map(cached, c)))
        if len(self.new) > self.most:
            self.new, self.old = {}, self.new
        return [np.frombuffer(r[0] if len(r) == 1 else b"".join(r), "<u4") for r in raw]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def tokenizer(path: str) -> Bpe:
    """One for each Python worker; its cache outlives tasks."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            ids = bpe.encode(common.texts_of(batch["text"]))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate([*ids, np.empty(0, "<u4")]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "ids"])

    return common.id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            texts = [bpe.decode(x or []) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row doc_id, n_tokens, ids_sha256 and decoded_sha256: encoded and decoded in one pass, so that no ids leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            texts = common.texts_of(batch["text"])
            counts, ids_sha, decoded_sha = [], [], []
            for a, b in common.slices([len(t) for t in texts], 1_000_000):
                for ids in bpe.encode(texts[a:b]):
                    listed = ids.tolist()
                    counts.append(len(listed))
                    ids_sha.append(hashlib.sha256(",".join(map(bpe.decimal.__getitem__, listed)).encode()).hexdigest())
                    decoded_sha.append(hashlib.sha256(bpe.decode(listed).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return common.id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
