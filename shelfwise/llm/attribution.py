"""Token counts by offset-mapped attribution (operator 4).

A document is encoded once, whole. Its tokens' character spans are joined to its sections' spans as intervals (both are in
order, so the join is a merge by binary search), and a token that crosses a border goes to one section by a rule:
"start" (the default) gives it to the section that holds its first character, "end" to that of its last one, "majority"
to the section with most of its characters (the first of equals). So every token counts once, and the counts of the
sections and of the text outside them add up to the whole text's, which encoding each section alone wouldn't.

Spans count code points. A token that holds only the last bytes of a character starts and ends in that character.

Defined cases: a null or empty text has no sections and no rows in `count_lines`; a long text stays whole; sections may
be empty (no tokens) but not overlap; tokens outside all sections go to section -1; rows that repeat are counted each; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .bpe import Bpe, tokenizer

RULES = ("start", "end", "majority")


def token_spans(bpe: Bpe, ids: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
    """The code points at which each token begins and ends (exclusive)."""
    ends = np.cumsum(bpe.length_of[ids])
    starts = ends - bpe.length_of[ids]
    if text.isascii():
        return starts, ends
    head = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
    chars = np.cumsum(head) - 1  # the character of each byte
    return chars[starts], chars[ends - 1] + 1


def attribute(starts: np.ndarray, ends: np.ndarray, begin: np.ndarray, end: np.ndarray, rule: str = "start") -> np.ndarray:
    """The section of each token, -1 outside all; sections are in order and don't overlap."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    full = np.flatnonzero(end > begin)
    if not full.size:
        return np.full(starts.size, -1)
    b, e = begin[full], end[full]

    def holds(at: np.ndarray) -> np.ndarray:
        k = np.searchsorted(b, at, "right") - 1
        return np.where((k >= 0) & (at < e[np.maximum(k, 0)]), k, -1)

    chosen = holds(ends - 1 if rule == "end" else starts)
    if rule == "majority":
        last = holds(ends - 1)
        for t in np.flatnonzero((chosen != last) | (chosen < 0)):
            near = range(max(0, int(np.searchsorted(e, starts[t], "right"))), int(np.searchsorted(b, ends[t], "left")))
            shares = [(min(ends[t], e[k]) - max(starts[t], b[k]), -k) for k in near]
            most, k = max(shares, default=(0, 1))
            chosen[t] = -k if most > 0 and most >= (ends[t] - starts[t]) - sum(s for s, _ in shares) else -1
    return np.where(chosen >= 0, full[np.maximum(chosen, 0)], -1)


def line_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lines with the line feed that ends them; a last line without text isn't one."""
    begin = [0]
    while (at := text.find("\n", begin[-1]) + 1) > 0:
        begin.append(at)
    if begin[-1] == len(text):
        begin.pop()
    return np.array(begin, np.int64), np.array([*begin[1:], len(text)] if begin else [], np.int64)


def count_sections(
    docs: DataFrame, path: str, sections: Callable[[str], tuple[np.ndarray, np.ndarray]] = line_spans, rule: str = "start", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per section doc_id, section, char_start, char_end, n_tokens, n_crossing (of these, tokens that reach beyond it) and doc_tokens; a row for section -1 where tokens lie outside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        names = ["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing", "doc_tokens"]
        for batch in batches:
            texts = common.texts_of(batch["text"])
            for a, b in common.slices([len(t) for t in texts], 2_000_000):
                out, rows = [[np.empty(0, np.int64)] for _ in names[1:]], []
                for k, (text, ids) in enumerate(zip(texts[a:b], bpe.encode(texts[a:b])), a):
                    begin, end = sections(text)
                    starts, ends = token_spans(bpe, ids, text)
                    own = attribute(starts, ends, begin, end, rule)
                    known = own >= 0
                    crossing = known.copy()
                    crossing[known] = (starts[known] < begin[own[known]]) | (ends[known] > end[own[known]])
                    values = [np.arange(begin.size), begin, end, np.bincount(own[known], minlength=begin.size), np.bincount(own[crossing], minlength=begin.size), np.full(begin.size, ids.size)]
                    if outside := int((~known).sum()):
                        values = [np.append(v, x) for v, x in zip(values, (-1, 0, 0, outside, 0, ids.size))]
                    for o, v in zip(out, values):
                        o.append(v.astype(np.int64))
                    rows.append(np.full(values[0].size, k))
                at = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(at)), *(pa.array(np.concatenate(o)) for o in out)], names)

    schema = "doc_id long, section long, char_start long, char_end long, n_tokens long, n_crossing long, doc_tokens long"
    return common.id_and_text(docs, id_col, text_col).mapInArrow(run, schema)
