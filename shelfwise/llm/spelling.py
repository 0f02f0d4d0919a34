"""Spelling variant grouping (operator 12): an even-partition pigeonhole join under one edit.

A word of length l is cut into two even segments, and two words one edit apart agree outside one of them: both segments
are indexed by length and place, words of equal length probe with the same substring, words one longer with the substring
that a letter more in the other segment shifts by one. What a key leaves open is its hole, [i, j) of the word; an index row
is the word without its hole. A key of more than `most` rows is never compared in pairs: its rows go to the next level,
where the hole is cut evenly again, until it is one letter (equal lengths) or empty (one longer). There a key's rows differ
in that letter only, so their number is bounded by the alphabet. So no candidate is dropped, and pairs within a key stay few.

Candidates are deduplicated and verified by an exact edit distance. Forms are followed by pointer jumping: each form is at
least `ratio` times as frequent as its word, so a chain has at most log(n) / log(ratio) links and no circle.

Defined cases: a null text has no words, a null id is hashed as empty text; ties in n go to the smallest word in
code-point order; rows that repeat count again; an empty table gives an empty result; further columns are ignored, whatever
their names.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

c = F.col
#: Rows of a key that are compared as they are.
MOST = 64


def altered(word: str, seen: int, every: int) -> str:
    """The word, without one of its letters where the hash of "id:word" is divisible by `every`; seen is the hash of "id:"."""
    h = zlib.crc32(word.encode(), seen)
    if h % every:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def counted_words(docs: DataFrame, least_chars: int = 6, least: int = 5, every: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) over all whole texts. Each batch counts its own words first, so a frequent word is one row of a batch."""
    # a shorter run can't give a longer word, and a match of at least so many letters is a maximal run
    runs = re.compile(f"[a-zÀ-ÿ]{{{least_chars},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: Counter[str] = Counter()
            for i, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                seen = zlib.crc32(f"{'' if i is None else i}:".encode())
                held.update(altered(w, seen, every) for w in runs.findall(text.encode().lower().decode()))
            kept = [(w, n) for w, n in held.items() if len(w) >= least_chars]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

    each = common.id_and_text(docs, id_col, text_col).mapInArrow(run, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).filter(c("n") >= least)


def without(word: Column, i: Column, j: Column) -> list[Column]:
    """What lies outside the hole [i, j)."""
    return [F.substr(word, F.lit(1), i), F.substr(word, j + 1)]


def keyed(holes: DataFrame) -> DataFrame:
    """Rows (word, n, longer, probe, len, i, j) with their key: kind, length of the index word, hole and what lies outside.

    A probing word that is one longer has one letter more in its hole.
    """
    end = c("j") + F.when(c("longer") & c("probe"), 1).otherwise(0)
    return holes.withColumn("key", F.xxhash64("longer", "len", "i", "j", *without(c("word"), c("i"), end)))


def row(longer: bool, probe: bool, length: Column, i: Column, j: Column) -> Column:
    return F.struct(F.lit(longer).alias("longer"), F.lit(probe).alias("probe"), length.cast("int").alias("len"), i.cast("int").alias("i"), j.cast("int").alias("j"))


def segments(words: DataFrame) -> DataFrame:
    """The first level: two holes for each word as an index of equal and of longer words, and as a longer word that probes."""
    size, zero = F.char_length("word"), F.lit(0)
    halves = lambda n: [(zero, F.floor(n / 2)), (F.floor(n / 2), n)]
    rows = [row(longer, False, size, i, j) for longer in (False, True) for i, j in halves(size)] + [row(True, True, size - 1, i, j) for i, j in halves(size - 1)]
    return keyed(words.select("word", "n", F.inline(F.array(*rows))))


def refined(hot: DataFrame) -> DataFrame:
    """The next level of rows whose keys are too common: the hole cut evenly again; a hole of one letter, in which one is put in, into what lies before and behind it."""
    i, j, mid = c("i"), c("j"), F.floor((c("i") + c("j")) / 2).cast("int")
    single = j - i == 1
    cuts = F.when(single, F.array(F.struct(i.alias("i"), i.alias("j")), F.struct(j.alias("i"), j.alias("j")))).otherwise(F.array(F.struct(i.alias("i"), mid.alias("j")), F.struct(mid.alias("i"), j.alias("j"))))
    return keyed(hot.select("word", "n", "longer", "probe", "len", F.inline(cuts)))


def pairs_of(rows: DataFrame) -> DataFrame:
    """Verified pairs (a, a_n, b, b_n) of one key, both ways round. Keys are small here."""
    item = F.struct("word", "n")
    sides = rows.groupBy("key").agg(F.collect_list(F.when(~c("probe"), item)).alias("index"), F.collect_list(F.when(c("probe") | ~c("longer"), item)).alias("probes"))
    one = sides.filter("size(index) > 0 and size(probes) > 0").select(F.explode("index").alias("x"), "probes")
    near = one.select("x", F.explode(F.filter("probes", lambda y: (y["word"] != c("x")["word"]) & (F.levenshtein(c("x")["word"], y["word"], 1) == 1))).alias("y"))
    # of equal lengths each row is index and probe, which gives both ways; a longer word is only a probe
    ways = F.when(F.char_length("x.word") == F.char_length("y.word"), F.array(F.struct("x", "y"))).otherwise(F.array(F.struct("x", "y"), F.struct(c("y").alias("x"), c("x").alias("y"))))
    return near.select(F.inline(ways)).select(c("x.word").alias("a"), c("x.n").alias("a_n"), c("y.word").alias("b"), c("y.n").alias("b_n"))


def near_pairs(words: DataFrame, most: int = MOST) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs (a, a_n, b, b_n) of words one edit apart, both ways round, and the stored tables that they are read from.

    A letter doubled (or left out) at the border of two segments is found by both, so a pair may come twice.
    """
    found, levels = [], [common.stored(segments(words), "segments")]
    while True:
        rows = levels[-1]
        sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.max((~c("longer") & (c("j") - c("i") <= 1)) | (c("i") == c("j"))).alias("last"))
        hot = sizes.filter((c("size") > most) & ~c("last")).select("key")
        found.append(pairs_of(rows.join(hot, "key", "left_anti")))
        levels.append(common.stored(refined(rows.join(hot, "key", "left_semi")), "segments"))
        if levels[-1].isEmpty():
            break
    return functools.reduce(DataFrame.unionByName, found), levels


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form): pointer jumping, the ways doubled each time until none goes on."""
    held = common.stored(links.select("word", c("form").alias("root")), "roots")
    while not held.join(links.select(c("word").alias("root")), "root", "left_semi").isEmpty():
        onward = held.select(c("word").alias("root"), c("root").alias("onward"))
        further = common.stored(held.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root")), "roots")
        common.forget(held)
        held = further
    return held


def group_variants(docs: DataFrame, least_chars: int = 6, least: int = 5, every: int = 199, ratio: int = 5, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per word: form (the most frequent word one edit away, if at least `ratio` times as frequent), root (the last form), n, n_near, form_n."""
    words = common.stored(counted_words(docs, least_chars, least, every, id_col, text_col), "words")
    pairs, levels = near_pairs(words, most)
    # the set also takes out pairs that came twice; the alphabet and the length bound its size
    joined = pairs.groupBy(c("a").alias("word")).agg(F.collect_set(F.struct((-c("b_n")).alias("less"), c("b").alias("form"))).alias("near"))
    joined = joined.select("word", F.size("near").cast("long").alias("n_near"), F.array_min("near").alias("best"))
    fit = -c("best.less") >= ratio * c("n")
    formed = common.stored(
        words.join(joined, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fit, c("best.form")).alias("form"), F.when(fit, -c("best.less")).alias("form_n")), "forms"
    )
    common.forget(words, *levels)
    ends = roots(formed.filter("form is not null").select("word", "form"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
