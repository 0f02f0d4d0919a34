"""Set-similarity join of two collections of texts: all pairs whose words have a Jaccard similarity of a threshold or more.

Equal sets of words are one set first. The words of each are ordered by rarity over both sides; two sets of similarity t
must share one of the first |x| - ceil(t |x|) + 1 of them, so only those prefixes are joined. Sizes must agree within t,
which the join key says by bands of size, and a shared word's places bound what the rest can share. Candidates carry ids
only; what they propose is decided on the whole sets.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources.shared import written

c = F.col

#: A word with at least this share of all words is frequent; there are at most so many, and they are broadcast with their counts.
FREQUENT = 10_000
#: Rows of one key on the larger side that stay together.
TOGETHER = 20_000


def sets_of(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, set, words): set is a digest of the words, equal for equal sets; texts without words are left out, as nothing is similar to them."""
    named = rows.select(c(id_col).alias("id"), F.array_sort(F.array_distinct(t.words(c(text_col)))).alias("words")).filter(F.size("words") > 0)
    return named.select("id", F.sha2(F.array_join("words", "\n"), 256).alias("set"), "words")


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(side, set, size, word, place): the rarest words of each set, as many as the threshold asks for. sets: (side, set, words)."""
    each = sets.select("side", "set", F.size("words").alias("size"), F.explode("words").alias("word"))
    counts = each.groupBy("word").agg(F.count("*").alias("n"), (F.min("side") != F.max("side")).alias("both"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    frequent = counts.filter(c("n") * FREQUENT >= total)  # at most FREQUENT rows
    known = each.join(F.broadcast(frequent), "word", "left")
    rare = known.filter("n is null").drop("n", "both").join(counts.filter(c("n") * FREQUENT < total), "word")
    ranked = known.filter("n is not null").unionByName(rare).groupBy("side", "set", "size").agg(F.array_sort(F.collect_list(F.struct("both", "n", "word"))).alias("words"))
    # a hair is taken off before rounding up, so that no product that is a whole number in truth is rounded past it
    first = F.slice("words", F.lit(1), (c("size") - F.ceil(c("size") * threshold - 1e-9) + 1).cast("int"))
    # a word of one side only takes its place, before all others, but meets nothing
    return ranked.select("side", "set", "size", F.posexplode(first).alias("place", "x")).filter("x.both").select("side", "set", "size", "place", "x.word")


def candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Distinct (left, right) digests whose prefixes meet, with sizes and places that allow the threshold."""
    # a band is a little wider than the threshold, so that sizes that agree lie in neighbouring bands whatever rounding does
    band = F.floor(F.log(c("size")) / (-1.001 * math.log(threshold))).cast("int") if threshold < 1 else c("size")
    l_rows = left.select(c("set").alias("l_set"), c("size").alias("l_size"), c("place").alias("l_place"), "word", band.alias("band"))
    r_rows = right.select(c("set").alias("r_set"), c("size").alias("r_size"), c("place").alias("r_place"), "word", F.explode(F.array(band - 1, band, band + 1) if threshold < 1 else F.array(band)).alias("band"))
    # a key with many rows on the left is parted; the right side's rows go to each part
    parts = l_rows.groupBy("word", "band").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("parts")).filter("parts > 1")
    dealt = lambda rows: rows.join(parts, ["word", "band"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    l_rows = dealt(l_rows).withColumn("part", F.pmod(F.xxhash64("l_set"), c("parts")).cast("int")).drop("parts")
    r_rows = dealt(r_rows).withColumn("part", F.explode(F.sequence(F.lit(0), c("parts") - 1))).drop("parts")
    least = F.ceil((c("l_size") + c("r_size")) * (threshold / (1 + threshold)) - 1e-9)
    fits = (c("l_size") >= c("r_size") * threshold - 1e-9) & (c("r_size") >= c("l_size") * threshold - 1e-9)
    # of the words that a pair shares, those from a shared word on; for the first of them this is all, and it lies in both prefixes
    enough = F.least(c("l_size") - c("l_place"), c("r_size") - c("r_place")) >= least
    return l_rows.join(r_rows, ["word", "band", "part"]).filter(fits & enough).select("l_set", "r_set").distinct()


def similar_sets(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(l_set, r_set, similarity) of two collections of distinct sets (set, words)."""
    both = left.select(F.lit("l").alias("side"), "set", "words").unionByName(right.select(F.lit("r").alias("side"), "set", "words"))
    prefix = written(prefixes(both, threshold), "prefixes")  # read by both sides, and for how many rows a key has
    proposed = candidates(prefix.filter("side = 'l'"), prefix.filter("side = 'r'"), threshold)
    whole = proposed.join(left.select(c("set").alias("l_set"), c("words").alias("l_words")), "l_set").join(right.select(c("set").alias("r_set"), c("words").alias("r_words")), "r_set")
    shared = F.size(F.array_intersect("l_words", "r_words"))
    similarity = shared / (F.size("l_words") + F.size("r_words") - shared)
    return whole.select("l_set", "r_set", similarity.alias("similarity")).filter(c("similarity") >= threshold)


def similar_texts(left: DataFrame, right: DataFrame, threshold: float, left_id: str, right_id: str, text_col: str = "text") -> DataFrame:
    """(left_id, right_id, similarity) of all pairs of rows at the threshold or above."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and at most at 1")
    # texts are cut into words once; sets are read for prefixes, for the exact similarity and for their members
    r_rows = written(sets_of(right, right_id, text_col), "sets")
    # sizes that no set of the right side agrees with go before anything is stored or dealt
    least, most = r_rows.agg(F.min(F.size("words")), F.max(F.size("words"))).first()
    size = F.size("words")
    near = (size >= least * threshold - 1e-9) & (size * threshold - 1e-9 <= most) if most else F.lit(False)
    l_rows = written(sets_of(left, left_id, text_col).filter(near), "sets")
    one = lambda rows: rows.groupBy("set").agg(F.any_value("words").alias("words"))
    found = similar_sets(one(l_rows), one(r_rows), threshold)
    ids = found.join(l_rows.select(c("set").alias("l_set"), c("id").alias(left_id)), "l_set").join(r_rows.select(c("set").alias("r_set"), c("id").alias(right_id)), "r_set")
    return ids.select(left_id, right_id, "similarity")
