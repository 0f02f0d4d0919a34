"""Raw sheets and pages to descriptions; all that concerns a text stays within its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

#: A text with less left is no description.
LEAST_CHARS = 20
c = F.col


def once(rows: DataFrame, made: dict[str, Column]) -> DataFrame:
    """rows with columns that are made once for each row: a generator stands between them and what uses them, so that the optimizer doesn't put them in again at each use."""
    return rows.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in made.items()]))))


def judged_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line, x, reason): each line of a text without white space at its ends, and why it is junk, null for text."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line", "_x"))
    return once(once(lines, {"x": t.strip(c("_x"))}).drop("_x"), {"reason": t.junk_reason(c("x"))})


def gated(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, reason): each text without ASCII white space at its ends, and why it can't stand as a description, null if it can."""
    plain = once(docs.select(id_col, text_col), {"_text": t.ascii_strip(F.coalesce(text_col, F.lit("")))}).select(id_col, c("_text").alias("text"))
    return once(plain, {"reason": t.description_gate(c("text"), stripped=True)})


def runs_of_lines(rows: DataFrame, lines: str) -> DataFrame:
    """rows with `_sorted` (key, n, x of each line, by key, then place) and `_starts`, the places in it where a new key begins.

    Sorting takes n log n steps for a text of n lines; both arrays are columns of their own, so that they are made once.
    """
    keyed = F.transform(lines, lambda x, n: F.struct(t.line_key(x).alias("key"), n.alias("n"), x.alias("x")))
    out = rows.withColumn("_sorted", F.array_sort(keyed))
    fresh = F.transform("_sorted", lambda s, k: F.when((k == 0) | (F.get("_sorted", k - 1).key != s.key), k))
    return out.withColumn("_starts", F.filter(fresh, lambda k: k.isNotNull()))


def first_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line, n_copies): the first of a text's equal lines and how many there are; no shuffle."""
    runs = runs_of_lines(docs.select(id_col, F.split(text_col, "\n").alias("_lines")), "_lines")
    each = F.transform("_starts", lambda s, k: F.struct(F.get("_sorted", s).n.cast("long").alias("line"), (F.coalesce(F.get("_starts", k + 1), F.size("_sorted")) - s).cast("long").alias("n_copies")))
    # the outer form, as the optimizer would evaluate the arrays again to test for emptiness; a split text has a line at least
    return runs.select(id_col, each.alias("_each")).select(id_col, F.inline_outer("_each")).filter("line is not null")


def clean_descriptions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, cleaned): variant blocks and junk lines out, broken lines joined, the first of equal lines kept, then lines of three words or with an end mark.

    Texts with nothing left have no row.
    """
    lines = docs.select(id_col, t.without_variants(c(text_col)).alias("_text")).select(id_col, t.merged_lines(c("_text")).alias("_lines"))
    first = runs_of_lines(lines, "_lines").select(id_col, F.array_sort(F.transform("_starts", lambda s: F.struct(F.get("_sorted", s).n.alias("n"), F.get("_sorted", s).x.alias("x")))).alias("_first"))
    good = F.filter("_first", lambda s: (F.size(t.words(s.x)) >= 3) | s.x.rlike(r"[.:!]$"))
    out = first.select(id_col, F.array(F.array_join(F.transform(good, lambda s: s.x), "\n")).alias("_cleaned"))
    # through a generator, as the filter would else be pushed down with all that makes the text
    return out.select(id_col, F.explode_outer("_cleaned").alias("cleaned")).filter(F.length("cleaned") >= LEAST_CHARS)


def with_cleaned(rows: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """rows with a text's description in out_col, null where under 20 characters are left; the rules of clean_descriptions, and every row stays."""
    lines = rows.withColumn("_lines", t.merged_lines(t.without_variants(c(text_col))))
    first = runs_of_lines(lines, "_lines").withColumn("_first", F.array_sort(F.transform("_starts", lambda s: F.struct(F.get("_sorted", s).n.alias("n"), F.get("_sorted", s).x.alias("x")))))
    good = F.filter("_first", lambda s: (F.size(t.words(s.x)) >= 3) | s.x.rlike(r"[.:!]$"))
    text = F.array_join(F.transform(good, lambda s: s.x), "\n")
    return first.withColumn(out_col, F.when(F.length(text) >= LEAST_CHARS, text)).drop("_lines", "_sorted", "_starts", "_first")
