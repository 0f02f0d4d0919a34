"""Labelled values in the texts of data sheets, with where they stand and what they are worth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as t
from . import cleaning

c = F.col
#: Characters on both sides of a match that its evidence holds.
AROUND = 80


def tidy(value: Column) -> Column:
    """Lines without white space at their ends and with single blanks; empty ones go."""
    lines = F.transform(F.split(t.strip(value), "\n"), lambda x: t.strip(F.regexp_replace(x, "[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def shortened(value: Column, most: int) -> Column:
    """At most `most` characters, up to the last full stop if that lies in their second half."""
    head = F.substring(value, 1, most)
    stop = F.length(head) - F.instr(F.reverse(head), ".") + 1
    has = F.instr(head, ".") > 0
    return F.when(F.length(value) <= most, value).when(has & (stop - 1 > most // 2), F.substr(head, F.lit(1), stop)).otherwise(F.regexp_replace(head, r"(?U)\s+$", ""))


def _any(x: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [x.rlike("(?U)" + p) for p in patterns])


def worth(value: Column, field: str) -> Column:
    """1 for a value that fits its field; a factor for each thing against it: boilerplate, cut off, too short, no packaging."""
    cut_off = (F.length(value) > 40) & ~F.substring(value, -1, 1).rlike("""[.!?)"':;,0-9%]""") & value.rlike("(?U)" + fixed.SENTENCE_WORDS)
    out = F.when(_any(value, fixed.SHEET_BOILERPLATE), 0.3).otherwise(1.0) * F.when(cut_off, 0.5).otherwise(1.0)
    if field == "description":
        out = out * F.when(F.length(value) < 20, 0.3).otherwise(1.0) * F.when(F.length(value) < 10, 0.3).otherwise(1.0)
    if field == "packaging_info":
        out = out * F.when(_any(value, fixed.SHEET_PACKAGING), 1.0).otherwise(0.2)
    return out


_FLAGS = "(?dimsuU)"


def _may_match(low: Column, labels: tuple[str, ...]) -> Column:
    """Whether a lower-cased text holds what a match needs; plain substrings first, as they are found far faster than patterns."""
    plain = [F.contains(low, F.lit(x)) for x in (*labels, *fixed.SHEET_LETTERS) if "." not in x]
    return reduce(lambda a, b: a | b, plain + [low.rlike("(?s)" + x) for x in labels if "." in x])


def values(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, field, value, at, snippet, quality): of each text and field the first match that gives a fitting value; at counts characters before the match.

    A match begins where its text is first found: wherever a label stands before a character, the pattern matches.
    Each step's columns are made once for each row, as the next step names them many times.
    """
    tried = [(f, k, p) for f, ps in fixed.SHEET_PATTERNS.items() for k, p in enumerate(ps)]
    col = lambda what, f, k: c(f"_{what}_{f}_{k}")
    step = lambda rows, made: cleaning.once(rows, {f"_{what}_{f}_{k}": x for f, k, p in tried for what, x in made(f, k, p).items()})

    def whole(f, k, p):
        return {"whole": F.when(_may_match(c("_low"), fixed.SHEET_LABELS[f][k]), F.regexp_extract(text_col, _FLAGS + p, 0))}

    def plain(f, k, p):
        m = col("whole", f, k)
        return {"at": F.when(m != "", F.instr(text_col, m) - 1), "plain": F.when(m != "", tidy(F.regexp_extract(m, _FLAGS + p, 1)))}

    def kept(f, k, p):
        at, end = col("at", f, k), col("at", f, k) + F.char_length(col("whole", f, k)) + AROUND
        begin = F.greatest(F.lit(0), at - AROUND)
        fits = F.length(col("plain", f, k)) > 1
        snippet = F.regexp_replace(t.strip(F.substr(text_col, begin + 1, end - begin)), "[ \t]+", " ")
        return {"value": F.when(fits, shortened(col("plain", f, k), fixed.SHEET_LONGEST[f])), "snippet": F.when(fits, snippet)}

    def quality(f, k, p):
        return {"quality": F.when(col("value", f, k).isNotNull(), worth(col("value", f, k), f))}

    seen = cleaning.once(docs.select(id_col, text_col), {"_low": F.lower(text_col)})
    for made in (whole, plain, kept, quality):
        seen = step(seen, made)
    first = lambda f: F.coalesce(*[F.when(col("quality", f, k) >= 0.1, F.struct(*[col(x, f, k).alias(x) for x in ("value", "at", "snippet", "quality")])) for g, k, _ in tried if g == f])
    each = [F.struct(F.lit(f).alias("field"), first(f).alias("x")) for f in fixed.SHEET_PATTERNS]
    rows = seen.select(id_col, F.explode(F.array(*each)).alias("e")).filter("e.x is not null")
    return rows.select(id_col, "e.field", "e.x.value", "e.x.at", "e.x.snippet", "e.x.quality")


def labelled_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, specs): the label and value lines of each text as a map in the order of their first mention; of a label that comes again the last value holds."""
    pattern = F.lit("(?dmU)" + fixed.SHEET_LINE)
    pairs = F.arrays_zip(F.regexp_extract_all(text_col, pattern, F.lit(1)).alias("k"), F.regexp_extract_all(text_col, pattern, F.lit(2)).alias("v"))
    stripped = F.transform(pairs, lambda x: F.struct(t.strip(x["k"]).alias("key"), t.strip(x["v"]).alias("value")))
    skipped = lambda k: reduce(lambda a, b: a | b, [F.contains(F.lower(k), F.lit(w)) for w in fixed.SHEET_SKIPPED])
    fit = F.filter(stripped, lambda x: (x["key"] != "") & (x["value"] != "") & (F.length(x["key"]) < 60) & (F.length(x["value"]) < 300) & ~skipped(x["key"]))
    found = docs.select(id_col, fit.alias("_pairs")).filter(F.size("_pairs") > 0)
    keys = F.array_distinct(F.transform("_pairs", lambda x: x["key"]))
    last = F.transform(keys, lambda k: F.element_at(F.filter("_pairs", lambda x: x["key"] == k), -1)["value"])
    return found.select(id_col, F.map_from_arrays(keys, last).alias("specs"))
