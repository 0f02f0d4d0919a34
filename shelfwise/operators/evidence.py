"""Evidence from documents and manufacturers: merge, choice, gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

c = F.col


def values_match(a: Column, b: Column) -> Column:
    """Equal but for case, white space and punctuation, or one holds the other at 80 % of its length (over five characters each)."""
    x, y = (F.lower(F.trim(F.regexp_replace(v, r"(?U)[\s\-_/.,;:]+", " "))) for v in (a, b))
    near = (F.length(x) > 5) & (F.length(y) > 5) & (F.contains(x, y) | F.contains(y, x)) & (F.least(F.length(x), F.length(y)) >= 0.8 * F.greatest(F.length(x), F.length(y)))
    return (a == b) | (x == y) | near


def merge(pdf: DataFrame, mfr: DataFrame) -> DataFrame:
    """Full outer join of two sources' (key, field, value, conf) with what the pair tells; conf in hundredths."""
    p, m = (d.select("key", "field", c("value").alias(f"{n}_value"), c("conf").alias(f"{n}_conf")) for d, n in ((pdf, "pdf"), (mfr, "mfr")))
    both = c("pdf_value").isNotNull() & c("mfr_value").isNotNull()
    same = values_match(c("pdf_value"), c("mfr_value"))
    return p.join(m, ["key", "field"], "full_outer").select(
        "key", "field", F.coalesce("pdf_value", "mfr_value").alias("value"),
        F.when(both & same, "FOUND_IN_BOTH_MATCH").when(both, "FOUND_IN_BOTH_CONFLICT").when(c("pdf_value").isNotNull(), "FOUND_IN_PDF_ONLY").when(c("mfr_value").isNotNull(), "FOUND_IN_MANUFACTURER_ONLY").otherwise("NOT_FOUND").alias("match_status"),
        F.when(both & same, F.least(F.lit(95), c("pdf_conf") + 15)).when(both, F.floor(F.greatest("pdf_conf", "mfr_conf") * 60 / 100)).otherwise(F.coalesce("pdf_conf", "mfr_conf", F.lit(0))).cast("long").alias("conf"),
    )


def gate(suggestions: DataFrame) -> DataFrame:
    """Suggestions (current, suggested, conf in hundredths) that stand: not blank, confident, and saying something new."""
    cur, new = t.words(c("current")), t.words(c("suggested"))
    same = F.array_join(cur, " ") == F.array_join(new, " ")
    close = (F.length("current") > 20) & (t.jaccard(cur, new) > 0.8)
    a, b = F.array_distinct(cur), F.array_distinct(new)
    held = (F.length("current") > 30) & (F.size(F.array_intersect(a, b)) > 0.85 * F.size(a)) & (F.size(F.array_except(b, a)) < 0.2 * F.size(b))
    drop = (F.trim(F.coalesce("suggested", F.lit(""))) == "") | (c("conf") < 50) | F.coalesce(same, F.lit(False)) | F.coalesce(close, F.lit(False)) | F.coalesce(held, F.lit(False))
    return suggestions.filter(~drop)
