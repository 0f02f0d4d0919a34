"""Findings of other sources: rows for each field, their application, and what a description is worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t

c = F.col
#: Statuses of a field that a finding may mend.
WEAK = ["MISSING", "WEAK", "SHOULD_IMPROVE", "PROBABLE_ERROR", "MANUAL_REVIEW"]
_TECHNICAL = r"\b(?:mm|cm|ml|g|kg|stk|steril|nitril|vinyl|latex|engangs|flergangs|pudderfri|materiale|størrelse|diameter|lengde|bredde|volum)\b"


def manufacturer_rows(df: DataFrame, key: str, name: Column, description: Column, details: Column, conf: Column) -> DataFrame:
    """(key, field, value, conf): name, description and each detail, with 0.9, 0.8 and 0.7 of the confidence."""
    row = lambda field, value, share: F.struct(field.alias("field"), value.alias("value"), (conf * share / 100).alias("conf"))
    plain = [F.when(t.filled(v).isNotNull(), row(F.lit(k), v, share)) for k, v, share in (("product_name", name, 90), ("description", description, 80))]
    specs = F.transform(F.map_entries(F.coalesce(details, F.create_map().cast("map<string,string>"))), lambda e: row(F.concat(F.lit("spec:"), e.key), e.value, 70))
    every = F.filter(F.concat(F.array(*plain), specs), lambda x: x.isNotNull())
    return df.select(c(key).alias("key"), F.inline(every))


def applied(statuses: DataFrame, found: DataFrame, least: int = 60) -> DataFrame:
    """(key, field, status, suggested, conf): the surest finding of each weak field that is confident enough and not in conflict; the first of equals."""
    order = W.partitionBy("key", "field").orderBy(F.desc("conf"), "seq")
    best = found.filter((c("conf") >= least) & (c("review") != "conflict")).withColumn("r", F.row_number().over(order)).filter("r = 1")
    return statuses.filter(c("status").isin(WEAK)).join(best.select("key", "field", c("value").alias("suggested"), "conf"), ["key", "field"])


def technical_words(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit(t.re2(_TECHNICAL)))


def points(x: Column, sentences: Column, technical: Column, gate: Column) -> Column:
    """Hundredths for a text without white space at its ends: its length, sentences, technical words, and whether nothing speaks against it (gate)."""
    size = F.length(x)
    out = (
        F.when(size < 50, 10).when(size <= 500, 25).when(size <= 1000, 20).otherwise(10) + F.when(sentences >= 2, 25).when(sentences == 1, 15).otherwise(0)
        + F.when(technical >= 3, 25).when(technical >= 1, 15).otherwise(0) + F.when(gate.isNull(), 25).otherwise(0)
    )
    return F.when(x == "", 0).when(size < 15, 5).otherwise(out)


def description_quality(text: Column, gate: Column | None = None) -> Column:
    """The points of any text; gate is its reason, if it is known already."""
    x = t.ascii_strip(F.coalesce(text, F.lit("")))
    return points(x, t.sentences(x), technical_words(x), t.description_gate(text) if gate is None else gate)
