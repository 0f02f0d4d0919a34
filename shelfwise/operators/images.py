"""Product images: addresses, identity of candidates, reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as t

c = F.col


def verification_label(status: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, v in fixed.VERIFICATION_LABELS.items():
        out = out.when(status == k, v)
    return out


def addresses(df: DataFrame, number: str, base: str, most: int = 11) -> DataFrame:
    """df with a row for each place of an image: its place and address; the first has no number of its own."""
    out = df.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    suffix = F.when(c("place") == 0, "").otherwise(F.concat(F.lit("-"), c("place") + 1))
    return out.withColumn("url", F.concat(F.lit(base), F.trim(number), suffix, F.lit(".jpg")))


def identity(url: Column, their_number: Column, own_number: Column, maker: Column, domain: Column, description: Column, specification: Column, page: Column) -> Column:
    """0 to 1: how many signals say that an image shows the product. Numbers in the address and on the page weigh most, and more together."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-zA-Z]+://[^/]*", "")
    in_url, in_file = t.holds_number(url, their_number), t.holds_number(F.substring_index(path, "/", -1), their_number)
    ours, in_page = t.holds_number(url, own_number), t.holds_number(page, their_number)
    name = t.without_suffixes(maker, [*fixed.SUFFIXES, " norge"])
    named = F.coalesce((name != "") & (F.contains(F.lower(domain), name) | F.contains(F.lower(F.coalesce(page, F.lit(""))), name)), F.lit(False))
    shared = F.coalesce(t.overlap(description, page), F.lit(0.0))
    terms = F.regexp_extract_all(F.lower(specification), F.lit(r"\d+x\d+\s*mm|\d+\s*my|\d+\s*ml|\d+\s*g\b"), F.lit(0))
    closed = F.replace(F.lower(page), F.lit(" "), F.lit(""))
    hits = F.size(F.filter(terms, lambda x: F.contains(closed, F.replace(x, F.lit(" "), F.lit("")))))
    points = lambda when, n: F.when(when, n).otherwise(0.0)
    total = (
        points(in_url, 0.35) + points(in_file, 0.30) + points(ours, 0.20) + points(in_page, 0.25) + points(named, 0.15)
        + F.when(shared >= 0.4, F.least(shared * 0.25, F.lit(0.20))).otherwise(0.0) + F.when(hits > 0, F.least(hits / F.size(terms) * 0.15, F.lit(0.15))).otherwise(0.0)
        + points((in_url | in_file) & in_page, 0.10) + points((in_url | in_file) & named, 0.10)
    )
    return F.least(total, F.lit(1.0))


def confidence(identity_score: Column, source: Column) -> Column:
    """Identity times how far the source is trusted; a sure identity at a trusted source gets more."""
    names = ["manufacturer_mediabank", "manufacturer_website", "official_distributor", "catalog_site", "web_search"]
    trust = F.lit(0.5)
    for name, x in zip(names, fixed.SOURCE_TRUST.values()):
        trust = F.when(source == name, x).otherwise(trust)
    return F.least(F.lit(1.0), F.when((identity_score >= 0.5) & (trust >= 0.7), identity_score * (trust + 0.15)).otherwise(identity_score * trust))


def improvement(current: Column, source: Column) -> Column:
    """How much better a candidate is than what there is, in hundredths."""
    base, more = F.lit(20), F.lit(0)
    for k, v in fixed.IMPROVEMENT.items():
        base = F.when(current == k, v).otherwise(base)
    for k, v in fixed.IMPROVEMENT_BOOST.items():
        more = F.when(source == k, v).otherwise(more)
    return F.least(F.lit(100), base + more)


def review_status(n_images: Column, score: Column, quality: Column) -> Column:
    """Why a product's image needs a review; ok if it doesn't."""
    return F.when(n_images == 0, "missing").when(score < 70, "low_quality").when(quality.isin("FAIL", "REVIEW"), "review").otherwise("ok")


def session_summary(df: DataFrame) -> DataFrame:
    status, there = review_status(c("image_count"), c("image_avg"), c("image_quality")), c("image_count") > 0
    return df.agg(
        F.count("*").alias("total"), F.count_if(~there).alias("missing"), F.count_if(there & (c("image_avg") < 40)).alias("low"), F.count_if(status != "ok").alias("needs_review"),
        F.count_if(there & (c("image_avg") >= 70)).alias("good"), F.bround(F.avg("image_avg"), 1).alias("avg_score"),
    )
