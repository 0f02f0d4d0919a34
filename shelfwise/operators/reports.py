"""Sheets of the report as tables: one row for each product, field, conflict, image or manufacturer's gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as t
from . import cleaning, fields, images

c = F.col

#: Where a field's values lie in the two sources.
SOURCES = {
    "name": ("web_name", "erp_name"), "description": ("description", "erp_text"), "specification": ("specification", "erp_specification"), "manufacturer": ("manufacturer", "supplier"), "mfr_number": ("mfr_number", "erp_number"), "brand": (None, "brand"),
    "category": ("category", None), "packaging": ("packaging", None),
}


def _yes(x: Column) -> Column:
    return F.when(F.coalesce(x, F.lit(False)), "Ja").otherwise("Nei")


def verification_evidence(status: Column, own: Column) -> Column:
    """A verification's own evidence, else the standard text of its status."""
    out = F.lit("")
    for k, v in fixed.VERIFICATION_EVIDENCE.items():
        out = F.when(status == k, v).otherwise(out)
    return F.coalesce(t.filled(own), out)


def image_result(n_images: Column, average: Column, doubtful: Column) -> tuple[Column, Column]:
    """(status, priority) of a product's images: how many there are, their average score, and whether one of them isn't good."""
    good = average >= 70
    status = F.when(n_images == 0, "MISSING").when(good & ~doubtful, "PASS").when(good, "PASS_WITH_NOTES").when(average >= 40, "REVIEW").otherwise("FAIL")
    priority = F.when(n_images == 0, "high").when(good & ~doubtful, "none").when(good, "low").when(average >= 40, "medium").otherwise("high")
    return status, priority


def main_image_status(there: Column, score: Column, issues: Column) -> Column:
    """What is to be done about a main image: missing, low_quality, poor_background, review or ok."""
    about = lambda word: F.exists(issues, lambda x: F.contains(F.lower(x), F.lit(word)))
    middling = F.when(about("background"), "poor_background").when(about("resolution"), "low_quality").otherwise("review")
    return F.when(~F.coalesce(there, F.lit(False)), "missing").when(score < 40, "low_quality").when(score < 70, middling).otherwise("ok")


def judged(products: DataFrame) -> DataFrame:
    """Products with field statuses, overall status, total score and review flags, each made once."""
    out = cleaning.once(fields.with_statuses(products), {"total_score": fields.total_score(), "overall_status": fields.overall_status()})
    return out.withColumns(fields.review_flags())


def overview(judged_products: DataFrame, found: DataFrame) -> DataFrame:
    """One row for each product. found: (key, match_status) of its findings in other sources, counted before they are joined."""
    counted = found.groupBy("key").agg(F.count_if(c("match_status") != "NOT_FOUND").alias("n_found"), F.count_if(c("match_status") == "FOUND_IN_BOTH_CONFLICT").alias("n_conflicts"))
    p = judged_products.join(counted, "key", "left")
    return p.select(
        "key", F.coalesce("web_name", F.lit("")).alias("name"), _yes(c("found")).alias("found_on_site"), images.verification_label(c("verification")).alias("verification"), verification_evidence(c("verification"), F.lit(None).cast("string")).alias("evidence"),
        "total_score", "overall_status", F.coalesce("manufacturer", F.lit("")).alias("manufacturer"), F.coalesce(t.filled(F.array_join("crumbs", " > ")), "category", F.lit("")).alias("category"),
        F.coalesce(F.bround("image_avg", 1), F.lit(0.0)).alias("image_score"), F.coalesce("image_quality", F.lit("MISSING")).alias("image_status"), "image_count", _yes(c("pdf")).alias("pdf"), F.coalesce("n_found", F.lit(0)).alias("n_found"),
        F.coalesce("n_conflicts", F.lit(0)).alias("n_conflicts"), _yes(c("auto_fix")).alias("auto_fix"), _yes(c("manual_review")).alias("manual_review"), _yes(c("requires_manufacturer")).alias("requires_manufacturer"), F.coalesce("product_url", F.lit("")).alias("url"),
    )


def details(judged_products: DataFrame) -> DataFrame:
    """(key, field, value, status, origin, website_value, erp_value) for each product and field that two sources can fill."""
    rows = []
    for field, (web, erp) in SOURCES.items():
        w, e = (t.filled(c(x)) if x else F.lit(None).cast("string") for x in (web, erp))
        rows.append(F.struct(F.lit(fixed.FIELD_LABELS[field]).alias("field"), F.coalesce(w, e).alias("value"), c(f"{field}_status").alias("status"), t.source_label(w, e).alias("origin"), w.alias("website_value"), e.alias("erp_value")))
    return judged_products.select("key", F.inline(F.array(*rows)))


def manufacturer_gaps(judged_products: DataFrame) -> DataFrame:
    """(manufacturer, key, missing, overall_status) of products that only their manufacturer can complete."""
    gaps = [F.when(c(f"{k}_status").isin("MISSING", "REQUIRES_MANUFACTURER"), v) for k, v in fixed.FIELD_LABELS.items() if f"{k}_status" in judged_products.columns]
    missing = F.array_join(F.filter(F.array(*gaps), lambda x: x.isNotNull()), ", ")
    return judged_products.filter("requires_manufacturer").select(F.coalesce(t.filled(c("manufacturer")), F.lit("Ukjent produsent")).alias("manufacturer"), "key", missing.alias("missing"), "overall_status")


def image_issues(rows: DataFrame) -> DataFrame:
    """(key, rank, priority, status, score, n_images): products (key, n_images, average, doubtful) whose images need work. By rank, then by falling score, they stand as the report lists them."""
    status, priority = image_result(c("n_images"), c("average"), c("doubtful"))
    rank = F.when(c("priority") == "high", 0).when(c("priority") == "medium", 1).otherwise(2)
    label = F.lit("")
    for k, v in fixed.PRIORITY_LABELS.items():
        label = F.when(c("priority") == k, v).otherwise(label)
    found = rows.select("key", "n_images", F.coalesce("average", F.lit(0.0)).alias("score"), status.alias("status"), priority.alias("priority")).filter("priority <> 'none'")
    return found.select("key", rank.alias("rank"), label.alias("priority"), "status", "score", "n_images")


def conflicts(pdf: DataFrame, mfr: DataFrame, same: Column) -> DataFrame:
    """(key, field, pdf_value, mfr_value, evidence, advice) where both sources of (key, field, value) speak and disagree; same compares pdf_value with mfr_value."""
    both = pdf.select("key", "field", c("value").alias("pdf_value")).join(mfr.select("key", "field", c("value").alias("mfr_value")), ["key", "field"])
    evidence = F.concat(F.lit("KONFLIKT - PDF: '"), c("pdf_value"), F.lit("' vs Produsent: '"), c("mfr_value"), F.lit("'"))
    return both.filter(~same).select("key", "field", "pdf_value", "mfr_value", evidence.alias("evidence"), F.lit("Manuell vurdering påkrevd").alias("advice"))
