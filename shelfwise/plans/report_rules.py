"""Queries on the report's sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import evidence, fields, reports
from ..sources.views import PRODUCTS_SQL, products, table
from . import sql
from .catalog import _sources, query

c = F.col

V = f"WITH v AS ({PRODUCTS_SQL})"
_CONTACT = "(manufacturer_status = 'MISSING' OR mfr_number_status = 'MISSING' OR specification_status = 'MISSING')"
_JUDGED = f"{V}, s AS ({sql.STATUSES}), j AS (SELECT *, {sql.TOTAL} AS total_score, {sql.OVERALL} AS overall_status, {_CONTACT} AS requires FROM s)"


def _case(x: str, values: dict[str, str], rest: str = "NULL") -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {rest} END"


def _yes(x: str) -> str:
    return f"CASE WHEN {x} THEN 'Ja' ELSE 'Nei' END"


_MATCHES = "SELECT l_partkey AS key, CASE l_linenumber % 4 WHEN 0 THEN 'NOT_FOUND' WHEN 1 THEN 'FOUND_IN_BOTH_CONFLICT' ELSE 'FOUND_IN_PDF_ONLY' END AS match_status FROM lineitem"


@query(f"""{_JUDGED}, m AS (SELECT key, count_if(match_status <> 'NOT_FOUND') AS n_found, count_if(match_status = 'FOUND_IN_BOTH_CONFLICT') AS n_conflicts FROM ({_MATCHES}) GROUP BY 1)
    SELECT j.key, coalesce(web_name, '') AS name, {_yes('found')} AS found_on_site, {_case('verification', fixed.VERIFICATION_LABELS)} AS verification, {_case('verification', fixed.VERIFICATION_EVIDENCE, "''")} AS evidence, total_score, overall_status, coalesce(manufacturer, '') AS manufacturer,
        coalesce(array_to_string(crumbs, ' > '), category, '') AS category, round_even(image_avg, 1) AS image_score, coalesce(image_quality, 'MISSING') AS image_status, image_count, {_yes('pdf')} AS pdf, coalesce(n_found, 0) AS n_found, coalesce(n_conflicts, 0) AS n_conflicts,
        {_yes("overall_status = 'SHOULD_IMPROVE' AND NOT requires")} AS auto_fix, {_yes("overall_status IN ('PROBABLE_ERROR', 'MISSING') OR verification IN ('UNVERIFIED', 'MISMATCH', 'AMBIGUOUS', 'CDN_ONLY')")} AS manual_review, {_yes('requires')} AS requires_manufacturer, coalesce(product_url, '') AS url
    FROM j LEFT JOIN m ON j.key = m.key""")
def q_overview(spark, sf):
    """One row for each product, as the report's overview has it."""
    kind = F.when(c("l_linenumber") % 4 == 0, "NOT_FOUND").when(c("l_linenumber") % 4 == 1, "FOUND_IN_BOTH_CONFLICT").otherwise("FOUND_IN_PDF_ONLY")
    return reports.overview(reports.judged(products(spark, sf)), table(spark, sf, "lineitem").select(c("l_partkey").alias("key"), kind.alias("match_status")))


def _detail(field: str) -> str:
    web, erp = (f"nullif({x}, '')" if x else "NULL::VARCHAR" for x in reports.SOURCES[field])
    return f"""SELECT key, '{fixed.FIELD_LABELS[field]}' AS field, coalesce({web}, {erp}) AS value, {field}_status AS status,
        CASE WHEN {web} IS NOT NULL AND {erp} IS NOT NULL THEN 'nettside + ERP' WHEN {web} IS NOT NULL THEN 'nettside kun' WHEN {erp} IS NOT NULL THEN 'ERP kun' END AS origin, {web} AS website_value, {erp} AS erp_value FROM s"""


@query(f"{V}, s AS ({sql.STATUSES}) {' UNION ALL '.join(map(_detail, reports.SOURCES))}")
def q_field_details(spark, sf):
    """One row for each product and field: value, status, and what both sources say."""
    return reports.details(fields.with_statuses(products(spark, sf)))


_GAPS = ", ".join(f"CASE WHEN {k}_status IN ('MISSING', 'REQUIRES_MANUFACTURER') THEN '{v}' END" for k, v in fixed.FIELD_LABELS.items())


@query(f"{_JUDGED} SELECT coalesce(nullif(manufacturer, ''), 'Ukjent produsent') AS manufacturer, key, array_to_string(list_filter([{_GAPS}], lambda x: x IS NOT NULL), ', ') AS missing, overall_status FROM j WHERE requires")
def q_manufacturer_gaps(spark, sf):
    """What each manufacturer has to supply, by product."""
    return reports.manufacturer_gaps(reports.judged(products(spark, sf)))


@query(f"""{V}, i AS (SELECT key, image_count AS n, image_avg AS s, image_quality IN ('REVIEW', 'FAIL') AS d FROM v), r AS (SELECT *, CASE WHEN n = 0 OR s < 40 THEN 'high' WHEN s < 70 THEN 'medium' WHEN coalesce(d, FALSE) THEN 'low' ELSE 'none' END AS p FROM i)
    SELECT key, CASE p WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS rank, {_case('p', fixed.PRIORITY_LABELS)} AS priority, CASE WHEN n = 0 THEN 'MISSING' WHEN s < 40 THEN 'FAIL' WHEN s < 70 THEN 'REVIEW' ELSE 'PASS_WITH_NOTES' END AS status, s AS score, n AS n_images FROM r WHERE p <> 'none'""")
def q_image_issues(spark, sf):
    """Products whose images need work, with their rank in the report."""
    doubtful = F.coalesce(c("image_quality").isin("REVIEW", "FAIL"), F.lit(False))
    return reports.image_issues(products(spark, sf).select("key", c("image_count").alias("n_images"), c("image_avg").alias("average"), doubtful.alias("doubtful")))


@query(f"""{V} SELECT key, CASE WHEN image_count = 0 THEN 'missing' WHEN image_avg < 40 THEN 'low_quality' WHEN image_avg < 70 THEN CASE key % 3 WHEN 0 THEN 'poor_background' WHEN 1 THEN 'low_quality' ELSE 'review' END ELSE 'ok' END AS status FROM v""")
def q_main_image_status(spark, sf):
    """What is to be done about each main image."""
    issues = F.when(c("key") % 3 == 0, F.array(F.lit("Low resolution"), F.lit("Busy Background"))).when(c("key") % 3 == 1, F.array(F.lit("Low resolution"))).otherwise(F.array(F.lit("dark")))
    return products(spark, sf).select("key", reports.main_image_status(c("image_count") > 0, c("image_avg"), issues).alias("status"))


@query("""WITH x AS (SELECT p_partkey AS key, p_name AS pdf_value, 'other ' || p_brand AS mfr_value FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 4 <> 0 AND p_partkey % 5 = 0)
    SELECT key, 'name' AS field, pdf_value, mfr_value, 'KONFLIKT - PDF: ''' || pdf_value || ''' vs Produsent: ''' || mfr_value || '''' AS evidence FROM x""")
def q_source_conflicts(spark, sf):
    """Fields for which data sheet and manufacturer disagree."""
    found = reports.conflicts(*_sources(spark, sf), evidence.values_match(c("pdf_value"), c("mfr_value")))
    return found.select("key", "field", "pdf_value", "mfr_value", "evidence")


@query(f"{V}, a AS ({sql.AREAS}) SELECT key, {' + '.join(f'len({k}_grave)' for k in fixed.AREA_WEIGHTS)} AS n_high FROM a")
def q_grave_issues(spark, sf):
    """How many grave issues all areas of a product have."""
    return fields.scored_areas(products(spark, sf)).select("key", c("n_high").cast("long").alias("n_high"))
