"""Queries on merged findings, what suggestions amount to, and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import cleaning, fields, findings
from ..sources.views import PRODUCTS_SQL, products, table
from . import sql
from .catalog import query

c = F.col

V = f"WITH v AS ({PRODUCTS_SQL})"

_SHEET = """SELECT p_partkey AS key, 'product_name' AS field, p_name AS value, CASE WHEN p_partkey % 2 = 0 THEN 'seen in ' || p_type END AS evidence, 50 + p_size % 40 AS conf, 's.pdf' AS url, 'sheet' AS level,
    CASE WHEN p_partkey % 7 = 0 THEN 'NOT_FOUND' ELSE 'FOUND_IN_INTERNAL_PDF' END AS match_status, 'open' AS review FROM part WHERE p_partkey % 3 <> 0"""
_MAKER = """SELECT p_partkey AS key, 'product_name' AS field, CASE p_partkey % 5 WHEN 0 THEN 'other ' || p_brand WHEN 1 THEN '' ELSE upper(p_name) END AS value, NULL AS evidence, 40 + p_size % 50 AS conf, 'https://m' AS url, 'maker' AS level,
    'FOUND_IN_MANUFACTURER_SOURCE' AS match_status, 'new' AS review FROM part WHERE p_partkey % 4 <> 0"""


@query(f"""WITH s AS (SELECT *, match_status <> 'NOT_FOUND' AS told FROM ({_SHEET})), m AS (SELECT *, value <> '' AS told FROM ({_MAKER})),
    j AS (SELECT coalesce(s.key, m.key) AS key, coalesce(s.told, FALSE) AS a, coalesce(m.told, FALSE) AS b, m.key % 5 <> 0 AS same, s, m FROM s FULL JOIN m ON s.key = m.key),
    k AS (SELECT *, CASE WHEN a AND b AND same THEN 'match' WHEN a AND b THEN 'conflict' WHEN a THEN 'sheet' WHEN b THEN 'maker' ELSE 'none' END AS how, s.key IS NOT NULL AS has FROM j)
    SELECT k.key, 'product_name' AS field, CASE WHEN k.key % 6 <> 0 THEN 'now ' || k.key END AS current_value, CASE how WHEN 'none' THEN NULL WHEN 'maker' THEN m.value ELSE s.value END AS value,
        CASE how WHEN 'match' THEN 'PDF: ' || coalesce(s.evidence, s.value) || ' | Produsent: ' || m.value WHEN 'conflict' THEN 'KONFLIKT - PDF: ''' || s.value || ''' vs Produsent: ''' || m.value || '''' WHEN 'sheet' THEN s.evidence WHEN 'none' THEN CASE WHEN has THEN s.evidence END END AS evidence,
        CASE how WHEN 'none' THEN 0 WHEN 'match' THEN least(95, s.conf + 15) WHEN 'conflict' THEN greatest(s.conf, m.conf) * 0.6::DOUBLE WHEN 'sheet' THEN s.conf ELSE m.conf END::DOUBLE AS conf,
        CASE WHEN how = 'maker' OR NOT has THEN 'maker' ELSE 'sheet' END AS level,
        CASE how WHEN 'none' THEN 'NOT_FOUND' WHEN 'match' THEN 'FOUND_IN_BOTH_MATCH' WHEN 'conflict' THEN 'FOUND_IN_BOTH_CONFLICT' WHEN 'sheet' THEN s.match_status ELSE m.match_status END AS match_status,
        CASE how WHEN 'match' THEN 'auto' WHEN 'conflict' THEN 'conflict' WHEN 'sheet' THEN 'open' WHEN 'maker' THEN 'new' ELSE CASE WHEN has THEN 'open' ELSE 'new' END END AS review FROM k""")
def q_merged_findings(spark, sf):
    """Both sources' findings as one, with evidence, review status, and rows that say that nothing was found."""
    p, k = table(spark, sf, "part"), c("p_partkey")
    row = lambda value, said, conf, url, level, status, review: (k.alias("key"), F.lit("product_name").alias("field"), value.alias("value"), said.alias("evidence"), conf.cast("double").alias("conf"), F.lit(url).alias("url"), F.lit(level).alias("level"), status.alias("match_status"), F.lit(review).alias("review"))
    sheet = p.filter("p_partkey % 3 <> 0").select(*row(c("p_name"), F.when(k % 2 == 0, F.concat(F.lit("seen in "), c("p_type"))), 50 + c("p_size") % 40, "s.pdf", "sheet", F.when(k % 7 == 0, "NOT_FOUND").otherwise("FOUND_IN_INTERNAL_PDF"), "open"))
    said = F.when(k % 5 == 0, F.concat(F.lit("other "), c("p_brand"))).when(k % 5 == 1, "").otherwise(F.upper("p_name"))
    maker = p.filter("p_partkey % 4 <> 0").select(*row(said, F.lit(None).cast("string"), 40 + c("p_size") % 50, "https://m", "maker", F.lit("FOUND_IN_MANUFACTURER_SOURCE"), "new"))
    current = p.filter("p_partkey % 6 <> 0").select(k.alias("key"), F.lit("product_name").alias("field"), F.concat(F.lit("now "), k).alias("current_value"))
    return findings.merged(sheet, maker, current).drop("url")


_JUDGED_FIELDS = {k: v for k, v in fixed.FIELD_LABELS.items() if k != "image"}


def _labels(*statuses: str) -> str:
    return f"list_filter([{', '.join(f'''CASE WHEN {k}_status IN ({sql.strings(list(statuses))}) THEN '{v}' END''' for k, v in _JUDGED_FIELDS.items())}], lambda x: x IS NOT NULL)"


@query(f"""{V}, s AS ({sql.STATUSES}), a AS (SELECT key, found, list_concat(CASE WHEN key % 2 = 0 THEN ['Produktnavn'] ELSE [] END, CASE WHEN key % 3 = 0 THEN ['Beskrivelse'] ELSE [] END) AS suggested, CASE WHEN key % 6 = 0 THEN ['Beskrivelse'] ELSE [] END AS made,
        {_labels('MISSING', 'PROBABLE_ERROR')} AS missing, {_labels('WEAK', 'SHOULD_IMPROVE')} AS weak, CASE WHEN key % 5 = 0 THEN 2 ELSE 0 END AS n, CASE WHEN key % 4 = 0 THEN ['Produktnavn'] ELSE [] END AS unsure FROM s),
    b AS (SELECT *, list_filter(missing, lambda x: x IN ({sql.strings(list(findings.CRITICAL))})) AS critical, len(made) + n + len(unsure) + len(missing) > 0 AS doubtful,
        concat_ws('; ', CASE WHEN len(made) > 0 THEN 'AI-generert innhold for: ' || array_to_string(made, ', ') END, CASE WHEN n > 0 THEN n || ' kildekonflikt(er)' END, CASE WHEN len(unsure) > 0 THEN 'Lav confidence: ' || array_to_string(unsure, ', ') END) AS notes FROM a),
    d AS (SELECT *, CASE WHEN NOT found THEN 1 WHEN len(suggested) = 0 AND len(missing) = 0 THEN 2 WHEN len(critical) >= 2 AND len(suggested) = 0 THEN 3 WHEN len(suggested) > 0 AND NOT doubtful THEN 4 WHEN len(suggested) > 0 THEN 5 ELSE 6 END AS k FROM b)
    SELECT key, CASE k WHEN 1 THEN 'Missing Source Data' WHEN 2 THEN 'No Change' WHEN 3 THEN 'Missing Source Data' WHEN 4 THEN 'Ready for Inriver' ELSE 'Needs Review' END AS status, k NOT IN (2, 4) AS review_required,
        CASE k WHEN 1 THEN 'Produkt ikke funnet i kilde' WHEN 2 THEN 'Produkt har akseptabel kvalitet' WHEN 3 THEN 'Mangler: ' || array_to_string(critical, ', ') ELSE concat_ws('; ', nullif(notes, ''),
            CASE WHEN k = 4 THEN 'Forslag for: ' || array_to_string(suggested, ', ') WHEN k = 5 AND len(missing) > 0 THEN 'Mangler fortsatt: ' || array_to_string(missing, ', ') WHEN k = 6 THEN 'Mangler: ' || array_to_string(missing, ', ') END) END AS comment FROM d""")
def q_enrichment_status(spark, sf):
    """What each product's suggestions amount to, and why."""
    k = c("key")
    fields_with = lambda *statuses: F.filter(F.array(*[F.when(c(f"{n}_status").isin(*statuses), v) for n, v in _JUDGED_FIELDS.items()]), lambda x: x.isNotNull())
    one = lambda mod, name: F.when(k % mod == 0, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    rows = cleaning.once(fields.with_statuses(products(spark, sf)), {"missing": fields_with("MISSING", "PROBABLE_ERROR"), "weak": fields_with("WEAK", "SHOULD_IMPROVE")})
    suggested = F.concat(one(2, "Produktnavn"), one(3, "Beskrivelse"))
    x = findings.outcome(c("found"), suggested, one(6, "Beskrivelse"), c("missing"), c("weak"), F.when(k % 5 == 0, 2).otherwise(0), one(4, "Produktnavn"))
    return cleaning.once(rows, {"x": x}).select("key", "x.status", "x.review_required", "x.comment")


_MADE = "CASE key % 4 WHEN 0 THEN 'Acme Norge AS' WHEN 1 THEN ' Beta GmbH' WHEN 2 THEN NULL ELSE 'AS' END"
_NUMBERED = "CASE key % 3 WHEN 0 THEN 'N' || key WHEN 1 THEN 'ab-' || key || '.1' END"


@query(f"""{V}, a AS (SELECT key, {_MADE} AS maker, {_NUMBERED} AS number, web_name, specification FROM v), b AS (SELECT *, trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(trim(coalesce(maker, '')), ' AS$', '')), ' GmbH$', '')), ' Norge$', '')) AS m,
        regexp_replace(regexp_replace(upper(coalesce(number, '')), '^N([0-9]+)$', '\\1'), '[-.]', '', 'g') AS n, list_filter(string_split_regex(coalesce(web_name, ''), '\\s+'), lambda w: length(w) >= 3) AS w, key::VARCHAR AS own FROM a),
    q AS (SELECT key, list_filter([CASE WHEN m <> '' AND n <> '' AND len(w) > 0 THEN array_to_string(w[1:4], ' ') || ' ' || m || ' ' || n END, CASE WHEN m <> '' AND n <> '' THEN m || ' ' || n END, CASE WHEN m <> '' AND len(w) > 0 THEN array_to_string(w[1:5], ' ') || ' ' || m END,
        CASE WHEN len(w) > 0 AND n <> '' THEN array_to_string(w[1:4], ' ') || ' ' || n END, CASE WHEN n <> '' THEN n || ' product image' END, CASE WHEN m <> '' AND len(w) > 0 THEN m || ' ' || array_to_string(w[1:3], ' ') || ' product image' END,
        CASE WHEN m <> '' AND coalesce(specification, '') <> '' THEN m || ' ' || trim(substr(specification, 1, 50)) END, CASE WHEN len(w) > 0 THEN array_to_string(w[1:5], ' ') || ' product image' END, CASE WHEN len(w) > 0 THEN array_to_string(w[1:4], ' ') || ' medical product' END,
        CASE WHEN m <> '' THEN m || ' ' || own END], lambda x: x IS NOT NULL) AS q FROM b)
    SELECT key, array_to_string(list_filter(q, lambda x, i: list_position(list_transform(q, lambda y: lower(y)), lower(x)) = i), '|') AS queries FROM q""")
def q_search_queries(spark, sf):
    """What to search each product by, most special first."""
    made = findings.search_queries(F.expr(_MADE), F.expr(_NUMBERED), c("web_name"), c("specification"), c("key").cast("string"))
    return products(spark, sf).select("key", F.array_join(made, "|").alias("queries"))
