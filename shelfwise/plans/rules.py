"""Queries on the smaller rules: labels, addresses, image candidates, enrichment, family overrides and reports."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as t
from ..operators import cleaning, enrichment, families, fields, images, state
from ..sources.views import products, table
from . import sql
from .catalog import V, _records, _texts, query

c = F.col


def _cases(x: str, values: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


# labels

_RAW = "CASE key % 3 WHEN 0 THEN concat(article_number, '.0') WHEN 1 THEN 'NaN' ELSE concat(' 00', article_number) END"
_NUMBER = "CASE key % 3 WHEN 0 THEN concat('N', article_number) WHEN 1 THEN concat('nab-1.', article_number) ELSE concat(' n ', article_number) END"
_BULLETS = "concat('*  ', p_name, chr(10), ' -  B  c', chr(10), 'd')"
_MAKER = "CASE key % 4 WHEN 0 THEN 'Acme® AS' WHEN 1 THEN 'Two Words' WHEN 2 THEN 'ab' ELSE 'Medline inc as' END"


@query(f"""{V}, x AS (SELECT *, regexp_replace(trim({_RAW}), '\\.0+$', '') AS p, {_MAKER} AS maker FROM v)
    SELECT key, CASE WHEN lower(p) = 'nan' THEN '' ELSE p END AS strict, regexp_replace(regexp_replace(upper(trim({_NUMBER})), '^N([0-9]+)$', '\\1'), '[\\s\\-.]', '', 'g') AS number,
    {sql._BRAND} AS group_brand, lower(trim(regexp_replace(regexp_replace({_BULLETS}, '(?m)^\\s*[•\\-*►▸‣⁃]\\s*', '- ', 'g'), '\\s+', ' ', 'g'))) AS comparable, concat_ws(' | ', nullif(description, ''), 'checked') AS rationale,
    concat_ws('|', nullif(mfr_number, ''), nullif(web_name, '')) AS searches, CASE WHEN image_avg >= 70 THEN 'Høy tillit' WHEN image_avg >= 45 THEN 'Middels tillit' WHEN image_avg >= 25 THEN 'Lav tillit' ELSE 'Krever manuell vurdering' END AS confidence,
    CASE WHEN verification = 'CDN_ONLY' THEN 'Ingen produktside funnet på nettstedet (kun bilde bekreftet via CDN)' WHEN NOT found THEN 'Produktet ble ikke funnet på nettstedet' WHEN verification = 'MISMATCH' THEN 'Produktsiden tilhører et annet produkt (SKU-avvik)'
        ELSE 'Nettstedet mangler denne verdien' END AS no_page, coalesce(nullif(description, ''), '(mangler)') AS shown, {_cases('verification', fixed.VERIFICATION_LABELS)} AS label,
    regexp_replace(article_number || '/x y.z', '[^0-9A-Za-z_-]', '_', 'g') AS file_name,
    CASE maker WHEN 'Acme® AS' THEN 'www.acme.com' WHEN 'Medline inc as' THEN 'www.medline.com' END AS domain FROM x""")
def q_text_labels(spark, sf):
    """Small text rules on the catalogue: strict identifiers, numbers to compare, brands, labels, guessed addresses."""
    v = products(spark, sf)
    return v.select(
        "key", F.coalesce(t.normalize_identifier(F.expr(_RAW)), F.lit("")).alias("strict"), t.normalized_number(F.expr(_NUMBER)).alias("number"), t.effective_brand(c("brand"), c("supplier")).alias("group_brand"),
        t.comparable(F.expr(_BULLETS)).alias("comparable"), t.with_rationale(c("description"), F.lit("checked")).alias("rationale"), F.concat_ws("|", t.filled(c("mfr_number")), t.filled(c("web_name"))).alias("searches"),
        t.confidence_label(c("image_avg") / 100).alias("confidence"), t.no_page_reason(c("verification"), c("found")).alias("no_page"), F.coalesce(t.filled(c("description")), F.lit("(mangler)")).alias("shown"),
        images.verification_label(c("verification")).alias("label"), F.regexp_replace(F.concat(c("article_number"), F.lit("/x y.z")), r"(?U)[^\w\-]", "_").alias("file_name"), t.guessed_domain(F.expr(_MAKER)).alias("domain"),
    )


_NAMED = "concat(p_name, CASE key % 8 WHEN 0 THEN ' hanske' WHEN 1 THEN ' kanyle' WHEN 2 THEN ' bandasje' WHEN 3 THEN ' plaster' WHEN 4 THEN ' plastered' WHEN 5 THEN ' sterilisert kateter' ELSE '' END)"
_SITE = "concat('https://www.', CASE key % 6 WHEN 0 THEN 'Molnlycke' WHEN 1 THEN 'b-braun' WHEN 2 THEN 'scandia' WHEN 3 THEN '3m' ELSE 'other' END, '.com/p')"


@query(f"""{V} SELECT key, CASE {' '.join(f"WHEN regexp_matches(lower({_NAMED}), '{k}') THEN '{x}'" for k, x in fixed.CATEGORY_PATTERNS.items())} END AS category,
    CASE {' '.join(f"WHEN contains(lower({_SITE}), '{k}') THEN '{x}'" for k, x in fixed.MANUFACTURER_DOMAINS.items())} END AS manufacturer FROM v""")
def q_inferred(spark, sf):
    """What a name tells of the category, and an address of the manufacturer."""
    return products(spark, sf).select("key", t.first_match(F.lower(F.expr(_NAMED)), fixed.CATEGORY_PATTERNS, True).alias("category"), t.first_match(F.lower(F.expr(_SITE)), fixed.MANUFACTURER_DOMAINS, False).alias("manufacturer"))


_ADDRESS = "concat('https://x.no/', CASE key % 7 WHEN 0 THEN 'a.JPG?w=2' WHEN 1 THEN 'a.tiff' WHEN 2 THEN 'img/logo.png' WHEN 3 THEN 'ImageHandler?id=3' WHEN 4 THEN 'page.html?x=.png' WHEN 5 THEN 'b.png' ELSE 'asset/spinner' END)"
_ALT = "CASE key % 5 WHEN 0 THEN 'Banner' WHEN 1 THEN NULL ELSE 'a glove' END"


def _any(x: str, parts: list[str], how: str = "contains") -> str:
    return "(" + " OR ".join(f"{how}({x}, '{p}')" for p in parts) + ")"


@query(f"""{V}, u AS (SELECT key, lower({_ADDRESS}) AS u, coalesce(lower({_ALT}), '') AS alt FROM v), w AS (SELECT *, {_any("regexp_replace(u, '[?#].*$', '')", fixed.IMAGE_ENDINGS, 'ends_with')} OR {_any('u', fixed.IMAGE_MARKS)} AS image FROM u)
    SELECT key, image, image AND NOT {_any('u', fixed.IMAGE_SKIPS)} AND NOT {_any('alt', fixed.IMAGE_SKIPS)} AS product_image,
    ({_any('u', fixed.LIKELY_ENDINGS)} OR {_any('u', ['image', 'img', 'photo'])}) AND NOT {_any('u', fixed.LIKELY_SKIPS)} AS likely FROM w""")
def q_image_addresses(spark, sf):
    u, low = F.expr(_ADDRESS), F.lower(F.expr(_ADDRESS))
    likely = (t.holds_any(low, fixed.LIKELY_ENDINGS) | t.holds_any(low, ["image", "img", "photo"])) & ~t.holds_any(low, fixed.LIKELY_SKIPS)
    return products(spark, sf).select("key", t.is_image_url(u).alias("image"), t.is_product_image(u, F.expr(_ALT)).alias("product_image"), likely.alias("likely"))


@query(f"{V} SELECT key, i AS place, 'https://cdn/' || article_number || CASE WHEN i = 0 THEN '' ELSE '-' || (i + 1) END || '.jpg' AS url FROM v, (SELECT unnest(range(11))::INTEGER AS i)")
def q_image_urls(spark, sf):
    """The addresses at which a product's images may lie."""
    return images.addresses(products(spark, sf), "article_number", "https://cdn/").select("key", "place", "url")


# image candidates and sessions

_CANDIDATE = {
    "own": "concat('N', article_number)", "theirs": "concat('MF', article_number)",
    "url": "concat('https://x.no/', CASE key % 5 WHEN 0 THEN concat('img/mf', article_number, '.jpg') WHEN 1 THEN concat('q', article_number, '/a.png') WHEN 2 THEN concat('a.png?n=MF-', article_number) ELSE 'b.png' END)",
    "domain": "CASE WHEN key % 3 = 0 THEN 'acme.com' ELSE 'x.no' END", "page": "CASE WHEN key % 2 = 0 THEN concat('Ref. MF ', article_number, ' ', p_name, ' of acme, 10x20mm 35 my') ELSE p_name END",
    "description": "concat(p_name, ' soft with a long life')", "spec": "'10x20 mm, 35 my, 5ml'",
    "source": "CASE key % 4 WHEN 0 THEN 'manufacturer_mediabank' WHEN 1 THEN 'manufacturer_website' WHEN 2 THEN 'official_distributor' ELSE 'web_search' END",
    "state": "CASE key % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'low_quality' WHEN 2 THEN 'poor_background' WHEN 3 THEN 'review' ELSE 'ok' END",
}


@query(f"""{V}, k AS (SELECT key, {', '.join(f'{x} AS {k}' for k, x in _CANDIDATE.items())}, regexp_replace(lower(p_name), '\\s+', ' ', 'g') AS nm FROM v),
    s AS (SELECT *, key % 5 IN (0, 2) AS in_url, key % 5 = 0 AS in_file, contains(regexp_replace(upper(url), '[\\s\\-.]', '', 'g'), article) AS ours, key % 2 = 0 AS in_page, key % 3 = 0 OR key % 2 = 0 AS maker,
        list_distinct(list_filter(regexp_extract_all(lower(description), '\\w+'), lambda w: length(w) >= 3 AND w NOT IN ({sql.strings(fixed.OVERLAP_STOPS)}))) AS words FROM (SELECT *, substr(own, 2) AS article FROM k)),
    o AS (SELECT *, len(list_filter(words, lambda w: contains(lower(page), w)))::DOUBLE / len(words) AS shared FROM s),
    i AS (SELECT key, state, source, least(1.0::DOUBLE, (CASE WHEN in_url THEN 0.35 ELSE 0 END)::DOUBLE + (CASE WHEN in_file THEN 0.30 ELSE 0 END)::DOUBLE + (CASE WHEN ours THEN 0.20 ELSE 0 END)::DOUBLE + (CASE WHEN in_page THEN 0.25 ELSE 0 END)::DOUBLE + (CASE WHEN maker THEN 0.15 ELSE 0 END)::DOUBLE
        + CASE WHEN shared >= 0.4 THEN least(shared * 0.25::DOUBLE, 0.20::DOUBLE) ELSE 0 END + (CASE WHEN in_page THEN least(2::DOUBLE / 3 * 0.15::DOUBLE, 0.15::DOUBLE) ELSE 0 END)
        + (CASE WHEN (in_url OR in_file) AND in_page THEN 0.10 ELSE 0 END)::DOUBLE + (CASE WHEN (in_url OR in_file) AND maker THEN 0.10 ELSE 0 END)::DOUBLE) AS identity,
        CASE source WHEN 'manufacturer_mediabank' THEN 1.0 WHEN 'manufacturer_website' THEN 0.85 WHEN 'official_distributor' THEN 0.7 ELSE 0.5 END::DOUBLE AS trust FROM o)
    SELECT key, round(identity, 6) AS identity, round(least(1.0::DOUBLE, CASE WHEN identity >= 0.5 AND trust >= 0.7 THEN identity * (trust + 0.15::DOUBLE) ELSE identity * trust END), 6) AS confidence,
        least(100, CASE state WHEN 'missing' THEN 95 WHEN 'low_quality' THEN 70 WHEN 'poor_background' THEN 50 WHEN 'review' THEN 30 ELSE 20 END + CASE source WHEN 'manufacturer_mediabank' THEN 10 WHEN 'manufacturer_website' THEN 5 ELSE 0 END) AS improvement FROM i""")
def q_candidate_identity(spark, sf):
    """How surely an image shows the product, how far it is trusted, and how much it would improve."""
    k = products(spark, sf).select("key", *[F.expr(x).alias(n) for n, x in _CANDIDATE.items()])
    scored = k.withColumn("identity", images.identity(c("url"), c("theirs"), c("own"), F.lit("Acme AS"), c("domain"), c("description"), c("spec"), c("page")))
    return scored.select("key", F.round("identity", 6).alias("identity"), F.round(images.confidence(c("identity"), c("source")), 6).alias("confidence"), images.improvement(c("state"), c("source")).alias("improvement"))


_REVIEW = "CASE WHEN image_count = 0 THEN 'missing' WHEN image_avg < 70 THEN 'low_quality' WHEN image_quality IN ('FAIL', 'REVIEW') THEN 'review' ELSE 'ok' END"


@query(f"{V}, s AS (SELECT key, image_avg, {_REVIEW} AS status FROM v) SELECT key, status, row_number() OVER (ORDER BY status = 'ok', image_avg, key) AS place FROM s ORDER BY place LIMIT 40")
def q_image_review_order(spark, sf):
    """The first 40 products to review: those in need of it, then by ascending score."""
    top = products(spark, sf).select("key", "image_avg", images.review_status(c("image_count"), c("image_avg"), c("image_quality")).alias("status")).orderBy(c("status") == "ok", "image_avg", "key").limit(40)
    return top.withColumn("place", F.row_number().over(W.orderBy(c("status") == "ok", "image_avg", "key")).cast("long")).select("key", "status", "place")


@query(f"""{V}, s AS (SELECT image_avg, image_count, {_REVIEW} AS status FROM v) SELECT count(*) AS total, count_if(image_count = 0) AS missing, count_if(image_count > 0 AND image_avg < 40) AS low, count_if(status <> 'ok') AS needs_review,
    count_if(image_count > 0 AND image_avg >= 70) AS good, round_even(avg(image_avg), 1) AS avg_score FROM s""")
def q_image_session_summary(spark, sf):
    return images.session_summary(products(spark, sf))


# enrichment


@query(f"""{V}, m AS (SELECT key, 50 AS conf, erp_name, erp_text, details FROM v WHERE found)
    SELECT key, 'product_name' AS field, erp_name AS value, conf * 90 / 100.0::DOUBLE AS conf FROM m WHERE erp_name IS NOT NULL UNION ALL SELECT key, 'description', erp_text, conf * 80 / 100.0::DOUBLE FROM m WHERE erp_text IS NOT NULL
    UNION ALL SELECT key, 'spec:' || e[1], e[2], conf * 70 / 100.0::DOUBLE FROM (SELECT key, conf, unnest(details) AS e FROM m)""")
def q_manufacturer_rows(spark, sf):
    """A manufacturer's finding as one row for each field; each keeps a share of its confidence (hundredths)."""
    return enrichment.manufacturer_rows(products(spark, sf).filter("found"), "key", c("erp_name"), c("erp_text"), c("details"), F.lit(50))


_NEW = "list_filter(coalesce(details, []), lambda e: NOT contains(coalesce(specification, ''), e[1]))"


@query(f"""{V} SELECT key, len({_NEW}) AS n_new, array_to_string(list_transform(list_sort(list_transform({_NEW}, lambda e: e[1] || ': ' || e[2])), lambda x: x), '; ') AS added FROM v WHERE len({_NEW}) > 0""")
def q_new_specifications(spark, sf):
    """Details that a specification doesn't name yet, as one text."""
    v = products(spark, sf)
    new = F.filter(F.map_entries("details"), lambda e: ~F.contains(F.coalesce("specification", F.lit("")), e.key))
    found = v.select("key", F.array_sort(F.transform(new, lambda e: F.concat(e.key, F.lit(": "), e.value))).alias("new")).filter(F.size("new") > 0)
    return found.select("key", F.size("new").cast("long").alias("n_new"), F.array_join("new", "; ").alias("added"))


_ROWS = "SELECT l_partkey AS key, CASE l_linenumber % 3 WHEN 0 THEN 'description' WHEN 1 THEN 'name' ELSE 'category' END AS field, concat('v', CAST(l_orderkey AS STRING)) AS value, CAST(50 + l_quantity AS INTEGER) AS conf, CASE WHEN l_returnflag = 'R' THEN 'conflict' ELSE 'open' END AS review, l_orderkey * 10 + l_linenumber AS seq FROM lineitem"
_WEAK = "('MISSING', 'WEAK', 'SHOULD_IMPROVE', 'PROBABLE_ERROR', 'MANUAL_REVIEW')"


@query(f"""{V}, s AS ({sql.STATUSES}), f AS (SELECT key, 'description' AS field, description_status AS status FROM s UNION ALL SELECT key, 'name', name_status FROM s UNION ALL SELECT key, 'category', category_status FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY key, field ORDER BY conf DESC, seq) AS r FROM ({_ROWS}) WHERE conf >= 60 AND review <> 'conflict')
    SELECT f.key, f.field, status, r.value AS suggested, r.conf FROM f JOIN r ON f.key = r.key AND f.field = r.field WHERE r = 1 AND status IN {_WEAK}""")
def q_apply_enrichment(spark, sf):
    """The surest finding for each weak field: confident enough, and not in conflict."""
    found = table(spark, sf, "lineitem").select(
        c("l_partkey").alias("key"), F.when(c("l_linenumber") % 3 == 0, "description").when(c("l_linenumber") % 3 == 1, "name").otherwise("category").alias("field"), F.concat(F.lit("v"), c("l_orderkey")).alias("value"),
        (50 + c("l_quantity")).cast("int").alias("conf"), F.when(c("l_returnflag") == "R", "conflict").otherwise("open").alias("review"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("seq"),
    )
    s = fields.with_statuses(products(spark, sf))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), c(f"{k}_status").alias("status")) for k in ("description", "name", "category")])).alias("x")
    return enrichment.applied(s.select("key", each).select("key", "x.field", "x.status"), found)


@query(f"SELECT key, count(*) AS n, count_if(review = 'conflict') AS n_conflicts, min(conf) AS least_conf, bool_or(review = 'conflict') AS any_review, string_agg(DISTINCT field, ',' ORDER BY field) AS fields FROM ({_ROWS}) GROUP BY key")
def q_enrichment_counts(spark, sf):
    """Per product how much was found, in conflict, how surely, and for which fields."""
    field = F.when(c("l_linenumber") % 3 == 0, "description").when(c("l_linenumber") % 3 == 1, "name").otherwise("category")
    conflict = c("l_returnflag") == "R"
    return table(spark, sf, "lineitem").groupBy(c("l_partkey").alias("key")).agg(
        F.count("*").alias("n"), F.count_if(conflict).alias("n_conflicts"), F.min((50 + c("l_quantity")).cast("int")).alias("least_conf"), F.bool_or(conflict).alias("any_review"), F.array_join(F.array_sort(F.collect_set(field)), ",").alias("fields"),
    )


_TECH = r"\b(?:mm|cm|ml|g|kg|stk|steril|nitril|vinyl|latex|engangs|flergangs|pudderfri|materiale|størrelse|diameter|lengde|bredde|volum)\b"


@query(f"""WITH d AS (SELECT doc_id, {sql.stripped("coalesce(text, '')")} AS t, string_split({sql.stripped("coalesce(text, '')")}, chr(10)) AS ls FROM documents),
    n AS (SELECT *, len(regexp_extract_all(lower(t), '{_TECH}')) AS tech, {sql.GATE} AS reason FROM d)
    SELECT doc_id, CASE WHEN t = '' THEN 0 WHEN length(t) < 15 THEN 5 ELSE CASE WHEN length(t) < 50 THEN 10 WHEN length(t) <= 500 THEN 25 WHEN length(t) <= 1000 THEN 20 ELSE 10 END + CASE WHEN {sql.n_sentences('t')} >= 2 THEN 25 WHEN {sql.n_sentences('t')} = 1 THEN 15 ELSE 0 END
        + CASE WHEN tech >= 3 THEN 25 WHEN tech >= 1 THEN 15 ELSE 0 END + CASE WHEN reason IS NULL THEN 25 ELSE 0 END END AS quality FROM n""")
def q_description_quality(spark, sf):
    """How well a text serves as a description, in hundredths."""
    judged = cleaning.gated(_texts(spark, sf), "doc_id", "text")
    measured = cleaning.once(judged, {"sentences": t.sentences(c("text")), "technical": enrichment.technical_words(c("text"))})
    return measured.select("doc_id", enrichment.points(c("text"), c("sentences"), c("technical"), c("reason")).alias("quality"))


# reports


@query(f"""{V}, s AS ({sql.STATUSES}), o AS (SELECT *, {sql.OVERALL} AS overall_status FROM s), k AS (SELECT *, manufacturer_status = 'MISSING' OR mfr_number_status = 'MISSING' OR specification_status = 'MISSING' AS requires_manufacturer FROM o)
    SELECT key, overall_status, requires_manufacturer, overall_status IN ('PROBABLE_ERROR', 'MISSING') OR verification IN ('UNVERIFIED', 'MISMATCH', 'AMBIGUOUS', 'CDN_ONLY') AS manual_review, overall_status = 'SHOULD_IMPROVE' AND NOT requires_manufacturer AS auto_fix,
    coalesce(length(description) >= 50, FALSE) AND (specification IS NOT NULL OR details IS NOT NULL) AND pdf AS sufficient FROM k""")
def q_review_flags(spark, sf):
    """Who has to act on a product, and whether the first sources suffice."""
    s = fields.with_statuses(products(spark, sf)).withColumn("overall_status", fields.overall_status())
    enough = F.coalesce(F.length("description") >= 50, F.lit(False)) & (t.filled(c("specification")).isNotNull() | c("details").isNotNull()) & c("pdf")
    return s.select("key", "overall_status", *[v.alias(k) for k, v in fields.review_flags().items()], enough.alias("sufficient"))


@query(f"{V}, s AS ({sql.STATUSES}) SELECT overall_status, count(*) AS n FROM (SELECT {sql.OVERALL} AS overall_status FROM s) GROUP BY 1")
def q_overall_distribution(spark, sf):
    return fields.with_statuses(products(spark, sf)).select(fields.overall_status().alias("overall_status")).groupBy("overall_status").agg(F.count("*").alias("n"))


@query(f"""{V}, s AS ({sql.STATUSES}), x AS (SELECT key, CASE WHEN key % 3 = 0 THEN image_avg ELSE {sql.TOTAL} END AS score FROM s) SELECT key, score FROM x WHERE score < 55""")
def q_below_threshold(spark, sf):
    """Products whose effective score (a model's where there is one, else the total) lies below a threshold."""
    score = F.coalesce(F.when(c("key") % 3 == 0, c("image_avg")), fields.total_score())
    return fields.with_statuses(products(spark, sf)).select("key", score.alias("score")).filter("score < 55")


@query(f"""{V}, s AS ({sql.STATUSES}), x AS (SELECT CASE WHEN key % 3 = 0 THEN image_avg ELSE {sql.TOTAL} END AS score FROM s) SELECT count(*) AS n, count_if(score < 40) AS n_critical, round(avg(score), 6) AS avg_score FROM x""")
def q_history_stats(spark, sf):
    score = F.coalesce(F.when(c("key") % 3 == 0, c("image_avg")), fields.total_score())
    return fields.with_statuses(products(spark, sf)).select(score.alias("score")).agg(F.count("*").alias("n"), F.count_if(c("score") < 40).alias("n_critical"), F.round(F.avg("score"), 6).alias("avg_score"))


@query(f"""{V}, s AS ({sql.STATUSES}) {' UNION ALL '.join(f"SELECT key, '{k}' AS field, {k}_status AS status FROM s" for k in fixed.FIELD_WEIGHTS)}""")
def q_field_rows(spark, sf):
    """One row for each field of a product."""
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("field"), c(f"{k}_status").alias("status")) for k in fixed.FIELD_WEIGHTS]))
    return fields.with_statuses(products(spark, sf)).select("key", each)


@query(f"{V}, s AS ({sql.STATUSES}) SELECT field, n_found >= 3 AND n_missing > 0.5 * n_found AS broken, n_missing FROM (SELECT count_if(found) AS n_found, count_if(found AND description_status = 'MISSING') AS d, count_if(found AND specification_status = 'MISSING') AS s, count_if(found AND category_status = 'MISSING') AS g FROM s) UNPIVOT (n_missing FOR field IN (d, s, g))")
def q_selector_health(spark, sf):
    """Whether a field is missing on over half of the pages that were found, which points at the page and not the products."""
    n = lambda k: F.count_if(c("found") & (c(f"{k}_status") == "MISSING"))
    sums = fields.with_statuses(products(spark, sf)).agg(F.count_if("found").alias("n_found"), n("description").alias("d"), n("specification").alias("s"), n("category").alias("g"))
    return sums.unpivot("n_found", ["d", "s", "g"], "field", "n_missing").select("field", ((c("n_found") >= 3) & (c("n_missing") > 0.5 * c("n_found"))).alias("broken"), "n_missing")


@query(f"{V} SELECT supplier, count(*) AS n, min(key) AS first_key FROM v WHERE supplier IS NOT NULL AND trim(supplier) <> '' GROUP BY 1")
def q_suppliers(spark, sf):
    """The suppliers of the ERP with how many products each has."""
    return products(spark, sf).filter("trim(supplier) <> ''").groupBy("supplier").agg(F.count("*").alias("n"), F.min("key").alias("first_key"))


@query("SELECT count(*) AS n_urls, count(DISTINCT page_id) FILTER (WHERE page_id % 3 <> 0) AS n_indexed, round_even(100.0::DOUBLE * count(DISTINCT page_id) FILTER (WHERE page_id % 3 <> 0) / count(*), 1) AS coverage FROM pages")
def q_index_coverage(spark, sf):
    """How much of the known addresses is indexed, in percent."""
    indexed = F.count_distinct(F.when(c("page_id") % 3 != 0, c("page_id")))
    return table(spark, sf, "pages").agg(F.count("*").alias("n_urls"), indexed.alias("n_indexed"), F.bround(100.0 * indexed / F.count("*"), 1).alias("coverage"))


@query("SELECT count(*) AS n_rows, count(x) AS n_valid, count(DISTINCT x) AS n_unique, count(x) - count(DISTINCT x) AS n_duplicates FROM (SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE l_partkey::VARCHAR END AS x FROM lineitem)")
def q_column_check(spark, sf):
    """Rows, valid values, distinct ones and duplicates of a column of identifiers."""
    raw = F.when(c("l_linenumber") == 7, "n/a").otherwise(F.concat(c("l_partkey").cast("string"), F.lit(".0")))
    x = table(spark, sf, "lineitem").select(t.normalize_identifier(raw).alias("x"))
    n, u = F.count("x"), F.count_distinct("x")
    return x.agg(F.count("*").alias("n_rows"), n.alias("n_valid"), u.alias("n_unique"), (n - u).alias("n_duplicates"))


# family overrides

_MEMBERS = f"{V}, {sql.RECORDS}, {sql.GROUPS}, m AS (SELECT r.key, f.family_id FROM rec r LEFT JOIN (SELECT * FROM fam WHERE score >= 30) f ON r.group_key = f.group_key)"


def _members(spark, sf):
    recs = _records(spark, sf)
    return families.members(recs, families.groups(recs)).select("key", "family_id")


@query(f"""{_MEMBERS}, e AS (SELECT family_id, min(family_id) OVER () AS target FROM (SELECT DISTINCT family_id FROM m WHERE ends_with(family_id, '3')))
    SELECT m.key, coalesce(e.target, m.family_id) AS family_id, e.target IS NOT NULL AS moved FROM m LEFT JOIN (SELECT * FROM e WHERE family_id <> target) e ON m.family_id = e.family_id""")
def q_family_merge(spark, sf):
    """Families whose id ends in 3 become the first of them."""
    mem = _members(spark, sf)
    own = mem.filter(F.endswith("family_id", F.lit("3"))).select(c("family_id").alias("source")).distinct()
    target = own.agg(F.min("source").alias("target"))
    return families.merged(mem, own.join(F.broadcast(target), c("source") != c("target")))


@query(f"""{_MEMBERS}, o AS (SELECT *, key % 4 = 0 AS out FROM m), s AS (SELECT family_id, count_if(out) AS k, count(*) AS n, min(CASE WHEN out THEN key END) AS f FROM o WHERE family_id IS NOT NULL GROUP BY 1)
    SELECT o.key, CASE WHEN out AND k < n THEN 'FAM-' || substr(sha256('manual-split-' || o.family_id || '-' || f), 1, 16) ELSE o.family_id END AS family_id, coalesce(out AND k < n, FALSE) AS moved FROM o LEFT JOIN s ON o.family_id = s.family_id""")
def q_family_split(spark, sf):
    """Every fourth key leaves its family for a new one."""
    mem = _members(spark, sf)
    return families.split_off(mem, mem.filter("key % 4 = 0"))


@query(f"""{_MEMBERS}, l AS (SELECT user_id AS key, event_id AS seq, 'FAM-' || event_type AS target FROM events), u AS (SELECT * FROM l WHERE seq < (SELECT max(seq) FROM l)),
    o AS (SELECT key, target FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM u) WHERE r = 1) SELECT m.key, coalesce(target, family_id) AS family_id, target IS NOT NULL AS moved FROM m LEFT JOIN o ON m.key = o.key""")
def q_family_undo(spark, sf):
    """Moves replayed after the last of them is undone."""
    log = table(spark, sf, "events").select(c("user_id").cast("long").alias("key"), c("event_id").alias("seq"), F.concat(F.lit("FAM-"), c("event_type")).alias("target"), F.lit(False).alias("undone"))
    return families.replay(_members(spark, sf), families.without_last(log))


@query("SELECT event_id, event_type FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 10")
def q_last_errors(spark, sf):
    return state.newest(table(spark, sf, "events").filter("event_type = 'error'").select("event_id", "event_type"), F.desc("event_id"), keep=10)
