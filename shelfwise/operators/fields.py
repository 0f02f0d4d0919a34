"""Field statuses, area scores with their issues, and a product's total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, scores
from ..functions import text as t

c = F.col


def name_status() -> Column:
    web, erp = t.filled(c("web_name")), t.filled(c("erp_name"))
    wrong = web.rlike(r"^[\d\s\-/]+$")
    english = t.keyword_hits(web, fixed.ENGLISH_NAMES) >= 2
    poor = (F.length(web) < 5) | t.plain(web).isin(fixed.GENERIC_NAMES) | english | ((F.length(web) > 3) & (F.upper(web) == web))
    return (
        F.when(web.isNull() & erp.isNull(), "MISSING").when(web.isNull(), "OK").when(wrong, "PROBABLE_ERROR").when(poor, "SHOULD_IMPROVE")
        .when((F.length(web) >= 10) & ~t.is_upper(web), "STRONG").otherwise("OK")
    )


def description_status() -> Column:
    d, erp = t.filled(c("description")), t.filled(c("erp_text"))
    short, same = F.length(d) < 20, F.coalesce(t.plain(d) == t.plain(t.filled(c("web_name"))), F.lit(False))
    article = (F.length("article_number") > 0) & F.contains(d, c("article_number")) & (F.length(d) < 50)
    return (
        F.when(d.isNull() & erp.isNull(), "MISSING").when(d.isNull(), "OK").when(same | article, "SHOULD_IMPROVE")
        .when(short & (F.length(d) >= 10), "WEAK").when(short, "SHOULD_IMPROVE").when((F.length(d) >= 80) & d.rlike(r"[.!?]\s"), "STRONG").otherwise("OK")
    )


def attribute_count(details: Column, s: Column) -> Column:
    """Entries of the details; without any, parts of a divided specification, and none of an undivided one."""
    n = F.length(s) - F.length(F.replace(s, F.lit(";"))) + F.length(s) - F.length(F.replace(s, F.lit("\n")))
    return F.when(F.size(details) > 0, F.size(details)).when(n > 0, n + 1).otherwise(0)


def specification_status() -> Column:
    s, details, erp, d, name = t.filled(c("specification")), c("details"), t.filled(c("erp_specification")), t.filled(c("description")), t.filled(c("web_name"))
    has = F.coalesce(F.size(details), F.lit(0)) > 0
    n, technical = attribute_count(details, s), c("_technical")
    same = F.coalesce(t.plain(s) == t.plain(name), F.lit(False)) | F.coalesce(t.plain(s) == t.plain(d), F.lit(False))
    keys = F.transform(F.map_keys(details), F.lower)
    few = (n < 2) & ~technical
    unusual = has & ~F.coalesce(F.arrays_overlap(keys, F.array(*map(F.lit, fixed.EXPECTED_DETAILS))), F.lit(False)) & (n < 3)
    absent = F.when(erp.isNotNull(), "OK").when(c("_technical_text"), "WEAK").otherwise("MISSING")
    return (
        F.when(s.isNull() & ~has, absent).when(same, "SHOULD_IMPROVE").when((few | unusual) & (n >= 1), "WEAK").when(few | unusual, "SHOULD_IMPROVE")
        .when((n >= 4) | ((n >= 2) & technical), "STRONG").otherwise("OK")
    )


def manufacturer_status() -> Column:
    m, supplier = t.filled(c("manufacturer")), t.filled(c("supplier"))
    return (
        F.when(m.isNull() & supplier.isNull(), "MISSING").when(m.isNull(), "OK").when(t.plain(m).isin(fixed.NO_MANUFACTURER), "PROBABLE_ERROR")
        .when(F.length(m) < 2, "SHOULD_IMPROVE").otherwise("OK")
    )


def mfr_number_status() -> Column:
    return F.when(t.first_filled(c("mfr_number"), c("erp_number")).isNull(), "MISSING").otherwise("OK")


def url_category(url: Column) -> Column:
    """The last part of an address that isn't a fixed or an internal one, as a title."""
    parts = F.filter(F.split(url, "/"), lambda p: (p != "") & ~p.isin(fixed.URL_PARTS) & ~p.startswith("i00"))
    return F.initcap(F.replace(F.try_element_at(parts, F.lit(-1)), F.lit("-"), F.lit(" ")))


def category_status() -> Column:
    g, depth = t.filled(c("category")), F.coalesce(F.size("crumbs"), F.lit(0))
    by_url = F.when(url_category(c("product_url")).isNotNull(), "SHOULD_IMPROVE").otherwise("MISSING")
    poor = (depth == 1) | F.coalesce((F.length(F.trim(g)) < 3) | t.plain(g).isin(fixed.NO_CATEGORY), F.lit(False))
    return F.when(g.isNull() & (depth == 0), by_url).when(poor, "SHOULD_IMPROVE").otherwise("OK")


def packaging_keys(details: Column, words: list[str]) -> Column:
    """The keys of details that name packaging."""
    key = lambda k: F.regexp_replace(F.trim(F.regexp_replace(F.lower(F.replace(F.replace(k, F.lit(" "), F.lit(" ")), F.lit("​"))), r"\s+", " ")), ":+$", "")
    return F.filter(F.map_keys(details), lambda k: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(key(k), w)))


def packaging_status() -> Column:
    own = t.first_filled(c("packaging"), c("packaging_unit")).isNotNull()
    return F.when(own | (F.coalesce(F.size(packaging_keys(c("details"), fixed.PACKAGING_KEYS)), F.lit(0)) > 0), "OK").otherwise("MISSING")


def image_status() -> Column:
    q, url = c("image_quality"), t.filled(c("image_url"))
    plain = F.when(url.isNull(), "MISSING").when(c("image_ok") == F.lit(False), "SHOULD_IMPROVE").otherwise("OK")
    return (
        F.when(q.isNull(), plain).when((q == "MISSING") | (c("image_count") == 0), "MISSING").when(q == "FAIL", "PROBABLE_ERROR")
        .when(q.isin("REVIEW", "PASS_WITH_NOTES"), "SHOULD_IMPROVE").otherwise("OK")
    )


def brand_status() -> Column:
    return F.when(t.filled(c("brand")).isNull(), "SHOULD_IMPROVE").otherwise("OK")


def _apart(a: Column, b: Column, common: list[str], more_a: int, more_b: int) -> Column:
    """Whether two texts share no word but common ones, and have more than so many distinct words each."""
    x, y = (F.array_distinct(F.filter(t.words(v), lambda w: ~w.isin(common))) for v in (a, b))
    return F.coalesce((F.size(x) > more_a) & (F.size(y) > more_b) & ~F.arrays_overlap(x, y), F.lit(False))


def consistency_status() -> Column:
    """Name against description and name against category."""
    name = c("web_name")
    odd = _apart(name, c("description"), fixed.COMMON_WORDS, 2, 0) | _apart(c("category"), name, fixed.COMMON_WORDS_OF_CATEGORIES, 1, 1)
    return F.when(odd, "SHOULD_IMPROVE").otherwise("OK")


def statuses() -> dict[str, Column]:
    return {
        "name": name_status(), "description": description_status(), "specification": specification_status(), "manufacturer": manufacturer_status(),
        "mfr_number": mfr_number_status(), "category": category_status(), "packaging": packaging_status(), "image": image_status(),
        "brand": brand_status(), "consistency": consistency_status(),
    }


def with_statuses(products: DataFrame) -> DataFrame:
    technical = {k: F.coalesce(t.has_measurable_content(t.filled(c(x))), F.lit(False)) for k, x in (("_technical", "specification"), ("_technical_text", "description"))}
    return products.withColumns(technical).withColumns({f"{k}_status": v for k, v in statuses().items()}).drop(*technical)


def total_score() -> Column:
    """0 to 100 with one decimal, from whole numbers: weights in halves, points in hundredths; half-even on the tenth."""
    worth = F.create_map(*[F.lit(x) for kv in fixed.STATUS_POINTS.items() for x in kv])
    points = {k: worth[c(f"{k}_status")] for k in fixed.FIELD_WEIGHTS}  # one reference each, as plans may repeat what a reference stands for
    return F.bround(sum((v * fixed.FIELD_WEIGHTS[k] for k, v in points.items()), F.lit(0)).cast("double") / sum(fixed.FIELD_WEIGHTS.values()), 1)


def overall_status() -> Column:
    """The ladder over all field statuses."""
    every = F.array(*[c(f"{k}_status") for k in fixed.FIELD_WEIGHTS])
    n = lambda s: F.size(F.filter(every, lambda x: x == s))
    return (
        F.when(n("PROBABLE_ERROR") > 0, "PROBABLE_ERROR").when(n("MISSING") >= 3, "MISSING").when(n("MISSING") > 0, "SHOULD_IMPROVE")
        .when(n("SHOULD_IMPROVE") > 0, "SHOULD_IMPROVE").when(n("WEAK") > 0, "WEAK").when(n("STRONG") >= len(fixed.FIELD_WEIGHTS) // 2, "STRONG").otherwise("OK")
    )


def needs_manufacturer() -> Column:
    """Whether only the manufacturer can supply what is missing."""
    return (c("manufacturer_status") == "MISSING") | (c("mfr_number_status") == "MISSING") | (c("specification_status") == "MISSING")


def review_flags() -> dict[str, Column]:
    """Whether a product needs its manufacturer, a manual review, or can be mended by itself; from its overall status."""
    status, contact = c("overall_status"), needs_manufacturer()
    weak = c("verification").isin("UNVERIFIED", "MISMATCH", "AMBIGUOUS", "CDN_ONLY")
    return {"requires_manufacturer": contact, "manual_review": status.isin("PROBABLE_ERROR", "MISSING") | weak, "auto_fix": (status == "SHOULD_IMPROVE") & ~contact}


def band(x: Column, steps: list[tuple[int, int]], rest: int) -> Column:
    """The points of the first bound that x stays below."""
    out = None
    for bound, points in steps:
        out = F.when(x < bound, points) if out is None else out.when(x < bound, points)
    return out.otherwise(rest)


#: Issues in the order in which an area finds them: text and severity where the condition holds.
Issues = list[tuple[Column, Column | str, str]]


def _measured(products: DataFrame) -> DataFrame:
    """products with what several rules ask of the texts, as columns, so that it is counted once."""
    s, d = t.filled(c("specification")), t.first_filled(c("description"), c("erp_text"))
    shown = F.transform(F.map_entries("details"), lambda e: F.concat(e.key, F.lit(": "), e.value))
    every = F.concat(F.coalesce(s, F.lit("")), F.lit(" "), F.coalesce(F.array_join(shown, " "), F.lit("")))
    out = products.withColumns({"_text": F.lower(d), "_every": F.lower(every)})
    return out.withColumns({"_sentences": t.sentences(c("_text")), "_hits": t.keyword_hits(c("_text")), "_keywords": t.keyword_hits(c("_every")), "_units": F.regexp_count("_every", F.lit(t.UNIT))})


def _areas() -> dict[str, tuple[Column, Issues]]:
    """By area: points before they are cut to 0 to 100, and issues."""
    name, d, s = t.first_filled(c("web_name"), c("erp_name")), t.first_filled(c("description"), c("erp_text")), t.filled(c("specification"))
    web, erp = t.filled(c("web_name")), t.filled(c("erp_name"))
    own_d, erp_d, own_m, erp_m = (t.filled(c(x)) for x in ("description", "erp_text", "manufacturer", "supplier"))
    m, g, b = F.coalesce(own_m, erp_m), t.filled(c("category")), t.filled(c("brand"))
    p = t.first_filled(c("packaging"), c("packaging_unit"))
    depth, n_details = F.coalesce(F.size("crumbs"), F.lit(0)), F.coalesce(F.size("details"), F.lit(0))
    no = F.lit(False)

    generic, digits = F.coalesce(t.is_placeholder(name), no), F.coalesce(name.rlike(r"^[\d\s\-/]+$"), no)
    capitals = F.coalesce((F.upper(name) == name) & (F.length(name) > 3), no)
    of_name = (
        band(F.length(name), [(5, 10), (15, 20)], 30) + F.when(generic | digits, 0).otherwise(25) + F.when(capitals, 5).otherwise(15)
        + F.when(web.isNotNull() & erp.isNotNull(), 30).when(web.isNotNull(), 25).otherwise(15)
    )
    name_issues = [
        (name.isNull(), "Produktnavn mangler", "Kritisk"), (F.length(name) < 5, F.concat(F.lit("For kort ("), F.length(name), F.lit(" tegn)")), "Høy"),
        (generic, "Generisk/placeholder-navn", "Høy"), (digits & ~generic, "Kun tall/tegn, mangler beskrivende tekst", "Høy"), (capitals, "STORE BOKSTAVER", "Lav"),
    ]

    size, n_sent, hits = F.length(d), c("_sentences"), c("_hits")
    same = F.coalesce(t.plain(d) == t.plain(web), no)
    article = F.coalesce((F.length("article_number") > 0) & F.contains(d, c("article_number")) & (size < 50), no) & ~same
    filler = F.coalesce(t.is_placeholder(d), no) & ~same & ~article
    of_description = (
        band(size, [(20, 5), (80, 15), (200, 25)], 30) + F.when(n_sent >= 3, 25).when(n_sent == 2, 20).when(n_sent == 1, 10).otherwise(5)
        + F.when(same, 0).when(article | filler, 5).when(hits >= 3, 25).when(hits >= 1, 20).otherwise(15)
        + F.when(own_d.isNotNull() & erp_d.isNotNull(), 20).when(own_d.isNotNull(), 15).otherwise(10)
    )
    description_issues = [
        (d.isNull(), "Ingen beskrivelse funnet", "Høy"), (size < 20, F.concat(F.lit("For kort ("), size, F.lit(" tegn, minimum 20)")), "Høy"),
        ((size >= 20) & (size < 80), F.concat(F.lit("Kort beskrivelse ("), size, F.lit(" tegn)")), "Middels"), (n_sent == 1, "Kun én setning", "Lav"),
        (n_sent == 0, "Ingen fullstendige setninger", "Middels"), (same, "Identisk med produktnavn", "Høy"), (article, "Inneholder hovedsakelig artikkelnummer", "Høy"),
        (filler, "Ser ut som placeholder-tekst", "Høy"), (own_d.isNull() & erp_d.isNotNull(), "Kun fra ERP, mangler på nettside", "Lav"),
    ]

    any_spec = s.isNotNull() | (n_details > 0) | t.filled(c("erp_specification")).isNotNull()
    attrs = F.when(n_details > 0, n_details).when(s.isNotNull(), F.regexp_count(F.coalesce(s, F.lit("")), F.lit("[;\n]")) + 1).otherwise(0)
    kw, units = c("_keywords"), c("_units")
    keys = F.size(F.array_intersect(F.transform(F.map_keys("details"), F.lower), F.array(*map(F.lit, fixed.KEY_DETAILS))))
    as_name = F.coalesce(t.plain(s) == t.plain(web), no)
    as_text = F.coalesce(t.plain(s) == t.plain(own_d), no) & ~as_name
    of_specification = (
        F.when(attrs >= 4, 35).when(attrs >= 2, 25).when(attrs == 1, 15).otherwise(5)
        + F.when((kw >= 4) & (units >= 2), 30).when((kw >= 2) | (units >= 1), 20).when(kw >= 1, 10).otherwise(5)
        + F.when((n_details > 0) & (keys >= 2), 20).when((n_details > 0) & (keys == 1), 10).otherwise(5) + F.when(as_name | as_text, 0).otherwise(15)
    )
    specification_issues = [
        (~any_spec, "Ingen spesifikasjoner funnet", "Høy"), (any_spec & (attrs == 1), "Kun 1 attributt", "Middels"), (any_spec & (attrs == 0), "Svært få strukturerte attributter", "Høy"),
        (any_spec & (kw == 0) & (units == 0), "Mangler teknisk/målbart innhold", "Middels"), (as_name, "Identisk med produktnavn", "Høy"), (as_text, "Identisk med beskrivelse", "Middels"),
    ]

    cv, url, n_images, average = c("image_quality"), t.filled(c("image_url")), c("image_count"), c("image_avg")
    main = n_images > 0
    whole = F.format_string("%.0f", average)
    of_images = F.when(cv.isNull(), F.when(url.isNotNull(), 40).otherwise(0)).when(~main, 0).otherwise(
        30 + F.when(n_images >= 2, 20).otherwise(10) + F.when(average >= 80, 50).when(average >= 60, 40).when(average >= 40, 25).otherwise(10)
    )
    seen = cv.isNotNull() & main
    images_issues = [
        (cv.isNull() & url.isNull(), "Ingen bilder funnet", "Høy"), (cv.isNotNull() & ~main, "Hovedbilde mangler", "Kritisk"), (seen & (n_images == 1), "Kun 1 bilde(r), anbefalt minst 2", "Lav"),
        (seen & (average >= 40) & (average < 60), F.concat(F.lit("Middels bildekvalitet (score "), whole, F.lit(")")), "Middels"),
        (seen & (average < 40), F.concat(F.lit("Lav bildekvalitet (score "), whole, F.lit(")")), "Høy"), (seen & t.filled(c("image_issues")).isNotNull(), c("image_issues"), "Middels"),
    ]

    has_category = g.isNotNull() | (depth > 0)
    vague = F.coalesce(t.is_placeholder(m), no)
    has = lambda x: F.when(x.isNotNull(), 15).otherwise(0)
    of_attributes = (
        F.when(n_details >= 5, 40).when(n_details >= 3, 30).when(n_details >= 1, 15).otherwise(0) + has(b) + has(p) + F.when(has_category, 15).otherwise(0)
        - F.when(depth == 1, 5).otherwise(0) + has(m) - F.when(vague, 10).otherwise(0)
    )
    attributes_issues = [
        ((n_details >= 1) & (n_details < 3), F.concat(F.lit("Kun "), n_details, F.lit(" tekniske attributter")), "Middels"), (n_details == 0, "Ingen strukturerte tekniske detaljer", "Høy"),
        (b.isNull(), "Merkevare mangler", "Lav"), (p.isNull(), "Pakningsinformasjon mangler", "Middels"), (depth == 1, "Grunt kategorihierarki (kun 1 nivå)", "Lav"),
        (~has_category, "Kategori mangler", "Middels"), (vague, "Produsent er en placeholder-verdi", "Høy"), (m.isNull(), "Produsentinformasjon mangler", "Høy"),
    ]

    of_manufacturer = F.when(m.isNull(), 0).otherwise(F.when(vague, 10).when(F.length(m) < 2, 20).otherwise(70) + F.when(own_m.isNotNull() & erp_m.isNotNull(), 30).when(own_m.isNotNull(), 15).otherwise(0))
    manufacturer_issues = [
        (m.isNull(), "Produsent mangler", "Høy"), (vague, "Placeholder-verdi", "Høy"), (~vague & (F.length(m) < 2), "For kort", "Middels"),
        (m.isNotNull() & t.first_filled(c("mfr_number"), c("erp_number")).isNull(), "Produsentens varenummer mangler", "Middels"),
    ]

    odd_category = (depth == 0) & F.coalesce(t.is_placeholder(g), no)
    of_category = F.when(depth >= 3, 100).when(depth == 2, 85).when(depth == 1, 60).when(odd_category, 15).when(g.isNotNull(), 70).otherwise(0)
    category_issues = [(~has_category, "Kategori mangler", "Middels"), (depth == 1, "Grunt kategorihierarki", "Lav"), (odd_category, "Placeholder-kategori", "Middels")]
    packed = p.isNotNull() | (F.coalesce(F.size(packaging_keys(c("details"), fixed.PACKAGING_AREA_KEYS)), F.lit(0)) > 0)
    return {
        "name": (F.when(name.isNull(), 0).otherwise(of_name), name_issues),
        "description": (F.when(d.isNull(), 0).otherwise(of_description), description_issues),
        "specification": (F.when(~any_spec, 0).otherwise(of_specification), specification_issues),
        "images": (of_images, images_issues),
        "attributes": (of_attributes, attributes_issues),
        "documents": (F.when(c("pdf"), 100).otherwise(0), [(~c("pdf"), "Produktdatablad ikke funnet", "Middels")]),
        "manufacturer": (of_manufacturer, manufacturer_issues),
        "category": (of_category, category_issues),
        "packaging": (F.when(packed, 100).otherwise(0), [(~packed, "Pakningsinformasjon mangler", "Middels")]),
    }


def _issues(found: Issues) -> Column:
    """The issues that hold, in order, as structs of text and severity."""
    each = [F.when(F.coalesce(when, F.lit(False)), F.struct((text if isinstance(text, Column) else F.lit(text)).cast("string").alias("text"), F.lit(severity).alias("severity"))) for when, text, severity in found]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def scored_areas(products: DataFrame, areas: list[str] | None = None) -> DataFrame:
    """Area scores, issues and explanations, their weighted mean with one decimal, severity, priority and why a score is low. areas: a choice of them; others are skipped."""
    chosen = [a for a in fixed.AREA_WEIGHTS if areas is None or a in areas]
    every = _areas()
    out = _measured(products).withColumns({f"{k}_score": F.greatest(F.lit(0), F.least(F.lit(100), every[k][0])).cast("int") for k in chosen})
    out = out.withColumns({f"{k}_issues": _issues(every[k][1]) for k in chosen})
    own = {k: c(f"{k}_score") for k in chosen}
    out = out.withColumn("overall", F.bround(scores.weighted(own, fixed.AREA_WEIGHTS), 1))
    zero = F.lit(100)
    out = out.withColumn("priority", scores.priority(c("overall"), own.get("description", zero), own.get("images", zero))).withColumn("severity", scores.severity(c("overall")))
    flat = F.flatten(F.array(*[c(f"{k}_issues") for k in chosen]))
    out = out.withColumns({"n_issues": F.size(flat), "n_high": F.size(F.filter(flat, lambda x: x.severity.isin("Kritisk", "Høy")))})
    return out.withColumn("why_low", why_low(chosen))


def explanation(area: str) -> Column:
    """An area's score and its first three issues."""
    score, label = c(f"{area}_score").cast("string"), F.lit(fixed.AREA_LABELS[area])
    texts = F.array_join(F.transform(F.slice(f"{area}_issues", 1, 3), lambda x: x.text), "; ")
    return F.when(F.size(f"{area}_issues") == 0, F.concat(label, F.lit(" er god (score "), score, F.lit("/100)"))).otherwise(F.concat(label, F.lit(" score "), score, F.lit("/100: "), texts))


def why_low(chosen: list[str]) -> Column:
    """Missing areas, weak areas, and the first two grave issues of the areas by ascending score; empty for a good score without gaps."""
    areas = F.array(*[F.struct(c(f"{k}_score").alias("score"), F.lit(i).alias("at"), F.lit(fixed.AREA_LABELS[k]).alias("label"), c(f"{k}_issues").alias("issues")) for i, k in enumerate(chosen)])
    labels = lambda keep: F.transform(F.filter(areas, keep), lambda a: a.label)
    missing, weak = labels(lambda a: a.score == 0), labels(lambda a: (a.score > 0) & (a.score < 75))
    grave = F.flatten(F.transform(F.array_sort(areas), lambda a: F.filter(a.issues, lambda x: x.severity.isin("Kritisk", "Høy"))))
    n = F.size(missing)
    parts = F.array(
        F.when((n > 0) & (n <= 3), F.concat(F.lit("Mangler: "), F.array_join(missing, ", "))).when(n > 3, F.concat(F.lit("Mangler "), n, F.lit(" områder inkl. "), F.array_join(F.slice(missing, 1, 2), ", "))),
        F.when(F.size(weak) > 0, F.concat(F.lit("Svak: "), F.array_join(F.slice(weak, 1, 3), ", "))),
        F.when(F.size(grave) > 0, F.array_join(F.transform(F.slice(grave, 1, 2), lambda x: x.text), "; ")),
    )
    return F.when((c("overall") >= 80) & (n == 0), "").otherwise(F.array_join(F.filter(parts, lambda x: x.isNotNull()), ". "))


def evaluated(model_score: Column) -> list[Column]:
    """Columns rule_score, model_score, combined_score and flag: 20 points for each of five fields, 0.4 of them with 0.6 of a model's score."""
    rule = sum((F.when(t.filled(c(x)).isNotNull(), 20).otherwise(0) for x in ("web_name", "description", "specification", "category", "packaging")), F.lit(0))
    combined = F.when(model_score.isNull(), rule.cast("double")).otherwise((rule * 4 + model_score * 6) / 10)
    flag = F.when(combined >= 70, "OK").when(combined >= 40, "Needs review").otherwise("Critical")
    return [rule.alias("rule_score"), model_score.alias("model_score"), F.bround(combined, 1).alias("combined_score"), flag.alias("flag")]
