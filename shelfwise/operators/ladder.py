"""Suggestions for weak fields: each field has a ladder of candidates, and the first one that is valid stands.

A rung is a struct (value, source, url, evidence, conf, review, reason): value is null where a source says nothing new,
reason where the value can stand. All rungs of all fields are made from columns of one row and folded within it, so a
product needs no join for any of its fields; what was refused, and why, is kept beside the suggestion.

A row has found, a map from field to struct (value, evidence, conf, url, match_status, review) of a data sheet's surest
findings, maker, a struct (product_name, description, specifications, conf, url) or null, the product's current values and
the fields' statuses. Confidence is in hundredths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as t
from . import cleaning, enrichment

c = F.col

FOUND = "map<string, struct<value: string, evidence: string, conf: double, url: string, match_status: string, review: string>>"
MAKER = "struct<product_name: string, description: string, specifications: map<string, string>, conf: double, url: string>"
#: Fields in their order, with what a row calls their current value.
FIELDS = {"Produktnavn": "name", "Beskrivelse": "description", "Spesifikasjon": "specification", "Kategori": "category", "Pakningsinformasjon": "packaging", "Produsent": "manufacturer", "Produsentens varenummer": "mfr_number"}
PDF, MAKER_NAME, PAGE, STRUCTURING = (fixed.SOURCE_NAMES[k] for k in ("pdf", "manufacturer", "page", "structuring"))


def _any(x: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [x.rlike("(?U)" + p) for p in patterns])


def invalid(value: Column, field: str) -> Column:
    """Why a value can't be suggested for a field; null if it can."""
    x = t.strip(F.coalesce(value, F.lit("")))
    cut_off = (F.length(x) > 40) & ~F.substring(x, -1, 1).rlike("""[.!?)"':;,–—0-9%]""") & x.rlike("(?U)" + fixed.SENTENCE_WORDS)
    out = F.when(x == "", "Tom verdi").when(cut_off, "Teksten ser ut til å være avkortet midt i en setning")
    if field == "Beskrivelse":
        out = out.when(F.length(x) < 15, "Beskrivelsen er for kort til å være nyttig")
    if field == "Pakningsinformasjon":
        packed = _any(x, fixed.PACKAGING_SIGNS)
        out = out.when(_any(x, fixed.NOT_PACKAGING) & ~packed, "Verdien inneholder ikke pakningsinformasjon (lagring/bruk/markedsføring)").when(~packed & (F.length(x) > 50), "Lang tekst uten gjenkjennelig pakningsdata")
    if field == "Produktnavn":
        out = out.when(F.length(x) > 150, "Produktnavnet er for langt — ser ut som en beskrivelse").when(F.length(x) - F.length(F.replace(x, F.lit("."))) > 2, "Produktnavnet inneholder flere setninger")
    return out


def rung(value: Column, source, conf: Column, evidence: Column, url: Column | None = None, review: Column | None = None, reason: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    of = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        t.filled(value).alias("value"), of(source).alias("source"), (none if url is None else url).alias("url"), evidence.alias("evidence"), conf.cast("double").alias("conf"),
        (conf < fixed.AUTO_CONFIDENCE if review is None else review).alias("review"), (none if reason is None else reason).alias("reason"),
    )


def finding(field: str) -> tuple[Column, Column, Column, Column]:
    """Value, evidence, confidence and address of a data sheet's finding; what is in conflict counts 0.6 of its confidence."""
    x = c("found")[field]
    told = t.filled(x["value"]).isNotNull() & (F.coalesce(x["match_status"], F.lit("")) != "NOT_FOUND")
    return F.when(told, x["value"]), x["evidence"], F.when(x["review"] == "conflict", x["conf"] * 0.6).otherwise(x["conf"]), x["url"]


def _new(value: Column, current: Column) -> Column:
    return F.when(~value.eqNullSafe(current), value)


def _from_pdf(field: str, label: str, current: Column, checked: bool, rationale: str | None = None) -> Column:
    value, evidence, conf, url = finding(field)
    said = evidence if rationale is None else t.with_rationale(evidence, F.lit(rationale))
    return rung(_new(value, current), PDF, conf, said, url, reason=invalid(value, label) if checked else None)


def built_description(name: Column, details: Column) -> Column:
    """A description put together from a name and details: material, a size, a pack; null without any of them."""
    held = lambda keys: F.get(F.filter(F.array(*map(F.lit, keys)), lambda k: F.coalesce(F.map_contains_key(details, k), F.lit(False))), 0)
    parts = [F.concat(F.lit(label) if label else held(keys), F.lit(": "), details[held(keys)], F.lit(".")) for label, keys in fixed.BUILT_FROM.items()]
    some = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return F.when(t.filled(name).isNotNull() & (F.size(some) > 0), F.array_join(F.concat(F.array(F.concat(F.regexp_replace(name, r"\.+$", ""), F.lit("."))), some), "\n"))


def _name_rungs() -> list[Column]:
    own, conf = c("maker.product_name"), c("maker.conf") * 0.9
    return [_from_pdf("product_name", "Produktnavn", c("name"), True), rung(_new(t.filled(own), c("name")), MAKER_NAME, conf, F.concat(F.lit("Produsentens produktnavn: "), own), c("maker.url"), reason=invalid(own, "Produktnavn"))]


def _description_rungs() -> list[Column]:
    """The better of data sheet and manufacturer, by what each is worth as a description, else one put together from details."""
    _, evidence, pdf_conf, pdf_url = finding("description")
    pdf, own, current = c("_pdf_clean"), c("_maker_clean"), t.filled(c("description"))
    worth = {k: c(f"_worth_{k}") for k in ("_pdf_clean", "_maker_clean", "description")}
    use_pdf = pdf.isNotNull() & (current.isNull() | (worth["_pdf_clean"] > worth["description"]))
    own_conf = c("maker.conf") * 0.85
    use_own = own.isNotNull() & (~use_pdf | ((worth["_maker_clean"] > worth["_pdf_clean"]) & (own_conf > pdf_conf)))
    value = F.when(use_own, own).when(use_pdf, pdf)
    value = F.when(~value.eqNullSafe(c("description")), value)
    conf, source = F.when(use_own, own_conf).otherwise(pdf_conf), F.when(use_own, MAKER_NAME).otherwise(PDF)
    said = F.when(use_own, F.concat(F.lit("Produsentens beskrivelse: "), F.substring(own, 1, 120), F.lit("..."))).otherwise(evidence)
    gate, english = F.when(use_own, c("_gate_maker_clean")).otherwise(c("_gate_pdf_clean")), t.looks_english(value)
    rationale = F.when(english, "Engelsk kildetekst — oversettelse påkrevet").when(use_own, "Produsentens beskrivelse brukt som supplement").otherwise("PDF-beskrivelse validert som komplett")
    best = rung(
        value, F.when(gate.isNull() & english, F.concat(source, F.lit(" (oversettelse påkrevet)"))).otherwise(source), F.when(gate.isNotNull(), F.least(conf, F.lit(45.0))).when(english, F.least(conf, F.lit(65.0))).otherwise(conf),
        F.when(gate.isNotNull(), F.concat(F.lit("Kvalitetssjekk: "), gate)).otherwise(t.with_rationale(said, rationale)), F.when(use_own, c("maker.url")).otherwise(pdf_url),
        gate.isNotNull() | english | (conf < fixed.AUTO_CONFIDENCE), invalid(value, "Beskrivelse"),
    )
    built = F.when(value.isNull() & current.isNull(), built_description(c("name"), c("details")))
    return [best, rung(built, STRUCTURING, F.lit(55), F.lit("Generert fra produktnavn og tekniske spesifikasjoner"), review=F.lit(True))]


def _specification_rungs() -> list[Column]:
    """What the details lack, from the data sheet, then from the manufacturer; the first source of a key holds."""
    none = F.array().cast("array<struct<key: string, value: string>>")
    entries = lambda m: F.coalesce(F.map_entries(m), none)
    mine = entries(c("details"))
    sheet = F.transform(F.filter(entries_of_found(), lambda e: e["key"].startswith("spec:") & t.filled(e["value"]).isNotNull()), lambda e: F.struct(F.substr(e["key"], F.lit(6)).alias("key"), e["value"].alias("value")))
    keys = lambda xs: F.transform(xs, lambda e: e["key"])
    lacking = lambda xs, have: F.filter(xs, lambda e: ~F.array_contains(have, e["key"]))
    new_sheet = lacking(sheet, keys(mine))
    new_own = lacking(entries(c("maker.specifications")), keys(F.concat(mine, new_sheet)))
    added = F.array_sort(keys(F.concat(new_sheet, new_own)))
    text = F.array_join(F.transform(F.concat(mine, new_sheet, new_own), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    from_sheet = F.size(new_sheet) > 0
    source = F.when(from_sheet & (F.size(new_own) > 0), f"{PDF}, {MAKER_NAME}").when(from_sheet, PDF).otherwise(MAKER_NAME)
    url = F.get(F.filter(entries_of_found(), lambda e: e["key"].startswith("spec:")), 0)["url"]
    return [rung(F.when(F.size(added) > 0, text), source, F.when(from_sheet, 70).otherwise(60), F.concat(F.lit("Nye spesifikasjoner funnet: "), F.array_join(added, ", ")), url)]


def entries_of_found() -> Column:
    """The findings as an array of (key, value, url), in the map's order."""
    none = F.array().cast("array<struct<key: string, value: string, url: string>>")
    return F.coalesce(F.transform(F.map_entries("found"), lambda e: F.struct(e["key"].alias("key"), e["value"]["value"].alias("value"), e["value"]["url"].alias("url"))), none)


def _category_words() -> Column:
    pairs = F.transform(F.coalesce(F.map_entries("details"), F.array().cast("array<struct<key: string, value: string>>")), lambda e: F.concat_ws(" ", e["key"], e["value"]))
    return F.lower(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.array_join(pairs, " ")))


def _category_rungs() -> list[Column]:
    inferred = t.first_match(c("_words"), fixed.CATEGORY_PATTERNS, True)
    shallow = F.coalesce(F.size("crumbs"), F.lit(0)) < 2
    return [rung(_new(F.when(shallow, inferred), c("category")), STRUCTURING, F.lit(50), F.lit("Basert på produktnavn og spesifikasjoner"), review=F.lit(True))]


def _manufacturer_rungs() -> list[Column]:
    current = c("manufacturer")
    named = t.first_match(F.lower("maker.url"), fixed.MANUFACTURER_DOMAINS, False)
    by_url = rung(_new(named, current), MAKER_NAME, c("maker.conf") * 0.85, F.concat(F.lit("Utledet fra produsentens nettside: "), c("maker.url")), c("maker.url"), F.lit(True))
    brands = [(k, _new(t.filled(c("details")[k]), current)) for k in fixed.BRAND_KEYS]
    brand = F.coalesce(*[v for _, v in brands])
    by_brand = rung(F.concat(brand, F.lit(" (merkevare — verifiser produsent)")), PAGE, F.lit(45), F.concat(F.lit("Merkevare '"), brand, F.lit("' funnet i spesifikasjoner")), review=F.lit(True))
    return [_from_pdf("manufacturer", "Produsent", current, False), by_url, by_brand]


def rungs() -> dict[str, list[Column]]:
    packed = F.coalesce(t.filled(c("packaging")), c("packaging_unit"))
    return {
        "Produktnavn": _name_rungs(), "Beskrivelse": _description_rungs(), "Spesifikasjon": _specification_rungs(), "Kategori": _category_rungs(),
        "Pakningsinformasjon": [_from_pdf("packaging_info", "Pakningsinformasjon", packed, True, "PDF pakningsdata validert")], "Produsent": _manufacturer_rungs(),
        "Produsentens varenummer": [_from_pdf("manufacturer_article_number", "Produsentens varenummer", c("mfr_number"), False)],
    }


def climbed(ladder: Column) -> Column:
    """The first rung with a value and without a reason against it, and the reasons against those below it."""
    told = F.filter(ladder, lambda x: x["value"].isNotNull())
    stands = F.get(F.filter(told, lambda x: x["reason"].isNull()), 0)
    refused = F.transform(F.filter(told, lambda x: x["reason"].isNotNull()), lambda x: F.concat(x["source"], F.lit(": "), x["reason"]))
    return F.struct(stands.alias("stands"), F.array_join(refused, " | ").alias("refused"))


def suggestions(rows: DataFrame, key: str = "key") -> DataFrame:
    """(key, field, current_value, suggested_value, source, source_url, evidence, conf, review_required, refused) for fields whose status is neither STRONG nor OK.

    A field of which all candidates were refused has a row without a suggestion.
    """
    weak = {field: F.coalesce(~c(f"{own}_status").isin("STRONG", "OK"), F.lit(True)) for field, own in FIELDS.items()}
    texts = cleaning.once(rows, {**{f"_weak_{k}": v for k, v in weak.items()}, "_pdf_text": finding("description")[0], "_maker_text": c("maker.description")})
    for text, clean in (("_pdf_text", "_pdf_clean"), ("_maker_text", "_maker_clean")):
        texts = cleaning.once(cleaning.with_cleaned(texts, text, "_cleaned"), {clean: c("_cleaned")}).drop("_cleaned")
        texts = cleaning.once(texts, {f"_gate{clean}": t.description_gate(c(clean))})
        texts = texts.withColumn(f"_worth_{clean}", enrichment.description_quality(c(clean), c(f"_gate{clean}")))
    texts = cleaning.once(texts, {"_worth_description": enrichment.description_quality(c("description"))})
    texts = cleaning.once(texts, {"_words": _category_words()})
    # a field's ladder is made for weak fields only, and once: what is read of it are its first rung and the reasons
    ladders = {f"_ladder_{field}": F.when(c(f"_weak_{field}"), F.array(*ladder)) for field, ladder in rungs().items()}
    texts = cleaning.once(texts, ladders)
    packed = F.coalesce(t.filled(c("packaging")), c("packaging_unit"))
    trail = F.coalesce(t.filled(c("category")), F.array_join("crumbs", " > "))
    currents = {**FIELDS, "Pakningsinformasjon": packed, "Kategori": trail}
    each = []
    for field in FIELDS:
        current = currents[field]
        each.append(F.when(c(f"_weak_{field}"), F.struct(F.lit(field).alias("field"), (c(current) if isinstance(current, str) else current).alias("current"), climbed(c(f"_ladder_{field}")).alias("x"))))
    # through a generator, so that the ladders are made once and not again in the filter
    out = texts.select(c(key), F.explode(F.array(*each)).alias("e")).filter("e is not null").select(key, "e.field", "e.current", "e.x.stands", "e.x.refused").filter("stands is not null or refused <> ''")
    return out.select(
        key, "field", c("current").alias("current_value"), c("stands.value").alias("suggested_value"), c("stands.source").alias("source"), c("stands.url").alias("source_url"), c("stands.evidence").alias("evidence"),
        c("stands.conf").alias("conf"), c("stands.review").alias("review_required"), "refused",
    )


def reviewed(suggested: DataFrame, reviews: DataFrame, key: str = "key") -> DataFrame:
    """Suggestions after a model's reviews (key, field, verdict, rejected, reviewed_value, confidence_adjustment, review_required, rationale).

    Verdicts against a suggestion drop it. A reviewed value replaces the suggested one unless over 80 % of their words are
    the same; the first value is kept as original_value, conf stays within 0 and 100. Of several reviews one has to be chosen before.
    """
    names = ("verdict", "rejected", "reviewed_value", "confidence_adjustment", "review_required", "rationale")
    r = reviews.select(key, "field", F.lit(True).alias("_seen"), *[c(k).alias(f"_{k}") for k in names])
    joined = suggested.join(r, [key, "field"], "left").withColumn("_verdict", F.upper(F.coalesce("_verdict", F.lit(""))))
    out = c("_verdict").isin("NO_MEANINGFUL_IMPROVEMENT", "REJECTED_CONTENT_DEGRADATION") | (F.coalesce("_rejected", F.lit(False)) & (c("_verdict") != "APPROVED"))
    new = t.filled(t.strip(c("_reviewed_value")))
    close = (t.jaccard(t.words(c("suggested_value")), t.words(new)) > 0.8) & (new != c("suggested_value"))
    taken = new.isNotNull() & ~F.coalesce(close, F.lit(False))
    adjusted = F.greatest(F.lit(0.0), F.least(F.lit(100.0), c("conf") + F.coalesce("_confidence_adjustment", F.lit(0.0)) * 100))
    said = F.when(t.filled(c("_rationale")).isNotNull(), t.with_rationale(c("evidence"), F.concat(F.lit("AI: "), c("_rationale")))).otherwise(c("evidence"))
    changed = {
        "original_value": F.when(c("_seen"), c("suggested_value")), "ai_modified": taken, "suggested_value": F.when(taken, new).otherwise(c("suggested_value")), "conf": F.when(c("_seen"), adjusted).otherwise(c("conf")),
        "review_required": F.coalesce("_review_required", "review_required"), "evidence": said,
    }
    return joined.filter(~out).withColumns(changed).drop("_seen", *[f"_{k}" for k in names])
