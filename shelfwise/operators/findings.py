"""Findings of two sources merged with their evidence, what a product's suggestions amount to, and what to search for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from . import evidence

c = F.col

#: Forms of companies as they end a maker's name in a search, each taken off once, in order.
FORMS = (" AS", " Ab", " GmbH", " Inc", " Ltd", " AG", " SA", " Norge", " Norway")
#: Fields whose gaps weigh most, and fields that are judged elsewhere.
CRITICAL = ("Produktnavn", "Beskrivelse", "Spesifikasjon")
_ROW = ("value", "evidence", "conf", "url", "level", "match_status", "review")


def merged(sheet: DataFrame, maker: DataFrame, current: DataFrame) -> DataFrame:
    """(key, field, current_value, value, evidence, conf, url, level, match_status, review) of two sources' findings, one row for each key and field of either.

    Both have unique (key, field) with value, evidence, conf (hundredths), url, level, match_status and review; current is
    (key, field, current_value). Where both speak the sheet's row stays, surer if they agree and in conflict if not. Where
    only one speaks its row stays as it is. Where none does, the row says so without a value.
    """
    s, m = (d.select("key", "field", F.struct(*_ROW).alias(n)) for d, n in ((sheet, "s"), (maker, "m")))
    told = lambda x: x.isNotNull() & t.filled(x["value"]).isNotNull() & (F.coalesce(x["match_status"], F.lit("")) != "NOT_FOUND")
    by_s, by_m = told(c("s")), told(c("m"))
    both = by_s & by_m
    lower = lambda x: F.lower(t.strip(x["value"]))
    same = both & evidence.values_match(lower(c("s")), lower(c("m")))
    conflict = both & ~same
    base = F.when(by_s, c("s")).when(by_m, c("m")).otherwise(F.coalesce("s", "m"))
    said = lambda x: F.coalesce(t.filled(x["evidence"]), x["value"])
    quoted = lambda x: F.concat(F.lit("'"), x["value"], F.lit("'"))
    texts = F.when(same, F.concat(F.lit("PDF: "), said(c("s")), F.lit(" | Produsent: "), said(c("m")))).when(conflict, F.concat(F.lit("KONFLIKT - PDF: "), quoted(c("s")), F.lit(" vs Produsent: "), quoted(c("m"))))
    none = ~by_s & ~by_m
    joined = s.join(m, ["key", "field"], "full_outer").join(current, ["key", "field"], "left")
    return joined.select(
        "key", "field", "current_value", F.when(~none, base["value"]).alias("value"), F.coalesce(texts, base["evidence"]).alias("evidence"),
        F.when(none, 0.0).when(same, F.least(F.lit(95.0), c("s.conf") + 15)).when(conflict, F.greatest("s.conf", "m.conf") * 0.6).otherwise(base["conf"]).alias("conf"), base["url"].alias("url"), base["level"].alias("level"),
        F.when(none, "NOT_FOUND").when(same, "FOUND_IN_BOTH_MATCH").when(conflict, "FOUND_IN_BOTH_CONFLICT").otherwise(base["match_status"]).alias("match_status"), F.when(same, "auto").when(conflict, "conflict").otherwise(base["review"]).alias("review"),
    )


def outcome(found: Column, suggested: Column, by_model: Column, missing: Column, weak: Column, n_conflicts: Column, unsure: Column) -> Column:
    """Struct (status, review_required, comment): what a product's suggestions amount to.

    suggested, by_model, missing, weak and unsure are arrays of fields: with a suggestion, with one that a model made, without
    a value or with a wrong one, in need of work, with a suggestion of under 0.7.
    """
    some = lambda x: F.size(x) > 0
    listed = lambda x: F.array_join(x, ", ")
    critical = F.filter(missing, lambda x: x.isin(*CRITICAL))
    notes = [
        F.when(some(by_model), F.concat(F.lit("AI-generert innhold for: "), listed(by_model))), F.when(n_conflicts > 0, F.concat(n_conflicts.cast("string"), F.lit(" kildekonflikt(er)"))),
        F.when(some(unsure), F.concat(F.lit("Lav confidence: "), listed(unsure))),
    ]
    comment = lambda *more: F.array_join(F.filter(F.array(*notes, *more), lambda x: x.isNotNull()), "; ")
    told = lambda status, review, text: F.struct(F.lit(status).alias("status"), F.lit(review).alias("review_required"), text.alias("comment"))
    doubtful = some(by_model) | (n_conflicts > 0) | some(unsure) | some(missing)
    return (
        F.when(~F.coalesce(found, F.lit(False)), told("Missing Source Data", True, F.lit("Produkt ikke funnet i kilde")))
        .when(~some(suggested) & ~some(missing), told("No Change", False, F.lit("Produkt har akseptabel kvalitet")))
        .when((F.size(critical) >= 2) & ~some(suggested), told("Missing Source Data", True, F.concat(F.lit("Mangler: "), listed(critical))))
        .when(some(suggested) & ~doubtful, told("Ready for Inriver", False, comment(F.concat(F.lit("Forslag for: "), listed(suggested)))))
        .when(some(suggested), told("Needs Review", True, comment(F.when(some(missing), F.concat(F.lit("Mangler fortsatt: "), listed(missing))))))
        .when(some(missing), told("Needs Review", True, comment(F.concat(F.lit("Mangler: "), listed(missing)))))
        .when(some(weak), told("Needs Review", True, comment(F.concat(F.lit("Bør forbedres: "), listed(weak)))))
        .otherwise(told("No Change", False, F.lit("Ingen endringer nødvendig")))
    )


def search_queries(maker: Column, maker_number: Column, name: Column, specification: Column, own_number: Column) -> Column:
    """What to search a product by, from the most special to the most general, each once whatever its case."""
    number, own = t.normalized_number(maker_number), t.normalized_number(own_number)
    m = t.strip(F.coalesce(maker, F.lit("")))
    for form in FORMS:
        m = t.strip(F.regexp_replace(m, f"{form}$", ""))
    words = F.filter(F.split(F.coalesce(name, F.lit("")), r"(?U)\s+"), lambda w: F.length(w) >= 3)
    first = lambda n: F.array_join(F.slice(words, 1, n), " ")
    has_m, has_n, has_w, spec = m != "", number != "", F.size(words) > 0, F.substring(F.coalesce(specification, F.lit("")), 1, 50)
    said = [
        (has_m & has_n & has_w, (first(4), m, number)), (has_m & has_n, (m, number)), (has_m & has_w, (first(5), m)), (has_w & has_n, (first(4), number)), (has_n, (number, F.lit("product image"))), (has_m & has_w, (m, first(3), F.lit("product image"))),
        (has_m & (F.coalesce(specification, F.lit("")) != ""), (m, t.strip(spec))), (has_w, (first(5), F.lit("product image"))), (has_w, (first(4), F.lit("medical product"))), (has_m & (own != ""), (m, own)),
    ]
    every = F.filter(F.array(*[F.when(when, t.strip(F.concat_ws(" ", *parts))) for when, parts in said]), lambda x: x.isNotNull() & (x != ""))
    low = F.transform(every, F.lower)
    return F.filter(F.transform(every, lambda x, i: F.when(F.array_position(low, F.lower(x)) == i + 1, x)), lambda x: x.isNotNull())
