"""Suggestions by worked products; values of data sheets against the patterns in plain loops."""

import random
import re

import pytest

from shelfwise.functions import fixed
from shelfwise.operators import ladder, sheets

STATUSES = ", ".join(f"{k}_status string" for k in ladder.FIELDS.values())
ROW = f"key long, name string, description string, specification string, category string, crumbs array<string>, packaging string, packaging_unit string, manufacturer string, mfr_number string, details map<string,string>, found {ladder.FOUND}, maker {ladder.MAKER}, {STATUSES}"
COLUMNS = ["key", "name", "description", "specification", "category", "crumbs", "packaging", "packaging_unit", "manufacturer", "mfr_number", "details", "found", "maker", *[f"{k}_status" for k in ladder.FIELDS.values()]]
GOOD = "Denne hansken er laget av nitril og er steril. Den leveres i størrelse medium og brukes til undersøkelser av pasienter."
ENGLISH = "The glove is used for examination with this material. The gloves are sterile and can be used for patients."


def product(key, found=None, maker=None, status="WEAK", **values):
    row = {"key": key, "found": {k: (*v, *[None] * (6 - len(v))) for k, v in (found or {}).items()}, "maker": maker, **{f"{k}_status": status for k in ladder.FIELDS.values()}, **values}
    return tuple(row.get(n) for n in COLUMNS)


PRODUCTS = [
    product(1, {"product_name": ("Sheet name", "seen", 80.0, "u")}, status="STRONG", name="n"),
    product(2, {"product_name": ("Sheet name", "seen", 80.0, "u")}, status="OK", name="n"),
    product(3, {"product_name": ("Sheet name", "seen", 80.0, "u")}, name="old"),
    product(4, {"product_name": ("x" * 151, "seen", 80.0, "u")}, ("Maker's", None, None, 70.0, "https://www.molnlycke.com")),
    product(5, {"product_name": ("A. b. c. d.", "seen", 80.0, "u")}),
    product(6, {"product_name": ("same", "seen", 80.0, "u"), "manufacturer": ("M", "seen", 80.0, "u", None, "conflict"), "manufacturer_article_number": ("7", "seen", 90.0, "u", "NOT_FOUND")}, name="same"),
    product(7, {"description": (GOOD, "seen", 90.0, "u")}, description="short"),
    product(8, {"description": (ENGLISH, "seen", 90.0, "u")}),
    product(9, {"description": ("XS S M L XL 1 2 3", "seen", 90.0, "u")}, name="Hanske.", details={"Material": "Nitril", "Size": "M", "Brand": "B"}),
    product(10, {"spec:Form": ("rund", "seen", 60.0, "u"), "spec:Vekt": ("2", "seen", 60.0, "u")}, ("n", None, {"Form": "oval", "Lagring": "tørr"}, 70.0, None), details={"Vekt": "1"}),
    product(11, {"packaging_info": ("Oppbevares tørt", "seen", 80.0, "u")}, name="Nitrilhansker", packaging="x"),
    product(12, {"packaging_info": ("50 stk i pakning", "seen", 80.0, "u")}, packaging_unit="50 stk i pakning"),
    product(13, {"packaging_info": ("100 stk", "seen", 70.0, "u")}, crumbs=["a", "b"], name="hanske", status=None),
]


@pytest.fixture(scope="module")
def suggested(spark):
    return {(r.key, r.field): r for r in ladder.suggestions(spark.createDataFrame(PRODUCTS, ROW)).collect()}


def test_strong_and_ok_fields_get_none(suggested):
    assert not [k for k in suggested if k[0] in (1, 2)]


def test_names(suggested):
    r = suggested[3, "Produktnavn"]
    assert (r.current_value, r.suggested_value, r.source, r.source_url, r.conf, r.review_required, r.refused) == ("old", "Sheet name", ladder.PDF, "u", 80.0, False, "")
    r = suggested[4, "Produktnavn"]
    assert (r.suggested_value, r.source, r.conf, r.review_required) == ("Maker's", ladder.MAKER_NAME, 63.0, True) and "for langt" in r.refused
    assert suggested[5, "Produktnavn"].suggested_value is None and "flere setninger" in suggested[5, "Produktnavn"].refused
    assert (6, "Produktnavn") not in suggested and suggested[6, "Produsent"].conf == 48.0 and (6, "Produsentens varenummer") not in suggested


def test_descriptions(suggested):
    r = suggested[7, "Beskrivelse"]
    assert (r.suggested_value, r.conf, r.review_required, r.evidence) == (GOOD, 90.0, False, "seen | PDF-beskrivelse validert som komplett")
    r = suggested[8, "Beskrivelse"]
    assert r.source == ladder.PDF + " (oversettelse påkrevet)" and r.conf == 65.0 and r.review_required
    assert suggested[9, "Beskrivelse"].suggested_value == "Hanske.\nMateriale: Nitril.\nSize: M." and suggested[9, "Beskrivelse"].conf == 55.0


def test_other_fields(suggested):
    r = suggested[10, "Spesifikasjon"]
    assert r.suggested_value == "Vekt: 1; Form: rund; Lagring: tørr" and r.conf == 70.0 and r.source == "Produktdatablad (PDF), Produsent" and r.evidence.endswith("Form, Lagring")
    assert suggested[11, "Pakningsinformasjon"].suggested_value is None and "pakningsinformasjon" in suggested[11, "Pakningsinformasjon"].refused
    assert (12, "Pakningsinformasjon") not in suggested and suggested[13, "Pakningsinformasjon"].evidence == "seen | PDF pakningsdata validert"
    assert suggested[4, "Produsent"].suggested_value == "Mölnlycke Health Care" and suggested[4, "Produsent"].conf == 59.5
    assert suggested[9, "Produsent"].suggested_value == "B (merkevare — verifiser produsent)"
    assert suggested[9, "Kategori"].suggested_value == "Hansker og beskyttelsesprodukter" and (13, "Kategori") not in suggested


def test_reviews(spark):
    rows = spark.createDataFrame([(k, "Beskrivelse", "one two three four five six", "seen", 70.0, False) for k in range(8)], "key long, field string, suggested_value string, evidence string, conf double, review_required boolean")
    said = [
        (0, "Beskrivelse", "no_meaningful_improvement", None, None, None, None, None), (1, "Beskrivelse", "REJECTED_CONTENT_DEGRADATION", None, None, None, None, None), (2, "Beskrivelse", None, True, None, None, None, None),
        (3, "Beskrivelse", "APPROVED", True, "quite another text", 0.5, True, "better"), (4, "Beskrivelse", "APPROVED", None, "one two three four five six seven", -0.1, None, None), (5, "Beskrivelse", "APPROVED", None, " ", -2.0, None, None), (6, "Other", "APPROVED", None, "x", 0.0, None, None),
    ]
    reviews = spark.createDataFrame(said, "key long, field string, verdict string, rejected boolean, reviewed_value string, confidence_adjustment double, review_required boolean, rationale string")
    got = {r.key: r for r in ladder.reviewed(rows, reviews).collect()}
    assert sorted(got) == [3, 4, 5, 6, 7]
    assert (got[3].suggested_value, got[3].original_value, got[3].ai_modified, got[3].conf, got[3].review_required, got[3].evidence) == ("quite another text", "one two three four five six", True, 100.0, True, "seen | AI: better")
    assert (got[4].suggested_value, got[4].ai_modified, round(got[4].conf, 6)) == ("one two three four five six", False, 60.0)
    assert got[5].conf == 0.0 and not got[5].ai_modified and (got[7].conf, got[7].original_value) == (70.0, None)


def plain_value(text, field):
    """The first fitting value of a field's patterns, by a loop."""
    for pattern in fixed.SHEET_PATTERNS[field]:
        m = re.search(pattern, text, re.I | re.M | re.S)
        if not m:
            continue
        value = "\n".join(x for x in (re.sub("[ \t]+", " ", line).strip() for line in m[1].strip().split("\n")) if x)
        most = fixed.SHEET_LONGEST[field]
        if len(value) > most:
            head = value[:most]
            value = head[: head.rfind(".") + 1] if head.rfind(".") > most // 2 else head.rstrip()
        if len(value) <= 1:
            continue
        worth = 0.3 if any(re.search(p, value) for p in fixed.SHEET_BOILERPLATE) else 1.0
        worth *= 0.5 if len(value) > 40 and value[-1] not in ".!?)\"':;,0123456789%" and re.search(fixed.SENTENCE_WORDS, value) else 1.0
        worth *= (0.3 if len(value) < 20 else 1.0) * (0.3 if len(value) < 10 else 1.0) if field == "description" else 1.0
        worth *= 0.2 if field == "packaging_info" and not any(re.search(p, value) for p in fixed.SHEET_PACKAGING) else 1.0
        if worth >= 0.1:
            return value, m.start(), re.sub("[ \t]+", " ", text[max(0, m.start() - 80) : m.end() + 80].strip()), worth
    return None


def test_values_equal_plain_loops(spark):
    r = random.Random(6)
    bits = ["Produktnavn: ", "Product name - ", "Beskrivelse:", "Materiale ", "Size:", "Antall i pakning: ", "Ref. nr: ", "Produsent: ", "Emballasje:", "Manufacturer item code: ", "\n", "\n\n", " ", "50 stk", "en hanske til bruk for alle", "Oppbevares tørt", "www.x.no", "A1", "é", "x" * 60 + ". ", "word " * 9, "\t", "•"]
    rows = [(k, "".join(r.choice(bits) for _ in range(r.randrange(30)))) for k in range(400)] + [(900, None), (901, "")]
    got = {(x.id, x.field): x for x in sheets.values(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    want = {(k, f): v for k, text in rows for f in fixed.SHEET_PATTERNS if (v := plain_value(text or "", f))}
    assert got.keys() == want.keys() and len(want) > 400
    for k, (value, at, snippet, worth) in want.items():
        assert (got[k].value, got[k].at, got[k].snippet) == (value, at, snippet) and abs(got[k].quality - worth) < 1e-9


def test_every_label_is_found_in_any_case(spark):
    """Texts are searched only if they hold a part of a label; letters that equal an ASCII one where case doesn't count are no way past it."""
    labels = ["produktnavn", "product name", "productname", "varenavn", "betegnelse", "beskrivelse", "description", "produktbeskrivelse", "product\xa0description", "produsent", "manufacturer", "leverandør", "leverandor", "supplier", "fabrikant"]
    labels += ["produsentens varenummer", "produsenten kode", "produsentens artikkel nr", "manufacturer item code", "manufacturer no", "ref. nr", "ref number", "refkode", "pakning", "emballasje", "packaging", "pack size", "pakningsstørrelse", "forpakning"]
    labels += ["antall i pakning", "antall eske", "antall pr kartong", "antallperpall", "materiale", "material", "sammensetning", "composition", "dimensjone", "dimensjoner", "dimension", "dimensions", "størrelse", "storrelse", "size", "mål", "m\nl", "m\U0001f600l"]
    others = {"i": "\u0130\u0131", "s": "\u017f", "k": "\u212a"}
    forms = [form for x in labels for form in (x, x.upper(), x.title(), *[x.upper().replace(a.upper(), b) for a, bs in others.items() for b in bs if a in x])]
    rows = [(k, f"\u0130 før {form}: 50 stk i hver.\n" if k % 2 else f"før {form}: 50 stk i hver.\n") for k, form in enumerate(forms)]
    got = {(x.id, x.field): (x.value, x["at"]) for x in sheets.values(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    want = {(k, f): v[:2] for k, text in rows for f in fixed.SHEET_PATTERNS if (v := plain_value(text, f))}
    assert got == want and {k for k, _ in want} == set(range(len(forms)))


def test_each_match_is_sought_once(spark):
    plan = sheets.values(spark.createDataFrame([(1, "Size: 4")], "id long, text string"), "id", "text")._jdf.queryExecution().optimizedPlan().toString()
    patterns = sum(map(len, fixed.SHEET_PATTERNS.values()))
    assert 0 < plan.count("regexp_extract") <= 2 * patterns and plan.count("regexp_replace") <= 3 * patterns


def test_label_lines(spark):
    text = "Farge: blå\nStørrelse\tM\nfarge: no\nDate: 1\nFarge: rød  \nLengde : 20 cm\nX: y\nSide: 3"
    (row,) = sheets.labelled_lines(spark.createDataFrame([(1, text), (2, None), (3, "none")], "id long, text string"), "id", "text").collect()
    assert row.specs == {"Farge": "rød", "Størrelse": "M", "Lengde": "20 cm"}
