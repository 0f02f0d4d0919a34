"""Merged findings, outcomes and searches by worked rows."""

from pyspark.sql import functions as F

from shelfwise.operators import findings

ROWS = "key long, field string, value string, evidence string, conf double, url string, level string, match_status string, review string"


def test_merged_findings(spark):
    row = lambda key, value, conf, status="FOUND", said=None: (key, "f", value, said, conf, "u", "l", status, "r")
    sheet = spark.createDataFrame([row(1, "Nitril", 60.0, said="p. 1"), row(2, "Nitril", 90.0), row(3, "Nitril", 70.0), row(4, "gone", 70.0, "NOT_FOUND"), row(5, None, 50.0), row(7, "Nitril", 85.0)], ROWS)
    maker = spark.createDataFrame([row(1, " NITRIL ", 50.0), row(2, "Nitril lateksfri puderfri", 40.0), row(4, "back", 30.0), row(5, "", 20.0), row(6, "only", 20.0), row(7, "nitril.", 10.0)], ROWS)
    current = spark.createDataFrame([(1, "f", "old"), (9, "f", "x")], "key long, field string, current_value string")
    got = {r.key: r for r in findings.merged(sheet, maker, current).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7]
    assert (got[1].match_status, got[1].conf, got[1].review, got[1].evidence, got[1].current_value) == ("FOUND_IN_BOTH_MATCH", 75.0, "auto", "PDF: p. 1 | Produsent:  NITRIL ", "old")
    assert (got[2].match_status, got[2].conf, got[2].review, got[2].evidence) == ("FOUND_IN_BOTH_CONFLICT", 54.0, "conflict", "KONFLIKT - PDF: 'Nitril' vs Produsent: 'Nitril lateksfri puderfri'")
    assert (got[3].match_status, got[3].conf, got[3].value) == ("FOUND", 70.0, "Nitril") and (got[4].value, got[4].conf) == ("back", 30.0)
    assert (got[5].match_status, got[5].conf, got[5].value) == ("NOT_FOUND", 0.0, None) and got[6].value == "only" and got[7].conf == 95.0


def test_outcomes(spark):
    cases = [
        (False, [], [], [], [], 0, [], "Missing Source Data", "Produkt ikke funnet i kilde"), (True, [], [], [], ["x"], 0, [], "No Change", "Produkt har akseptabel kvalitet"),
        (True, [], [], ["Produktnavn", "Beskrivelse", "Kategori"], [], 0, [], "Missing Source Data", "Mangler: Produktnavn, Beskrivelse"), (True, ["a", "b"], [], [], [], 0, [], "Ready for Inriver", "Forslag for: a, b"),
        (True, ["a"], ["a"], ["m"], [], 2, ["l"], "Needs Review", "AI-generert innhold for: a; 2 kildekonflikt(er); Lav confidence: l; Mangler fortsatt: m"), (True, [], [], ["Kategori"], [], 0, [], "Needs Review", "Mangler: Kategori"),
    ]
    rows = spark.createDataFrame([(k, *x[:7]) for k, x in enumerate(cases)], "k int, found boolean, s array<string>, m array<string>, missing array<string>, weak array<string>, n int, unsure array<string>")
    got = rows.select("k", findings.outcome(*[F.col(x) for x in ("found", "s", "m", "missing", "weak", "n", "unsure")]).alias("x")).orderBy("k").collect()
    assert [(r.x.status, r.x.comment) for r in got] == [x[7:] for x in cases]
    assert [r.x.review_required for r in got] == [True, False, True, False, True, True]


def test_searches(spark):
    rows = spark.createDataFrame([("Acme Norge AS", "N-12.3", "Blue glove of a size", "5 ml", "N77"), (None, None, "ab", None, None), ("AS", None, "Acme product image", None, "1")], "m string, n string, d string, s string, o string")
    got = [r[0] for r in rows.select(findings.search_queries(*[F.col(x) for x in "mndso"])).collect()]
    assert got[0] == [
        "Blue glove size Acme N123", "Acme N123", "Blue glove size Acme", "Blue glove size N123", "N123 product image", "Acme Blue glove size product image", "Acme 5 ml", "Blue glove size product image", "Blue glove size medical product", "Acme 77",
    ]
    assert got[1] == [] and got[2][0] == "Acme product image AS" and len(got[2]) == len({x.lower() for x in got[2]})
