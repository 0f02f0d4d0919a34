"""Every catalogue query against its SQL, and rules against known facts."""

import glob
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from shelfwise import streaming
from shelfwise.functions import text as t
from shelfwise.operators import cleaning, evidence, families, fields, pages, state
from shelfwise.plans import catalog
from shelfwise.sources import files

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def norm(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    result = duck.execute(catalog.oracle_sql()[name])
    names = sorted(df.columns)
    found = [d[0] for d in result.description]
    assert sorted(found) == names
    ours = sorted(tuple(norm(r[n]) for n in names) for r in df.collect())
    theirs = sorted(tuple(norm(r[found.index(n)]) for n in names) for r in result.fetchall())
    assert ours == theirs


def values(spark, pairs, expression):
    df = spark.createDataFrame([(k, *(v if isinstance(v, tuple) else (v,))) for k, v in enumerate(pairs)], "k int, " + ", ".join(f"c{i} string" for i in range(2 if isinstance(pairs[0], tuple) else 1)))
    return [r[0] for r in df.orderBy("k").select(expression).collect()]


def test_identifiers(spark):
    given = ["12345.0", "8286416.0", "12345.00", "N12345", "007890", "ABC-123/456", " 12345  ", "12345.5", None, "", "nan", "N/A", "None"]
    assert values(spark, given, t.normalize_identifier(F.col("c0"))) == ["12345", "8286416", "12345", "N12345", "007890", "ABC-123/456", "12345", "12345.5", None, None, None, None, None]
    numbers = spark.createDataFrame([(0, 12345.0), (1, 12345.5), (2, float("nan")), (3, float("inf")), (4, None)], "k int, x double")
    assert [r[0] for r in numbers.orderBy("k").select(t.identifier_of_number(F.col("x"))).collect()] == ["12345", "12345.5", None, None, None]


def test_sku_status(spark):
    given = [("12345", "12345"), ("N12345", "12345"), ("99999", "12345")]
    assert values(spark, given, pages.sku_status(F.lit("x"), F.col("c0"), F.col("c1"))) == ["EXACT_MATCH", "NORMALIZED_MATCH", "MISMATCH"]
    assert values(spark, [(None, "12345"), (None, "7")], pages.sku_status(F.lit("see 12345"), F.col("c0"), F.col("c1"))) == ["SKU_IN_PAGE", "UNVERIFIED"]


def test_values_match(spark):
    given = [("Nitril Hanske", " nitril  hanske"), ("Nitril", "Nitril lateksfri puderfri"), ("a-b", "a b")]
    assert values(spark, given, evidence.values_match(F.col("c0"), F.col("c1"))) == [True, False, True]


def test_structured_text(spark):
    assert values(spark, ["<p>a</p><p>b</p>", "<ul><li>x</li><li>y</li></ul>", "a<br/>b"], pages.structured_text(F.col("c0"))) == ["a\nb", "• x\n• y", "a\nb"]


def test_gate(spark):
    good = "This is a well made product. It is used every day in many clinics."
    assert values(spark, [good, "Short.", "", good + " Number 1234567 here.", good + " Pack 10 / 100 now."], t.description_gate(F.col("c0"))) == [None, "short", "empty", "number", "quantity"]


def test_family_dimensions(spark):
    dims = families.dimensions(F.col("c0"), F.col("c1"))
    given = [("Hanske", "M rosa AQL 1,5"), ("Kanyle 18G x 40mm Rosa", ""), ("Kompress 5x5cm", ""), ("Stetoskop", "Standard"), ("Kateter 10ml ch14", None)]
    got = values(spark, given, F.struct(*[v.alias(k) for k, v in dims.items()]))
    assert (got[0]["size"], got[0]["colour"], got[1]["gauge"], got[1]["colour"], got[2]["dimension"]) == ("M", "Rosa", "18G", "Rosa", "5x5cm")
    assert all(v is None for v in got[3].asDict().values())
    assert (got[4]["volume"], got[4]["ch"]) == ("10ml", "CH14")


def test_base_names(spark):
    given = ["Hanske Nitril XL", "Kanyle 18G x 40mm Rosa", "KD-Ject sprøyte 5 ml", "Sutur USP 2-0 venstre", "Kompress 7,5x7,5 cm steril", "Plaster, engangs - 7", None]
    assert values(spark, given, families.base_name(F.col("c0"))) == ["hanske nitril", "kanyle x", "kdject sprøyte", "sutur", "kompress steril", "plaster,", ""]


def test_families_are_capped(spark):
    rows = [(k, "a", "Hanske", None) for k in range(3)] + [(k, "b", "Hanske" + (" XL" if k == 10 else ""), None) for k in (10, 11, 12)] + [(20 + k, "c", f"Hanske {x}", None) for k, x in enumerate(["S", "M", "L"])] + [(30 + k, None, "Ting", None) for k in range(2)]
    df = spark.createDataFrame(rows, "key long, brand string, family_name string, family_specification string")
    df = df.withColumn("article_number", F.col("key").cast("string")).withColumn("supplier", F.lit(None).cast("string")).withColumn("family_category", F.lit(None).cast("string")).withColumn("details", F.lit(None).cast("map<string,string>"))
    got = {r.group_key: r for r in families.groups(families.records(df)).collect()}
    assert got["a||hanske"].score == 40 and got["b||hanske"].score == 40 and got["c||hanske"].score > 65 and got["c||hanske"].varying == "Størrelse"
    assert got["_unknown_||ting"].score == 17 and got["b||hanske"].mother_key is None


def test_junk_lines(spark):
    junk = ["ab", "Størrelseskode Dispenser", "Produktdatablad 2024", "2024-01-15", "150 / 1500", "222001", "10 20 30", "Salgsenhet: 10", "Produsent: Acme", "Antall pr eske", "www.firma.no info", "© 2024 Firma", "REF nr 12", "a / b / c / d", "kode 12345 hanske 10 / 20"]
    text = ["Hansken er laget av nitril.", "Steril kompress til sårpleie", "This one mentions copyright within", "XS/S/M/L passer alle"]
    assert None not in values(spark, junk, t.junk_reason(F.col("c0")))
    assert values(spark, text, t.junk_reason(F.col("c0"))) == [None] * 4


def test_variant_blocks(spark):
    block = "Myk kompress til sår. 222001 SELEFA Optimia kompress 120 / 10800 7,5 cm 222002 SELEFA Optimia kompress 60 / 5400 Holder lenge."
    assert values(spark, [block, "Uten tabell 222001 SELEFA kompress 120 / 10800"], t.without_variants(F.col("c0"))) == ["Myk kompress til sår.\nHolder lenge.", "Uten tabell 222001 SELEFA kompress 120 / 10800"]


def test_line_queries_have_no_shuffle(spark):
    for name in ("q_dedup_lines", "q_clean_lines", "q_clean_documents"):
        assert "Exchange" not in catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_an_undivided_specification_has_no_attributes(spark):
    df = spark.createDataFrame([("long words", None), ("a; b", None), ("a", {"x": "1"})], "s string, d map<string,string>")
    assert [r[0] for r in df.select(fields.attribute_count(F.col("d"), F.col("s"))).collect()] == [0, 2, 1]


def test_miss_cut_keeps_rows_before_two_misses(spark):
    rows = [("a", i, h) for i, h in enumerate([1, 0, 1, 0, 0, 1])] + [("b", 0, 0), ("b", 1, 0)] + [("c", 0, 0)]
    got = state.before_misses(spark.createDataFrame(rows, "k string, i int, h int"), "k", "i", F.col("h") == 1)
    assert sorted((r.k, r.i) for r in got.collect()) == [("a", 0), ("a", 1), ("a", 2), ("c", 0)]


def test_workbook(spark, tmp_path):
    import zipfile

    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    sheet = f'<worksheet xmlns="{ns}"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>Navn</t></is></c><c r="B1" t="s"><v>0</v></c></row><row r="2"><c r="B2"><v>12345</v></c></row><row r="3"><c r="A3" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>Art. Nr</t></si></sst>')
    got = files.article_numbers(files.workbooks(spark, str(tmp_path)), ["artnr", "artikkelnummer"])
    assert [(r.row, r.value) for r in got.collect()] == [(2, "12345")]


def test_sitemap(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<urlset xmlns='x'><url><loc>http://a/products/1</loc></url><url><loc>http://a/about</loc></url></urlset>")
    assert [r.url for r in files.sitemap_urls(spark, str(tmp_path)).collect()] == ["http://a/products/1"]


def test_stream_keeps_first_of_each_key(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:02:00")], "k int, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, ts timestamp").parquet(str(tmp_path / "in"))
    streaming.new_keys(stream, "k", "ts").writeStream.format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(r.k for r in spark.table("fresh").collect()) == [1, 2]


def test_rate_limit_ignores_rejected(spark, tmp_path):
    rows = [(7, f"2024-01-01 00:00:{s:02d}") for s in (0, 1, 2, 3, 4, 5, 59)] + [(7, "2024-01-01 00:01:01")]
    spark.createDataFrame(rows, "k long, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, ts timestamp").parquet(str(tmp_path / "in"))
    streaming.admitted(stream, "k", "ts").writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(60)
    assert [r.allowed for r in spark.table("limited").orderBy("ts").collect()] == [True] * 5 + [False, False, True]


def test_consistency_and_name_rules(spark):
    rows = [
        (1, "nitril hanske rosa", "god bandasje for sår", None, "SHOULD_IMPROVE", "STRONG"),
        (2, "nitril hanske og", "god bandasje for sår", None, "OK", "STRONG"),
        (3, "nitril hanske", None, "sår pleie", "SHOULD_IMPROVE", "STRONG"),
        (4, "nitril hanske", None, "sår", "OK", "STRONG"),
        (5, "12-34 / 5", None, None, "OK", "PROBABLE_ERROR"),
        (6, "HANSKE", None, None, "OK", "SHOULD_IMPROVE"),
        (7, "produkt", None, None, "OK", "SHOULD_IMPROVE"),
        (8, "box of gloves", None, None, "OK", "SHOULD_IMPROVE"),
        (9, None, "god bandasje", None, "OK", "MISSING"),
    ]
    df = spark.createDataFrame(rows, "k int, web_name string, description string, category string, c string, n string").withColumn("erp_name", F.lit(None).cast("string"))
    for r in df.select("k", "c", "n", fields.consistency_status().alias("consistency"), fields.name_status().alias("name")).collect():
        assert (r.k, r.consistency, r.name) == (r.k, r.c, r.n)


def test_labels_and_restated_values(spark):
    long = "one two three four five six seven eight"
    rows = [(1, "a", "b", "nettside + ERP", False), (2, "a", "", "nettside kun", False), (3, None, "b", "ERP kun", False), (4, "", None, None, False), (5, long, long + " nine", "nettside + ERP", True), (6, long, long + " a b c d", "nettside + ERP", False)]
    df = spark.createDataFrame(rows, "k int, a string, b string, label string, same boolean")
    for r in df.select("*", t.source_label(F.col("a"), F.col("b")).alias("x"), t.restates(F.col("a"), F.col("b")).alias("y")).collect():
        assert (r.k, r.x, r.y) == (r.k, r.label, r.same)


def test_clean_descriptions(spark):
    text = "Side 1\nHansken er laget av nitril og\nkan brukes til mat.\nLateksfri.\n150 / 1500\nrosa\nHansken  er laget av nitril og kan brukes til MAT.\n"
    df = spark.createDataFrame([(1, text), (2, "150 / 1500\n2020-01-01"), (3, None), (4, "")], "id int, text string")
    out = {r.id: r.cleaned for r in cleaning.clean_descriptions(df, "id", "text").collect()}
    assert out == {1: "Hansken er laget av nitril og kan brukes til mat.\nLateksfri."}


def test_sheets_are_written_and_read(spark, tmp_path):
    files.write_sheets({"a": spark.range(3).toDF("x"), "b": spark.range(2).toDF("y")}, str(tmp_path), "csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/a").count() == 3
    assert spark.read.option("header", True).csv(f"{tmp_path}/b").columns == ["y"]


def test_image_means_are_summed_in_the_order_of_the_table(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.randrange(900), k % 4, 1, 1 + k % 7, r.randrange(1, 51) * 1.0, r.randrange(11) / 100, r.randrange(9) / 100) for k in range(4000)]
    # two rows at one place: the first in the table is the main one
    rows = [(5, 9, 1, 1, 7.0, 0.0, 0.01), *rows[:2000], (5, 9, 1, 1, 30.0, 0.1, 0.08), *rows[2000:]]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double"
    os.makedirs(f"{tmp_path}/lineitem.parquet")
    for k in range(8):
        spark.createDataFrame(rows[k * 501 : (k + 1) * 501], schema).coalesce(1).write.parquet(f"{tmp_path}/{k}")
        os.rename(next(x for x in glob.glob(f"{tmp_path}/{k}/*.parquet")), f"{tmp_path}/lineitem.parquet/part-{k}.parquet")
    con = duckdb.connect()
    con.execute("set threads = 1")
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(f"select l_partkey, n, best, mean, main, status from ({catalog.oracle_sql()['q_image_summary']})").fetchall()
    got = catalog.queries()["q_image_summary"](spark, str(tmp_path)).select("l_partkey", "n", "best", "mean", "main", "status").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 5


def test_gate_and_quality_equal_their_sql_on_odd_texts(spark, tmp_path):
    r = random.Random(5)
    parts = [
        "12345", "é12345", "12345é", "1 / 2", "ø1/2", "1\x0b/ 2", "side 7", "SİDE 7", "sıde 7", "ſide 7", "side\xa07", "2020-01-02", "å2020-01-02ø", "ſtørrelseskode", "STØRRELSESKODE", "bestillingsnummer", "beſtıllingsnummer",
        "dispenser \xa0/ kartong", "salgsenhet", "øsalgsenhet", "SALGSENHET́", "transportKartong", "søer", "våg", "hus og", "båt i", "café", "steril", "5 mm", "µg", "gå", "STØRRELSE", "a long run of plain words that goes on and on for all of its line",
        "\n", "\n", "\r\n", "\x0b", "\x85", " ", "\xa0", "　", "\t", "\x0c", "• ", "- ", ". ", "! ", "?", " ", "\xa0\xa0\xa0\xa0\xa0\xa0\xa0\xa0a.", " eleven char",
    ]
    sep = lambda: r.choice([" ", " ", "", ". "])
    good = "This is a well made product. It is used every day in many clinics"
    texts = ["".join(r.choice(parts) + sep() for _ in range(r.randrange(1, 14))) for _ in range(1500)]
    texts += [f"{good}{sep()}{r.choice(parts)}{sep()}{r.choice(parts)}" for _ in range(1500)] + [None, "", " \xa0 ", "\x0b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name, column in (("q_description_gate", "reason"), ("q_description_quality", "quality")):
        got = {x["doc_id"]: x[column] for x in catalog.queries()[name](spark, str(tmp_path)).collect()}
        want = dict(con.execute(f"select doc_id, {column} from ({catalog.oracle_sql()[name]})").fetchall())
        assert [(k, texts[k], got[k], want[k]) for k in want if got[k] != want[k]] == [] and len(got) == len(texts)
    assert len(set(con.execute(f"select reason from ({catalog.oracle_sql()['q_description_gate']})").fetchall())) > 10
