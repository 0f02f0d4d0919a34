"""Queries on suggestions for weak fields and on values in the texts of data sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import fields, ladder, sheets
from ..sources.views import PRODUCTS_SQL, products, table
from . import sql
from .catalog import _texts, query

c = F.col

# suggestions

_D1 = "Denne hansken er laget av nitril og er steril. Den leveres i størrelse medium og brukes til undersøkelser av pasienter."
_D2 = "The glove is used for examination with this material. The gloves are sterile and can be used for patients."
_D3 = "Produsentens tekst om hansken i vinyl. Den er steril og leveres i esker med stk 100 til klinikker."
_STORED = "Oppbevares tørt og kjølig i original emballasje til bruk."
_K = "CAST(key AS STRING)"
#: What a data sheet and a manufacturer say of a product, by its key: (field, value, when, confidence).
_SHEET = [
    ("product_name", f"CASE key % 3 WHEN 0 THEN concat('Sheet name ', {_K}) WHEN 1 THEN repeat('long name ', 20) END", 80), ("description", f"CASE key % 4 WHEN 0 THEN '{_D1}' WHEN 1 THEN '{_D2}' WHEN 2 THEN 'Kort.' END", 90),
    ("packaging_info", f"CASE key % 5 WHEN 0 THEN '50 stk per pakning' WHEN 1 THEN '{_STORED}' END", 80), ("manufacturer", "CASE WHEN key % 6 = 0 THEN 'Sheet maker' END", 70), ("manufacturer_article_number", f"CASE WHEN key % 7 = 0 THEN concat('MN-', {_K}) END", 90),
    ("spec:Form", "CASE WHEN key % 4 < 2 THEN 'rund' END", 60), ("spec:Farge", "CASE WHEN key % 4 < 2 THEN 'grønn' END", 60),
]
_URL = "CASE key % 3 WHEN 0 THEN 'https://www.molnlycke.com/p' ELSE 'https://other.com/p' END"


def _with_findings(spark, sf):
    one = lambda value, conf: F.struct(
        F.expr(value).alias("value"), F.lit("seen").alias("evidence"), F.lit(float(conf)).alias("conf"), F.lit("sheet.pdf").alias("url"), F.when(c("key") % 14 == 0, "NOT_FOUND").otherwise("FOUND").alias("match_status"), F.when(c("key") % 8 == 0, "conflict").alias("review")
    )
    found = F.create_map(*[x for k, value, conf in _SHEET for x in (F.lit(k), one(value, conf))]).cast(ladder.FOUND)
    maker = F.struct(
        F.concat(F.lit("Maker name "), c("key")).alias("product_name"), F.when(c("key") % 8 == 2, _D3).alias("description"), F.create_map(F.lit("Lagring"), F.lit("tørr"), F.lit("Form"), F.lit("oval")).alias("specifications"), F.lit(70.0).alias("conf"), F.expr(_URL).alias("url")
    )
    rows = fields.with_statuses(products(spark, sf))
    return rows.withColumns({"found": found, "maker": F.when(c("key") % 2 == 0, maker).cast(ladder.MAKER)}).withColumnRenamed("web_name", "name")


_CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce(web_name, '') || ' ' || coalesce(array_to_string(list_transform(details, lambda e: e[1] || ' ' || e[2]), ' '), '')), '{k}') THEN '{v}'" for k, v in fixed.CATEGORY_PATTERNS.items()) + " END"


@query(f"""WITH v AS ({PRODUCTS_SQL}), st AS (SELECT * FROM ({sql.STATUSES})), w AS (SELECT v.*, st.* EXCLUDE (key) FROM v JOIN (SELECT key, {', '.join(f'{x}_status' for x in ladder.FIELDS.values())} FROM st) st ON v.key = st.key),
    p AS (SELECT *, key % 14 <> 0 AS told, CASE WHEN key % 8 = 0 THEN 0.6 ELSE 1 END AS less, key % 2 = 0 AS made, {_URL} AS url FROM w), e AS (
    SELECT key, 'Produktnavn' AS field, CASE WHEN told AND key % 3 = 0 THEN 'Sheet name ' || key WHEN made THEN 'Maker name ' || key END AS value, CASE WHEN told AND key % 3 = 0 THEN 80 * less::DOUBLE WHEN made THEN 70 * 0.9::DOUBLE END AS conf,
        CASE WHEN told AND key % 3 = 1 THEN '{ladder.PDF}: Produktnavnet er for langt — ser ut som en beskrivelse' ELSE '' END AS refused FROM p WHERE name_status NOT IN ('STRONG', 'OK')
    UNION ALL SELECT key, 'Beskrivelse', CASE WHEN told AND key % 4 = 0 THEN '{_D1}' WHEN told AND key % 4 = 1 THEN '{_D2}' WHEN made AND key % 8 = 2 THEN '{_D3}'
        WHEN description IS NULL AND web_name IS NOT NULL AND key % 9 = 0 THEN web_name || '.' || chr(10) || 'Materiale: Nitril.' || chr(10) || 'Lengde: 20 cm.' WHEN description IS NULL AND web_name IS NOT NULL AND key % 9 = 1 THEN web_name || '.' || chr(10) || 'Pakning: 100.'
        WHEN description IS NULL AND web_name IS NOT NULL AND key % 9 = 4 THEN web_name || '.' || chr(10) || 'Size: ' || p_size || '.' END, CASE WHEN told AND key % 4 = 0 THEN 90 * less::DOUBLE WHEN told AND key % 4 = 1 THEN 65 WHEN made AND key % 8 = 2 THEN 70 * 0.85::DOUBLE ELSE 55 END, ''
        FROM p WHERE description_status NOT IN ('STRONG', 'OK')
    UNION ALL SELECT key, 'Spesifikasjon', array_to_string(list_concat(list_transform(coalesce(details, []), lambda d: d[1] || ': ' || d[2]), CASE WHEN key % 4 < 2 THEN list_concat(['Form: rund'], CASE WHEN key % 9 = 0 THEN [] ELSE ['Farge: grønn'] END) ELSE [] END,
        CASE WHEN made THEN list_concat(['Lagring: tørr'], CASE WHEN key % 4 < 2 THEN [] ELSE ['Form: oval'] END) ELSE [] END), '; '), CASE WHEN key % 4 < 2 THEN 70 ELSE 60 END, '' FROM p WHERE specification_status NOT IN ('STRONG', 'OK') AND (key % 4 < 2 OR made)
    UNION ALL SELECT key, 'Kategori', {_CATEGORY}, 50, '' FROM p WHERE category_status NOT IN ('STRONG', 'OK') AND coalesce(len(crumbs), 0) < 2 AND {_CATEGORY} IS DISTINCT FROM category
    UNION ALL SELECT key, 'Pakningsinformasjon', CASE WHEN key % 5 = 0 THEN '50 stk per pakning' END, CASE WHEN key % 5 = 0 THEN 80 * less::DOUBLE END, CASE WHEN key % 5 = 1 THEN '{ladder.PDF}: Verdien inneholder ikke pakningsinformasjon (lagring/bruk/markedsføring)' ELSE '' END
        FROM p WHERE packaging_status NOT IN ('STRONG', 'OK') AND told AND key % 5 < 2
    UNION ALL SELECT key, 'Produsent', CASE WHEN told AND key % 6 = 0 THEN 'Sheet maker' WHEN made AND key % 3 = 0 THEN 'Mölnlycke Health Care' END, CASE WHEN told AND key % 6 = 0 THEN 70 * less::DOUBLE WHEN made AND key % 3 = 0 THEN 70 * 0.85::DOUBLE END, ''
        FROM p WHERE manufacturer_status NOT IN ('STRONG', 'OK')
    UNION ALL SELECT key, 'Produsentens varenummer', CASE WHEN told AND key % 7 = 0 THEN 'MN-' || key END, 90 * less::DOUBLE, '' FROM p WHERE mfr_number_status NOT IN ('STRONG', 'OK'))
    SELECT key, field, value AS suggested_value, CASE WHEN value IS NOT NULL THEN conf END AS conf, refused FROM e WHERE value IS NOT NULL OR refused <> ''""")
def q_suggestions(spark, sf):
    """The first candidate that can stand for each weak field, and why others can't."""
    return ladder.suggestions(_with_findings(spark, sf)).select("key", "field", "suggested_value", "conf", "refused")


# data sheets

#: Every third text begins with labelled lines.
_HEAD = """CASE doc_id % 3 WHEN 0 THEN concat('Produktnavn: Hanske nr ', CAST(doc_id AS STRING), chr(10), 'Antall i pakning: 50 stk', chr(10), 'Produsent -  Acme   AS', chr(10), 'Beskrivelse: En hanske for bruk', chr(10), 'over to linjer.', chr(10), chr(10), 'Materiale: nitril og vinyl som varer lenge og er myk', chr(10), 'Ref. nr: A', CAST(doc_id AS STRING), chr(10), 'Size: ', CAST(doc_id % 9 AS STRING), chr(10))
    WHEN 1 THEN concat('Ref nr: ', chr(10), 'Emballasje: les mer om den', chr(10), 'Farge: blå', chr(10), 'Date: 1', chr(10), 'Farge: rød', chr(10)) ELSE '' END"""
_WORD = r"(^|[^\p{L}\p{N}_])(?:og|for|som|med|til|av|er|i|and|for|with|the|is)($|[^\p{L}\p{N}_])"


def _sheets(spark, sf):
    return _texts(spark, sf).select("doc_id", F.concat(F.expr(_HEAD), F.coalesce("text", F.lit(""))).alias("text"))


def _re2(pattern: str) -> str:
    """A pattern without a look ahead, with white space beyond ASCII."""
    return pattern.replace(r"((?:(?!\n\n).)+)", r"((?:\n?[^\n])+)").replace(r"[\.\s]", r"[\.\s\p{Z}]").replace(r"\s*", r"[\s\p{Z}\x0B]*")


def _any_of(x: str, patterns: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, '{p}')" for p in patterns) + ")"


def _tried(field: str, k: int, pattern: str) -> str:
    p, most = _re2(pattern), fixed.SHEET_LONGEST[field]
    tidy = f"array_to_string(list_filter(list_transform(string_split({sql.stripped('raw')}, chr(10)), lambda l: regexp_replace({sql.stripped('l')}, '[ \\t]+', ' ', 'g')), lambda l: l <> ''), chr(10))"
    head = f"substr(v, 1, {most})"
    stop = f"(length({head}) - strpos(reverse({head}), '.') + 1)"
    shorter = f"CASE WHEN length(v) <= {most} THEN v WHEN contains({head}, '.') AND {stop} - 1 > {most // 2} THEN substr({head}, 1, {stop}) ELSE regexp_replace({head}, '[\\s\\p{{Z}}]+$', '') END"
    worth = f"CASE WHEN {_any_of('s', fixed.SHEET_BOILERPLATE)} THEN 0.3::DOUBLE ELSE 1 END * CASE WHEN length(s) > 40 AND NOT regexp_matches(s, '[.!?)\"'':;,0-9%]$') AND regexp_matches(s, '{_WORD}') THEN 0.5::DOUBLE ELSE 1 END"
    if field == "description":
        worth += " * CASE WHEN length(s) < 20 THEN 0.3::DOUBLE ELSE 1 END * CASE WHEN length(s) < 10 THEN 0.3::DOUBLE ELSE 1 END"
    if field == "packaging_info":
        worth += f" * CASE WHEN {_any_of('s', fixed.SHEET_PACKAGING)} THEN 1 ELSE 0.2::DOUBLE END"
    return f"""SELECT doc_id, '{field}' AS field, {k} AS k, s AS value, "at", {worth} AS quality FROM (SELECT doc_id, "at", {shorter} AS s, v FROM (SELECT doc_id, "at", {tidy} AS v FROM
        (SELECT doc_id, regexp_extract(text, '(?ims){p}', 1) AS raw, length(regexp_extract(text, '(?ims)\\A(.*?){p}', 1))::INTEGER AS "at" FROM d WHERE regexp_matches(text, '(?ims){p}')))) WHERE length(v) > 1"""


_TRIED = " UNION ALL ".join(_tried(f, k, p) for f, ps in fixed.SHEET_PATTERNS.items() for k, p in enumerate(ps))


@query(f"""WITH d AS (SELECT doc_id, {_HEAD} || coalesce(text, '') AS text FROM documents), x AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY k) AS r FROM ({_TRIED}) WHERE quality >= 0.1)
    SELECT doc_id, field, value, "at", quality FROM x WHERE r = 1""")
def q_sheet_values(spark, sf):
    """Labelled values in texts, with their places and what they are worth."""
    return sheets.values(_sheets(spark, sf), "doc_id", "text").select("doc_id", "field", "value", "at", "quality")


_LINE = "(?m)" + fixed.SHEET_LINE.replace(r"\u00C0-\u00FF", r"\x{C0}-\x{FF}").replace(r"\s]", r"\s\p{Z}]").replace(r"\s*", r"[\s\p{Z}]*")


@query(f"""WITH d AS (SELECT doc_id, {_HEAD} || coalesce(text, '') AS text FROM documents), l AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_LINE}', 1)) AS k, unnest(regexp_extract_all(text, '{_LINE}', 2)) AS v, generate_subscripts(regexp_extract_all(text, '{_LINE}', 1), 1) AS i FROM d),
    s AS (SELECT doc_id, i, {sql.stripped('k')} AS label, {sql.stripped('v')} AS value FROM l), f AS (SELECT * FROM s WHERE label <> '' AND value <> '' AND length(label) < 60 AND length(value) < 300 AND NOT ({' OR '.join(f"contains(lower(label), '{w}')" for w in fixed.SHEET_SKIPPED)}))
    SELECT doc_id, label, arg_max(value, i) AS value FROM f GROUP BY 1, 2""")
def q_sheet_lines(spark, sf):
    """Label and value lines of texts; the last value of a label holds."""
    return sheets.labelled_lines(_sheets(spark, sf), "doc_id", "text").select("doc_id", F.explode("specs").alias("label", "value"))
