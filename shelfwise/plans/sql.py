"""Parts of the SQL that the queries are held against, written apart from the column expressions."""

from __future__ import annotations

from ..functions import fixed


def strings(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def case(x: str, values: dict) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {k} THEN {v}::DOUBLE" for k, v in values.items()) + " END"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[ \\t\\r\\n]+'), lambda w: w <> '')"


def hits(x: str, keywords: list[str] = fixed.SPEC_KEYWORDS) -> str:
    return f"len(list_filter([{strings(keywords)}], lambda k: contains(lower({x}), k)))"


UNIT = "[0-9]+[.,]?[0-9]*\\s*(mm|cm|m|ml|l|g|kg|stk|pk|µm|%)"


def measurable(x: str) -> str:
    return f"({hits(x, fixed.FIELD_KEYWORDS)} >= 2 OR regexp_matches(lower({x}), '{UNIT}') OR len(regexp_extract_all({x}, '\\w+\\s*[:=]\\s*\\w+')) >= 2)"


def n_sentences(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '[.!?]+'), lambda s: length(trim(s)) > 10))"


def low(x: str) -> str:
    return f"lower(trim({x}))"


def _apart(a: str, b: str, common: list[str], more_a: int, more_b: int) -> str:
    x, y = (f"list_distinct(list_filter({words(v)}, lambda w: w NOT IN ({strings(common)})))" for v in (a, b))
    return f"(len({x}) > {more_a} AND len({y}) > {more_b} AND NOT list_has_any({x}, {y}))"


_N = "len(coalesce(details, []))"
_PARTS = "(len(string_split(specification, ';')) + len(string_split(specification, chr(10))) - 2)"
_COUNT = f"CASE WHEN {_N} > 0 THEN {_N} WHEN specification IS NOT NULL AND {_PARTS} > 0 THEN {_PARTS} + 1 ELSE 0 END"
_TECH = f"coalesce({measurable('specification')}, FALSE)"
_SAME = f"(coalesce({low('specification')} = {low('web_name')}, FALSE) OR coalesce({low('specification')} = {low('description')}, FALSE))"
_ODD = f"((({_COUNT}) < 2 AND NOT {_TECH}) OR ({_N} > 0 AND ({_COUNT}) < 3 AND len(list_filter(details, lambda e: lower(e[1]) IN ({strings(fixed.EXPECTED_DETAILS)}))) = 0))"


def _packs(keys: list[str]) -> str:
    return f"len(list_filter(coalesce(details, []), lambda e: len(list_filter([{strings(keys)}], lambda k: contains(lower(e[1]), k))) > 0)) > 0"


_SLUG = "list_filter(string_split(product_url, '/'), lambda p: p <> '' AND p NOT IN ('nb-no', 'products', 'https:', 'http:', 'www.onemed.no') AND NOT starts_with(p, 'i00'))[-1]"
STATUS = {
    "name": f"CASE WHEN web_name IS NULL AND erp_name IS NULL THEN 'MISSING' WHEN web_name IS NULL THEN 'OK' WHEN regexp_matches(web_name, '^[0-9 \\t\\r\\n/-]+$') THEN 'PROBABLE_ERROR' WHEN length(web_name) < 5 OR {low('web_name')} IN ({strings(fixed.GENERIC_NAMES)}) OR {hits('web_name', fixed.ENGLISH_NAMES)} >= 2 OR (length(web_name) > 3 AND upper(web_name) = web_name) THEN 'SHOULD_IMPROVE' WHEN length(web_name) >= 10 THEN 'STRONG' ELSE 'OK' END",
    "description": f"CASE WHEN description IS NULL AND erp_text IS NULL THEN 'MISSING' WHEN description IS NULL THEN 'OK' WHEN coalesce({low('description')} = {low('web_name')}, FALSE) OR (contains(description, article_number) AND length(description) < 50) THEN 'SHOULD_IMPROVE' WHEN length(description) BETWEEN 10 AND 19 THEN 'WEAK' WHEN length(description) < 20 THEN 'SHOULD_IMPROVE' WHEN length(description) >= 80 AND regexp_matches(description, '[.!?]\\s') THEN 'STRONG' ELSE 'OK' END",
    "specification": f"CASE WHEN specification IS NULL AND {_N} = 0 THEN CASE WHEN erp_specification IS NOT NULL THEN 'OK' WHEN coalesce({measurable('description')}, FALSE) THEN 'WEAK' ELSE 'MISSING' END WHEN {_SAME} THEN 'SHOULD_IMPROVE' WHEN {_ODD} THEN CASE WHEN ({_COUNT}) >= 1 THEN 'WEAK' ELSE 'SHOULD_IMPROVE' END WHEN ({_COUNT}) >= 4 OR (({_COUNT}) >= 2 AND {_TECH}) THEN 'STRONG' ELSE 'OK' END",
    "manufacturer": f"CASE WHEN manufacturer IS NULL AND supplier IS NULL THEN 'MISSING' WHEN manufacturer IS NULL THEN 'OK' WHEN {low('manufacturer')} IN ({strings(fixed.NO_MANUFACTURER)}) THEN 'PROBABLE_ERROR' WHEN length(manufacturer) < 2 THEN 'SHOULD_IMPROVE' ELSE 'OK' END",
    "mfr_number": "CASE WHEN mfr_number IS NULL AND erp_number IS NULL THEN 'MISSING' ELSE 'OK' END",
    "category": f"CASE WHEN category IS NULL AND crumbs IS NULL THEN CASE WHEN {_SLUG} IS NULL THEN 'MISSING' ELSE 'SHOULD_IMPROVE' END WHEN len(crumbs) = 1 OR length(trim(category)) < 3 OR {low('category')} IN ({strings(fixed.NO_CATEGORY)}) THEN 'SHOULD_IMPROVE' ELSE 'OK' END",
    "packaging": f"CASE WHEN packaging IS NOT NULL OR packaging_unit IS NOT NULL OR {_packs(fixed.PACKAGING_KEYS)} THEN 'OK' ELSE 'MISSING' END",
    "image": "CASE WHEN image_quality IS NULL THEN CASE WHEN image_url IS NULL THEN 'MISSING' WHEN NOT image_ok THEN 'SHOULD_IMPROVE' ELSE 'OK' END WHEN image_quality = 'MISSING' OR image_count = 0 THEN 'MISSING' WHEN image_quality = 'FAIL' THEN 'PROBABLE_ERROR' WHEN image_quality = 'PASS' THEN 'OK' ELSE 'SHOULD_IMPROVE' END",
    "brand": "CASE WHEN brand IS NULL THEN 'SHOULD_IMPROVE' ELSE 'OK' END",
    "consistency": f"CASE WHEN {_apart('web_name', 'description', fixed.COMMON_WORDS, 2, 0)} OR {_apart('category', 'web_name', fixed.COMMON_WORDS_OF_CATEGORIES, 1, 1)} THEN 'SHOULD_IMPROVE' ELSE 'OK' END",
}
STATUSES = f"SELECT *, {', '.join(f'{v} AS {k}_status' for k, v in STATUS.items())} FROM v"
_POINTS = {k: f"(CASE {k}_status {' '.join(f'''WHEN '{s}' THEN {p}''' for s, p in fixed.STATUS_POINTS.items())} END)" for k in fixed.FIELD_WEIGHTS}
TOTAL = f"round_even(({' + '.join(f'{v} * {fixed.FIELD_WEIGHTS[k]}' for k, v in _POINTS.items())})::DOUBLE / {sum(fixed.FIELD_WEIGHTS.values())}, 1)"
_ALL = f"[{', '.join(f'{k}_status' for k in fixed.FIELD_WEIGHTS)}]"


def _n(s: str) -> str:
    return f"len(list_filter({_ALL}, lambda x: x = '{s}'))"


OVERALL = f"CASE WHEN {_n('PROBABLE_ERROR')} > 0 THEN 'PROBABLE_ERROR' WHEN {_n('MISSING')} >= 3 THEN 'MISSING' WHEN {_n('MISSING')} > 0 OR {_n('SHOULD_IMPROVE')} > 0 THEN 'SHOULD_IMPROVE' WHEN {_n('WEAK')} > 0 THEN 'WEAK' WHEN {_n('STRONG')} >= 5 THEN 'STRONG' ELSE 'OK' END"

_X = "coalesce(web_name, erp_name)"
_D = "coalesce(description, erp_text)"
_S = "specification"
_M = "coalesce(manufacturer, supplier)"
_HOLDER = f"({strings(fixed.PLACEHOLDERS)})"
_DIGITS = f"regexp_matches({_X}, '^[0-9 \\t\\r\\n/-]+$')"
_AS_NAME = f"coalesce({low(_D)} = {low('web_name')}, FALSE)"
_ABOUT = f"(NOT {_AS_NAME} AND contains({_D}, article_number) AND length({_D}) < 50)"
_ALL_SPEC = "(coalesce(specification, '') || ' ' || coalesce(array_to_string(list_transform(details, lambda e: e[1] || ': ' || e[2]), ' '), ''))"
_NS = f"CASE WHEN {_N} > 0 THEN {_N} WHEN {_S} IS NOT NULL THEN {_PARTS} + 1 ELSE 0 END"
_KEYS = f"len(list_filter(coalesce(details, []), lambda e: lower(e[1]) IN ({strings(fixed.KEY_DETAILS)})))"
_UNITS = f"len(regexp_extract_all(lower({_ALL_SPEC}), '{UNIT}'))"
_SPEC_NAME, _SPEC_TEXT = f"coalesce({low(_S)} = {low('web_name')}, FALSE)", f"coalesce({low(_S)} = {low('description')}, FALSE)"
_PACK = "(packaging IS NOT NULL OR packaging_unit IS NOT NULL)"
_VAGUE = f"coalesce({low(_M)} IN {_HOLDER}, FALSE)"
_AREA = {
    "name": f"CASE WHEN {_X} IS NULL THEN 0 ELSE (CASE WHEN length({_X}) < 5 THEN 10 WHEN length({_X}) < 15 THEN 20 ELSE 30 END) + (CASE WHEN {low(_X)} IN {_HOLDER} OR {_DIGITS} THEN 0 ELSE 25 END) + (CASE WHEN upper({_X}) = {_X} AND length({_X}) > 3 THEN 5 ELSE 15 END) + (CASE WHEN web_name IS NOT NULL AND erp_name IS NOT NULL THEN 30 WHEN web_name IS NOT NULL THEN 25 ELSE 15 END) END",
    "description": f"CASE WHEN {_D} IS NULL THEN 0 ELSE (CASE WHEN length({_D}) < 20 THEN 5 WHEN length({_D}) < 80 THEN 15 WHEN length({_D}) < 200 THEN 25 ELSE 30 END) + (CASE WHEN {n_sentences(_D)} >= 3 THEN 25 WHEN {n_sentences(_D)} = 2 THEN 20 WHEN {n_sentences(_D)} = 1 THEN 10 ELSE 5 END) + (CASE WHEN {_AS_NAME} THEN 0 WHEN {_ABOUT} OR {low(_D)} IN {_HOLDER} THEN 5 WHEN {hits(_D)} >= 3 THEN 25 WHEN {hits(_D)} >= 1 THEN 20 ELSE 15 END) + (CASE WHEN description IS NOT NULL AND erp_text IS NOT NULL THEN 20 WHEN description IS NOT NULL THEN 15 ELSE 10 END) END",
    "specification": f"CASE WHEN {_S} IS NULL AND {_N} = 0 AND erp_specification IS NULL THEN 0 ELSE (CASE WHEN ({_NS}) >= 4 THEN 35 WHEN ({_NS}) >= 2 THEN 25 WHEN ({_NS}) = 1 THEN 15 ELSE 5 END) + (CASE WHEN {hits(_ALL_SPEC)} >= 4 AND {_UNITS} >= 2 THEN 30 WHEN {hits(_ALL_SPEC)} >= 2 OR {_UNITS} >= 1 THEN 20 WHEN {hits(_ALL_SPEC)} >= 1 THEN 10 ELSE 5 END) + (CASE WHEN {_KEYS} >= 2 THEN 20 WHEN {_KEYS} = 1 THEN 10 ELSE 5 END) + (CASE WHEN {_SPEC_NAME} OR {_SPEC_TEXT} THEN 0 ELSE 15 END) END",
    "images": "CASE WHEN image_quality IS NULL THEN CASE WHEN image_url IS NULL THEN 0 ELSE 40 END WHEN image_count = 0 THEN 0 ELSE 30 + CASE WHEN image_count >= 2 THEN 20 ELSE 10 END + CASE WHEN image_avg >= 80 THEN 50 WHEN image_avg >= 60 THEN 40 WHEN image_avg >= 40 THEN 25 ELSE 10 END END",
    "attributes": f"greatest(0, (CASE WHEN {_N} >= 5 THEN 40 WHEN {_N} >= 3 THEN 30 WHEN {_N} >= 1 THEN 15 ELSE 0 END) + (CASE WHEN brand IS NOT NULL THEN 15 ELSE 0 END) + (CASE WHEN {_PACK} THEN 15 ELSE 0 END) + (CASE WHEN category IS NOT NULL OR crumbs IS NOT NULL THEN 15 ELSE 0 END) - (CASE WHEN len(crumbs) = 1 THEN 5 ELSE 0 END) + (CASE WHEN {_M} IS NOT NULL THEN 15 ELSE 0 END) - (CASE WHEN {_VAGUE} THEN 10 ELSE 0 END))",
    "documents": "CASE WHEN pdf THEN 100 ELSE 0 END",
    "manufacturer": f"CASE WHEN {_M} IS NULL THEN 0 ELSE least(100, (CASE WHEN {_VAGUE} THEN 10 WHEN length({_M}) < 2 THEN 20 ELSE 70 END) + (CASE WHEN manufacturer IS NOT NULL AND supplier IS NOT NULL THEN 30 WHEN manufacturer IS NOT NULL THEN 15 ELSE 0 END)) END",
    "category": f"CASE WHEN len(crumbs) >= 3 THEN 100 WHEN len(crumbs) = 2 THEN 85 WHEN len(crumbs) = 1 THEN 60 WHEN category IS NULL THEN 0 WHEN {low('category')} IN {_HOLDER} THEN 15 ELSE 70 END",
    "packaging": f"CASE WHEN {_PACK} OR {_packs(fixed.PACKAGING_AREA_KEYS)} THEN 100 ELSE 0 END",
}
#: By area, the issues that count as grave, in the order in which they are found.
_GRAVE = {
    "name": [(f"{_X} IS NULL", "'Produktnavn mangler'"), (f"length({_X}) < 5", f"'For kort (' || length({_X}) || ' tegn)'"), (f"{low(_X)} IN {_HOLDER}", "'Generisk/placeholder-navn'"), (f"{_DIGITS} AND {low(_X)} NOT IN {_HOLDER}", "'Kun tall/tegn, mangler beskrivende tekst'")],
    "description": [(f"{_D} IS NULL", "'Ingen beskrivelse funnet'"), (f"length({_D}) < 20", f"'For kort (' || length({_D}) || ' tegn, minimum 20)'"), (_AS_NAME, "'Identisk med produktnavn'"), (_ABOUT, "'Inneholder hovedsakelig artikkelnummer'"), (f"{low(_D)} IN {_HOLDER} AND NOT {_AS_NAME} AND NOT {_ABOUT}", "'Ser ut som placeholder-tekst'")],
    "specification": [(f"{_S} IS NULL AND {_N} = 0 AND erp_specification IS NULL", "'Ingen spesifikasjoner funnet'"), (f"{_S} IS NULL AND {_N} = 0 AND erp_specification IS NOT NULL", "'Svært få strukturerte attributter'"), (_SPEC_NAME, "'Identisk med produktnavn'")],
    "images": [("image_quality IS NULL AND image_url IS NULL", "'Ingen bilder funnet'"), ("image_quality IS NOT NULL AND image_count = 0", "'Hovedbilde mangler'"), ("image_quality IS NOT NULL AND image_count > 0 AND image_avg < 40", "'Lav bildekvalitet (score ' || image_avg::INTEGER || ')'")],
    "attributes": [(f"{_N} = 0", "'Ingen strukturerte tekniske detaljer'"), (_VAGUE, "'Produsent er en placeholder-verdi'"), (f"{_M} IS NULL", "'Produsentinformasjon mangler'")],
    "documents": [], "manufacturer": [(f"{_M} IS NULL", "'Produsent mangler'"), (_VAGUE, "'Placeholder-verdi'")], "category": [], "packaging": [],
}
GRAVE = ", ".join(
    "list_filter([" + ", ".join([*(f"CASE WHEN {w} THEN {x} END" for w, x in rules), "NULL::VARCHAR"]) + f"], lambda x: x IS NOT NULL) AS {k}_grave" for k, rules in _GRAVE.items()
)
AREAS = f"SELECT *, {', '.join(f'{v} AS {k}_score' for k, v in _AREA.items())}, {GRAVE} FROM v"
AREA_MEAN = f"round_even(({' + '.join(f'{k}_score * {w}' for k, w in fixed.AREA_WEIGHTS.items())})::DOUBLE / {sum(fixed.AREA_WEIGHTS.values())}, 1)"
PRIORITY = "CASE WHEN overall < 40 OR description_score = 0 OR images_score = 0 THEN 'Kritisk' WHEN overall < 60 THEN 'Høy' WHEN overall < 80 THEN 'Middels' ELSE 'Lav' END"

_SCORES = ", ".join(f"{{'score': {k}_score, 'at': {i}, 'label': '{fixed.AREA_LABELS[k]}', 'grave': {k}_grave}}" for i, k in enumerate(fixed.AREA_WEIGHTS))
WHY_LOW = f"""o AS (SELECT *, {AREA_MEAN} AS overall, [{_SCORES}] AS areas FROM a),
    w AS (SELECT key, overall, list_transform(list_filter(areas, lambda x: x.score = 0), lambda x: x.label) AS missing, list_transform(list_filter(areas, lambda x: x.score > 0 AND x.score < 75), lambda x: x.label) AS weak,
        flatten(list_transform(list_sort(areas), lambda x: x.grave)) AS grave FROM o)
    SELECT key, CASE WHEN overall >= 80 AND len(missing) = 0 THEN '' ELSE concat_ws('. ', CASE WHEN len(missing) BETWEEN 1 AND 3 THEN 'Mangler: ' || array_to_string(missing, ', ') WHEN len(missing) > 3 THEN 'Mangler ' || len(missing) || ' områder inkl. ' || array_to_string(missing[1:2], ', ') END,
        CASE WHEN len(weak) > 0 THEN 'Svak: ' || array_to_string(weak[1:3], ', ') END, CASE WHEN len(grave) > 0 THEN array_to_string(grave[1:2], '; ') END) END AS why_low FROM w"""

LINES = "SELECT doc_id, x, n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents)"
def rx(name: str, pattern: str) -> str:
    """A pattern as DuckDB reads it."""
    return ("(?i)" if name in fixed.ANY_CASE else "") + pattern.replace("'", "''")


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def junk(x: str) -> str:
    tokens = f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"
    rules = " ".join(f"WHEN regexp_matches({x}, '{rx(k, p)}') THEN '{k}'" for k, p in fixed.JUNK_PATTERNS.items())
    return f"""CASE WHEN length({x}) < 3 THEN 'short' {rules} WHEN len({tokens}) >= 3 AND len(list_filter({tokens}, lambda w: regexp_matches(w, '^[0-9.,/\\-x×]+$'))) > 0.4 * len({tokens}) THEN 'numbers'
        WHEN length({x}) - length(replace({x}, '/', '')) >= 3 AND NOT regexp_matches({x}, '\\b(XS|S|M|L|XL|XXL)\\b') THEN 'slashes' END"""


#: Lines without white space at their ends.
STRIPPED = f"SELECT doc_id, n, {stripped('x')} AS x FROM ({LINES})"
JUNK = junk("x")
_REJECT = " ".join(f"WHEN regexp_matches(t, '{rx(k, p)}') THEN '{k}'" for k, p in fixed.REJECTED.items())
GATE = f"""CASE WHEN t = '' THEN 'empty' WHEN {n_sentences('t')} < 2 THEN 'short' WHEN length(t) > 1500 THEN 'long' {_REJECT}
    WHEN len(ls) > 5 AND len(list_filter(ls, lambda l: length({stripped('l')}) < 30)) > 0.6 * len(ls) THEN 'table-like'
    WHEN len(list_filter(ls, lambda l: length({stripped('l')}) > 50 AND regexp_matches({stripped('l')}, '\\b(og|for|som|med|til|av|er|i)$') AND NOT regexp_matches({stripped('l')}, '^[•*-]'))) > 0 THEN 'broken' END"""


def _cut(x: str, k: str) -> str:
    return f"regexp_replace({x}, '{fixed.DIMENSION_PATTERNS[k]}', '', 'g')"


_BASE = "lower(trim(family_name))"
for _k in ("size", "number", "gauge", "dimension", "volume", "ch", "suture", "side"):
    _BASE = _cut(_BASE, _k)
for _words in (fixed.COLOURS, fixed.STRIP_TOKENS):
    _BASE = f"regexp_replace({_BASE}, '\\b({'|'.join(_words)})\\b', '', 'g')"
_BASE = f"regexp_replace({_cut(_BASE, 'length')}, '(^|[^0-9A-Za-z_])[,;/-]+($|[^0-9A-Za-z_])', '\\1 \\2', 'g')"
_BASE = f"regexp_replace(trim(regexp_replace(regexp_replace({_BASE}, '([0-9a-z_])-([0-9a-z_])', '\\1\\2', 'g'), '\\s+', ' ', 'g')), '\\s+[0-9]+$', '')"


def _got(x: str, k: str, more: str = "", before: str = "") -> str:
    """What a pattern finds in a text, with a unit after it or a mark before it."""
    p = fixed.DIMENSION_PATTERNS[k]
    unit = f" || regexp_extract({x}, '{p}', 2)" if more else ""
    return f"('{before}' || nullif(regexp_extract({x}, '{p}', 1), ''){unit})"


def _title(x: str) -> str:
    return f"(upper({x}[1]) || {x}[2:])"


_PAIR = ("fname", "fspec")
_COLOUR_RX = f"\\b({'|'.join(fixed.COLOURS)})\\b"
_FOUND = {
    "size": "coalesce(" + ", ".join(f"upper({_got(x, 'size')}), {_got(x, 'number')}" for x in _PAIR) + ")",
    "gauge": "coalesce(" + ", ".join(f"{_got(x, 'gauge')} || 'G'" for x in _PAIR) + ")",
    "dimension": "coalesce(" + ", ".join(_got(x, "dimension", "unit") for x in _PAIR) + ")",
    "volume": "coalesce(" + ", ".join(_got(x, "volume", "unit") for x in _PAIR) + ")",
    "ch": "coalesce(" + ", ".join(_got(x, "ch", before="CH") for x in _PAIR) + ")",
    "suture": "coalesce(" + ", ".join(_got(x, "suture") for x in _PAIR) + ")",
    "length": f"CASE WHEN {_got('fname', 'dimension')} IS NULL THEN coalesce({_got('fname', 'length', 'unit')}, CASE WHEN {_got('fspec', 'dimension')} IS NULL THEN {_got('fspec', 'length', 'unit')} END) END",
    "colour": "coalesce(" + ", ".join(_title(f"nullif(regexp_extract({x}, '{_COLOUR_RX}', 1), '')") for x in _PAIR) + ")",
    "side": "coalesce(" + ", ".join(_title(_got(x, "side")) for x in _PAIR) + ")",
    "width": "NULL::VARCHAR", "diameter": "NULL::VARCHAR",
}
_DETAIL = {k: f"list_filter(details, lambda e: regexp_matches(lower(trim(e[1])), '{p}') AND trim(e[2]) <> '')[1][2]" for k, p in fixed.DIMENSION_KEYS.items()}
_DIM_COLUMNS = ", ".join(f"coalesce({_FOUND[k]}, {_DETAIL.get(k, 'NULL::VARCHAR')}) AS dim_{k}" for k in fixed.DIMENSION_NAMES)
_BRAND = "CASE WHEN lower(trim(brand)) NOT IN ('', 'none', 'ukjent', 'unknown') THEN lower(trim(brand)) WHEN lower(trim(supplier)) NOT IN ('', 'none', 'ukjent') THEN lower(trim(supplier)) ELSE '' END"
RECORDS = f"""rec0 AS (SELECT key, article_number, family_name AS name, {_BRAND} AS brand, family_category AS category, details, lower(family_name) AS fname, lower(coalesce(family_specification, '')) AS fspec, {_BASE} AS base FROM v),
    rec AS (SELECT *, coalesce(nullif(brand, ''), '_unknown_') || '||' || base AS group_key, {_DIM_COLUMNS} FROM rec0 WHERE base <> '')"""
_HAS = f"coalesce({', '.join(f'dim_{k}' for k in fixed.DIMENSION_NAMES)}) IS NOT NULL"
_LOW = "least(cap, CASE WHEN nd < 2 THEN 30 WHEN NOT typed THEN 40 ELSE 100 END)"
_HALVES = " ".join(f"WHEN {x} THEN {y}" for x, y in fixed.REDUCED_HALVES.items())
GROUPS = f"""g AS (SELECT group_key, count(*) AS n, min(brand) AS brand, min(key) AS first_key, count(DISTINCT category) AS nc, count_if({_HAS}) AS nd, count_if(NOT {_HAS}) AS nw, min(CASE WHEN NOT {_HAS} THEN key END) AS wk,
        {' OR '.join(f"bool_and(contains(fname, '{k}'))" for k in fixed.TYPE_KEYWORDS)} AS typed, greatest({', '.join(f'count(dim_{k})' for k in fixed.DIMENSION_NAMES)}) AS most,
        array_to_string(list_filter([{', '.join(f"CASE WHEN count(DISTINCT dim_{k}) >= 2 THEN '{v}' END" for k, v in fixed.DIMENSION_NAMES.items())}], lambda x: x IS NOT NULL), ',') AS varying FROM rec GROUP BY group_key HAVING count(*) >= 2),
    h AS (SELECT *, least(100, greatest(0, 30 + CASE WHEN brand = '' THEN -10 ELSE 20 END + CASE WHEN nd >= 2 THEN 25 WHEN nd = 1 THEN 5 ELSE 0 END + CASE WHEN typed THEN 15 ELSE 0 END + CASE WHEN nc = 1 THEN 10 WHEN nc > 1 THEN -5 ELSE 0 END
        + CASE WHEN n > 15 THEN -5 WHEN n >= 3 THEN 5 ELSE 0 END + CASE WHEN most * 100 >= n * 60 THEN 10 ELSE 0 END)) AS raw FROM g),
    h2 AS (SELECT *, CASE WHEN nd < 2 THEN least(raw, 40) ELSE raw END AS cap FROM h),
    fam AS (SELECT 'FAM-' || substr(sha256(group_key), 1, 16) AS family_id, group_key, n, score, varying, score < 65 OR varying = '' AS needs_review, CASE WHEN nw = 1 THEN wk END AS mother_key, first_key FROM
        (SELECT *, (CASE WHEN brand = '' THEN CASE {_LOW} {_HALVES} ELSE floor(({_LOW} * 85 + 50) / 100) END ELSE cap END)::BIGINT AS score FROM h2))"""

_M = "least(l_orderkey % 1000 + 1.0, l_partkey % 1200 + 1.0)::DOUBLE"
IMAGE = {
    "resolution": f"CASE WHEN {_M} >= 800 THEN 100.0 WHEN {_M} >= 400 THEN 50 + 50 * ({_M} - 400) / 400 ELSE 50 * {_M} / 400 END::DOUBLE",
    "blur": "CASE WHEN l_quantity * 3 >= 100 THEN 100.0 WHEN l_quantity * 3 >= 30 THEN 40 + 60 * (l_quantity * 3 - 30) / 70 ELSE 40 * l_quantity * 3 / 30 END::DOUBLE",
    "brightness": "CASE WHEN l_quantity * 5 BETWEEN 80 AND 220 THEN 100.0 WHEN l_quantity * 5 >= 40 AND l_quantity * 5 < 80 THEN 60 + 40 * (l_quantity * 5 - 40) / 40 WHEN l_quantity * 5 > 220 AND l_quantity * 5 <= 240 THEN 60 + 40 * (240 - l_quantity * 5) / 20 ELSE 20.0 END::DOUBLE",
    "contrast": "CASE WHEN l_quantity >= 40 THEN 100.0 WHEN l_quantity >= 15 THEN 40 + 60 * (l_quantity - 15) / 25 ELSE 40 * l_quantity / 15 END::DOUBLE",
    "background": "CASE WHEN l_discount * 4 >= 0.30::DOUBLE THEN 100.0::DOUBLE WHEN l_discount * 4 >= 0.15::DOUBLE THEN 50 + 50 * (l_discount * 4 - 0.15::DOUBLE) / (0.30::DOUBLE - 0.15::DOUBLE) ELSE 50 * (l_discount * 4) / 0.15::DOUBLE END",
    "edge": "CASE WHEN l_tax / 3 >= 0.02::DOUBLE THEN 100.0::DOUBLE WHEN l_tax / 3 >= 0.005::DOUBLE THEN 40 + 60 * (l_tax / 3 - 0.005::DOUBLE) / (0.02::DOUBLE - 0.005::DOUBLE) ELSE 40 * (l_tax / 3) / 0.005::DOUBLE END",
    "fill": "CASE WHEN l_quantity / 50 BETWEEN 0.10::DOUBLE AND 0.75::DOUBLE THEN 100.0::DOUBLE WHEN l_quantity / 50 >= 0.05::DOUBLE AND l_quantity / 50 < 0.10::DOUBLE THEN 50 + 50 * (l_quantity / 50 - 0.05::DOUBLE) / 0.05::DOUBLE WHEN l_quantity / 50 > 0.75::DOUBLE AND l_quantity / 50 <= 0.90::DOUBLE THEN 50 + 50 * (0.90::DOUBLE - l_quantity / 50) / 0.15::DOUBLE WHEN l_quantity / 50 < 0.05::DOUBLE THEN 50 * (l_quantity / 50) / 0.05::DOUBLE ELSE 30.0::DOUBLE END",
}
IMAGE_OVERALL = f"({' + '.join(f'({IMAGE[k]}) * {w}' for k, w in fixed.IMAGE_WEIGHTS.items())})::DOUBLE / 100"
