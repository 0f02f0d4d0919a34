"""The catalogue as two sources: what the website has and what the ERP has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt to as many tasks as run at once, if it is read in fewer parts: a small file, or one whose rows lie in a single group.

    For work that is done row by row and takes far longer than reading. What has parts enough stays where it lies.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


#: A website row and an ERP row of each part, side by side. Values and gaps follow from the key, so that the rules' branches
#: occur; the expressions mean the same to Spark and to the SQL that results are held against. Details are "key=value|...",
#: breadcrumbs "a > b > c".
COLUMNS = {
    "key": "p_partkey",
    "article_number": "CAST(p_partkey AS STRING)",
    "web_name": """CASE p_partkey % 20 WHEN 0 THEN NULL WHEN 2 THEN upper(p_name) WHEN 3 THEN 'ABCD' WHEN 4 THEN '12-34 / 5' WHEN 5 THEN NULL WHEN 6 THEN 'item' WHEN 7 THEN 'box of gloves'
        WHEN 8 THEN concat(p_name, ' of a longer name') WHEN 9 THEN 'n/a' WHEN 10 THEN NULL WHEN 11 THEN 'ABCDE' WHEN 12 THEN 'Ab' WHEN 13 THEN 'ABC' WHEN 15 THEN NULL ELSE p_name END""",
    "erp_name": "CASE WHEN p_partkey % 4 <> 1 AND p_partkey % 40 <> 10 THEN concat(upper(substr(p_name, 1, 1)), substr(p_name, 2)) END",
    "description": """CASE p_partkey % 12 WHEN 0 THEN concat('Robust ', p_name, ' for daily use. Made of strong material with a long life. Sold in sizes of 10 mm and 20 cm for every need.')
        WHEN 1 THEN p_name WHEN 2 THEN NULL WHEN 3 THEN 'short' WHEN 4 THEN 'tiny text here' WHEN 5 THEN concat('Article ', CAST(p_partkey AS STRING), ' as it is sold') WHEN 6 THEN 'xxx' WHEN 7 THEN NULL
        WHEN 8 THEN concat(p_name, ' is a product of which much can be said. It lasts for years, is easy to clean and comes in several colours. Every part of it is made of cotton. Wash it warm and dry it in the shade of a tree.')
        WHEN 9 THEN 'Of his own. One sentence only is here, no more' ELSE 'On his own he runs far in his hurry, no' END""",
    "erp_text": "CASE WHEN p_partkey % 3 = 0 THEN concat('Text of the ERP on ', p_name) END",
    "specification": """CASE p_partkey % 11 WHEN 0 THEN NULL WHEN 1 THEN concat('size ', CAST(p_size AS STRING), ' mm; color red; weight 2 kg; latex') WHEN 2 THEN 'fin' WHEN 3 THEN p_name WHEN 4 THEN 'tiny text here'
        WHEN 5 THEN 'a; b' WHEN 6 THEN concat('Materiale: Nitril', chr(10), 'Farge: hvit') WHEN 7 THEN '40 %' WHEN 8 THEN 'x=1 y=2 no' WHEN 9 THEN concat(CAST(p_size AS STRING), ' stk') ELSE NULL END""",
    "erp_specification": "CASE WHEN p_partkey % 5 = 0 THEN concat('size ', CAST(p_size AS STRING)) END",
    "details": """CASE p_partkey % 9 WHEN 0 THEN 'Materiale=Nitril|Farge=red|Lengde=20 cm|Vekt=1 kg|Size=M' WHEN 1 THEN 'Antall i pakningen=100|Kolli=10' WHEN 2 THEN 'Foo=1|Bar=2' WHEN 3 THEN 'Foo=1|Bar=2|Baz=3'
        WHEN 4 THEN concat('Size=', CAST(p_size AS STRING)) WHEN 5 THEN 'Pall:=5|Produsent=Acme' END""",
    "manufacturer": "CASE p_partkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 'unknown' WHEN 2 THEN 'X' WHEN 3 THEN NULL WHEN 4 THEN 'todo' ELSE p_brand END",
    "supplier": "CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Test' WHEN 2 THEN NULL ELSE concat('Supplier ', CAST(p_partkey % 7 AS STRING)) END",
    "mfr_number": "CASE WHEN p_partkey % 4 = 0 THEN concat('MF-', CAST(p_partkey AS STRING)) END",
    "erp_number": "CASE WHEN p_partkey % 3 = 0 THEN concat('S', CAST(p_partkey AS STRING)) END",
    "brand": "CASE WHEN p_partkey % 7 <> 0 THEN p_brand END",
    "category": "CASE p_partkey % 10 WHEN 0 THEN NULL WHEN 1 THEN 'ab' WHEN 2 THEN 'annet' WHEN 3 THEN NULL WHEN 4 THEN 'n/a' ELSE p_type END",
    "crumbs": "CASE p_partkey % 7 WHEN 0 THEN concat('Home > Care > ', p_type) WHEN 1 THEN 'Home' WHEN 2 THEN concat('Home > ', p_type) END",
    "packaging": "CASE WHEN p_partkey % 9 NOT IN (0, 1, 5) AND p_partkey % 4 <> 3 THEN concat('box of ', CAST(p_size AS STRING)) END",
    "packaging_unit": "CASE WHEN p_partkey % 8 = 3 THEN concat(CAST(p_size AS STRING), ' stk') END",
    "image_url": "CASE WHEN p_partkey % 10 <> 0 THEN concat('http://img/', CAST(p_partkey AS STRING)) END",
    "image_ok": "CASE p_partkey % 5 WHEN 0 THEN FALSE WHEN 1 THEN TRUE END",
    "image_quality": "CASE p_partkey % 8 WHEN 0 THEN 'PASS' WHEN 1 THEN 'PASS_WITH_NOTES' WHEN 2 THEN 'REVIEW' WHEN 3 THEN 'FAIL' WHEN 4 THEN 'MISSING' END",
    "image_count": "CAST(p_partkey % 4 AS INTEGER)",
    "image_avg": "CAST(p_partkey * 37 % 101 AS DOUBLE)",
    "image_issues": "CASE WHEN p_partkey % 16 = 1 THEN 'blurry image' END",
    "product_url": "CASE WHEN p_partkey % 2 = 0 THEN concat('https://www.onemed.no/nb-no/products/i00', CAST(p_partkey AS STRING), '/', replace(lower(p_type), ' ', '-')) END",
    "found": "p_partkey % 13 <> 0",
    "pdf": "p_partkey % 3 = 0",
    "verification": "CASE p_partkey % 7 WHEN 0 THEN 'EXACT_MATCH' WHEN 1 THEN 'NORMALIZED_MATCH' WHEN 2 THEN 'SKU_IN_PAGE' WHEN 3 THEN 'MISMATCH' WHEN 4 THEN 'CDN_ONLY' WHEN 5 THEN 'AMBIGUOUS' ELSE 'UNVERIFIED' END",
    "family_name": """CASE p_partkey % 16 WHEN 0 THEN concat(p_name, ' XL') WHEN 1 THEN concat(p_name, ' str 4') WHEN 2 THEN concat(p_name, ' 18G x 40mm') WHEN 3 THEN concat(p_name, ' 5x5cm') WHEN 4 THEN concat(p_name, ' 30 ml')
        WHEN 5 THEN concat(p_name, ' CH 12') WHEN 6 THEN concat(p_name, ' USP 2-0') WHEN 7 THEN concat(p_name, ' left') WHEN 8 THEN concat(p_name, ' 25 mm') WHEN 9 THEN concat('KD-Ject ', p_name) WHEN 10 THEN concat(p_name, ', engangs')
        WHEN 11 THEN concat(p_name, ' - 7') WHEN 12 THEN concat(p_name, ' tape') ELSE p_name END""",
    "family_category": "CASE WHEN p_partkey % 5 <> 0 THEN p_type END",
    "family_specification": "CASE p_partkey % 6 WHEN 0 THEN concat('size ', CAST(p_size AS STRING)) WHEN 1 THEN 'M rosa AQL 1,5' WHEN 2 THEN '10ml ch14 40cm' END",
    **{c: c for c in ("p_name", "p_brand", "p_size", "p_type", "p_retailprice")},
}


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """details as a map, breadcrumbs as an array, next to the plain columns."""
    rows = spread(table(spark, sf_dir, "part")).select(*[F.expr(v).alias(k) for k, v in COLUMNS.items()])
    return rows.withColumns({"details": F.str_to_map("details", F.lit(r"\|"), F.lit("=")), "crumbs": F.split("crumbs", " > ")})


#: The same view as SQL; details are a list of [key, value].
PRODUCTS_SQL = f"""SELECT * REPLACE (list_transform(string_split(details, '|'), lambda e: string_split(e, '=')) AS details, string_split(crumbs, ' > ') AS crumbs)
    FROM (SELECT {", ".join(f"{v} AS {k}" for k, v in COLUMNS.items())} FROM part)"""


#: A shop's markup for each page, put where its body begins: structured data, breadcrumbs, sections, tables and lists whose
#: forms follow from the page's id. The expressions mean the same to Spark and to the SQL.
_ID = "CAST(page_id AS STRING)"
PAGE_PARTS = {
    "product": f"""CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN concat('<script type="application/ld+json">{{"@type": "Product", "name": "Product ', {_ID}, '", "description": "Short text on product ', {_ID}, '", "sku": "S', {_ID},
        '", "brand": {{"@type": "Brand", "name": "Maker ', CAST(page_id % 7 AS STRING), '"}}, "offers": {{"@type": "Offer", "price": ', CAST(page_id % 90 AS STRING), '.5}}}}</script>')
        WHEN 2 THEN concat('<script type="application/ld+json">[{{"@type": "Product", "name": "First", "brand": "Plain"}}, {{"@type": "Product", "name": "Second ', {_ID}, '", "sku": ', {_ID}, ', "image": "https://img/', {_ID}, '.png"}}]</script>')
        WHEN 3 THEN '<script type="application/ld+json">{{"@type": "Product", "name": "broken"</script>'
        ELSE concat('<script type="application/ld+json">{{"@graph": [{{"@type": "Product", "name": "Hidden ', {_ID}, '"}}, [{{"@type": "Offer", "price": 1}}]]}}</script>') END""",
    "trail": f"""CASE page_id % 3 WHEN 0 THEN concat('<script type="application/ld+json">{{"@type": "BreadcrumbList", "itemListElement": [{{"position": 2, "name": "Group ', CAST(page_id % 7 AS STRING), '"}}, {{"position": 1, "item": {{"name": "Home"}}}}, {{"position": 3, "name": ""}}]}}</script>')
        WHEN 1 THEN concat('<div class="breadcrumb-nav"><a href="/">Home</a> <a href="/c"> Care </a><a>›</a><a href="/g">Group ', CAST(page_id % 7 AS STRING), '</a></div>') ELSE '' END""",
    "section": f"""CASE page_id % 4 WHEN 0 THEN concat('<div id="accordionItem_description"><p>A longer text that says all there is to say on product ', {_ID}, ' and its use.</p><ul><li>one</li><li> two </li></ul></div>')
        WHEN 1 THEN '<div id="accordionItem_description"><p>Too short</p></div><div class="accordion-desc">A text of the second<br>choice for pages</div>' ELSE '' END""",
    "details": f"""CASE page_id % 6 WHEN 0 THEN concat('<div id="accordionItem_specifications"><table><tr><td>Farge</td><td>blå ', {_ID}, '</td></tr><tr><td>Antall i pakningen</td><td>100 stk</td></tr><tr><td>Antall i transport-pakke</td><td>10</td></tr></table></div>')
        WHEN 1 THEN concat('<dl><dt>Vekt:</dt><dd>', {_ID}, ' kg</dd><dt>Produsent</dt><dd>Acme</dd><dt>alone</dt></dl>') WHEN 2 THEN '<ul class="spec-list"><li>Form: rund: flat</li><li>no pair</li><li>Antall på pall: 5</li></ul>'
        WHEN 3 THEN '<table><tr><th>Farge</th><td>red</td></tr><tr><td>Farge</td><td>blue</td></tr><tr><td>one cell</td></tr></table>' ELSE concat('<p>Lev. art. nr: AB-', {_ID}, ' og 50 stk per pakning</p>') END""",
}


def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and html: each page with a shop's markup at the start of its body."""
    added = F.concat(*[F.expr(x) for x in PAGE_PARTS.values()])
    return spread(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", F.replace("html", F.lit("<body>"), F.concat(F.lit("<body>"), added)).alias("html"))


PRODUCT_PAGES_SQL = f"SELECT page_id, replace(html, '<body>', '<body>' || {' || '.join(PAGE_PARTS.values())}) AS html FROM pages"
