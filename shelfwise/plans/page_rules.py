"""Queries on product pages. The view says by page_id what a page holds, and so does their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import linked_data, product_pages
from ..sources import page_index, shared
from ..sources.views import PRODUCT_PAGES_SQL, table
from ..sources.views import product_pages as pages_view
from .catalog import query

c = F.col

_SCRIPTS = f"""WITH v AS ({PRODUCT_PAGES_SQL}), s AS (SELECT page_id, unnest(x) AS json, generate_subscripts(x, 1) - 1 AS script FROM
    (SELECT page_id, regexp_extract_all(html, '<script type="application/ld\\+json">(.*?)</script>', 1) AS x FROM v)), j AS (SELECT page_id, script, json::JSON AS json FROM s WHERE json_valid(json))"""


@query(f"""{_SCRIPTS} SELECT page_id, script::INTEGER AS script, len(regexp_extract_all(t.fullkey, '\\."[^"]*"|\\.[^.\\[]+|\\[[0-9]+\\]'))::INTEGER AS depth, t.value ->> '@type' AS type, t.value ->> 'name' AS name
    FROM j, json_tree(j.json) t WHERE t.type = 'OBJECT' AND t.value ->> '@type' IS NOT NULL""")
def q_jsonld_nodes(spark, sf):
    """Every typed object in the pages' JSON-LD, at any depth."""
    found = linked_data.nodes(linked_data.scripts(pages_view(spark, sf)))
    return found.select(c("page").alias("page_id"), "script", F.size("path").alias("depth"), "type", linked_data.text_at(c("node"), "$.name").alias("name"))


@query(f"""{_SCRIPTS}, t AS (SELECT page_id, script, 0 AS k, json AS x FROM j WHERE json_type(json) = 'OBJECT' UNION ALL SELECT page_id, script, e.key::INTEGER, e.value FROM j, json_each(j.json) e WHERE json_type(j.json) = 'ARRAY'),
    p AS (SELECT page_id, arg_max(x, script * 1000 + k) AS x, arg_max(coalesce(x -> 'brand' ->> 'name', x ->> 'brand'), script * 1000 + k) FILTER (coalesce(x -> 'brand' ->> 'name', x ->> 'brand') IS NOT NULL) AS brand FROM t WHERE x ->> '@type' = 'Product' GROUP BY 1),
    b AS (SELECT page_id, 'Home > Group ' || page_id % 7 AS crumbs FROM pages WHERE page_id % 3 = 0)
    SELECT coalesce(p.page_id, b.page_id) AS page_id, x ->> 'name' AS name, x ->> 'description' AS description, x ->> 'sku' AS sku, x ->> 'image' AS image, x -> 'offers' ->> 'price' AS price, brand, crumbs FROM p FULL JOIN b ON p.page_id = b.page_id""")
def q_jsonld_products(spark, sf):
    """The product and the breadcrumbs that each page's JSON-LD names."""
    return linked_data.products(pages_view(spark, sf)).select(c("page").alias("page_id"), "name", "description", "sku", "image", "price", "brand", F.array_join("crumbs", " > ").alias("crumbs"))


_SPECS = """CASE page_id % 6 WHEN 0 THEN [['Farge', 'blå ' || page_id], ['Antall i pakningen', '100 stk'], ['Antall i transport-pakke', '10']] WHEN 1 THEN [['Vekt', page_id || ' kg'], ['Produsent', 'Acme']]
    WHEN 2 THEN [['Form', 'rund: flat'], ['Antall på pall', '5']] WHEN 3 THEN [['Farge', 'blue']] ELSE [] END"""


@query(f"SELECT page_id, generate_subscripts(s, 1)::INTEGER AS place, unnest(s)[1] AS key, unnest(s)[2] AS value FROM (SELECT page_id, {_SPECS} AS s FROM pages)")
def q_page_specs(spark, sf):
    """Specification rows of tables, definition lists and labelled lists, in order, the last value of each key."""
    pairs = product_pages.last_values(product_pages.specifications())
    rows = product_pages.pages_of(pages_view(spark, sf)).select("page", F.posexplode(pairs).alias("at", "x"))
    return rows.select(c("page").alias("page_id"), (c("at") + 1).alias("place"), "x.key", "x.value")




@query(f"""WITH p AS (SELECT page_id, html, {_SPECS} AS s, 'Group ' || page_id % 7 AS g FROM pages)
    SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'Product ' || page_id WHEN 2 THEN 'Second ' || page_id END AS ld_name,
        CASE WHEN page_id % 4 = 0 THEN 'A longer text that says all there is to say on product ' || page_id || ' and its use.' || chr(10) || '• one' || chr(10) || '• two' WHEN page_id % 4 = 1 AND page_id % 5 <> 1 THEN 'A text of the second' || chr(10) || 'choice for pages'
            WHEN page_id % 5 = 1 THEN CASE WHEN page_id % 4 = 1 AND 37 > length('Short text on product ' || page_id) * 1.3 THEN 'A text of the second' || chr(10) || 'choice for pages' ELSE 'Short text on product ' || page_id END END AS section,
        CASE page_id % 3 WHEN 0 THEN 'Home > ' || g WHEN 1 THEN 'Home > Care > ' || g END AS crumbs, CASE WHEN page_id % 3 < 2 THEN g END AS category,
        CASE WHEN page_id % 5 = 1 THEN 'Maker ' || page_id % 7 WHEN page_id % 5 = 2 THEN 'Plain' WHEN page_id % 6 = 1 THEN 'Acme' END AS manufacturer,
        CASE WHEN page_id % 5 = 2 THEN 'https://img/' || page_id || '.png' ELSE 'https://images.example/' || page_id || '.jpg' END AS image_url,
        CASE page_id % 6 WHEN 0 THEN 'Antall i pakning: 100 stk; Antall i transportpakke: 10' WHEN 2 THEN 'Antall på pall: 5' WHEN 4 THEN '50 stk per pakning' WHEN 5 THEN '50 stk per pakning' END AS packaging_info,
        CASE page_id % 6 WHEN 0 THEN '100 stk' WHEN 4 THEN '50 stk' WHEN 5 THEN '50 stk' END AS packaging_unit, CASE WHEN page_id % 6 = 0 THEN '10' END AS transport_packaging,
        CASE WHEN page_id % 6 > 3 THEN 'AB-' || page_id END AS mfr_number, len(s)::INTEGER AS n_specs
    FROM p""")
def q_page_products(spark, sf):
    """Each page as a product row. Names and texts that only the generated article gives are left out here (the tests have them)."""
    rows = product_pages.parsed(pages_view(spark, sf))
    ld = c("name").rlike("^(Product|Second) [0-9]+$")
    own = c("description").rlike("^(A longer text|A text of the second|Short text on product)")
    return rows.select(
        "page_id", F.when(ld, c("name")).alias("ld_name"), F.when(own, c("description")).alias("section"), F.array_join("crumbs", " > ").alias("crumbs"), "category", "manufacturer", "image_url", "packaging_info", "packaging_unit", "transport_packaging", "mfr_number",
        F.size("specs").alias("n_specs"),
    )


@query("""WITH s AS (SELECT page_id, url, CASE WHEN page_id % 7 <> 3 THEN 'S' || page_id % 60 END AS sku FROM pages)
    SELECT sku, arg_min(url, page_id) AS url, min(page_id) AS at FROM s WHERE sku IS NOT NULL GROUP BY 1""")
def q_page_index(spark, sf):
    """The index after a scan of half the pages and one of all that was left."""
    index = page_index.PageIndex(spark, f"{shared.folder(spark)}/index-{uuid.uuid4().hex}", buckets=16)
    pages = table(spark, sf, "pages").select(c("page_id").alias("at"), "url", F.when(c("page_id") % 7 != 3, F.concat(F.lit("S"), c("page_id") % 60)).alias("sku"))
    index.scan(pages.filter("at % 2 = 0"))
    index.scan(pages)
    return index.read()
