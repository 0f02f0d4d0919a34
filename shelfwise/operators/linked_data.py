"""JSON-LD of pages: scripts parsed to VARIANT, opened level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col

_SCRIPT = r"""(?is)<script\b[^>]*\btype\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script\s*>"""
#: Levels opened between two looks at whether anything is left.
STRIDE = 8


def text_at(node: Column, path: str) -> Column:
    """A scalar as text; null for objects, lists and what isn't there."""
    x = F.try_variant_get(node, path, "variant")
    return F.when(~F.schema_of_variant(x).rlike("^(OBJECT|ARRAY)"), F.try_variant_get(node, path, "string"))


def scripts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page, script, node): the JSON-LD scripts of each page in order; one that isn't JSON has no row."""
    found = pages.select(c(id_col).alias("page"), F.posexplode(F.regexp_extract_all(html_col, F.lit(_SCRIPT), F.lit(1))).alias("script", "json"))
    return found.select("page", "script", F.try_parse_json("json").alias("node")).filter("node is not null")


def children(level: DataFrame) -> DataFrame:
    """What lies one level below: the elements of lists, the values of objects."""
    spark = level.sparkSession
    below = level.withColumnRenamed("path", "above").lateralJoin(spark.tvf.variant_explode(c("node").outer()).toDF("at", "key", "value"))
    step = F.concat("above", F.array(F.when(c("key").isNotNull(), c("key")).otherwise(F.format_string("%06d", "at"))))
    return below.select("page", "script", step.alias("path"), c("value").alias("node")).filter(F.schema_of_variant("node").rlike("^(OBJECT|ARRAY)"))


def nodes(found: DataFrame) -> DataFrame:
    """(page, script, path, type, node): every object with an @type, at any depth, in lists, graphs, offers and elsewhere.

    path holds the keys and places that lead to it, so it orders what lies in lists; a node's keys are in no order. Levels are
    opened until none is left.
    """
    level = found.select("page", "script", F.array().cast("array<string>").alias("path"), "node").filter(F.schema_of_variant("node").rlike("^(OBJECT|ARRAY)"))
    out = level
    while True:
        for _ in range(STRIDE):
            out, level = out.unionByName(level) if out is not level else level, children(level)
        if level.isEmpty():
            break
    kind = F.coalesce(text_at(c("node"), "$['@type']"), text_at(c("node"), "$['@type'][0]"))
    return out.select("page", "script", "path", kind.alias("type"), "node").filter("type is not null")


def top_nodes(found: DataFrame) -> DataFrame:
    """(page, script, at, node): each script's node, or the elements of its list, in order."""
    spark = found.sparkSession
    is_list = F.schema_of_variant("node").startswith("ARRAY")
    listed = found.filter(is_list).lateralJoin(spark.tvf.variant_explode(c("node").outer()).toDF("at", "key", "value")).select("page", "script", "at", c("value").alias("node"))
    return found.filter(~is_list).select("page", "script", F.lit(0).alias("at"), "node").unionByName(listed)


def crumbs(node: Column) -> Column:
    """The names of a breadcrumb list by position (0 where there is none), names within `item` too, empty ones left out."""
    item = "array<struct<position double, name string, item variant>>"
    listed = F.try_variant_get(node, "$.itemListElement", item)
    name = lambda x: F.coalesce(F.nullif(x["name"], F.lit("")), text_at(x["item"], "$.name"), F.lit(""))
    placed = F.transform(listed, lambda x, i: F.struct(F.coalesce(x["position"], F.lit(0.0)).alias("position"), i.alias("i"), F.trim(name(x)).alias("name")))
    return F.filter(F.transform(F.array_sort(placed), lambda x: x["name"]), lambda x: x != "")


def products(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per page with JSON-LD the last top-level product's fields and the last breadcrumb list that isn't empty."""
    top = top_nodes(scripts(pages, id_col, html_col)).withColumn("type", text_at(c("node"), "$['@type']"))
    node, order = c("node"), F.struct("script", "at")
    brand = F.coalesce(text_at(node, "$.brand.name"), text_at(node, "$.brand"))
    fields = {k: text_at(node, f"$.{k}") for k in ("name", "description", "sku", "image", "url")} | {"price": text_at(node, "$.offers.price")}
    whole = F.struct(*[v.alias(k) for k, v in fields.items()])
    is_product, trail = c("type") == "Product", F.when(c("type") == "BreadcrumbList", crumbs(node))
    # a product without a brand leaves the brand of one before it
    found = top.filter("type in ('Product', 'BreadcrumbList')").groupBy("page").agg(
        F.max_by(F.when(is_product, whole), F.when(is_product, order)).alias("p"),
        F.max_by(brand, F.when(is_product & brand.isNotNull(), order)).alias("brand"),
        F.max_by(trail, F.when(F.size(trail) > 0, order)).alias("crumbs"),
    )
    return found.select("page", *[c(f"p.{k}").alias(k) for k in fields], "brand", "crumbs")
