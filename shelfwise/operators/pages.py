"""Pages to columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def heading(html: Column) -> Column:
    return F.regexp_extract(html, "<h1>([^<]*)</h1>", 1)


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('<a href="([^"]*)"'), F.lit(1))


def host(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1)


def page_sku(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r'"sku"\s*:\s*"([^"]+)"', 1), F.lit(""))


def sku_status(html: Column, sku: Column, wanted: Column) -> Column:
    """How a page's article number agrees with the wanted one."""
    plain = lambda x: F.lower(F.regexp_replace(x, "^[Nn]+", ""))
    return (
        F.when(sku == wanted, "EXACT_MATCH").when(plain(sku) == plain(wanted), "NORMALIZED_MATCH").when(sku.isNotNull(), "MISMATCH")
        .when(F.contains(html, wanted), "SKU_IN_PAGE").otherwise("UNVERIFIED")
    )


def structured_text(html: Column) -> Column:
    """Paragraphs and line breaks as lines, list items as bullets, tags out, white space closed up; a null is an empty text."""
    x = F.regexp_replace(html, "(?s)<(script|style)[^>]*>.*?</(script|style)>", "")
    x = F.regexp_replace(F.regexp_replace(x, "<li[^>]*>", "\n• "), "<br ?/?>|</p>|<p>|</li>|</h1>", "\n")
    x = F.regexp_replace(F.regexp_replace(x, "<[^>]+>", ""), "[ \t]+", " ")
    lines = F.regexp_replace(F.regexp_replace(x, " *\n *", "\n"), "\n+", "\n")
    return F.coalesce(F.regexp_replace(lines, r"^\s+|\s+$", ""), F.lit(""))


def is_product_image(url: Column) -> Column:
    return F.lower(url).rlike(r"\.(jpg|jpeg|png|webp)($|\?)|image|img|photo") & ~F.lower(url).rlike("logo|icon|sprite|banner|pixel|favicon|placeholder|avatar")
