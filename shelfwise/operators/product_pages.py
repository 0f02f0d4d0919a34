"""Product pages to typed rows: specifications, breadcrumbs, texts and packaging of each page.

The page is a stream of tags (`markup`); what is asked of it are intervals in intervals: cells of table rows, terms and
definitions of lists, items of a breadcrumb, children of an accordion. All of it stays within the row of the page: a page's
elements are never dealt, only the product's fields are, to meet those of its JSON-LD.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as t
from . import linked_data, markup
from .cleaning import once

c = F.col

_BLOCKS = ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "blockquote")
_LISTS = ("ul", "ol")


def _like(x: Column, pattern: str) -> Column:
    return F.coalesce(F.lower(x).rlike(pattern), F.lit(False))


def kinds(x: Column) -> Column:
    """The kinds of an element that something is read from; none for any other."""
    name, cls, own = x["name"], x["cls"], markup.attribute(x["tag"], "id")
    of = {
        "row": name == "tr", "terms": name == "dl", "pairs": name.isin("div", "section", "ul") & _like(cls, fixed.PAGE_PAIRS), "heading": name == "h1", "meta": (name == "meta") & (markup.attribute(x["tag"], "name") == "description"),
        "crumbs_class": _like(cls, "breadcrumb"), "crumbs_nav": (name == "nav") & _like(markup.attribute(x["tag"], "aria-label"), "breadcrumb|brødsmule|sti"), "crumbs_list": name.isin(*_LISTS) & _like(cls, "breadcrumb|crumb"),
        "described": F.coalesce(own.isin(*fixed.PAGE_DESCRIPTIONS), F.lit(False)), "described_class": _like(cls, "accordion.*desc|desc.*accordion"), "described_div": (name == "div") & _like(cls, "description|product-desc"),
        "specified": F.coalesce(own.isin(*fixed.PAGE_SPECIFICATIONS), F.lit(False)), "specified_class": _like(cls, "accordion.*spec|spec.*accordion"), "specified_block": name.isin("div", "section") & _like(cls, "spec|technical|egenskap"),
        "main": name == "main", "article": name == "article", "content": _like(own, "product|content"), "maker": _like(cls, "brand|manufacturer|producer|supplier"),
    }
    return F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in of.items()]), lambda k: k.isNotNull())


def structured(e: Column) -> Column:
    """The text of a region by its children: blocks as lines, list items as bullets; without blocks the lines as they are."""
    inner = e["inner"]
    child = lambda x: x["depth"] == e["depth"] + 1
    is_text = lambda x: x["name"] == ""
    has_blocks = F.exists(inner, lambda x: child(x) & x["name"].isin(*_BLOCKS, *_LISTS))
    items = lambda of: F.transform(F.filter(inner, lambda x: (x["name"] == "li") & (x["depth"] == of["depth"] + 1) & (x["pos"] > of["pos"]) & (x["pos"] < of["end"]) & (x["text"] != "")), lambda x: F.concat(F.lit("• "), x["text"]))
    parts = F.flatten(F.transform(F.filter(inner, child), lambda x: F.when(x["name"].isin(*_LISTS), items(x)).otherwise(F.array(x["text"]))))
    lines = F.transform(F.split(e["raw"], "\n"), lambda x: t.strip(F.regexp_replace(x, "[ \t]+", " ")))
    joined = F.array_join(F.filter(F.when(has_blocks, parts).otherwise(lines), lambda x: x != ""), "\n")
    return F.when(e.isNotNull(), joined)


_CHILDREN = ("described", "described_class", "described_div", "specified", "specified_class", "specified_block")
_ASKED = ("td", "th", "dt", "dd", "li", "a", "span", "p", "table", "dl")


def pages_of(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page, text, raw, regions): per page its texts and its regions in order, each with what lies in it."""
    rows = markup.in_rows(pages, id_col, html_col)
    cut = lambda text, a, b: F.coalesce(markup.text_between(c(text), a, b), F.lit(""))
    own_text = lambda x: F.coalesce(x["own"], cut("text", x["text_from"], x["text_to"]))
    named = F.transform(F.filter("items", lambda x: x["name"] != ""), lambda x: F.struct(x.alias("x"), kinds(x).alias("kinds")))
    rows = once(rows, {"_named": named})
    rows = once(rows, {"_regions": F.filter("_named", lambda o: F.size(o["kinds"]) > 0)}).drop("_named")
    # texts and inline elements of their own are only asked for where a region is read by its children
    asked = lambda o, i: i["name"].isin(*_ASKED) | i["cls"].isNotNull() | (F.arrays_overlap(o["kinds"], F.array(*map(F.lit, _CHILDREN))) & (i["depth"] == o["x"]["depth"] + 1))
    within = lambda o: F.filter("items", lambda i: (i["pos"] > o["x"]["pos"]) & (i["pos"] < o["x"]["end"]) & asked(o, i))
    item = lambda i: F.struct(i["pos"].alias("pos"), i["end"].alias("end"), i["name"].alias("name"), i["depth"].alias("depth"), i["tag"].alias("tag"), own_text(i).alias("text"))
    region = lambda o: F.struct(
        *[o["x"][k].alias(k) for k in ("pos", "end", "name", "depth", "tag", "cls")], markup.attribute(o["x"]["tag"], "id").alias("own_id"), o["kinds"].alias("kinds"), own_text(o["x"]).alias("text"),
        cut("raw", o["x"]["raw_from"], o["x"]["raw_to"]).alias("raw"), F.transform(within(o), item).alias("inner"),
    )
    return once(rows, {"regions": F.transform("_regions", region)}).select("page", "text", "raw", "regions")


def of_kind(kind: str) -> Column:
    return F.filter(F.coalesce("regions", F.array()), lambda r: F.array_contains(r["kinds"], kind))


def first(found: Column) -> Column:
    return F.get(found, 0)


def _named(r: Column, *names: str) -> Column:
    return F.filter(r["inner"], lambda x: x["name"].isin(*names))


def _pair(key: Column, value: Column, most: int | None = None) -> Column:
    fits = (key != "") & (value != "") & (F.length(key) < most if most else F.lit(True))
    return F.when(fits, F.struct(key.alias("key"), value.alias("value")))


def _zipped(keys: Column, values: Column, tidy=lambda x: x) -> Column:
    """Pairs by order, as many as the shorter side has."""
    n = F.least(F.size(keys), F.size(values))
    return F.zip_with(F.slice(keys, F.lit(1), n), F.slice(values, F.lit(1), n), lambda k, v: _pair(tidy(k["text"]), v["text"]))


def _cells(r: Column) -> Column:
    cells = _named(r, "td", "th")
    return F.when(F.size(cells) >= 2, F.array(_pair(F.get(cells, 0)["text"], F.get(cells, 1)["text"], 100))).otherwise(F.array())


def _terms(r: Column) -> Column:
    return _zipped(_named(r, "dt"), _named(r, "dd"), lambda k: F.regexp_replace(k, ":+$", ""))


def _labelled(r: Column) -> Column:
    items = F.transform(F.filter(_named(r, "li"), lambda x: F.contains(x["text"], F.lit(":"))), lambda x: _pair(t.strip(F.substring_index(x["text"], ":", 1)), t.strip(F.regexp_replace(x["text"], "(?s)^[^:]*:", ""))))
    classed = lambda pattern: F.filter(r["inner"], lambda x: _like(markup.attribute(x["tag"], "class"), pattern))
    return F.concat(items, _zipped(classed("label|key|name"), classed("value|data|content")))


def specifications() -> Column:
    """Pairs of a page in the order in which their keys are first met; of a key that comes again the last value holds.

    Tables, definition lists and labelled lists are read in this order, those within a specification section first.
    """
    section = first(F.array_sort(F.transform(of_kind("specified"), lambda r: F.struct(F.array_position(F.array(*map(F.lit, fixed.PAGE_SPECIFICATIONS)), r["own_id"]).alias("rank"), r["pos"], r["end"]))))
    in_section = lambda r: (r["pos"] > section["pos"]) & (r["pos"] < section["end"])
    read = lambda kind, how: F.flatten(F.transform(of_kind(kind), how))
    inside = lambda kind, how: F.flatten(F.transform(F.filter(of_kind(kind), in_section), how))
    every = F.concat(inside("row", _cells), inside("terms", _terms), read("row", _cells), read("terms", _terms), read("pairs", _labelled))
    return F.filter(every, lambda x: x.isNotNull())


def last_values(pairs: Column) -> Column:
    keys = F.array_distinct(F.transform(pairs, lambda x: x["key"]))
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(pairs, lambda x: x["key"] == k), -1)["value"].alias("value")))


def html_crumbs() -> Column:
    """The names in the first breadcrumb element: its links, else its list items, else its spans."""
    nav = F.coalesce(first(of_kind("crumbs_class")), first(of_kind("crumbs_nav")), first(of_kind("crumbs_list")))
    texts = lambda name: F.filter(F.transform(_named(nav, name), lambda x: x["text"]), lambda x: x != "")
    return F.when(F.size(texts("a")) > 0, texts("a")).when(F.size(texts("li")) > 0, texts("li")).otherwise(texts("span"))


def described() -> Column:
    """The text of the first description section of a known id that has over 10 characters, else of the first of a telling class with over 20."""
    of_id = lambda i: F.filter(of_kind("described"), lambda r: r["own_id"] == i)
    by_id = [F.filter(F.transform(F.slice(of_id(i), 1, 1), structured), lambda x: F.length(x) > 10) for i in fixed.PAGE_DESCRIPTIONS]
    by_class = F.filter(F.transform(of_kind("described_class"), structured), lambda x: F.length(x) > 20)
    return F.coalesce(*[first(x) for x in by_id], first(by_class))


def fallback_description() -> Column:
    div = first(of_kind("described_div"))
    meta = t.strip(markup.attribute(first(of_kind("meta"))["tag"], "content"))
    main = F.coalesce(first(of_kind("main")), first(of_kind("article")), first(of_kind("content")))
    long_texts = F.filter(F.transform(_named(main, "p"), lambda x: x["text"]), lambda x: F.length(x) > 30)
    paragraphs = F.when(F.size(long_texts) > 0, F.array_join(F.slice(long_texts, 1, 3), "\n"))
    return F.when(div.isNotNull(), structured(div)).when(F.length(meta) > 0, F.when(F.length(meta) > 20, meta)).otherwise(paragraphs)


def fallback_specification() -> Column:
    """A specification section's text where no pairs are found."""
    sections = F.transform(F.array_sort(F.transform(of_kind("specified"), lambda r: F.struct(F.array_position(F.array(*map(F.lit, fixed.PAGE_SPECIFICATIONS)), r["own_id"]).alias("rank"), r.alias("r")))), lambda x: structured(x["r"]))
    own = F.nullif(first(sections), F.lit(""))
    by_class = first(F.filter(F.transform(of_kind("specified_class"), structured), lambda x: F.length(x) > 20))
    section = F.coalesce(own, by_class)
    block = structured(first(of_kind("specified_block")))
    return F.when(F.length(section) > 10, section).when(F.length(block) > 10, block)


def plain_key(key: Column) -> Column:
    """A specification's key in small letters, hard and no-width blanks gone, white space closed up, without colons at its end."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(F.translate(key, "\xa0\u200b", " "), r"\s+", " "))), ":+$", "")


def routed(pairs: Column) -> Column:
    """Pairs on packaging, each with its route: unit, transport or pallet."""
    has = lambda k, words: reduce(lambda a, b: a | b, [F.contains(plain_key(k), F.lit(w)) for w in words])
    route = lambda k: F.when(has(k, fixed.PAGE_UNIT), "unit").when(has(k, fixed.PAGE_TRANSPORT), "transport").when(has(k, ("pall",)), "pallet")
    return F.filter(F.transform(pairs, lambda x: F.struct(route(x["key"]).alias("route"), x["value"].alias("value"))), lambda x: x["route"].isNotNull())


def matched(text: Column, patterns: tuple[str, ...], group: int) -> Column:
    """What the first of the patterns that is found gives."""
    out = F.lit(None).cast("string")
    for p in reversed(patterns):
        out = F.when(text.rlike("(?i)" + p), F.regexp_extract(text, "(?i)" + p, group)).otherwise(out)
    return out


def tidy(x: Column) -> Column:
    """Blanks closed up, hard and no-width blanks as plain ones or none, at most one empty line; nothing left is null."""
    x = F.regexp_replace(t.strip(x), "[ \t]+", " ")
    x = F.translate(x, "\xa0\u200b\ufeff", " ")
    return F.nullif(t.strip(F.regexp_replace(x, "\n{3,}", "\n\n")), F.lit(""))


def parsed(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", image_base: str = "https://images.example") -> DataFrame:
    """Per page its product: name, description, image_url, crumbs, category, manufacturer, product_url, specs, specification, packaging_info, packaging_unit, transport_packaging, mfr_number."""
    linked = linked_data.products(pages, id_col, html_col).withColumnsRenamed({k: f"ld_{k}" for k in ("name", "description", "sku", "image", "url", "price", "brand", "crumbs")})
    raw = pages_of(pages, id_col, html_col).withColumn("raw", F.coalesce("raw", F.lit("")))
    # what the page itself says, before its row is dealt
    own = once(raw, {
        "specs": last_values(specifications()), "_section": described(), "_fallback": fallback_description(), "_trail": html_crumbs(), "_heading": first(of_kind("heading"))["text"], "_maker": first(of_kind("maker"))["text"],
        "_specified": fallback_specification(), "mfr_number": F.trim(matched(c("raw"), fixed.PAGE_MAKER_NUMBER, 1)), "_packed": matched(c("raw"), fixed.PAGE_PACKAGING, 0), "_count": matched(c("raw"), fixed.PAGE_PACKAGING, 1),
        "_shipped": F.nullif(F.regexp_extract("raw", "(?i)" + fixed.PAGE_SHIPPING, 1), F.lit("")),
    }).drop("text", "raw", "regions")
    rows = own.join(linked, "page", "left")
    filled = lambda x: F.nullif(x, F.lit(""))
    section, maker = c("_section"), c("_maker")
    rich = F.when(F.length(section) > F.length("ld_description") * 1.3, section).when(F.length("ld_description") > 0, c("ld_description")).otherwise(section)
    trail = F.when(F.size("ld_crumbs") > 0, c("ld_crumbs")).otherwise(c("_trail"))
    trail = F.filter(F.transform(trail, t.strip), lambda x: ~x.isin("", ">", "/", "»", "›"))
    by_key = first(F.filter("specs", lambda x: F.lower(x["key"]).rlike("produsent|manufacturer|leverandør|supplier|brand|merke")))["value"]
    rows = rows.withColumns({
        "name": F.coalesce(filled(c("ld_name")), c("_heading")), "description": F.coalesce(filled(rich), c("_fallback")), "image_url": F.coalesce(filled(c("ld_image")), F.concat(F.lit(image_base + "/"), c("page"), F.lit(".jpg"))),
        "crumbs": F.when(F.size(trail) > 0, trail), "manufacturer": F.coalesce(filled(c("ld_brand")), F.when((F.length(maker) > 0) & (F.length(maker) < 100), maker), by_key), "routes": routed(c("specs")),
        "specification": F.when(F.size("specs") > 0, F.array_join(F.transform("specs", lambda x: F.concat(x["key"], F.lit(": "), x["value"])), "\n")).otherwise(c("_specified")),
    })
    last = lambda route: F.get(F.reverse(F.filter("routes", lambda x: x["route"] == route)), 0)["value"]
    label = lambda x: F.when(x["route"] == "unit", "Antall i pakning: ").when(x["route"] == "transport", "Antall i transportpakke: ").otherwise("Antall på pall: ")
    said = F.array_join(F.transform("routes", lambda x: F.concat(label(x), x["value"])), "; ")
    none = F.size("routes") == 0
    rows = rows.withColumns({
        "packaging_info": F.when(none, c("_packed")).otherwise(said), "packaging_unit": F.when(none, F.concat(c("_count"), F.lit(" stk"))).otherwise(last("unit")),
        "transport_packaging": F.when(none, F.concat(c("_shipped"), F.lit(" stk"))).otherwise(last("transport")), "category": F.get(F.reverse("crumbs"), 0),
    })
    cleaned = {k: tidy(c(k)) for k in ("name", "description", "specification", "manufacturer", "mfr_number", "category", "packaging_info")}
    return rows.withColumns(cleaned).select(
        c("page").alias(id_col), "name", "description", "image_url", "crumbs", "category", "manufacturer", c("ld_url").alias("product_url"), "specs", "specification", "packaging_info", "packaging_unit", "transport_packaging", "mfr_number"
    )
