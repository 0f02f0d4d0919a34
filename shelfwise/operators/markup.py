"""Markup as a stream of rows: tags and texts with their depth, elements as intervals of it.

A page is cut into tags and texts, each a row with its position. A running sum of +1 for an opening and -1 for a closing tag
gives the depth; the same sum over the tags of one name pairs each opening tag with the closing one at its level. An element
is then an interval of positions, what lies in it is an interval join within the page, and its text is a slice of the page's
text between two running lengths. `stream` and what follows it deal the rows by page; `in_rows` has the same within the page's own row, so
nothing is dealt at all, and only the running sums leave the expressions.

An element that nothing closes ends with its page. Comments, scripts and styles are single tokens and have no text.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions import text as t
from .cleaning import once

c = F.col
#: The end of an element that nothing closes.
OPEN = 2**31 - 1

_TOKEN = r"(?is)<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)\s*>|<[^>]*>|[^<]+|<"
_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
_NAMED = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": "\xa0", "&amp;": "&"}


def decoded(text: Column) -> Column:
    """The common character references as characters."""
    for k, v in _NAMED.items():
        text = F.replace(text, F.lit(k), F.lit(v))
    return text


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of an opening tag, null if it has none."""
    found = F.regexp_extract_all(tag, F.lit(rf"""(?is)[\s"']{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""), F.lit(1))
    return decoded(F.regexp_replace(F.get(found, 0), "^[\"']|[\"']$", ""))


def stream(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page, pos, tag, name, step, text): step is 1 for an opening tag, -1 for a closing one, 0 for anything else; text is null for tags."""
    cut = pages.select(c(id_col).alias("page"), F.posexplode(F.regexp_extract_all(F.coalesce(html_col, F.lit("")), F.lit(_TOKEN), F.lit(0))).alias("pos", "token"))
    # what begins with < is no text, but for a < that begins nothing
    is_text = ~c("token").startswith("<") | (c("token") == "<")
    name = F.when(is_text, "").otherwise(F.lower(F.regexp_extract("token", r"^</?([A-Za-z][A-Za-z0-9]*)", 1)))
    named = cut.select("page", "pos", F.when(~is_text, c("token")).alias("tag"), name.alias("name"), F.when(is_text, decoded(c("token"))).alias("text"))
    single = c("name").isin("", "script", "style", *_VOID) | c("tag").endswith("/>")
    step = F.when(single, 0).when(c("tag").startswith("</"), -1).otherwise(1)
    return named.select("page", "pos", "tag", "name", step.alias("step"), F.when(c("name") == "br", "\n").otherwise(c("text")).alias("text"))


def elements(tokens: DataFrame) -> DataFrame:
    """(page, pos, end, name, depth, tag, start_at, end_at, raw_start, raw_end): each element as an interval, void ones too, with the lengths of the text before its ends.

    start_at and end_at count stripped texts, raw_start and raw_end texts as they are.
    """
    by_page = W.partitionBy("page").orderBy("pos")
    run = tokens.select(
        "page", "pos", "tag", "name", "step", F.sum("step").over(by_page).alias("depth"),
        F.sum(F.coalesce(F.length(t.strip(c("text"))), F.lit(0))).over(by_page).alias("at"), F.sum(F.coalesce(F.length("text"), F.lit(0))).over(by_page).alias("raw_at"),
    ).filter("name <> ''")
    level = F.sum("step").over(W.partitionBy("page", "name").orderBy("pos")) + F.when(c("step") == -1, 1).otherwise(0)
    ends = F.lead(F.struct("pos", "at", "raw_at", "step")).over(W.partitionBy("page", "name", "level").orderBy("pos"))
    paired = run.withColumn("level", level).withColumn("end", F.when(c("step") == 1, ends)).filter("step >= 0")
    # an opening tag is followed by its closing one, or by nothing
    closed = c("end.step") == -1
    most = F.lit(2**31 - 1)
    until = lambda x: F.when(c("step") == 0, c(x if x != "pos" else "pos")).when(closed, c(f"end.{x}")).otherwise(most)
    return paired.select(
        "page", "pos", until("pos").alias("end"), "name", (c("depth") + F.when(c("step") == 0, 1).otherwise(0)).alias("depth"), "tag",
        c("at").alias("start_at"), until("at").alias("end_at"), c("raw_at").alias("raw_start"), until("raw_at").alias("raw_end"),
    )


def page_texts(tokens: DataFrame) -> DataFrame:
    """(page, text, raw): all texts of a page in order, stripped and as they are."""
    kept = tokens.filter("text is not null").groupBy("page").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("x"))
    texts = F.transform("x", lambda x: x["text"])
    return kept.select("page", F.array_join(F.transform(texts, t.strip), "").alias("text"), F.array_join(texts, "").alias("raw"))


def text_between(text: Column, start: Column, end: Column) -> Column:
    return F.substr(text, (start + 1).cast("int"), (end - start).cast("int"))


def with_text(found: DataFrame, tokens: DataFrame) -> DataFrame:
    """Elements with text (stripped strings run together) and raw (as it is)."""
    joined = found.join(page_texts(tokens).withColumnsRenamed({"text": "page_text", "raw": "page_raw"}), "page", "left")
    cut = lambda x, a, b: F.coalesce(text_between(c(x), c(a), c(b)), F.lit(""))
    return joined.withColumns({"text": cut("page_text", "start_at", "end_at"), "raw": cut("page_raw", "raw_start", "raw_end")}).drop("page_text", "page_raw")


def contained(outer: DataFrame, inner: DataFrame, keep: Column) -> DataFrame:
    """outer with `inner`: the structs of what lies in each, in order. keep says over (o, i) which of them are asked for."""
    o, i = outer.alias("o"), inner.alias("i")
    within = (c("o.page") == c("i.page")) & (c("i.pos") > c("o.pos")) & (c("i.pos") < c("o.end")) & keep
    item = F.struct("i.pos", "i.end", "i.name", "i.depth", "i.tag", "i.text")
    names = [f"o.{x}" for x in outer.columns]
    return o.join(i, within, "left").groupBy(*names).agg(F.array_sort(F.collect_list(F.when(c("i.pos").isNotNull(), item))).alias("inner"))


@F.pandas_udf(StructType([StructField(x, ArrayType(IntegerType())) for x in ("depth", "end", "at", "raw_at")]))
def _running(names: pd.Series, steps: pd.Series, sizes: pd.Series, raw_sizes: pd.Series) -> pd.DataFrame:
    """Running sums over a page's tokens, and where each opening tag's element ends: at the closing tag of its name and level."""
    rows = []
    for name, step, size, raw in zip(names, steps, sizes, raw_sizes):
        end, level, opened = list(range(len(step))), {}, {}
        for k, (n, s) in enumerate(zip(name, step)):
            if s > 0:
                level[n] = level.get(n, 0) + 1
                opened[n, level[n]], end[k] = k, OPEN
            elif s < 0:
                k_open = opened.pop((n, level.get(n, 0)), None)
                level[n] = level.get(n, 0) - 1
                if k_open is not None:
                    end[k_open] = k
        rows.append((step.cumsum(), end, size.cumsum(), raw.cumsum()))
    return pd.DataFrame(rows, columns=["depth", "end", "at", "raw_at"])


def in_rows(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page, text, raw, items): per page its texts, run together stripped and as they are (null for none), and its elements and texts in order.

    An item is (pos, end, name, depth, tag, cls, text_from, text_to, raw_from, raw_to, own): name is empty for a text, which own holds.
    """
    cut = once(pages.select(c(id_col).alias("page"), html_col), {"_cut": F.regexp_extract_all(F.coalesce(html_col, F.lit("")), F.lit(_TOKEN), F.lit(0))}).drop(html_col)
    is_text = lambda x: ~x.startswith("<") | (x == "<")
    split = lambda x: F.struct(
        F.when(~is_text(x), x).alias("tag"), F.when(is_text(x), "").otherwise(F.lower(F.regexp_extract(x, r"^</?([A-Za-z][A-Za-z0-9]*)", 1))).alias("name"), F.when(is_text(x), decoded(x)).alias("text")
    )
    single = lambda x: x["name"].isin("", "script", "style", *_VOID) | F.coalesce(x["tag"].endswith("/>"), F.lit(False))
    step = lambda x: F.when(single(x), 0).when(x["tag"].startswith("</"), -1).otherwise(1)
    split_rows = once(cut, {"_split": F.transform("_cut", split)}).drop("_cut")
    token = lambda x: F.struct(x["tag"], x["name"], step(x).alias("step"), F.when(x["name"] == "br", "\n").otherwise(x["text"]).alias("raw"))
    stepped = once(split_rows, {"_raws": F.transform("_split", token)}).drop("_split")
    tokens = once(stepped, {"_t": F.transform("_raws", lambda x: F.struct(x["tag"], x["name"], x["step"], x["raw"], t.strip(x["raw"]).alias("text")))}).drop("_raws")
    size = lambda field: F.transform("_t", lambda x: F.coalesce(F.length(x[field]), F.lit(0)))
    run = tokens.withColumn("_r", _running(F.transform("_t", lambda x: x["name"]), F.transform("_t", lambda x: x["step"]), size("text"), size("raw")))
    at = lambda field, k: F.get(c("_r")[field], k)
    until = lambda field, k: F.when(at("end", k) == OPEN, F.lit(OPEN)).otherwise(at(field, at("end", k)))
    item = lambda x, k: F.when(
        ((x["name"] != "") & (x["step"] >= 0)) | ((x["name"] == "") & x["raw"].isNotNull()),
        F.struct(
            k.alias("pos"), at("end", k).alias("end"), x["name"].alias("name"), (at("depth", k) + F.when(x["step"] == 0, 1).otherwise(0)).alias("depth"), x["tag"].alias("tag"), attribute(x["tag"], "class").alias("cls"),
            at("at", k).alias("text_from"), until("at", k).alias("text_to"), at("raw_at", k).alias("raw_from"), until("raw_at", k).alias("raw_to"), F.when(x["name"] == "", x["text"]).alias("own"),
        ),
    )
    texts = F.filter("_t", lambda x: x["raw"].isNotNull())
    joined = lambda field: F.when(F.size(texts) > 0, F.array_join(F.transform(texts, lambda x: x[field]), ""))
    return once(run, {"text": joined("text"), "raw": joined("raw"), "items": F.filter(F.transform("_t", item), lambda x: x.isNotNull())}).select("page", "text", "raw", "items")
