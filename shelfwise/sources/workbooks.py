"""Workbooks as rows: all their sheets, which column holds article numbers, a preview, and the ERP's table.

Workbooks come through Spark's own file reader, so they may lie in any store that Spark reads; a task holds one workbook at
a time. What is found out about columns is an aggregate over all rows, not a look at headers alone: a header that names
article numbers wins, else the column whose values are most often plausible numbers and seldom repeat.

Defined cases: a workbook without sheets, and a file that is none, have no rows; an empty sheet has none either; the header
is the first row with a known header, else the first that isn't empty; rows and columns count from 1, empty cells are null.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as t

c = F.col

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
ROWS = "path string, sheet string, sheet_no int, active boolean, row int, cells array<string>"


def _column(reference: str) -> int:
    at = 0
    for letter in re.match("[A-Z]*", reference)[0]:
        at = at * 26 + ord(letter) - 64
    return at


def cells_of(row: ElementTree.Element, shared: list[str]) -> list[str | None]:
    """A row's cells as text, at the places that their references name."""
    out: list[str | None] = []
    for cell in row.iter(f"{_MAIN}c"):
        out += [None] * (_column(cell.get("r", "")) - 1 - len(out))
        kind, value = cell.get("t"), cell.findtext(f"{_MAIN}v")
        if kind == "inlineStr":
            value = "".join(x.text or "" for x in cell.iter(f"{_MAIN}t"))
        elif kind == "s" and value is not None:
            value = shared[int(value)]
        elif kind == "e":
            value = None
        out.append(value or None)
    return out


def sheets_in(data: bytes) -> Iterator[tuple[str, int, bool, int, list[str | None]]]:
    """(sheet, its number, whether it is the active one, row, cells) of every row that isn't empty, sheet by sheet; a row is parsed when it is reached."""
    try:
        book = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        return
    with book:
        names = set(book.namelist())
        if "xl/workbook.xml" not in names:
            return
        shared = ["".join(x.text or "" for x in s.iter(f"{_MAIN}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
        rels = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))} if "xl/_rels/workbook.xml.rels" in names else {}
        root = ElementTree.fromstring(book.read("xl/workbook.xml"))
        view = root.find(f"{_MAIN}bookViews/{_MAIN}workbookView")
        active = int(view.get("activeTab", 0)) if view is not None else 0
        for k, sheet in enumerate(root.iter(f"{_MAIN}sheet")):
            target = rels.get(sheet.get(_REL), f"worksheets/sheet{k + 1}.xml")
            part = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
            if part not in names:
                continue
            at = 0
            with book.open(part) as stream:
                for _, row in ElementTree.iterparse(stream):
                    if row.tag != f"{_MAIN}row":
                        continue
                    at = int(row.get("r", at + 1))
                    cells = cells_of(row, shared)
                    row.clear()
                    if any(x is not None for x in cells):
                        yield sheet.get("name", ""), k + 1, k == active, at, cells


def read(spark: SparkSession, path: str, batch: int = 5000) -> DataFrame:
    """Every row of every sheet of the workbooks under a path: ROWS."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"]):
                held = []
                for row in sheets_in(data):
                    held.append((name, *row))
                    if len(held) == batch:
                        yield pd.DataFrame(held, columns=[x.split()[0] for x in ROWS.split(", ")])
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=[x.split()[0] for x in ROWS.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, ROWS)


def _key(x: Column) -> Column:
    """A header as headers are compared: small letters, no dots, blanks and underscores."""
    return F.regexp_replace(F.lower(t.strip(x)), "[. _]", "")


def headers(rows: DataFrame, known: list[str]) -> DataFrame:
    """(path, sheet, header_row, header) of each sheet: its first row that has a known header, else its first."""
    named = F.exists("cells", lambda x: _key(x).isin(known))
    return rows.groupBy("path", "sheet").agg(F.coalesce(F.min(F.when(named, c("row"))), F.min("row")).alias("header_row"), F.coalesce(F.min_by(F.when(named, c("cells")), F.when(named, c("row"))), F.min_by("cells", "row")).alias("header"))


def plausible(value: Column) -> Column:
    """Whether a value looks like an article number: a digit among 3 to 20 letters, digits, dashes, slashes, dots."""
    return t.normalize_identifier(value).rlike(r"^(?=.*[0-9])[A-Za-z0-9][A-Za-z0-9\-/.]{2,19}$")


def profile(rows: DataFrame, known: list[str] | None = None) -> DataFrame:
    """(path, sheet, column, header, n, n_plausible, n_distinct, named) of each column below the header.

    Cells become rows (one for each value), and a column's distinct values are counted in two steps, so that no task holds a column.
    """
    known = fixed.ARTICLE_HEADERS if known is None else known
    head = headers(rows, known)
    below = rows.join(head.select("path", "sheet", "header_row"), ["path", "sheet"]).filter("row > header_row")
    each = below.select("path", "sheet", F.posexplode("cells").alias("column", "value")).filter("value is not null")
    counted = each.groupBy("path", "sheet", "column", "value").agg(F.count("*").alias("n"))
    sums = counted.groupBy("path", "sheet", "column").agg(F.sum("n").alias("n"), F.sum(F.when(plausible(c("value")), c("n")).otherwise(0)).alias("n_plausible"), F.count("*").alias("n_distinct"))
    title = F.get("header", c("column"))
    return sums.join(head, ["path", "sheet"]).select("path", "sheet", (c("column") + 1).alias("column"), title.alias("header"), "n", "n_plausible", "n_distinct", F.coalesce(_key(title).isin(known), F.lit(False)).alias("named"))


def article_columns(columns: DataFrame, share: float = 0.8, distinct: float = 0.5) -> DataFrame:
    """(path, sheet, column, header, how) of the column of each sheet that holds article numbers: one that is named, else the most plausible one, else the first.

    A column is plausible from a share of plausible and a share of distinct values on; the better product wins, then the first.
    """
    fit = (c("n_plausible") >= share * c("n")) & (c("n_distinct") >= distinct * c("n"))
    how = F.when(c("named"), "header").when(fit, "values").otherwise("first")
    rank = F.row_number().over(W.partitionBy("path", "sheet").orderBy(F.desc("named"), F.desc(fit), F.when(fit & ~c("named"), -c("n_plausible") * c("n_distinct") / (c("n") * c("n"))), "column"))
    return columns.withColumn("_r", rank).filter("_r = 1").select("path", "sheet", "column", "header", how.alias("how"))


def article_numbers(rows: DataFrame, active_only: bool = True) -> DataFrame:
    """(path, sheet, row, article_number) of the column that holds them, normalised, repeats kept; of active sheets only unless told otherwise."""
    asked = rows.filter("active") if active_only else rows
    at = article_columns(profile(asked)).select("path", "sheet", "column")
    head = headers(asked, fixed.ARTICLE_HEADERS).select("path", "sheet", "header_row")
    found = asked.join(head, ["path", "sheet"]).filter("row > header_row").join(at, ["path", "sheet"])
    return found.select("path", "sheet", "row", t.normalize_identifier(F.get("cells", c("column") - 1)).alias("article_number")).filter("article_number is not null")


def preview(rows: DataFrame, n: int = 5) -> DataFrame:
    """(path, sheet, headers, preview_rows, total_columns, total_data_rows, detected_column) of each sheet."""
    head = headers(rows, fixed.ARTICLE_HEADERS)
    below = rows.join(head, ["path", "sheet"]).filter("row > header_row")
    place = F.row_number().over(W.partitionBy("path", "sheet").orderBy("row"))
    few = below.withColumn("_r", place).filter(c("_r") <= n).groupBy("path", "sheet").agg(F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("x"))
    total = below.groupBy("path", "sheet").agg(F.count("*").alias("total_data_rows"))
    columns = article_columns(profile(rows)).select("path", "sheet", F.when(c("how") != "first", c("column")).alias("detected_column"))
    out = head.join(few, ["path", "sheet"], "left").join(total, ["path", "sheet"], "left").join(columns, ["path", "sheet"], "left")
    return out.select(
        "path", "sheet", c("header").alias("headers"), F.transform("x", lambda r: r["cells"]).alias("preview_rows"), F.size("header").alias("total_columns"), F.coalesce("total_data_rows", F.lit(0)).alias("total_data_rows"), "detected_column"
    )


def erp_rows(rows: DataFrame) -> DataFrame:
    """The ERP's table from the active sheets of its workbooks: one row for each article number, the last one (by path, then row) of those that repeat; columns that a workbook lacks are null."""
    known = [k.lower().replace(".", "").replace(" ", "").replace("_", "") for k in fixed.ERP_COLUMNS]
    head = headers(rows.filter("active"), known)
    body = rows.filter("active").join(head, ["path", "sheet"]).filter("row > header_row")
    out = {}
    for header, name in fixed.ERP_COLUMNS.items():
        place = F.array_position(F.transform("header", t.strip), header)
        value = F.when(place > 0, F.get("cells", (place - 1).cast("int")))
        out[name] = t.normalize_identifier(value) if name in fixed.ERP_IDENTIFIERS else t.strip(value)
    named = body.select("path", "row", *[v.alias(k) for k, v in out.items()]).filter("article_number is not null")
    last = named.groupBy("article_number").agg(F.max_by(F.struct(*[k for k in out if k != "article_number"]), F.struct("path", "row")).alias("x"))
    return last.select("article_number", "x.*")
