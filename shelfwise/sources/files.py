"""Files as tables: workbooks, site maps and versioned caches."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(data: bytes) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, cells as text) of a workbook's first sheet."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in s.iter(f"{_NS}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        first = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        for k, row in enumerate(ElementTree.fromstring(z.read(first)).iter(f"{_NS}row"), 1):
            cells: list[str | None] = []
            for c in row.iter(f"{_NS}c"):
                at = 0
                for letter in re.match("[A-Z]*", c.get("r", ""))[0]:
                    at = at * 26 + ord(letter) - 64
                cells += [None] * (at - 1 - len(cells))
                value = c.findtext(f"{_NS}v") if c.get("t") != "inlineStr" else "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                cells.append(shared[int(value)] if c.get("t") == "s" and value is not None else value)
            yield k, cells


def workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, cells array<string>) of the first sheet of every workbook under a path; one workbook at a time in memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                rows = list(sheet_rows(data))
                yield pd.DataFrame({"path": [name] * len(rows), "row": [k for k, _ in rows], "cells": [c for _, c in rows]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row int, cells array<string>")


def article_numbers(sheets: DataFrame, aliases: list[str]) -> DataFrame:
    """(path, row, value) of the column whose header is an alias (lower case, without dots, blanks and underscores), else the first; in order, repeats kept."""
    clean = lambda c: F.regexp_replace(F.lower(c), r"[. _]", "")
    head = sheets.filter("row = 1").select("path", F.greatest(F.lit(1), F.array_max(F.transform(F.array(*map(F.lit, aliases)), lambda a: F.array_position(F.transform("cells", clean), a)))).cast("int").alias("at"))
    return sheets.filter("row > 1").join(head, "path").select("path", "row", F.try_element_at("cells", F.col("at")).alias("value")).filter("value is not null")


def sitemap_urls(spark: SparkSession, path: str, holds: str = "/products/") -> DataFrame:
    """The page addresses in site maps that hold a text."""
    xml = spark.read.text(path, wholetext=True)
    return xml.select(F.explode(F.xpath("value", F.lit('//*[local-name()="loc"]/text()'))).alias("url")).filter(F.contains("url", F.lit(holds)))


def cached(snapshot: DataFrame, version: int = 2) -> DataFrame:
    """Entries of the current version that were found."""
    return snapshot.filter((F.col("_cache_version") == version) & F.col("found"))


def write_sheets(sheets: dict[str, DataFrame], path: str, form: str = "parquet") -> None:
    """Each table as a folder of its own under a path, in any format Spark writes; what is there is replaced."""
    for name, sheet in sheets.items():
        sheet.write.format(form).mode("overwrite").option("header", True).save(f"{path.rstrip('/')}/{name}")
