"""Workbooks (XLSX: a zip of XML parts) as rows of cells. A workbook is a small file; many of them are read side by side."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: names of the format
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: A sheet that is never read for conditions.
SKIPPED = ("recording times",)


def _column(reference: str) -> int:
    """A cell's column from its letters: A is 0."""
    n = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def _text(node: ET.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def read_workbook(data: bytes) -> list[tuple[str, list[list[str | None]]]]:
    """(name, rows of texts) of each sheet in order. Numbers are as they are stored, missing cells None."""
    with zipfile.ZipFile(io.BytesIO(data)) as parts:
        names = set(parts.namelist())
        shared = [_text(x) for x in ET.fromstring(parts.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(parts.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ET.fromstring(parts.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = targets[sheet.get(_LINK)].lstrip("/")
            rows: list[list[str | None]] = []
            for row in ET.fromstring(parts.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_MAIN}row"):
                cells: dict[int, str | None] = {}
                for c in row.iter(f"{_MAIN}c"):
                    value, kind = c.find(f"{_MAIN}v"), c.get("t")
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    if kind == "inlineStr":
                        cells[at] = _text(c)
                    elif value is not None and value.text is not None:
                        cells[at] = shared[int(value.text)] if kind == "s" else value.text
                rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
            out.append((sheet.get("name"), rows))
    return out


def workbook_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, ord, cells): the rows under each sheet's first row, as maps from its trimmed, lower-cased headers to texts; missing cells are left out.

    ord counts through the sheets of a file, in their order. Of equal headers the first counts. A file that can't be read fails the read.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(frames):
        for frame in frames:
            for file, data in zip(frame["path"], frame["content"], strict=True):
                found, n = [], 0
                for sheet, rows in read_workbook(data):
                    header = [str(c).strip().lower() if c is not None else "" for c in (rows[0] if rows else [])]
                    for row in rows[1:]:
                        cells: dict[str, str] = {}
                        for name, value in zip(header, row, strict=False):
                            if name and value is not None:
                                cells.setdefault(name, value)
                        found.append((file, sheet, n, cells))
                        n += 1
                yield pd.DataFrame(found, columns=["file", "sheet", "ord", "cells"])

    return files.mapInPandas(run, "file string, sheet string, ord long, cells map<string,string>").filter(~F.col("sheet").isin(*SKIPPED))
