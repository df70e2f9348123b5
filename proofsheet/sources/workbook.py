"""Spreadsheet rows as a DataFrame: read_workbooks(spark, "folder/*.xlsx").

Rows come values-only, as text, from every sheet: case_id (the file's name without ending), sheet, sheet_idx, row,
cells. Files are read by Spark and parsed in tasks. Files are checked before they are read: size, number of members, encryption,
paths that leave the archive, and limits on rows, columns, cells and shared text; a file that fails gives one row with the reason in
error and nothing else, and the others are read.
"""

from __future__ import annotations

import io
import posixpath
import re
import sys
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "case_id string, sheet string, sheet_idx int, row int, cells array<string>, error string"
FILE_BYTES, MEMBERS, MEMBER_BYTES, ROWS, COLUMNS, CELLS, STRINGS = 20 << 20, 2_000, 64 << 20, 10_000, 128, 500_000, 500_000
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
OFFICE = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def preflight(content: bytes) -> zipfile.ZipFile:
    """The archive of a workbook that keeps within the limits."""
    if len(content) > FILE_BYTES:
        raise ValueError("workbook too large")
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise ValueError("not a workbook") from e
    members = archive.infolist()
    if len(members) > MEMBERS or any(m.file_size > MEMBER_BYTES for m in members):
        raise ValueError("workbook has too many or too large members")
    for m in members:
        if m.flag_bits & 1:
            raise ValueError("workbook is encrypted")
        if m.filename.startswith("/") or ".." in m.filename.split("/"):
            raise ValueError("workbook has unsafe member names")
    if "xl/workbook.xml" not in archive.namelist():
        raise ValueError("not a workbook")
    return archive


def column_of(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference.upper())[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(content: bytes) -> Iterator[tuple[str, int, int, list[str | None]]]:
    """(sheet, sheet_idx, row from 1, cells) of every row of every sheet."""
    archive = preflight(content)
    parse = lambda name: ElementTree.fromstring(archive.read(name))
    shared = []
    if "xl/sharedStrings.xml" in archive.namelist():
        shared = ["".join(t.text or "" for t in item.iter(f"{MAIN}t")) for item in parse("xl/sharedStrings.xml").iter(f"{MAIN}si")]
        if len(shared) > STRINGS:
            raise ValueError("workbook has too many strings")
    targets = {r.get("Id"): r.get("Target") for r in parse("xl/_rels/workbook.xml.rels")}
    count = 0
    for k, sheet in enumerate(parse("xl/workbook.xml").iter(f"{MAIN}sheet")):
        target = targets[sheet.get(f"{OFFICE}id")]
        part = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
        for at, row in enumerate(parse(part).iter(f"{MAIN}row"), 1):
            number = int(row.get("r") or at)
            cells: list[str | None] = []
            for c in row.iter(f"{MAIN}c"):
                col = column_of(c.get("r")) if c.get("r") else len(cells)
                count += 1
                if number > ROWS or col >= COLUMNS or count > CELLS:
                    raise ValueError("sheet too large")
                cells += [None] * (col + 1 - len(cells))
                value = c.find(f"{MAIN}v")
                if c.get("t") == "inlineStr":
                    cells[col] = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                elif value is not None and value.text is not None:
                    cells[col] = shared[int(value.text)] if c.get("t") == "s" else value.text
            yield sheet.get("name"), k, number, cells


def workbook_rows(files: DataFrame) -> DataFrame:
    """The rows of all workbooks of files (path, content)."""
    from pyspark.sql.types import StructType

    def rows(batches):
        import pandas as pd

        for pdf in batches:
            for path_, content in zip(pdf.path, pdf.content):
                case = posixpath.basename(path_).rsplit(".", 1)[0]
                try:
                    out = [(case, *r, None) for r in sheet_rows(bytes(content))]
                except (ValueError, KeyError, ElementTree.ParseError, zipfile.BadZipFile) as e:
                    out = [(case, None, None, None, None, f"{type(e).__name__}: {e}")]
                pdf_out = pd.DataFrame(out, columns=["case_id", "sheet", "sheet_idx", "row", "cells", "error"])
                yield pdf_out.astype({"sheet_idx": "Int32", "row": "Int32"})

    return files.select("path", "content").mapInPandas(rows, StructType.fromDDL(SCHEMA))


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all workbooks that a path or pattern names; the files are read by Spark, from whatever store it can reach."""
    return workbook_rows(spark.read.format("binaryFile").load(path))
