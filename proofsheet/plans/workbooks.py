"""Registered queries on workbooks as files: rows, pictures, image columns, inspection.

Every supplier is a workbook, written in tasks: a sheet of its nation's suppliers up to it in turn, and a sheet of pictures.
One in eleven is no workbook, one in thirteen has too many parts of pictures to be read.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofsheet.operators import uploads
from proofsheet.plans.catalog import query, table
from proofsheet.sources import drawings, workbook

AT_ONCE = 16
LINKS = "http://schemas.openxmlformats.org/package/2006/relationships"
PLACES = "http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing"


def png(width: int, height: int) -> bytes:
    """A grey picture."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = zlib.compress((b"\0" + b"\x80" * width) * height)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", rows) + chunk(b"IEND", b"")


def links(items: list[tuple[str, str, str]]) -> str:
    rows = "".join(f'<Relationship Id="{i}" Type="{drawings.LINK_KIND}{kind}" Target="{target}"/>' for i, kind, target in items)
    return f'<Relationships xmlns="{LINKS}">{rows}</Relationships>'


def anchor(key: int, i: int) -> str:
    """Picture i begins half a row down in row i + 2; every other one is placed by its corner alone and 30 points high."""
    at = lambda side, row, col, off: f"<x:{side}><x:col>{col}</x:col><x:row>{row}</x:row><x:rowOff>{off}</x:rowOff></x:{side}>"
    start, picture = at("from", i + 2, 1 + i % 4, 95250), f'<x:pic><x:blipFill><a:blip r:embed="p{i}"/></x:blipFill></x:pic>'
    if i % 2:
        return f'<x:oneCellAnchor>{start}<x:ext cx="1" cy="381000"/>{picture}</x:oneCellAnchor>'
    return f'<x:twoCellAnchor>{start}{at("to", i + 3, 1 + i % 4 + (key % 3 == 0), 0)}{picture}</x:twoCellAnchor>'


def book(key: int, nation: int) -> bytes:
    """A workbook as described above; picture 3 is of a kind that is not read, picture 5 is damaged."""
    if key % 11 == 0:
        return b"not a workbook"
    main = f'xmlns="{drawings.MAIN[1:-1]}" xmlns:r="{drawings.LINK[1:-1]}"'
    line = lambda r, cells, more="": f'<row r="{r}"{more}>' + "".join(f'<c r="{c}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in cells) + "</row>"
    people = [line(1, [("A", "STT"), ("B", "Họ và tên"), ("C", "Số CCCD")])] + [line(k + 2, [("A", k + 1), ("B", f"An {k}"), ("C", f"{key * 100 + k:012d}")]) for k in range(nation)]
    sized = "".join(line(k + 3, [("A", k + 1)], f' ht="{20 + 5 * k}"') for k in range(0, 6, 2))
    heads = line(1, [("A", "Hình ảnh người nộp")]) + line(2, [("A", "STT"), ("B", "Hình CCCD"), ("D", "STK"), ("E", "Hình Ảnh")])
    pictures = range(600 if key % 13 == 0 else key % 7)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main}><sheets><sheet name="list" sheetId="1" r:id="a"/><sheet name="Ảnh" sheetId="2" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", links([("a", "worksheet", "worksheets/sheet1.xml"), ("b", "worksheet", "/xl/worksheets/sheet2.xml")]))
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData>{"".join(people)}</sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {main}><sheetFormatPr defaultRowHeight="15"/><sheetData>{heads}{sized}</sheetData><mergeCells><mergeCell ref="A1:F1"/><mergeCell ref="B2:C2"/></mergeCells><drawing r:id="d"/></worksheet>')
        z.writestr("xl/worksheets/_rels/sheet2.xml.rels", links([("d", "drawing", "../drawings/drawing1.xml")]))
        z.writestr("xl/drawings/drawing1.xml", f'<x:wsDr xmlns:x="{PLACES}" xmlns:a="{drawings.ART[1:-1]}" {main}>{"".join(anchor(key, i) for i in pictures)}</x:wsDr>')
        z.writestr("xl/drawings/_rels/drawing1.xml.rels", links([(f"p{i}", "image", f"../media/p{i}.{'gif' if i == 3 else 'png'}") for i in pictures]))
        for i in pictures:
            z.writestr(f"xl/media/p{i}.{'gif' if i == 3 else 'png'}", png(key % 9 + 1, i + 1)[: -1 if i == 5 else None])
    return out.getvalue()


def books(spark, sf_dir) -> DataFrame:
    """path and content of every supplier's workbook."""
    def write(batches):
        for batch in batches:
            for at in range(0, len(batch), AT_ONCE):  # a task holds few workbooks at a time, however many suppliers come to it together
                pdf = batch.iloc[at:at + AT_ONCE]
                yield pdf.assign(content=[book(k, n) for k, n in zip(pdf.s_suppkey, pdf.s_nationkey)], path="/in/" + pdf.s_suppkey.astype(str) + ".xlsx")[["path", "content"]]

    # a row becomes a file of many times its size: suppliers that one task reads in no time are dealt over all tasks before they are written
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").repartition(tasks).mapInPandas(write, "path string, content binary")


# Rows 3, 5 and 7 (from 1) are 20, 30 and 40 points high, the others 15, so row r from 0 begins 5, 15 and 25 points lower behind them.
TOP = "(({0}) * 190500 + CASE WHEN ({0}) > 2 THEN 63500 ELSE 0 END + CASE WHEN ({0}) > 4 THEN 190500 ELSE 0 END + CASE WHEN ({0}) > 6 THEN 317500 ELSE 0 END)"
PICTURES = f"""SELECT s_suppkey AS k, s_suppkey % 7 AS all_of, i, i + 2 AS from_row, 1 + i % 4 AS from_col, i + 3 AS to_row, 1 + i % 4 + CASE WHEN i % 2 = 1 OR s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS to_col,
 {TOP.format('i + 2')} + 95250 AS top, CASE WHEN i % 2 = 1 THEN {TOP.format('i + 2')} + 476250 ELSE {TOP.format('i + 3')} END AS bottom
 FROM supplier, range(6) t(i) WHERE i < s_suppkey % 7 AND s_suppkey % 11 <> 0 AND s_suppkey % 13 <> 0"""
KIND = "CASE WHEN from_col <= 2 THEN 'card' WHEN to_col >= 4 THEN 'bank' END"


@query(f"""WITH p AS ({PICTURES}), r AS (SELECT r, {TOP.format('r')} AS t, {TOP.format('r + 1')} AS b FROM range(40) x(r))
 SELECT CAST(k AS VARCHAR) AS case_id, 'drawing-' || lpad(CAST(i + 1 AS VARCHAR), 4, '0') AS drawing_id, from_row, from_col, to_row, to_col, top AS top_emu, bottom AS bottom_emu, r AS center_row, k % 9 + 1 AS width, i + 1 AS height, {KIND} AS kind
 FROM p JOIN r ON (top + bottom) // 2 >= t AND (top + bottom) // 2 < b WHERE i NOT IN (3, 5)""")
def workbook_drawings(spark, sf_dir):
    d = drawings.drawings(drawings.workbook_parts(books(spark, sf_dir)))
    return d.select("case_id", "drawing_id", "from_row", "from_col", "to_row", "to_col", "top_emu", "bottom_emu", "center_row", "width", "height", "kind")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS case_id, CASE WHEN s_suppkey % 11 <> 0 AND s_suppkey % 13 <> 0 THEN 'drawing-' || lpad(CAST(i + 1 AS VARCHAR), 4, '0') END AS drawing_id,
 CASE WHEN s_suppkey % 11 = 0 THEN 'damaged: BadZipFile' WHEN s_suppkey % 13 = 0 THEN 'drawing-limit' ELSE 'unsupported-media' END AS code FROM supplier, (VALUES (3), (5)) t(i)
 WHERE (i = 3 AND (s_suppkey % 11 = 0 OR s_suppkey % 13 = 0)) OR (i < s_suppkey % 7 AND s_suppkey % 11 <> 0 AND s_suppkey % 13 <> 0)""")
def workbook_issues(spark, sf_dir):
    return drawings.issues(drawings.workbook_parts(books(spark, sf_dir))).select("case_id", "drawing_id", "code")


@query(f"""SELECT CAST(k AS VARCHAR) AS case_id, ['B', 'C', 'D', 'E'][from_col] AS "column", count(*) AS n, arg_max(coalesce({KIND}, ''), i) AS kind FROM ({PICTURES}) GROUP BY k, from_col""")
def drawing_columns(spark, sf_dir):
    return drawings.described(drawings.workbook_parts(books(spark, sf_dir))).select("case_id", "column", "n", F.coalesce("kind", F.lit("")).alias("kind"))


SHEET_ROWS = """SELECT s_suppkey AS k, 'list' AS sheet, r + 1 AS "row", CASE WHEN r = 0 THEN 'STT|Họ và tên|Số CCCD' ELSE r || '|An ' || (r - 1) || '|' || lpad(CAST(s_suppkey * 100 + r - 1 AS VARCHAR), 12, '0') END AS cells
 FROM supplier, range(40) t(r) WHERE r <= s_nationkey
 UNION ALL SELECT s_suppkey, 'Ảnh', r, cells FROM supplier, (VALUES (1, 'Hình ảnh người nộp'), (2, 'STT|Hình CCCD|-|STK|Hình Ảnh'), (3, '1'), (5, '3'), (7, '5')) t(r, cells)"""


@query(f"""SELECT CAST(k AS VARCHAR) AS case_id, sheet, "row", cells, NULL AS error FROM ({SHEET_ROWS}) WHERE k % 11 <> 0
 UNION ALL SELECT CAST(s_suppkey AS VARCHAR), NULL, NULL, NULL, 'ValueError: not a workbook' FROM supplier WHERE s_suppkey % 11 = 0""")
def workbook_rows(spark, sf_dir):
    rows = workbook.workbook_rows(books(spark, sf_dir))
    return rows.select("case_id", "sheet", "row", F.array_join("cells", "|", "-").alias("cells"), "error")


@query(f"""WITH i AS (SELECT k, string_agg(c, ',' ORDER BY c) AS images FROM (SELECT k, ['B', 'C', 'D', 'E'][from_col] || ':' || coalesce(arg_max(coalesce({KIND}, ''), i), '') || ':' || count(*) AS c FROM ({PICTURES}) GROUP BY k, from_col) GROUP BY k)
 SELECT CAST(s_suppkey AS VARCHAR) AS case_id, CASE WHEN s_suppkey % 11 <> 0 THEN 'list' END AS sheet, CASE WHEN s_suppkey % 11 <> 0 THEN 'cccd,name' ELSE '' END AS fields,
 CASE WHEN s_suppkey % 11 <> 0 THEN s_nationkey ELSE 0 END AS people, coalesce(images, '') AS images FROM supplier LEFT JOIN i ON k = s_suppkey""")
def upload_inspection(spark, sf_dir):
    files = books(spark, sf_dir)
    seen = uploads.inspection(workbook.workbook_rows(files), drawings.described(drawings.workbook_parts(files)))
    image = F.transform("images", lambda i: F.concat_ws(":", i["column"], F.coalesce(i["kind"], F.lit("")), i["n"].cast("string")))
    return seen.select("case_id", "sheet", F.array_join(F.array_remove("fields", "stt"), ",").alias("fields"), "people", F.array_join(image, ",").alias("images"))
