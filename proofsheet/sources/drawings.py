"""Pictures embedded in workbooks: where they are anchored, what their columns' headings say, their size and digest.

`workbook_parts(files)` reads each workbook once, in a task, and gives a row per sheet: its headings, its placed pictures and
what was wrong with the others. What follows (`drawings`, `issues`, `described`) are expressions on such a row, without
a shuffle. Files come as rows of path and content (`workbook_files`), so they may lie in any store that Spark reads.

Limits are checked before anything is decompressed; a workbook beyond one, or one that is damaged, is a row with the
reason in error and nothing else. A picture that cannot be used (no place, no picture, an external or unsafe target, damaged
or unsupported content) keeps its number and is a row with the reason in issue. Null content counts as too large (see `workbook_files`).
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import struct
import sys
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofsheet.functions import text as T
from proofsheet.operators import cards

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The limits of a workbook.
FILE_BYTES, MEMBERS, MEMBER_BYTES, ALL_BYTES = 100 << 20, 10_000, 100 << 20, 600 << 20
XML_BYTES, DRAWINGS, IMAGE_BYTES, ALL_IMAGE_BYTES, PIXELS = 10 << 20, 500, 25 << 20, 500 << 20, 40_000_000
COLUMNS = 16_384  # of any sheet, by the file format
#: Lengths are in 1/12700 of a point; a row without a height of its own is 15 points high.
POINT, ROW_POINTS = 12_700, 15.0

DRAWING = (
    "struct<drawing_id: string, from_row: int, from_col: int, to_row: int, to_col: int, from_row_offset: bigint, from_col_offset: bigint, to_row_offset: bigint, "
    "to_col_offset: bigint, top_emu: bigint, bottom_emu: bigint, center_row: int, media: string, width: int, height: int, sha256: string, issue: string>"
)
NAMES = [f.split(":")[0].strip() for f in DRAWING[7:-1].split(",")]
SCHEMA = f"case_id string, sheet string, sheet_idx int, headings array<struct<col: int, text: string>>, drawings array<{DRAWING}>, error string"

# Names of the file format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
PLACE = "{http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing}"
ART = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
LINK_KIND = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"


class Refused(ValueError):
    """The whole workbook is not read."""


def opened(content: bytes | None) -> zipfile.ZipFile:
    """The archive of a workbook within the limits. Members never give more than the size they declare, so that size is a bound."""
    if content is None or len(content) > FILE_BYTES:
        raise Refused("workbook-too-large")
    archive = zipfile.ZipFile(io.BytesIO(content))
    members = archive.infolist()
    for bad, code in (
        (len(members) > MEMBERS, "archive-member-limit"),
        (any(m.file_size > MEMBER_BYTES for m in members), "archive-member-too-large"),
        (sum(m.file_size for m in members) > ALL_BYTES, "archive-uncompressed-too-large"),
        (any(m.flag_bits & 1 for m in members), "encrypted-entry"),
    ):
        if bad:
            raise Refused(code)
    return archive


def xml_of(archive: zipfile.ZipFile, part: str) -> ElementTree.Element:
    if archive.getinfo(part).file_size > XML_BYTES:
        raise Refused("xml-too-large")
    return ElementTree.fromstring(archive.read(part))


def links_of(archive: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str | None, str | None]]:
    """Of each link of a part its kind, the member it names, or else what is wrong with it."""
    folder, name = posixpath.split(part)
    found = {}
    for e in xml_of(archive, f"{folder}/_rels/{name}.rels"):
        target = e.get("Target") or ""
        full = posixpath.normpath(target[1:] if target.startswith("/") else posixpath.join(folder, target))
        unsafe = not target or "\\" in target or "\0" in target or target.startswith("//") or full in ("", ".") or full.startswith("/") or ".." in full.split("/")
        wrong = "external-relationship" if e.get("TargetMode") == "External" else "invalid-target" if unsafe else None
        found[e.get("Id")] = (e.get("Type"), None if wrong else full, wrong)
    return found


def linked(links: dict, key: str) -> str:
    _, member, wrong = links[key]
    if wrong:
        raise Refused(wrong)
    return member


def column_and_row(reference: str) -> tuple[int, int]:
    """Both from 0; row -1 if the reference names none."""
    letters, digits = re.match(r"([A-Za-z]*)(\d*)", reference.replace("$", "")).groups()
    col = 0
    for c in letters.upper():
        col = col * 26 + ord(c) - 64
    return col - 1, int(digits or 0) - 1


def headings(sheet: ElementTree.Element, shared: list[str]) -> dict[int, str]:
    """Text by column of the first row with two filled cells, else of the first filled row. A heading merged over several
    columns stands for all of them; merges of other rows, such as a title's, say nothing about columns."""
    chosen: tuple[int, dict[int, str]] | None = None
    for row in sheet.iterfind(f"{MAIN}sheetData/{MAIN}row"):
        filled, number = {}, -1
        for c in row.iterfind(f"{MAIN}c"):
            if not c.get("r"):
                continue
            value, inline = c.findtext(f"{MAIN}v") or "", c.find(f"{MAIN}is")
            if c.get("t") == "s":
                value = shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
            elif c.get("t") == "inlineStr":
                value = "".join(inline.itertext()) if inline is not None else ""
            if value.strip():
                col, at = column_and_row(c.get("r"))
                number = number if filled else at
                filled[col] = value
        if len(filled) >= 2 or (filled and chosen is None):
            chosen = (number, filled)
        if len(filled) >= 2:
            break
    number, text = chosen or (-1, {})
    text = dict(text)
    for merge in sheet.iterfind(f"{MAIN}mergeCells/{MAIN}mergeCell"):
        first, _, last = (merge.get("ref") or "").partition(":")
        col, row = column_and_row(first)
        if last and row == number and text.get(col):
            for k in range(col + 1, min(column_and_row(last)[0] + 1, COLUMNS)):
                text.setdefault(k, text[col])
    return text


class Rows:
    """Where the rows of a sheet begin: only rows with a height of their own are listed."""

    def __init__(self, sheet: ElementTree.Element):
        def number(text):
            try:
                return float(text)
            except (TypeError, ValueError):
                return None

        form = sheet.find(f"{MAIN}sheetFormatPr")
        points = number(form.get("defaultRowHeight")) if form is not None else None
        self.default = max(round((ROW_POINTS if points is None else points) * POINT), 1)
        own = {int(r.get("r")) - 1: round(number(r.get("ht")) * POINT) for r in sheet.iterfind(f"{MAIN}sheetData/{MAIN}row") if r.get("r") and number(r.get("ht")) is not None}
        self.listed = np.array(sorted(own), dtype=np.int64)
        self.heights = np.array([own[k] for k in self.listed.tolist()], dtype=np.int64)
        self.extra = np.concatenate([[0], np.cumsum(self.heights - self.default)])

    def top(self, row: int) -> int:
        return int(row * self.default + self.extra[np.searchsorted(self.listed, row)])

    def at(self, place: int) -> int:
        """The row that holds a place; of rows without height the last."""
        tops = self.listed * self.default + self.extra[:-1]
        k = int(np.searchsorted(tops, place, side="right")) - 1
        if k < 0:
            return max(place // self.default, 0)
        beyond = place - int(tops[k] + self.heights[k])
        return int(self.listed[k]) + (0 if beyond < 0 else 1 + beyond // self.default)


def png_size(b: bytes) -> tuple[int, int]:
    """Width and height of a whole, undamaged PNG: every chunk's checksum holds and its rows decompress to just the size that the header implies."""
    if b[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no png")
    at, head, data, kind = 8, None, [], b""
    while kind != b"IEND":
        length, kind = struct.unpack_from(">I4s", b, at)
        body = b[at + 8 : at + 8 + length]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", b, at + 8 + length)[0]:
            raise ValueError("damaged chunk")
        at += 12 + length
        if head is None:
            if kind != b"IHDR" or length != 13:
                raise ValueError("no header")
            head = struct.unpack(">IIBBBBB", body)
            if head[0] * head[1] > PIXELS:
                raise Refused("pixel-limit")
        elif kind == b"IDAT":
            data.append(body)
    width, height, depth, colour, packing, filtering, interlaced = head
    # Channels and depths of each colour type, and the seven interlaced passes (first column, row; steps).
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
    depths = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
    passes = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)) if interlaced else ((0, 0, 1, 1),)
    if not width or not height or depth not in depths.get(colour, ()) or packing or filtering or interlaced > 1 or length or at != len(b):
        raise ValueError("bad header or end")
    want = 0
    for x, y, dx, dy in passes:
        columns, rows = -(-(width - x) // dx), -(-(height - y) // dy)
        want += rows * (1 + -(-columns * channels[colour] * depth // 8)) if columns > 0 and rows > 0 else 0
    inflate, got = zlib.decompressobj(), 0
    for body in data:
        while body and got <= want:
            got += len(inflate.decompress(body, 1 << 16))
            body = inflate.unconsumed_tail
            if inflate.unused_data:
                raise ValueError("bytes after the rows")
    if got + len(inflate.flush(1)) != want or not inflate.eof:
        raise ValueError("rows of another size")
    return width, height


def jpeg_size(b: bytes) -> tuple[int, int]:
    """Width and height from the first frame header."""
    at = 2
    while at + 9 < len(b):
        if b[at] != 0xFF:
            break
        marker = b[at + 1]
        if marker == 0xFF:  # filling
            at += 1
        elif marker in (0xD8, 0xD9):
            at += 2
        else:
            length = struct.unpack_from(">H", b, at + 2)[0]
            if length < 2 or at + 2 + length > len(b):
                break
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack_from(">HH", b, at + 5)
                return width, height
            at += 2 + length
    raise ValueError("no jpeg frame")


def picture_size(content: bytes, media: str) -> tuple[int, int]:
    ending = media.rsplit(".", 1)[-1].lower()
    if ending == "png":
        size = png_size(content)
    elif ending in ("jpg", "jpeg") and content[:2] == b"\xff\xd8":
        size = jpeg_size(content)
    else:
        raise ValueError("unsupported")
    if size[0] * size[1] > PIXELS:
        raise Refused("pixel-limit")
    return size


def placed(anchor: ElementTree.Element, rows: Rows) -> dict:
    """Cells, offsets and vertical extent of an anchor; ValueError if its place is not stated.

    An anchor at one cell has no second corner: it counts as one cell wide and high, and its height is the one it states.
    """
    def value(side, name, default=None):
        text = anchor.findtext(f"{PLACE}{side}/{PLACE}{name}")
        if text is None and default is None:
            raise ValueError(f"no {side} {name}")
        return default if text is None else int(text)

    one = anchor.tag == f"{PLACE}oneCellAnchor"
    out = {"from_row": value("from", "row"), "from_col": value("from", "col")}
    out |= {"to_row": out["from_row"] + 1, "to_col": out["from_col"] + 1} if one else {"to_row": value("to", "row"), "to_col": value("to", "col")}
    for side, axis in (("from", "row"), ("from", "col"), ("to", "row"), ("to", "col")):
        out[f"{side}_{axis}_offset"] = 0 if one and side == "to" else value(side, f"{axis}Off", 0)
    top = rows.top(out["from_row"]) + out["from_row_offset"]
    extent = anchor.find(f"{PLACE}ext")
    stated = extent.get("cy") or "" if one and extent is not None else ""
    bottom = top + int(stated) if stated.isdigit() and int(stated) > 0 else rows.top(out["to_row"]) + out["to_row_offset"]
    return out | {"top_emu": top, "bottom_emu": bottom, "center_row": rows.at((top + bottom) // 2)}


def sheet_parts(content: bytes | None) -> Iterator[tuple[str, int, list, list]]:
    """(sheet, sheet_idx, headings, drawings) of every sheet, in the workbook's order; pictures are numbered through all sheets."""
    archive = opened(content)
    shared = ["".join(s.itertext()) for s in xml_of(archive, "xl/sharedStrings.xml").iterfind(f"{MAIN}si")] if "xl/sharedStrings.xml" in archive.namelist() else []
    book = links_of(archive, "xl/workbook.xml")
    count, image_bytes = 0, 0
    for idx, entry in enumerate(xml_of(archive, "xl/workbook.xml").iter(f"{MAIN}sheet")):
        part = linked(book, entry.get(f"{LINK}id"))
        sheet = xml_of(archive, part)
        rows, found = Rows(sheet), []
        marks = sheet.findall(f".//{MAIN}drawing")
        links = links_of(archive, part) if marks else {}
        for mark in marks:
            if links[mark.get(f"{LINK}id")][0] != LINK_KIND + "drawing":
                continue
            page = linked(links, mark.get(f"{LINK}id"))
            media = links_of(archive, page)
            try:
                anchors = [a for a in xml_of(archive, page) if a.tag in (f"{PLACE}twoCellAnchor", f"{PLACE}oneCellAnchor")]
            except ElementTree.ParseError:
                found.append({"issue": "malformed-drawing"})
                continue
            for anchor in anchors:
                count += 1
                if count > DRAWINGS:
                    raise Refused("drawing-limit")
                own = {"drawing_id": f"drawing-{count:04d}"}
                found.append(own)
                blip = anchor.find(f".//{ART}blip")
                kind, member, wrong = media.get(blip.get(f"{LINK}embed"), (None, None, None)) if blip is not None else (None, None, None)
                try:
                    place = placed(anchor, rows)
                except ValueError:
                    place = None
                if place is None or kind != LINK_KIND + "image" or wrong:
                    own["issue"] = "malformed-drawing" if place is None or kind != LINK_KIND + "image" else wrong
                    continue
                own |= place | {"media": member}
                if member.rsplit(".", 1)[-1].lower() not in ("png", "jpg", "jpeg"):
                    own["issue"] = "unsupported-media"
                    continue
                size = archive.getinfo(member).file_size
                image_bytes += size
                if size > IMAGE_BYTES or image_bytes > ALL_IMAGE_BYTES:
                    raise Refused("image-too-large" if size > IMAGE_BYTES else "total-image-too-large")
                picture = archive.read(member)
                try:
                    own["width"], own["height"] = picture_size(picture, member)
                    own["sha256"] = hashlib.sha256(picture).hexdigest()
                except Refused:
                    raise
                except (ValueError, struct.error, zlib.error):
                    own["issue"] = "unsupported-media"
        yield entry.get("name"), idx, [{"col": k, "text": v} for k, v in sorted(headings(sheet, shared).items())], [{n: d.get(n) for n in NAMES} for d in found]


def workbook_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of the workbooks that a path or pattern names; content is null, and not read, beyond the limit of a file.

    Spark's reader passes over files of no bytes: they give no row.
    """
    files = spark.read.format("binaryFile").load(path)
    large = files.filter(F.col("length") > FILE_BYTES).select("path", F.lit(None).cast("binary").alias("content"))
    return files.filter(F.col("length") <= FILE_BYTES).select("path", "content").unionByName(large)


def workbook_parts(files: DataFrame) -> DataFrame:
    """A row per sheet of each of files (path, content): case_id (the file's name without ending), sheet, sheet_idx, headings, drawings; or a row with error."""
    def read(batches):
        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf.path, pdf.content):
                case = posixpath.basename(path).rsplit(".", 1)[0]
                try:
                    out = [(case, *r, None) for r in sheet_parts(content)]
                except Refused as e:
                    out = [(case, None, None, None, None, str(e))]
                except (ValueError, KeyError, AttributeError, TypeError, struct.error, zlib.error, EOFError, NotImplementedError, ElementTree.ParseError, zipfile.BadZipFile) as e:
                    out = [(case, None, None, None, None, f"damaged: {type(e).__name__}")]
                yield pd.DataFrame(out, columns=["case_id", "sheet", "sheet_idx", "headings", "drawings", "error"]).astype({"sheet_idx": "Int32"})

    return files.select("path", "content").mapInPandas(read, SCHEMA)


def kinds_of(headings_: Column, sheet: Column) -> Column:
    """Array of (col, kind) of the headings over images, by column."""
    folded = F.transform(headings_, lambda h: F.struct(h["col"].alias("col"), T.fold_label(h["text"]).alias("text")))
    by_col = F.map_from_entries(folded)
    kind = lambda h: cards.heading_kind(h["text"], F.coalesce(F.try_element_at(by_col, h["col"] - 1), F.lit("")), sheet)
    return F.filter(F.transform(folded, lambda h: F.struct(h["col"].alias("col"), kind(h).alias("kind"))), lambda h: h["kind"].isNotNull())


def all_drawings(parts: DataFrame) -> DataFrame:
    """A row per picture, usable or not, with kind: that of the leftmost explained column it covers, else null."""
    known = parts.filter("error is null").withColumn("__kinds", kinds_of(F.col("headings"), F.col("sheet")))
    d = known.select("case_id", "sheet", "sheet_idx", "__kinds", F.explode("drawings").alias("__d"))
    covered = F.filter("__kinds", lambda k: k["col"].between(F.col("__d.from_col"), F.col("__d.to_col")))
    return d.select("case_id", "sheet", "sheet_idx", "__d.*", F.get(covered, F.lit(0))["kind"].alias("kind"))


def drawings(parts: DataFrame) -> DataFrame:
    """The usable pictures."""
    return all_drawings(parts).filter("issue is null").drop("issue")


def issues(parts: DataFrame) -> DataFrame:
    """case_id, sheet, drawing_id, code: pictures that cannot be used (drawing_id is null if a sheet's whole page of pictures
    is unreadable), and workbooks that were not read (sheet is null)."""
    whole = parts.filter("error is not null").select("case_id", "sheet", F.lit(None).cast("string").alias("drawing_id"), F.col("error").alias("code"))
    return all_drawings(parts).filter("issue is not null").select("case_id", "sheet", "drawing_id", F.col("issue").alias("code")).unionByName(whole)


def described(parts: DataFrame) -> DataFrame:
    """case_id, sheet, from_col, column (its letters), kind (of the last picture), n: how many placed pictures begin in each column, whether or not their content can be used."""
    own = all_drawings(parts).filter("media is not null")
    counted = own.groupBy("case_id", "sheet", "from_col").agg(F.max(F.struct("drawing_id", "kind"))["kind"].alias("kind"), F.count("*").alias("n"))
    return counted.withColumn("column", T.column_letters(F.col("from_col")))
