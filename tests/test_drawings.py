"""Pictures of workbooks: sizes, headings, rows, places, refusals."""

import io
import struct
import zipfile
import zlib
from xml.etree import ElementTree

import pytest

from proofsheet.plans import workbooks as made
from proofsheet.sources import drawings as D


def changed(content, part, old, new):
    """content with a text of one part replaced."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as a, zipfile.ZipFile(out, "w") as b:
        for m in a.namelist():
            data = a.read(m)
            if m == part:
                assert old in data
                data = data.replace(old, new)
            b.writestr(m, data)
    return out.getvalue()


def pictures(content):
    return [d for _, _, _, ds in D.sheet_parts(content) for d in ds]


def test_png_size():
    whole = made.png(7, 5)
    assert D.png_size(whole) == (7, 5)
    at = whole.index(b"IDAT")
    flipped = whole[: at + 6] + bytes([whole[at + 6] ^ 1]) + whole[at + 7 :]
    for bad in (whole[:-1], whole + b"x", flipped, whole[8:], b"", whole.replace(struct.pack(">II", 7, 5), struct.pack(">II", 0, 5))):
        with pytest.raises((ValueError, struct.error)):
            D.png_size(bad)


def png_with(width, height, depth, colour, interlaced, data):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    half = len(data) // 2
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced)) + chunk(b"IDAT", data[:half]) + chunk(b"IDAT", data[half:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("width,height,depth,colour,interlaced,size", [(9, 2, 1, 0, 0, 6), (3, 2, 8, 2, 0, 20), (1, 1, 8, 6, 1, 5), (8, 8, 8, 0, 1, 64 + 15), (3, 3, 16, 4, 0, 39)])
def test_png_rows(width, height, depth, colour, interlaced, size):
    """Two pixels a row of one bit, three colours, interlaced passes (15 rows in all for 8 x 8), wide pixels; one byte less or more is refused."""
    assert D.png_size(png_with(width, height, depth, colour, interlaced, zlib.compress(bytes(size)))) == (width, height)
    for other in (size - 1, size + 1, size + 100_000):
        with pytest.raises(ValueError):
            D.png_size(png_with(width, height, depth, colour, interlaced, zlib.compress(bytes(other))))
    with pytest.raises(ValueError):
        D.png_size(png_with(width, height, 3, colour, interlaced, zlib.compress(bytes(size))))


def test_pixels_are_bounded_before_anything_is_unpacked():
    with pytest.raises(D.Refused, match="pixel-limit"):
        D.png_size(png_with(100_000, 100_000, 8, 0, 0, b""))


def test_jpeg_size():
    frame = b"\xff\xd8" + b"\xff\xe0\x00\x04ab" + b"\xff\xff\xc2\x00\x0b\x08\x00\x05\x00\x07" + bytes(20)
    assert D.picture_size(frame, "m/a.JPG") == (7, 5)
    for bad in (frame[:8], b"\xff\xd8" + bytes(30), b"\xff\xd8\xff\xe0\xff\xff" + bytes(30)):
        with pytest.raises(ValueError):
            D.picture_size(bad, "m/a.jpeg")
    with pytest.raises(ValueError):
        D.picture_size(made.png(1, 1), "m/a.jpg")


def heads(rows, merges=()):
    body = "".join(f'<row r="{r}">' + "".join(f'<c r="{c}{r}"><v>{v}</v></c>' for c, v in cells) + "</row>" for r, cells in rows)
    refs = "".join(f'<mergeCell ref="{m}"/>' for m in merges)
    return D.headings(ElementTree.fromstring(f'<worksheet xmlns="{D.MAIN[1:-1]}"><sheetData>{body}</sheetData><mergeCells>{refs}</mergeCells></worksheet>'), [])


def test_headings():
    title, labels = (1, [("A", "title")]), (3, [("A", "no"), ("D", "both sides")])
    assert heads([title, (2, [("A", " ")]), labels], ["A1:F1", "D3:E3"]) == {0: "no", 3: "both sides", 4: "both sides"}
    assert heads([title], ["A1:C1"]) == {0: "title", 1: "title", 2: "title"}
    assert heads([]) == {}
    assert heads([(1, [("A", "a"), ("B", "b"), ("C", "c")])], ["A1:D1"]) == {0: "a", 1: "b", 2: "c", 3: "a"}
    assert len(heads([(1, [("A", "a"), ("B", "b")])], ["A1:ZZZZZZ1"])) == D.COLUMNS


def test_rows():
    sheet = ElementTree.fromstring(f'<worksheet xmlns="{D.MAIN[1:-1]}"><sheetFormatPr defaultRowHeight="10"/><sheetData><row r="2" ht="20"/><row r="3" ht="0"/><row r="5" ht="x"/></sheetData></worksheet>')
    rows, p = D.Rows(sheet), D.POINT
    assert [rows.top(r) // p for r in range(6)] == [0, 10, 30, 30, 40, 50]
    assert [rows.at(v * p) for v in (-1, 0, 9, 10, 29, 30, 40, 1030)] == [0, 0, 0, 1, 1, 3, 4, 103]


def test_places_and_refusals():
    whole = made.book(6, 3)
    page, rels = "xl/drawings/drawing1.xml", "xl/drawings/_rels/drawing1.xml.rels"
    assert [d["issue"] for d in pictures(whole)] == [None, None, None, "unsupported-media", None, "unsupported-media"]
    first = pictures(whole)[0]
    assert (first["width"], first["height"]) == (7, 1) and len(first["sha256"]) == 64
    assert pictures(changed(whole, rels, b'Target="../media/p0.png"', b'Target="http://x/p0.png" TargetMode="External"'))[0]["issue"] == "external-relationship"
    assert pictures(changed(whole, rels, b"../media/p0.png", b"../../../p0.png"))[0]["issue"] == "invalid-target"
    assert pictures(changed(whole, page, b'r:embed="p0"', b'r:embed="zz"'))[0]["issue"] == "malformed-drawing"
    assert pictures(changed(whole, page, b"<x:row>2</x:row>", b"<x:row>two</x:row>"))[0]["issue"] == "malformed-drawing"
    assert pictures(changed(whole, page, b"<x:wsDr", b"<x:wsDr <"))[0] | {"issue": None} == dict.fromkeys(D.NAMES)
    beyond = pictures(changed(whole, page, b'cy="381000"', b'cy="0"'))[1]
    assert beyond["bottom_emu"] == beyond["top_emu"] - 95250 + 40 * D.POINT - (40 - 15) * D.POINT  # its own row, 15 points high
    with pytest.raises(D.Refused, match="external-relationship"):
        pictures(changed(whole, "xl/_rels/workbook.xml.rels", b'Target="worksheets/sheet1.xml"', b'Target="x" TargetMode="External"'))
    with pytest.raises(KeyError):
        pictures(changed(whole, rels, b"p0.png", b"p9.png"))


def test_limits(monkeypatch):
    whole = made.book(6, 3)
    for name, least, code in (("FILE_BYTES", 10, "workbook-too-large"), ("MEMBERS", 2, "archive-member-limit"), ("MEMBER_BYTES", 10, "archive-member-too-large"), ("ALL_BYTES", 10, "archive-uncompressed-too-large"), ("XML_BYTES", 10, "xml-too-large"), ("DRAWINGS", 5, "drawing-limit"), ("IMAGE_BYTES", 10, "image-too-large"), ("ALL_IMAGE_BYTES", 100, "total-image-too-large"), ("PIXELS", 3, "pixel-limit")):
        with monkeypatch.context() as m, pytest.raises(D.Refused, match=code):
            m.setattr(D, name, least)
            pictures(whole)


def test_files_of_a_folder(spark, tmp_path, monkeypatch):
    """Good and damaged files, by path; Spark passes over files of no bytes."""
    (tmp_path / "a.xlsx").write_bytes(made.book(8, 3))
    (tmp_path / "b.xlsx").write_bytes(b"PK")
    (tmp_path / "c.xlsx").write_bytes(b"")
    parts = D.workbook_parts(D.workbook_files(spark, str(tmp_path / "*.xlsx")))
    assert [(r.case_id, r.drawing_id, r.kind) for r in D.drawings(parts).collect()] == [("a", "drawing-0001", "card")]
    assert sorted((r.case_id, r.sheet, r.code) for r in D.issues(parts).collect()) == [("b", None, "damaged: BadZipFile")]
    assert [(r.case_id, r.column, r.n) for r in D.described(parts).collect()] == [("a", "B", 1)]
    monkeypatch.setattr(D, "FILE_BYTES", 1)
    assert [(r.path[-6:], r.content) for r in D.workbook_files(spark, str(tmp_path / "*.xlsx")).sort("path").collect()] == [("a.xlsx", None), ("b.xlsx", None)]
    none = D.workbook_parts(spark.createDataFrame([("/x/n.xlsx", None)], "path string, content binary"))
    assert [r.code for r in D.issues(none).collect()] == ["workbook-too-large"]
    assert D.drawings(none).count() == 0 and D.drawings(none.limit(0)).count() == 0
