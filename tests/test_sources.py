"""Workbooks, stored cases, sinks and the decision stream."""

import json
import zipfile

import pytest

from proofsheet.sources import cases, workbook
from proofsheet.streaming import decisions

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def make_workbook(path, sheets):
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f"<workbook {NS}><sheets>{names}</sheets></workbook>")
        rels = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><t>Họ và tên</t></si></sst>")
        for i, rows in enumerate(sheets.values(), 1):
            body = ""
            for r, row in enumerate(rows, 1):
                cells = "".join(f'<c r="{chr(65 + k)}{r}" t="s"><v>0</v></c>' if v == "SHARED" else f'<c r="{chr(65 + k)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for k, v in enumerate(row) if v is not None)
                body += f'<row r="{r}">{cells}</row>'
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {NS}><sheetData>{body}</sheetData></worksheet>")


def test_workbook_rows(spark, tmp_path):
    make_workbook(tmp_path / "july.xlsx", {"list": [["STT", "SHARED"], ["1", None, "x"]], "other": [["a"]]})
    got = sorted((r.case_id, r.sheet, r.sheet_idx, r.row, r.cells) for r in workbook.read_workbooks(spark, str(tmp_path / "*.xlsx")).collect())
    assert got == [("july", "list", 0, 1, ["STT", "Họ và tên"]), ("july", "list", 0, 2, ["1", None, "x"]), ("july", "other", 1, 1, ["a"])]


def test_a_bad_workbook_is_a_row(spark, tmp_path):
    make_workbook(tmp_path / "good.xlsx", {"list": [["a"]]})
    (tmp_path / "bad.xlsx").write_bytes(b"not a zip")
    got = {r.case_id: (r.cells, r.error) for r in workbook.read_workbooks(spark, str(tmp_path / "*.xlsx")).collect()}
    assert got["good"] == (["a"], None) and got["bad"][0] is None and "not a workbook" in got["bad"][1]


def test_unsafe_workbooks_are_refused(tmp_path):
    with pytest.raises(ValueError):
        workbook.preflight(b"not a zip")
    with zipfile.ZipFile(tmp_path / "x.xlsx", "w") as z:
        z.writestr("../evil", "x")
        z.writestr("xl/workbook.xml", "<workbook/>")
    with pytest.raises(ValueError, match="unsafe"):
        workbook.preflight((tmp_path / "x.xlsx").read_bytes())


def test_case_scan(spark, tmp_path):
    review = {"done": True, "fields": {"a": {"seen": True, "flag": {"reason": "r", "note": ""}}, "b": {"seen": False, "flag": None}}}
    (tmp_path / "1.json").write_text(json.dumps({"id": "1", "createdAt": "2026-01-01", "status": "processing", "packets": [{"index": 0, "name": "An", "flags": ["near-threshold"], "review": review}, {"index": 1}]}))
    (tmp_path / "2.json").write_text(json.dumps({"id": "2", "status": "ready", "packets": []}))
    (tmp_path / "3.json").write_text("{broken")
    found = cases.read_cases(spark, str(tmp_path))
    assert [(r.id, r.status, r.error) for r in cases.newest_first(found).collect()] == [("1", "error", "interrupted"), ("2", "ready", None)]
    got = {r["index"]: (r.seen, r.flagged, r.done) for r in cases.packets_of(found).collect()}
    assert got == {0: (1, 1, True), 1: (0, 0, False)}


def test_report_csv(spark, tmp_path):
    cases.write_report_csv(spark.createDataFrame([("a,b", 'say "x"')], "p string, q string").coalesce(1), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("*.csv")).read_bytes().decode()
    assert text == 'p,q\r\n"a,b","say ""x"""\r\n'


def test_decision_stream(spark, tmp_path):
    rows = [("c", 0, 1, "BBNT", s, "", k) for k, s in enumerate(["ok", "no", "rv"])]
    for r in rows:
        cases.append_events(spark.createDataFrame([r], cases.REVIEW_EVENTS), str(tmp_path / "log"))
    q = decisions.current_decisions(decisions.decision_stream(spark, str(tmp_path / "log"), 1)).writeStream.outputMode("complete").format("memory").queryName("now").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.to_status, r.seq) for r in spark.table("now").collect()] == [("rv", 2)]
