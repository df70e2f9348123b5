"""Uploads are inspected without joins, and their rows are read once."""

from proofsheet.operators import uploads
from proofsheet.plans import catalog

SF = "/root/testdata/sf0.001"


def test_nothing_is_joined(spark):
    plan = catalog.QUERIES["upload_inspection"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInPandas rows(") == 1


def test_sheets_are_chosen_by_their_headings(spark):
    head, rows = ["STT", "Họ và tên", "Số CCCD"], []
    rows += [("a", "s", 1, 1, head, None), ("a", "s", 1, 2, ["1", "An", "9"], None), ("a", "s", 1, 3, ["Tổng", None, "x"], None), ("a", "s", 1, 4, ["2"], None)]
    rows += [("a", "t", 0, 1, head, None), ("a", "t", 0, 2, ["1", "Ngân hàng"], None), ("a", "u", 2, 1, ["STT", "Họ và tên"], None)]
    rows += [("b", "s", 0, 1, ["x", "Ho ten", None, "CMND", "Gross"], None), ("b", "t", 1, 1, head, None), ("b", "t", 1, 2, ["1"], None), ("c", None, None, None, None, "ValueError: no")]
    r = spark.createDataFrame(rows, "case_id string, sheet string, sheet_idx int, row int, cells array<string>, error string")
    images = spark.createDataFrame([("a", "s", 2, "C", None, 1), ("a", "s", 1, "B", "card", 3), ("d", "s", 1, "B", "card", 2)], "case_id string, sheet string, from_col int, column string, kind string, n long")
    got = {x.case_id: (x.sheet, x.fields, x.people, [tuple(i) for i in x.images], x.error) for x in uploads.inspection(r, images).collect()}
    assert got == {
        "a": ("t", ["cccd", "name", "stt"], 1, [("s", "B", "card", 3), ("s", "C", None, 1)], None), "b": ("s", ["cccd", "gross", "name"], 0, [], None),
        "c": (None, [], 0, [], "ValueError: no"), "d": (None, [], 0, [("s", "B", "card", 2)], None),
    }
