"""Names of the roster found on documents."""

from proofsheet.operators import confirm

CELLS = "case_id string, packet int, stt int, document string, status string, pending_reason string"
LINES = "case_id string, packet int, doc_ord int, doc_id string, kind string, page int, place int, text string"


def test_confirmed_names(spark):
    """The first document by order, then the first place; blank names, other kinds and unlike lines give none; repeated lines count once; an alike line at an earlier place comes before a verbatim one."""
    packets = spark.createDataFrame([("c", 1, "Lê Thị Bích Ngọc"), ("c", 2, " "), ("c", 3, None), ("c", 4, "Trần An")], "case_id string, packet int, expected string")
    lines = [(1, 1, "b0", "bbnt", 0, 0, "bà LÊ THỊ BÍCH NGỌC."), (1, 0, "a0", "contract", 2, 5, "Le Thi Bich Ngoc"), (1, 0, "a0", "contract", 1, 4, "Lê Thị Bích Ngc"), (1, 0, "a0", "contract", 0, 3, "Lê Thị Hoa"), (1, 0, "a0", "contract", 0, 2, None),
        (1, 3, "x", "other", 0, 0, "Lê Thị Bích Ngọc"), (2, 0, "a0", "contract", 0, 0, "Lê"), (3, 0, "a0", "contract", 0, 0, "Lê"), (4, 0, "a0", "id_back", 0, 0, "Trần Anh Tú"), (4, 0, "a0", "id_front", 0, 1, "Trần Ân Trần Ân"), (4, 0, "a0", "id_front", 0, 1, "Trần Ân Trần Ân")]
    found = confirm.confirmed_names(packets, spark.createDataFrame([("c", *x) for x in lines], LINES), ["case_id", "packet"])
    got = sorted((r.packet, r.document, r.doc_id, r.page, r.place, round(r.ratio, 3)) for r in found.collect())
    assert got == [(1, "BBNT", "b0", 0, 0, 1.0), (1, "Hợp đồng", "a0", 1, 4, 0.968), (4, "CCCD/Passport", "a0", 0, 0, 0.933)]


def test_with_confirmed(spark):
    cells = spark.createDataFrame([("c", 1, 1, "Hợp đồng", "pending", "unread"), ("c", 1, 1, "BBNT", "no", None), ("c", 1, 2, "Hợp đồng", "pending", "unread"), ("c", 1, 1, "Excel", "pending", "unmatched"), ("c", 2, 1, "Hợp đồng", "pending", "unread")], CELLS)
    found = spark.createDataFrame([("c", 1, d) for d in ("Hợp đồng", "BBNT", "Excel", "Hợp đồng")], "case_id string, packet int, document string")
    got = {(r.packet, r.stt, r.document): (r.status, r.pending_reason, r.confirmed) for r in confirm.with_confirmed(cells, found).collect()}
    assert len(got) == 5 and got[1, 1, "Hợp đồng"] == ("ok", None, True)
    assert {k: v for k, v in got.items() if v[2]} == {(1, 1, "Hợp đồng"): ("ok", None, True)} and got[1, 1, "BBNT"][0] == "no"
