"""What is known of a packet meets in one aggregation by packet: no side of the matrix is sent whole to driver or executors."""

import pytest

from proofsheet.operators import evaluate
from proofsheet.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["criteria_read", "packet_rollup", "criteria_matrix", "cell_actions", "criteria_all"])
def test_no_side_can_be_broadcast(spark, name):
    assert "Join" not in plan(spark, name)


def test_packets_keep_their_rows(spark):
    """A packet that is told twice has its cells twice, one without a number has no documents, documents without a packet have no cells."""
    row = {"name": "An", "mst": "0123456789"}
    people = spark.createDataFrame([("c", 0, True, row), ("c", 0, True, row), ("c", None, True, row), ("c", 2, True, row)], "case_id string, packet int, matched boolean, roster map<string, string>")
    docs = spark.createDataFrame([("c", 0, "d", "contract"), ("c", 0, "d", "contract"), ("c", None, "d", "contract"), ("c", 5, "d", "contract")], "case_id string, packet int, doc_id string, kind string")
    sources = spark.createDataFrame([("c", k, "mst", d, v) for k, d, v in ((0, "d", "0123456789"), (0, "d", ""), (0, "x", "1"), (None, "d", "0123456789"), (2, "d", "1"), (5, "d", "1"))], "case_id string, packet int, field_key string, doc_id string, value string")
    cells = evaluate.evaluate(people, docs, sources).filter(f"stt = 5 and document = '{evaluate.CONTRACT}'").collect()
    assert sorted((str(r.packet), r.status) for r in cells) == [("0", "ok"), ("0", "ok"), ("2", "missing"), ("None", "missing")]


def test_the_worst_copy_decides(spark):
    """Of copies that disagree alike the first document's decides whether it was misread."""
    people = spark.createDataFrame([("c", k, True, {"mst": "0123456789"}) for k in range(4)], "case_id string, packet int, matched boolean, roster map<string, string>")
    docs = spark.createDataFrame([("c", k, d, "contract") for k in range(4) for d in ("a", "b")], "case_id string, packet int, doc_id string, kind string")
    told, wrong, good = "MST TNCN: 0123456789", "9", "0123456789"
    reads = {0: ((wrong, told), (wrong, "")), 1: ((wrong, ""), (wrong, told)), 2: ((good, ""), (wrong, told)), 3: (("", told), (None, ""))}
    sources = spark.createDataFrame([("c", k, "mst", d, v, n) for k, two in reads.items() for d, (v, n) in zip("ab", two)], "case_id string, packet int, field_key string, doc_id string, value string, near string")
    cells = evaluate.evaluate(people, docs, sources).filter(f"stt = 5 and document = '{evaluate.CONTRACT}'")
    assert {r.packet: (r.status, r.pending_reason) for r in cells.collect()} == {0: ("rv", None), 1: ("no", None), 2: ("rv", None), 3: ("pending", "unread")}


def test_a_rollup_gathers_no_cells(spark):
    text = plan(spark, "packet_rollup")
    assert text.count("collect_list") <= 6  # what is known of a packet, named twice by the aggregation: cells were gathered by criterion and by packet


def test_rollup_names_documents(spark):
    rows = [(1, "Excel", "missing"), (1, evaluate.BBNT, "missing"), (2, evaluate.CONTRACT, "missing"), (2, evaluate.BBNT, "ok"), (3, evaluate.COMMITMENT, "na"), (4, evaluate.LISTING, "pending")]
    cells = spark.createDataFrame([("c", 0, *r) for r in rows] + [("c", 1, 3, evaluate.COMMITMENT, "rv"), ("c", 2, 3, "Excel", "na")], "case_id string, packet int, stt int, document string, status string")
    got = {r.packet: (r.findings, r.ai_status, r.span, r.missing, r.has_commitment) for r in evaluate.packet_rollup(cells).collect()}
    assert got == {0: (2, "missing", 3, sorted([evaluate.BBNT, evaluate.CONTRACT]), False), 1: (0, "rv", 1, [], True), 2: (0, "na", 0, [], False)}


def test_payloads_are_not_sorted_for_a_join(spark):
    text = catalog.QUERIES["matrix_payloads"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Join") == text.count("ShuffledHashJoin") > 0
