"""Queries that return every row of what they work on."""

from proofsheet.plans import catalog

SF = "/root/testdata/sf0.001"


def test_links_and_words_are_whole(spark):
    supplier, orders = (catalog.table(spark, SF, t) for t in ("supplier", "orders"))
    nodes = {r.node for r in catalog.QUERIES["linked_suppliers"](spark, SF).collect()}
    assert nodes >= {2 * r.s_suppkey for r in supplier.collect()}
    words = {r.o_orderkey: r.amount for r in catalog.QUERIES["number_words_all"](spark, SF).collect()}
    assert words == {r.o_orderkey: r.o_custkey % 10 * 1_000_000 + r.o_orderkey % 10 * 100 for r in orders.collect()}
    assert 0 in words.values()


def test_criteria_are_whole(spark):
    rows = catalog.QUERIES["criteria_all"](spark, SF).collect()
    stt = {r.stt for r in rows}
    assert stt == set(catalog.evaluate.CRITERIA) and len(stt) == 25
    assert len({(r.o_orderkey, r.stt) for r in rows}) == len(rows) == 25 * catalog.table(spark, SF, "orders").count()
    assert {r.status for r in rows if r.stt == 1} >= {"no", "missing", "pending"} and {r.status for r in rows if r.stt == 15} == {"no", "ok", "pending"}
    batch = catalog.QUERIES["batch_criteria"](spark, SF).collect()
    assert {r.stt for r in batch} == {20, 26, 30, 31, 32} and len(batch) == 5 * catalog.table(spark, SF, "customer").count()


def test_exception_order_is_whole(spark):
    rows = catalog.QUERIES["exception_order"](spark, SF).collect()
    assert {r.event_id for r in rows} == {r.event_id for r in catalog.table(spark, SF, "events").collect()}
    assert max(r.r for r in rows) > 3
