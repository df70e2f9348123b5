"""Texts are read and folded for what quotes ask for once; only those with a hit are read again."""

from proofsheet.plans import catalog


def test_locate_quote_reads_documents_once_more_for_hits(spark):
    plan = catalog.QUERIES["locate_quote"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [doc_id") == 1  # 3 before; the runs that are asked for are kept
