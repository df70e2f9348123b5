"""Workbooks are written and read by many tasks, few at a time in each."""

import pytest
from pyspark.sql import functions as F

from proofsheet.plans import catalog, workbooks

SF = "/root/testdata/sf0.001"


def test_books_are_dealt(spark):
    books = workbooks.books(spark, SF)
    assert books.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert books.count() == catalog.table(spark, SF, "supplier").count()


@pytest.mark.parametrize("name", ["workbook_drawings", "drawing_columns", "workbook_issues", "upload_inspection", "workbook_rows"])
def test_queries_deal_them(spark, name):
    assert "REPARTITION" in catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
