"""The corpus queries against their SQL twins in DuckDB, on the smallest tables."""

import duckdb
import pytest

from proofsheet.llm import queries, sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sql.ORACLE_SQL)
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(sql.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_every_query_has_a_name_of_its_own():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
