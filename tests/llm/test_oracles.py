"""Operators that SQL can express give its rows on the whole small tables."""

import duckdb
import pytest

from siltstone.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_equal_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark"):
        connection.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    result = connection.execute(ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(row[names.index(c)] for c in columns) for row in result.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr) == want
