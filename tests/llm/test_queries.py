"""The registered queries beside their SQL on a small table."""

import duckdb
import pytest

import __spark_entry__ as entry
from trendlab.llm.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels", "conversations")


def rows_of(found, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(row[k] for k in order) for row in found), key=repr)


@pytest.mark.parametrize("key", sorted(SQL))
def test_rows_equal_those_of_the_sql(spark, key):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    frame = QUERIES[key](spark, SMALL)
    cursor = con.execute(SQL[key])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    assert rows_of(cursor.fetchall(), names) == rows_of([tuple(r) for r in frame.collect()], frame.columns)


def test_one_query_for_each_operator_and_the_pipeline():
    known = entry.queries()
    assert [sum(key.startswith(f"op{n}_") for key in known) for n in range(1, 14)] == [1] * 13
    assert "pipeline" in known and set(SQL) <= set(entry.oracle_sql())
