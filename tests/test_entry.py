"""The registered queries and the scratch folder."""

import duckdb

import __spark_entry__ as entry
from trendlab.catalog import REGISTRY
from trendlab.sources import sinks

SF = "/root/testdata/sf0.001"


def test_every_sql_names_the_columns_of_its_query():
    con = duckdb.connect()
    for name in ("lineitem", "part"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    known = entry.oracle_sql()
    for key in REGISTRY:
        found = [row[0] for row in con.execute(f"describe {known[key]}").fetchall()]
        assert found == [name for name, _ in REGISTRY[key].columns], key


def test_flagship_runs(spark):
    rows = entry.entry(spark).collect()
    assert [r.place for r in sorted(rows, key=lambda r: r.place)] == list(range(1, len(rows) + 1)) and rows


def test_scratch_is_under_the_shared_folder(spark):
    table = sinks.stored(spark.range(5), "numbers")
    assert table.count() == 5
    assert all(spark.conf.get("spark.checkpoint.dir") in path for path in table.inputFiles())
