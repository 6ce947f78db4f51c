"""Islands of intervals against their SQL where dates are missing or alike."""

import datetime

import pytest

from tallyseq.plans import catalog


def test_orders_without_a_date_or_with_the_same_one(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    day = lambda n: None if n is None else datetime.datetime(1995, 1, 1) + datetime.timedelta(days=n)
    dates = {1: [0, 0, 90, 181, 181, None, None], 2: [None, None], 3: [5], 4: [None, 7, 300, 300], None: [1, None, 500, 500]}
    rows = [(cust, day(n)) for cust, all_ in dates.items() for n in all_]
    spark.createDataFrame(rows, "o_custkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    c = duckdb.connect()
    c.execute("SET threads = 1")  # with more, DuckDB may order rows alike in one way in one window and another way in the next
    c.execute(f"CREATE VIEW orders AS SELECT o_custkey, CAST(o_orderdate AS TIMESTAMP) AS o_orderdate FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    want = c.execute(catalog.oracle_sql()["interval_merge"]).fetchall()
    got = catalog.queries()["interval_merge"](spark, str(tmp_path)).select("cust", "start", "end", "n").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
