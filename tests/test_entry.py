"""The driver's contract."""

import __spark_entry__ as driver


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_names():
    queries, sql = driver.queries(), driver.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60
