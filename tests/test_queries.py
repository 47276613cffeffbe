"""Every registered query with SQL equals DuckDB on the smallest tables; the others run."""

import duckdb
import pytest

from maskwright import queries as privacy

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = privacy.queries(), privacy.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    rows = QUERIES[name](spark, SF)
    mine = rows.toPandas()
    if name not in SQL:
        return
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(rows.columns)
    plain = lambda v: None if v is None or v != v else bool(v) if type(v).__name__ in ("bool", "bool_") else v
    key = lambda r: tuple(repr(plain(v)) for v in r)
    theirs = sorted(key(r) for r in cursor.fetchall())
    assert sorted(key(r) for r in mine[names].astype(object).itertuples(index=False)) == theirs
