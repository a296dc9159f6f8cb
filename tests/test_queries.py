"""Every query of the library against DuckDB on the smallest tables; queries without SQL must run."""

from __future__ import annotations

import pytest

from quarrylane.plans import catalog

from .conftest import rows_of

_SQL = catalog.oracle_sql()


def test_every_sql_has_a_query():
    assert {*_SQL} <= {*catalog.queries()}


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, duck, name):
    got = catalog.queries()[name](spark, sf_dir).toPandas()
    if name not in _SQL:
        assert len(got.columns)
        return
    want = duck.execute(_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_formats_around_zero(spark, tmp_path):
    import duckdb

    where = str(tmp_path / "customer.parquet")
    cents = [(k, (k - 300) / 100) for k in range(600)]
    spark.createDataFrame([*cents, (900, None), (901, -0.0), (902, 9.94997), (903, -9.94997), (904, 9999.99)], "c_custkey long, c_acctbal double").write.parquet(where)
    got = catalog.queries()["t20_formats"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{where}/*.parquet')")
    assert rows_of(got) == rows_of(con.execute(_SQL["t20_formats"]).df())


def test_entry_point(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert {*catalog.queries()} <= {*entry.queries()}
