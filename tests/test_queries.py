"""Every registered query runs; those with SQL give what DuckDB gives."""

import pytest
from compare import connect, rows_of

import __spark_entry__ as entry
from orbitframe.plans import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = registry.QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if name in registry.SQL:
        answer = con.execute(registry.SQL[name])
        want = rows_of([d[0] for d in answer.description], answer.fetchall())
        assert got[0] == want[0]
        assert len(got[1]) == len(want[1])
        assert got[1] == want[1]
    assert df.columns and got[1], "a query without rows tests nothing"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
