"""Every registered query against its DuckDB oracle, or, where SQL cannot express it, against a plain version."""

import pytest

from plain import PLAIN
from tessella.plans import catalog


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, duck, name):
    got = catalog.queries()[name](spark, sf_dir)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        PLAIN[name](got.collect(), duck)
        return
    want = duck.sql(f"SELECT * FROM ({sql})")
    names = sorted(want.columns)
    assert names == sorted(got.columns)
    at = [want.columns.index(c) for c in names]
    assert rows_of(got) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_every_query_is_compared():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == set(PLAIN)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert set(df.columns) == {"category", "n", "share", "ks"} and df.count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
