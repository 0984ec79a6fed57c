"""Every query of the library against its SQL on the smallest tables."""

import duckdb
import pytest

from granary import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = sorted(repr(tuple(r)) for r in df.select(*cols).collect())
    assert len(cols) == len(set(cols))
    if name in catalog.SQL:
        got = duck.execute(catalog.SQL[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert sorted(repr(tuple(r[i] for i in at)) for r in got.fetchall()) == rows
    else:
        assert rows


def test_entry_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalog.QUERIES) <= set(e.queries())
