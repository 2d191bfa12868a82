"""Every query of the catalogue gives the rows of its SQL."""

import duckdb
import pytest

from rowfeed.plans.catalogue import QUERIES, SQL, bounds_are_exact

TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    return "" if v is None else repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*sorted(df.columns)).collect())
    out = duck.execute(SQL[name])
    names = [c[0] for c in out.description]
    at = [names.index(c) for c in sorted(df.columns)]
    assert sorted(names) == sorted(df.columns)
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in out.fetchall())


def test_split_bounds():
    assert bounds_are_exact()
