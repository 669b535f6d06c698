import os

import duckdb
import pytest

from tabulon.plans import catalog, roundtrips  # noqa: F401  registers its queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    k = sorted(got.columns)
    assert k == sorted(want.columns)
    rows = lambda f: sorted(map(str, f[k].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
