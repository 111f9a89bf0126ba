"""Every query of the catalogue against its SQL, and rows for those without."""

import os

import duckdb
import pytest

from facetlens.plans import catalog


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def sql_rows(sf, sql):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    r = c.execute(sql)
    names = [d[0] for d in r.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(repr(tuple(plain(row[k]) for k in order)) for row in r.fetchall())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    assert rows
    if name in catalog.SQL:
        assert (names, rows) == sql_rows(sf, catalog.SQL[name])
