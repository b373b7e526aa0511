"""Each query against DuckDB over the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from convolake.plans import catalog

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return db


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, sf_dir, name):
    got = catalog.queries()[name](spark, sf_dir)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    mine, theirs = plain(map(tuple, got.collect()), got.columns), plain(want.fetchall(), columns)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_rows(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0
