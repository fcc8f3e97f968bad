"""Every registered query that SQL can express gives the rows of its SQL."""

from __future__ import annotations

import glob
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from sonoframe.plans import catalog


@pytest.fixture(scope="module")
def db(sf):
    with duckdb.connect() as con:
        for path in glob.glob(f"{sf}/*.parquet"):
            con.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
        yield con


def alike(a, b):
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None:
            return a is b
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) or (math.isnan(a) and math.isnan(b))
    if isinstance(a, list | tuple) and isinstance(b, list | tuple):
        return len(a) == len(b) and all(map(alike, a, b))
    return a == b


def keyed(rows):
    return sorted(rows, key=lambda r: [f"{x:.6f}" if isinstance(x, float) else str(x) for x in r])


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_rows_of_the_sql(spark, sf, db, name):
    found = db.execute(catalog.ORACLES[name])
    columns = [d[0] for d in found.description]
    want = keyed(found.fetchall())
    df = catalog.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    got = keyed([tuple(r[c] for c in columns) for r in df.collect()])
    assert len(got) == len(want)
    assert all(alike(tuple(g), tuple(w)) for g, w in zip(got, want, strict=True))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_queries_without_sql_give_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry_points(spark):
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns
