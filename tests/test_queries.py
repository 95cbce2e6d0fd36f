"""Every registered query of the rest of the library against its SQL, by sorted values."""

import math
from pathlib import Path

import duckdb
import pytest

from pulselake.plans import registry

NAMES = sorted(registry.oracle_sql())


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v + 0.0, 10)
    return v


def same(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        # An exact half in the last digit may be rounded up by one engine and down by the other: a millionth, of sizeable values only.
        return math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-9)
    return a == b


def kind(x, digits):
    return (x is None, "", round(x, digits)) if isinstance(x, (int, float)) else (x is None, str(type(x)), x or "")


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(([plain(r[i]) for i in order] for r in rows), key=lambda r: ([kind(x, 3) for x in r], [kind(x, 6) for x in r]))


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = registry.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in rel.description]
    want = rows_of(columns, rel.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert all(same(a, b) for a, b in zip(g, w, strict=True)), (g, w)


def test_every_query_without_sql_returns_rows(spark, sf_dir):
    for name in sorted(set(registry.queries()) - set(NAMES)):
        assert registry.queries()[name](spark, sf_dir).count() > 0, name
