"""Every registered query of the library runs on sf0.001; those with SQL equal DuckDB there."""

import math

import duckdb
import pytest

from signaloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def near(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6) or (a != a and b != b))
    return str(a) == str(b)


def order(row):
    return tuple((x is None, f"{x:.4e}" if isinstance(x, float) else str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns, rows = df.columns, df.collect()
    if sql := catalog.oracle_sql().get(name):
        found = duck.execute(sql)
        other = [d[0] for d in found.description]
        assert sorted(columns) == sorted(other)
        keys = sorted(columns, key=lambda c: bool(rows) and isinstance(rows[0][c], float))
        a = sorted((tuple(r[c] for c in keys) for r in rows), key=order)
        b = sorted((tuple(r[other.index(c)] for c in keys) for r in found.fetchall()), key=order)
        assert len(a) == len(b)
        assert all(near(x, y) for p, q in zip(a, b) for x, y in zip(p, q)), next((p, q) for p, q in zip(a, b) if not all(near(x, y) for x, y in zip(p, q)))
