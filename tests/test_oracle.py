"""Every query with SQL gives the rows and the types that DuckDB gives for it on the same tables."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAME = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows_of(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_against_sql(spark, duck, sf, name):
    df = entry.queries()[name](spark, sf)
    names = sorted(df.columns)
    quoted = ", ".join(f'"{n}"' for n in names)
    theirs = duck.execute(f"SELECT {quoted} FROM ({entry.oracle_sql()[name]})")
    kinds = {d[0]: str(d[1]) for d in theirs.description}
    assert len(kinds) == len(names)
    want = rows_of(theirs.fetchall())
    got = rows_of(tuple(r) for r in df.select(*names).collect())
    assert len(got) == len(want)
    assert got == want
    types = {r[0]: r[1] for r in duck.execute(f"DESCRIBE SELECT {quoted} FROM ({entry.oracle_sql()[name]})").fetchall()}
    assert {n: SAME.get(t, t) for n, t in df.dtypes} == types
