"""Every registered query that SQL can say, against DuckDB over the smallest tables."""

import math

import duckdb
import pytest

from cohortry import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v if isinstance(v, (int, str, bool, type(None))) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, con, name):
    frame = catalog.queries()[name](spark, sf)
    columns = sorted(frame.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in frame.collect()), key=repr)
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(([plain(r[names.index(c)]) for c in columns] for r in cursor.fetchall()), key=repr)
    assert got == want


def test_every_sql_has_a_query():
    assert set(SQL) <= set(catalog.queries()) and catalog.FLAGSHIP in SQL


def test_library_doesnt_import_the_corpus_operators():
    import subprocess
    import sys

    code = "import sys; import cohortry.catalog; assert not any(m.startswith('cohortry.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests", 1)[0])
