"""Every catalogue query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from spanforge.plans import catalogue, files  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(names)
    at = [names.index(n) for n in order]
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    return order, sorted((tuple(tidy(r[i]) for i in at) for r in rows), key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_oracle(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    rel = duck.execute(catalogue.ORACLE_SQL[name])
    want = plain(rel.fetchall(), [c[0] for c in rel.description])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
