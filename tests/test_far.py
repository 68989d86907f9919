"""Queries on the smallest tables with keys so large that positions lie around and behind the reach of the
standard bins (2^29), against their SQL."""

import duckdb
import pytest

from spanforge.plans import catalogue, files  # noqa: F401
from tests.test_catalogue import plain

FAR = "bin_index_chunks bin_index_compressed bin_tree index_difference positions reg2bin_assign reg2bin_deep reg2bins_expand linear_index coverage_estimate index_query interval_join interval_semi interval_anti separate_regions missed_regions".split()
SHIFT = 536_800


@pytest.fixture(scope="module")
def far(sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("far")
    con = duckdb.connect()
    for t, key in (("part", "p_partkey"), ("lineitem", "l_partkey")):
        con.execute(f"COPY (SELECT * REPLACE (CAST({key} + {SHIFT} AS BIGINT) AS {key}) FROM '{sf}/{t}.parquet') TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{sf}/supplier.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", FAR)
def test_far_positions(spark, far, name):
    folder, con = far
    df = catalogue.QUERIES[name](spark, folder)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    rel = con.execute(catalogue.ORACLE_SQL[name])
    assert got == plain(rel.fetchall(), [c[0] for c in rel.description])
