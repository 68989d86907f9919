"""Queries over texts against their SQL where texts are null, empty or odd."""

import duckdb
import pytest

from spanforge.plans import catalogue, files  # noqa: F401
from tests.test_catalogue import plain

ROWS = [
    (0, "plain text", "en"), (1, None, "en"), (2, "", "fr"), (3, "more", "fr"), (4, "😀 𝒳 é", "de"), (5, "a\nb\r\nc\x0bd\x85", "de"), (6, "12 34", "es"), (7, "x" * 200 + "\n" + "y" * 61, None), (8, None, None),
    (9, "a" * 60, "q"), (10, ">head\nACGT", "en"), (11, None, "only"), (None, "abc", "en"), (12, "twice", "en"), (12, "twice", "en"), (13, "ab", "\nzz"),
]


@pytest.mark.parametrize("name", ["qual_stats", "fasta_file"])
def test_odd_documents(spark, tmp_path, name):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    got = plain([tuple(r) for r in df.collect()], df.columns)
    rel = con.execute(catalogue.ORACLE_SQL[name])
    assert got == plain(rel.fetchall(), [c[0] for c in rel.description])
