import pytest
from pyspark.sql import functions as F

LONG = "the quick brown fox jumps over the lazy dog again " * 4000
EDGE = [
    (1, "one two three four five six seven eight nine ten"),
    (2, "one two three four five six seven eight nine ten"),
    (2, "one two three four five six seven eight nine ten"),
    (3, None),
    (4, ""),
    (5, " \t\n"),
    (6, "word"),
    (7, "Ünïcode ß 漢字 😀 a b"),
    (8, LONG),
    (9, "x" * 50_000),
    (None, "no id at all here to be seen by anyone"),
    (None, None),
    (-3, "negative id <|endoftext|> with special text"),
]
#: Names that operators use inside.
CLASHES = ["_id", "_text", "_fp", "_r", "_b", "d", "th", "core", "size", "slot", "vslot", "shard", "ids", "length", "piece", "score", "component", "node", "_s", "_n", "_band", "text_crc32", "__x"]


@pytest.fixture(scope="session")
def edge_docs(spark):
    df = spark.createDataFrame(EDGE, "doc_id long, text string")
    df = df.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit("clash") for c in CLASHES}).repartition(3).cache()


@pytest.fixture
def edge_dir(edge_docs, tmp_path):
    edge_docs.write.parquet(f"{tmp_path}/edge/documents.parquet")
    return f"{tmp_path}/edge"


@pytest.fixture
def empty_dir(edge_docs, tmp_path):
    edge_docs.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    return f"{tmp_path}/empty"
