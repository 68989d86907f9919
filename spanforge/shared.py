"""Places that every executor can reach.

A stage that must cut its lineage writes a Parquet table below the folder named by
``spark.checkpoint.dir``.  The setting is read from the session; only where it is unset
(local tests) a temporary folder is made and set.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, as a URI or path that Spark's writers accept."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = getattr(spark, "_spanforge_shared", None)
        if not found:
            found = tempfile.mkdtemp(prefix="spanforge-")
            spark._spanforge_shared = found
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/spanforge-{name}-{uuid.uuid4().hex}"


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


ROWS_PER_FILE = 100_000


def materialise(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs start from the files,
    so a lost executor costs no recomputation of what came before.  Once the files are written
    nothing reads the shuffle that made them again, so Spark removes it with the job.

    ``rows``, where the caller knows how many there can be at most, bounds the number of files, so
    that a small table is not written as hundreds of tiny ones."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(4, -(-rows // ROWS_PER_FILE)))
    path = new_path(spark, name)
    was = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, was)
    return spark.read.schema(df.schema).parquet(path)


PIECE = 2 << 20  # bytes of input, as Spark's statistics tell them, of one task: some 600,000 rows of three numbers


def pieces(df: DataFrame) -> int | None:
    """How many tasks a shuffle of ``df`` should have, by the size of its input; None where that is small or
    unknown, and Spark's own number does."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = -(-size // PIECE)
    return n if df.sparkSession.sparkContext.defaultParallelism < n < 1 << 15 else None


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to as many tasks as their input needs, so that a task's memory does not grow with it.
    Spark would merge small partitions to a few large ones, whose sorts and groups take many times their
    shuffled bytes."""
    n = pieces(df)
    return df.repartition(n, *keys) if n else df


def drop_written(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by ``materialise`` that no later plan reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "spanforge-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def ship_code(spark: SparkSession) -> None:
    """Send this package (and modules beside it that use it) to the Python workers, once per context, unless
    their search path names its folder already.  Functions that run on executors are looked up there by name."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent.parent
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if getattr(sc, "_spanforge_shipped", False) or any(p and Path(p).resolve() == root for p in known):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="spanforge-code-"), "spanforge-code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in [*sorted((root / "spanforge").rglob("*.py")), *root.glob("corpus_pipeline.py")]:
            z.write(f, f.relative_to(root))
    sc.addPyFile(path)
    sc._spanforge_shipped = True
