"""Index statistics and linear indexes kept up to date as record files arrive.

Both are aggregations whose state is one row per contig or window: state does not grow with records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanforge.functions.bins import STANDARD, Scheme


def arriving(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 100) -> DataFrame:
    """Records of Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def running_stats(records: DataFrame, unmapped: Column) -> DataFrame:
    """(contig, off_beg, off_end, n_mapped, n_unmapped) over all that has arrived."""
    return records.groupBy("contig").agg(
        F.min("voff").alias("off_beg"), F.max("next_voff").alias("off_end"), F.count(F.when(~unmapped, 1)).alias("n_mapped"), F.count(F.when(unmapped, 1)).alias("n_unmapped")
    )


def running_linear(records: DataFrame, scheme: Scheme = STANDARD) -> DataFrame:
    """(contig, win, voff): the least offset per window over all that has arrived; empty windows are
    filled when the table is read (``indexing.linear_index`` on its rows)."""
    return records.select("contig", "voff", F.explode(scheme.reg2lins(F.col("beg"), F.col("end"))).alias("win")).groupBy("contig", "win").agg(F.min("voff").alias("voff"))


def windowed_counts(events: DataFrame, ts: str, key: str, width: str, late: str) -> DataFrame:
    """Counts per key and tumbling time window; what is later than ``late`` is dropped with its state."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"))
