"""Order-independent checksums and lossless comparison.

A table's checksum is the sum of its rows' 64-bit hashes modulo 2^64, so it depends on the multiset of
rows alone and partial sums can be added in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.sequence import bare_name, fastq_text, is_primary, oriented

MODULUS = 1 << 64
# Fixed value: the multiplier of the per-record hash.
MULTIPLIER = 0x2127599BF4325C37


def text_hash(data: bytes) -> int:
    """64-bit hash of a record's text: add a byte, fold, multiply, fold."""
    h = 0
    for c in data:
        h = (h + c) % MODULUS
        h ^= h >> 23
        h = h * MULTIPLIER % MODULUS
        h ^= h >> 47
    return h


def _hashes(texts: list[bytes]) -> np.ndarray:
    """``text_hash`` of many texts at once, position by position, longest first."""
    order = np.argsort([-len(t) for t in texts], kind="stable")
    sizes = np.array([len(texts[i]) for i in order])
    grid = np.zeros((len(texts), int(sizes[0]) if len(sizes) else 0), np.uint8)
    for k, i in enumerate(order):
        grid[k, : sizes[k]] = np.frombuffer(texts[i], np.uint8)
    h = np.zeros(len(texts), np.uint64)
    for at in range(grid.shape[1]):
        n = int(np.searchsorted(-sizes, -at, side="left"))  # texts longer than ``at``
        x = h[:n] + grid[:n, at]
        x ^= x >> np.uint64(23)
        x *= np.uint64(MULTIPLIER)
        x ^= x >> np.uint64(47)
        h[:n] = x
    out = np.empty_like(h)
    out[order] = h
    return out


def record_hash(text: Column) -> Column:
    """The hash of a record's text as decimal(20,0)."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            texts = [t.encode() for t in s.fillna("")]
            found = np.concatenate([_hashes(texts[k : k + 512]) for k in range(0, len(texts), 512)]) if texts else np.zeros(0, np.uint64)
            yield pd.Series([str(v) for v in found.tolist()], dtype="object")

    return run(text).cast("decimal(20,0)")


def summed(hashes: Column) -> Column:
    """Aggregate: the sum of 64-bit hashes modulo 2^64."""
    return (F.coalesce(F.sum(hashes.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")) % F.lit(str(MODULUS)).cast("decimal(38,0)")).cast("decimal(20,0)")


def md5_hash(text: Column) -> Column:
    """A portable 32-bit row hash: the first eight hex digits of md5, as a number."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("decimal(20,0)")


def md5_lanes(text: Column) -> list[Column]:
    """Aggregates: the four 32-bit lanes of md5, each summed modulo 2^32."""
    lane = lambda k: F.conv(F.substring(F.md5(text), 8 * k + 1, 8), 16, 10).cast("long")
    return [(F.sum(lane(k)) % F.lit(1 << 32)).alias(f"lane{k}") for k in range(4)]


def read_checksum(records: DataFrame) -> DataFrame:
    """(n, checksum) of primary alignments as they were read: name without suffix, bases and qualities
    in read direction."""
    seq, qual = oriented(F.col("flag"), F.col("seq"), F.col("qual"))
    text = fastq_text(bare_name(F.col("qname")), seq, qual)
    return records.where(is_primary(F.col("flag"))).agg(F.count(F.lit(1)).alias("n"), summed(record_hash(text)).alias("checksum"))


def fastq_checksum(reads: DataFrame) -> DataFrame:
    """(n, checksum) of FASTQ reads (name, seq, qual)."""
    return reads.agg(F.count(F.lit(1)).alias("n"), summed(record_hash(fastq_text(bare_name(F.col("name")), F.col("seq"), F.col("qual")))).alias("checksum"))


def same_checksum(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: both tables' counts and checksums, and whether they agree."""
    side = lambda df, s: df.select(F.col("n").alias(f"n_{s}"), F.col("checksum").alias(f"checksum_{s}"))
    return side(a, "left").crossJoin(side(b, "right")).withColumn("same", (F.col("n_left") == F.col("n_right")) & (F.col("checksum_left") == F.col("checksum_right")))


def multiset_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one table has more often than the other, with ``side``."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
