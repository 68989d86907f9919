"""Mate pairing, unpaired reads and template assembly over records (rg, qname, flag, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.sequence import fastq_text, is_primary, oriented


def which_mate(flag: Column) -> Column:
    """0 for a read that is not paired, else 1 or 2."""
    return F.when(flag.bitwiseAND(F.lit(1)) == 0, 0).when(flag.bitwiseAND(F.lit(64)) != 0, 1).otherwise(2)


def with_mate(records: DataFrame, flag: str = "flag") -> DataFrame:
    """Primary records with column ``mate``."""
    return records.where(is_primary(F.col(flag))).withColumn("mate", which_mate(F.col(flag)))


def mate_pairs(first: DataFrame, second: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Pairs of mates by equal keys; columns get suffixes _1 and _2."""
    side = lambda df, k: df.select(*keys, *[F.col(c).alias(f"{c}_{k}") for c in columns])
    return side(first, 1).join(side(second, 2), keys)


def unpaired(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Reads of either side whose mate is missing."""
    return first.join(second.select(*keys), keys, "left_anti").unionByName(second.join(first.select(*keys), keys, "left_anti"))


def complete_templates(records: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_records, complete) of every template; records have flag and sa (a mate's supplementary
    entries, each ended by ``;``, or null). A template is complete if each expected mate has as many
    records as its primary's entries announce, and one more."""
    mate = F.when(F.col("flag").bitwiseAND(F.lit(128)) != 0, 2).otherwise(1)
    expected = F.when(F.col("flag").bitwiseAND(F.lit(1)) != 0, 2).otherwise(1)
    entries = F.length(F.coalesce("sa", F.lit(""))) - F.length(F.regexp_replace(F.coalesce("sa", F.lit("")), ";", ""))
    rows = records.select(*keys, mate.alias("_mate"), expected.alias("_pairs"), (entries + 1).alias("_expected"))
    count = lambda m: F.count(F.when(F.col("_mate") == m, 1))
    most = lambda m: F.max(F.when(F.col("_mate") == m, F.col("_expected")))
    told = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_records"), F.max("_pairs").alias("_p"), count(1).alias("_n1"), count(2).alias("_n2"), most(1).alias("_e1"), most(2).alias("_e2"))
    full = (F.col("_n1") >= F.coalesce("_e1", F.lit(1))) & ((F.col("_p") == 1) | (F.col("_n2") >= F.coalesce("_e2", F.lit(1))))
    return told.select(*keys, "n_records", full.alias("complete"))


def assembled(records: DataFrame, keys: list[str]) -> DataFrame:
    """Records of complete templates, in order: first mate's primary, its others, then the second's."""
    whole = complete_templates(records, keys).where("complete").select(*keys)
    mate = F.when(F.col("flag").bitwiseAND(F.lit(128)) != 0, 2).otherwise(1)
    lesser = F.col("flag").bitwiseAND(F.lit(256 | 2048)) != 0
    return records.join(whole, keys, "left_semi").withColumns({"mate": mate, "secondary": lesser}).repartition(*keys).sortWithinPartitions(*keys, "mate", "secondary")


def export_fastq(records: DataFrame, interleave: bool = False) -> DataFrame:
    """(rg, which, qname, mate, text): FASTQ records of primary reads, in read direction. ``which`` is
    1 or 2 for mates, 3 for unpaired reads and orphans, or 0 for pairs that are interleaved. Write it
    with ``partitionBy('rg', 'which')``."""
    seq, qual = oriented(F.col("flag"), F.col("seq"), F.col("qual"))
    reads = with_mate(records).select("rg", "qname", "mate", seq.alias("seq"), qual.alias("qual"))
    whole = reads.where("mate > 0").groupBy("rg", "qname").agg(F.countDistinct("mate").alias("_n")).where("_n = 2").select("rg", "qname", F.lit(True).alias("_paired"))
    told = reads.join(whole, ["rg", "qname"], "left")
    which = F.when(F.col("_paired").isNull() | (F.col("mate") == 0), 3).otherwise(F.lit(0) if interleave else F.col("mate"))
    name = F.when(F.col("mate") == 0, F.col("qname")).otherwise(F.concat("qname", F.lit("/"), F.col("mate").cast("string")))
    return told.select("rg", which.alias("which"), "qname", "mate", fastq_text(name, F.col("seq"), F.col("qual")).alias("text"))


def read_group_fields(groups: DataFrame) -> DataFrame:
    """Read groups (id, sm, lb, pl, pu) with defaults: the id stands for a missing sample, the sample
    for a missing library, and a checksum of the id names the unit."""
    sample = F.coalesce("sm", "id")
    return groups.select("id", sample.alias("sm"), F.coalesce("lb", sample).alias("lb"), F.coalesce("pl", F.lit("UNKNOWN")).alias("pl"), F.coalesce("pu", F.hex(F.crc32(F.col("id").cast("binary")))).alias("pu"))


def align_manifest(files: DataFrame) -> DataFrame:
    """Lines ``Files=...;Type=...;RG=...`` from (rg, kind, files array)."""
    return files.select(F.concat(F.lit("Files="), F.array_join("files", ","), F.lit(";Type="), F.col("kind"), F.lit(";RG="), F.col("rg")).alias("value"))
