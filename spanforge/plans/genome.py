"""A virtual genome: interval, alignment and variant tables derived from the driver's tables, in Spark
and as SQL, so that every operator can run on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.sources.tables import table

RECORDS_SQL = """
SELECT l_suppkey AS contig, l_partkey * 1000 AS beg, l_partkey * 1000 + CAST(l_quantity AS BIGINT) * 100 AS "end",
       (CASE l_returnflag WHEN 'R' THEN 512 WHEN 'A' THEN 256 ELSE 0 END) + (CASE l_linestatus WHEN 'O' THEN 16 ELSE 0 END)
         + (CASE WHEN l_linenumber % 2 = 0 THEN 129 ELSE 65 END) AS flag,
       l_orderkey AS qname, l_linenumber AS line, l_extendedprice AS price
FROM lineitem"""

REGIONS_SQL = """
SELECT p_partkey AS region_id, p_partkey % 100 AS contig, p_partkey * 1000 AS beg, p_partkey * 1000 + CAST(p_size AS BIGINT) * 1000 AS "end" FROM part"""

FILED_SQL = f"""
SELECT *, CAST((row_number() OVER (PARTITION BY contig ORDER BY beg, "end") - 1) * 300 * 65536 AS BIGINT) AS voff,
       CAST(row_number() OVER (PARTITION BY contig ORDER BY beg, "end") * 300 * 65536 AS BIGINT) AS next_voff
FROM ({RECORDS_SQL}) r"""

VARIANTS_SQL = """
SELECT o_orderpriority AS source, o_custkey % 50 AS contig, o_orderkey % 40 AS pos,
       CASE o_orderkey % 7 WHEN 0 THEN 'A' WHEN 1 THEN 'ACG' WHEN 2 THEN 'AC' WHEN 3 THEN 'T' WHEN 4 THEN 'ACGT' WHEN 5 THEN 'G' ELSE 'CA' END AS ref,
       CASE o_custkey % 9 WHEN 0 THEN 'C' WHEN 1 THEN 'ACGT' WHEN 2 THEN 'AT' WHEN 3 THEN '<DEL>' WHEN 4 THEN '*' WHEN 5 THEN 'T' WHEN 6 THEN 'ATG' WHEN 7 THEN 'G' ELSE 'A[2:321[' END AS alt,
       o_orderkey AS rec
FROM orders"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig, beg, end, flag, qname, line, price."""
    c = F.col
    flag = F.when(c("l_returnflag") == "R", 512).when(c("l_returnflag") == "A", 256).otherwise(0) + F.when(c("l_linestatus") == "O", 16).otherwise(0) + F.when(c("l_linenumber") % 2 == 0, 129).otherwise(65)
    beg = c("l_partkey") * 1000
    return table(spark, sf_dir, "lineitem").select(
        c("l_suppkey").alias("contig"), beg.alias("beg"), (beg + c("l_quantity").cast("long") * 100).alias("end"), flag.alias("flag"), c("l_orderkey").alias("qname"), c("l_linenumber").alias("line"), c("l_extendedprice").alias("price")
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region_id, contig, beg, end."""
    beg = F.col("p_partkey") * 1000
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("region_id"), (F.col("p_partkey") % 100).alias("contig"), beg.alias("beg"), (beg + F.col("p_size").cast("long") * 1000).alias("end"))


def filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in file order, with the virtual offsets where they and their successors start."""
    n = F.row_number().over(W.partitionBy("contig").orderBy("beg", "end"))
    return records(spark, sf_dir).withColumn("_n", n).withColumns({"voff": ((F.col("_n") - 1).cast("long") * 300 * 65536), "next_voff": (F.col("_n").cast("long") * 300 * 65536)}).drop("_n")


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, contig, pos, ref, alt, rec."""
    pick = lambda c, n, values: F.get(F.array(*[F.lit(v) for v in values]), (F.col(c) % n).cast("int"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("source"),
        (F.col("o_custkey") % 50).alias("contig"),
        (F.col("o_orderkey") % 40).alias("pos"),
        pick("o_orderkey", 7, ("A", "ACG", "AC", "T", "ACGT", "G", "CA")).alias("ref"),
        pick("o_custkey", 9, ("C", "ACGT", "AT", "<DEL>", "*", "T", "ATG", "G", "A[2:321[")).alias("alt"),
        F.col("o_orderkey").alias("rec"),
    )
