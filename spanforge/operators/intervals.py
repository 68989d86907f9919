"""Interval joins, semi and anti joins, region queries and region sets.

Records carry the smallest bin that holds them; a region is exploded to the bins that overlap it, so
a pair meets in exactly one bin and the theta join becomes an equi-join on (contig, bin) with the
overlap predicate as a residual.  Nothing is de-duplicated afterwards.  A dense bin is a skewed join
key, which adaptive execution splits; no side is broadcast unless Spark itself finds it small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.bins import Scheme, overlaps
from spanforge.operators.stretches import before, united
from spanforge.shared import materialise

# As far as regions without an end go (2^35), so that long contigs do not crowd into the last leaf.
FAR = Scheme(14, 7)


def with_bin(records: DataFrame, beg: str = "beg", end: str = "end", scheme: Scheme = FAR) -> DataFrame:
    """Records with column ``bin``; what lies behind the scheme's reach is in its last leaf."""
    return records.withColumn("bin", scheme.reg2bin(*scheme.within(F.col(beg), F.col(end))))


def exploded(regions: DataFrame, scheme: Scheme = FAR) -> DataFrame:
    """Regions (contig, beg, end, ...) as one row per bin, in columns _contig, _beg, _end, _bin."""
    rest = [c for c in regions.columns if c not in ("contig", "beg", "end")]
    return regions.where("contig IS NOT NULL AND beg IS NOT NULL AND end IS NOT NULL AND end > beg").select(
        F.col("contig").alias("_contig"), F.col("beg").alias("_beg"), F.col("end").alias("_end"), *rest, F.explode(scheme.reg2bins(*scheme.within(F.col("beg"), F.col("end")))).alias("_bin")
    )


def _meets(inclusive: bool) -> Column:
    reach = F.when(F.col("end") > F.col("beg"), F.col("end")).otherwise(F.col("beg") + 1)  # an empty record lies on its position
    near = overlaps(F.col("beg"), F.col("end") + 1 if inclusive else reach, F.col("_beg"), F.col("_end") + 1 if inclusive else F.col("_end"))
    return (F.col("contig") == F.col("_contig")) & (F.col("bin") == F.col("_bin")) & near


def interval_join(records: DataFrame, regions: DataFrame, scheme: Scheme = FAR) -> DataFrame:
    """Every pair of a record (contig, beg, end, ...) and a region (contig, beg, end, payload...) that
    overlap. The region's own interval is in _beg and _end."""
    return with_bin(records, scheme=scheme).join(exploded(regions, scheme), _meets(False)).drop("bin", "_bin", "_contig")


def interval_semi(records: DataFrame, regions: DataFrame, scheme: Scheme = FAR) -> DataFrame:
    """Records that overlap any region, each once."""
    return with_bin(records, scheme=scheme).join(exploded(regions.select("contig", "beg", "end"), scheme), _meets(False), "left_semi").drop("bin")


def interval_anti(records: DataFrame, regions: DataFrame, scheme: Scheme = FAR) -> DataFrame:
    """Records that overlap no region."""
    return with_bin(records, scheme=scheme).join(exploded(regions.select("contig", "beg", "end"), scheme), _meets(False), "left_anti").drop("bin")


def missed_regions(regions: DataFrame, records: DataFrame, scheme: Scheme = FAR) -> DataFrame:
    """Regions that no record overlaps."""
    return interval_anti(regions, records, scheme)


def closed_regions(regions: DataFrame) -> DataFrame:
    """Regions with 0-based inclusive ends as half-open ones."""
    return regions.withColumn("end", F.col("end") + 1)


def region_query(records: DataFrame, contig, beg: int, end: int) -> DataFrame:
    """Records that overlap one region, in order. The conditions on begin and end reach the scan."""
    return records.where((F.col("contig") == contig) & (F.col("beg") < end) & (F.col("end") > beg)).orderBy("beg", "end")


def seek(records: DataFrame, contig, pos: int) -> DataFrame:
    """Records of a contig from a position on, as a cursor set there would read them."""
    return records.where((F.col("contig") == contig) & (F.col("end") > pos))


def merge_regions(regions: DataFrame, bits: int = 20) -> DataFrame:
    """The union of regions per contig: overlapping or touching ones become one (contig, beg, end, n).
    Contigs are gone through by stretches of 2^bits positions."""
    return united(regions.select("contig", "beg", "end"), bits)


def complement(regions: DataFrame, contigs: DataFrame, bits: int = 20) -> DataFrame:
    """What regions leave of contigs (contig, length). Their union, far smaller, is written first."""
    merged = materialise(merge_regions(regions, bits), "regions").join(contigs, "contig").select("contig", "beg", "end")
    # an empty interval at either end of each contig
    ends = contigs.select("contig", F.explode(F.array(F.lit(0).cast("long"), F.col("length").cast("long"))).alias("beg")).withColumn("end", F.col("beg") + 0)
    edges = merged.select("contig", F.col("beg").cast("long").alias("beg"), F.col("end").cast("long").alias("end")).union(ends).distinct()
    # merged regions do not meet, so the one before ends last
    edges = before(edges, ["contig"], ["beg", "end"], F.shiftright("beg", bits), "end", "_from")
    return edges.where("beg > _from").select("contig", F.col("_from").alias("beg"), F.col("beg").alias("end"))


def with_region_order(regions: DataFrame, longest_first: bool = True) -> DataFrame:
    """Regions by begin; of equal begins the longer first, or the shorter."""
    return regions.orderBy("contig", "beg", F.desc("end") if longest_first else F.asc("end"))


def overlap_interval(mode: int, beg: Column, ref: Column, alts: Column) -> tuple[Column, Column]:
    """The interval by which a variant meets a region: 0 its position, 1 its whole record, 2 the part
    that differs from the reference."""
    from spanforge.functions.variants import trimmed_beg

    if mode == 0:
        return beg, beg + 1
    if mode == 1:
        return beg, beg + F.length(ref)
    return trimmed_beg(beg, ref, alts), F.greatest(beg + F.length(ref), trimmed_beg(beg, ref, alts) + 1)
