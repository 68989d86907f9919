"""Pileup and depth over alignments (contig, pos 0-based, flag, cigar parsed, seq, qual, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.functions.sequence import reference_length
from spanforge.operators.stretches import islands
from spanforge.shared import pieces


def _walk(cigar: Column) -> Column:
    """Operations with the reference and query offsets at which they start, and what follows each."""
    start = F.struct(F.lit(0).alias("r"), F.lit(0).alias("q"), F.array().cast("array<struct<op:string,len:int,r:int,q:int>>").alias("ops"))

    def step(a: Column, o: Column) -> Column:
        on_ref, on_read = F.lit("MDN=X").contains(o["op"]), F.lit("MIS=X").contains(o["op"])
        one = F.struct(o["op"].alias("op"), o["len"].alias("len"), a["r"].alias("r"), a["q"].alias("q"))
        return F.struct((a["r"] + F.when(on_ref, o["len"]).otherwise(0)).alias("r"), (a["q"] + F.when(on_read, o["len"]).otherwise(0)).alias("q"), F.concat(a["ops"], F.array(one)).alias("ops"))

    return F.aggregate(cigar, start, step, lambda a: a["ops"])


def pileup(alignments: DataFrame) -> DataFrame:
    """One row per alignment and reference position it covers: every column of the alignment (but
    cigar) with ref_pos, qpos (null in a gap), base, base_qual, indel (the signed length of what follows
    the position), is_del, is_refskip, is_head and is_tail. Unmapped or unplaced records are skipped."""
    ops = _walk(F.col("cigar"))
    placed = alignments.where(F.col("contig").isNotNull() & (F.col("flag").bitwiseAND(F.lit(4)) == 0)).withColumns({"_ops": ops, "_len": reference_length(F.col("cigar"))})
    rows = placed.select("*", F.posexplode("_ops").alias("_k", "_o")).where(F.lit("MDN=X").contains(F.col("_o")["op"]))
    after = F.get(F.filter(F.slice("_ops", F.col("_k") + 2, F.size("_ops")), lambda o: o["op"] != "P"), F.lit(0))
    rows = rows.withColumn("_next", after).select("*", F.explode(F.sequence(F.lit(0), F.col("_o")["len"] - 1)).alias("_i"))
    gap = F.col("_o")["op"].isin("D", "N")
    last = F.col("_i") == F.col("_o")["len"] - 1
    indel = F.when(last & (F.col("_next")["op"] == "I"), F.col("_next")["len"]).when(last & (F.col("_next")["op"] == "D") & ~gap, -F.col("_next")["len"]).otherwise(0)
    at = F.col("_o")["q"] + F.col("_i")
    offset = F.col("_o")["r"] + F.col("_i")
    out = rows.withColumns({
        "ref_pos": F.col("pos") + offset,
        "qpos": F.when(~gap, at),
        "base": F.when(~gap, F.substring("seq", at + 1, F.lit(1))),
        "base_qual": F.when(~gap, F.ascii(F.substring("qual", at + 1, F.lit(1))) - 33),
        "indel": indel,
        "is_del": gap,
        "is_refskip": F.col("_o")["op"] == "N",
        "is_head": offset == 0,
        "is_tail": offset == F.col("_len") - 1,
    })
    return out.drop("_ops", "_len", "_k", "_o", "_next", "_i", "cigar")


def pileup_columns(alignments: DataFrame, order: str = "qname") -> DataFrame:
    """(contig, ref_pos, depth, reads): the reads over each covered position, in a fixed order."""
    read = F.struct(order, "qpos", "base", "base_qual", "indel", "is_del", "is_refskip", "is_head", "is_tail")
    return pileup(alignments).groupBy("contig", "ref_pos").agg(F.count(F.lit(1)).alias("depth"), F.sort_array(F.collect_list(read)).alias("reads"))


def depth(intervals: DataFrame, step: int = 1) -> DataFrame:
    """(contig, pos, depth): how many intervals cover each position (or window of ``step``) that any
    covers. Intervals are not exploded to positions: begins and ends are counted, summed in order per
    stretch of a contig with what reaches into it, and only covered stretches become rows."""
    w = F.lit(step)
    last = F.floor((F.greatest(F.col("end"), F.col("beg") + 1) - 1) / w)
    spans = intervals.select("contig", F.floor(F.col("beg") / w).cast("long").alias("_b"), last.cast("long").alias("_e"))
    # an interval is cut at stretch borders, so each stretch is summed by itself
    spans = spans.select("contig", "_b", "_e", F.explode(F.sequence(F.shiftright("_b", 16), F.shiftright("_e", 16))).alias("_s"))
    spans = spans.select("contig", "_s", F.greatest(F.col("_b"), F.shiftleft("_s", 16)).alias("_b"), F.least(F.col("_e"), F.shiftleft(F.col("_s") + 1, 16) - 1).alias("_e"))
    edge = F.explode(F.array(F.struct(F.col("_b").alias("at"), F.lit(1).alias("d")), F.struct((F.col("_e") + 1).alias("at"), F.lit(-1).alias("d"))))
    edges = spans.select("contig", "_s", edge.alias("x")).groupBy("contig", "_s", F.col("x")["at"].alias("_at")).agg(F.sum(F.col("x")["d"]).alias("_d"))
    order = W.partitionBy("contig", "_s").orderBy("_at")
    runs = edges.withColumns({"depth": F.sum("_d").over(order), "_next": F.lead("_at").over(order)}).where("depth > 0")
    return runs.select("contig", F.explode(F.sequence("_at", F.col("_next") - 1)).alias("_p"), "depth").select("contig", (F.col("_p") * w).cast("long").alias("pos"), F.col("depth").cast("long").alias("depth"))


def cap_per_start(records: DataFrame, order: list[str], most: int) -> DataFrame:
    """At most ``most`` records that start at one position: an approximation of a depth cap that does
    not depend on the order in which a file is read."""
    rank = F.row_number().over(W.partitionBy("contig", "beg").orderBy(*order))
    return records.withColumn("_n", rank).where(F.col("_n") <= most).drop("_n")


def capped(records: DataFrame, most: int, columns: list[str], bits: int = 20) -> DataFrame:
    """The exact depth cap: in file order, a record is dropped when ``most`` kept ones are still active
    where it starts. Records have contig, beg, end, voff, in order of beg. Nothing is active across a gap
    that no record covers, so each stretch between gaps is one sequential scan, and no more than that."""
    import heapq

    def run(batches):
        import pandas as pd

        contig, ends = None, []
        for b in batches:
            keep = []
            for c, beg, end in zip(b["contig"], b["beg"], b["end"], strict=True):
                if c != contig:
                    contig, ends = c, []
                while ends and ends[0] <= beg:
                    heapq.heappop(ends)
                keep.append(len(ends) < most)
                if keep[-1]:
                    heapq.heappush(ends, end)
            yield b[pd.Series(keep, index=b.index, dtype=bool)]

    rows = islands(records.select(*columns), ["beg", "voff"], bits)
    tasks = pieces(records)
    rows = (rows.repartition(tasks, "contig", "island") if tasks else rows.repartition("contig", "island")).sortWithinPartitions("contig", "voff").select(*columns)
    return rows.mapInPandas(run, rows.schema)


def merge_overlapping_mates(bases: DataFrame) -> DataFrame:
    """Qualities where both mates of a template cover a position: of equal bases the first in order of
    mate has the sum (200 at most) and the other 0; of different bases the better keeps four fifths and
    the other has 0. bases: pileup rows with qname, mate, contig, ref_pos, base, base_qual."""
    other = W.partitionBy("qname", "contig", "ref_pos").orderBy("mate")
    sides = {"_ob": F.coalesce(F.lead("base").over(other), F.lag("base").over(other)), "_oq": F.coalesce(F.lead("base_qual").over(other), F.lag("base_qual").over(other)), "_r": F.row_number().over(other)}
    q, o = F.col("base_qual"), F.col("_oq")
    alike = F.when(F.col("_r") == 1, F.least(q + o, F.lit(200))).otherwise(0)
    better = (q > o) | ((q == o) & (F.col("_r") == 1))
    unlike = F.when(better, F.floor(q * 0.8)).otherwise(0)
    return bases.withColumns(sides).withColumn("base_qual", F.when(o.isNull(), q).when(F.col("base") == F.col("_ob"), alike).otherwise(unlike).cast("int")).drop("_ob", "_oq", "_r")


def multi_depth(samples: dict[str, DataFrame], step: int = 1) -> DataFrame:
    """(contig, pos, one depth per sample): samples side by side over all positions that any covers."""
    union = None
    for name, df in samples.items():
        one = depth(df, step).withColumn("sample", F.lit(name))
        union = one if union is None else union.unionByName(one)
    return union.groupBy("contig", "pos").pivot("sample", list(samples)).agg(F.coalesce(F.sum("depth"), F.lit(0))).fillna(0)
