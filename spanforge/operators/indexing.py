"""Coordinate indexes as aggregations and windows over records (contig, beg, end, voff, next_voff).

``voff`` is where a record starts in its file and ``next_voff`` where the next one does.  Records are
gone through by stretches of the file (``FILE_BITS`` bits of an offset); windows per contig or per
(contig, bin) see index rows only, which are far fewer than records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.functions.bins import STANDARD, Scheme
from spanforge.operators.stretches import before
from spanforge.shared import materialise

FOLD = 0x10000
FILE_BITS = 42


def window_offsets(records: DataFrame, scheme: Scheme = STANDARD) -> DataFrame:
    """(contig, win, voff): the least offset of a record in each window that has one."""
    return records.select("contig", "voff", F.explode(scheme.reg2lins(F.col("beg"), F.col("end"))).alias("win")).groupBy("contig", "win").agg(F.min("voff").alias("voff"))


def linear_index(records: DataFrame, scheme: Scheme = STANDARD) -> DataFrame:
    """(contig, win, voff): the least offset of a record in each window; a window without one has that
    of the next window to its right that has."""
    after = F.lag("win").over(W.partitionBy("contig").orderBy("win"))
    return window_offsets(records, scheme).withColumn("_from", F.coalesce(after + 1, F.lit(0))).select("contig", F.explode(F.sequence("_from", "win")).alias("win"), "voff")


def bin_chunks(records: DataFrame, scheme: Scheme = STANDARD, bits: int = FILE_BITS) -> DataFrame:
    """(contig, bin, chunk_beg, chunk_end): runs of records of one bin that follow each other in the file.
    Runs are made within stretches; then the first and last run of each stretch are joined across them."""
    rows = records.select("contig", "voff", "next_voff", scheme.reg2bin(F.col("beg"), F.col("end")).alias("bin"), F.shiftright("voff", bits).alias("_s"))
    by_file = W.partitionBy("contig", "_s").orderBy("voff")
    rows = rows.withColumn("_new", F.when((F.row_number().over(by_file) > 1) & F.col("bin").eqNullSafe(F.lag("bin").over(by_file)), 0).otherwise(1))
    rows = rows.withColumns({"_run": F.sum("_new").over(by_file.rowsBetween(W.unboundedPreceding, 0)), "_ends": F.lead("voff").over(by_file).isNull()})
    runs = rows.groupBy("contig", "_s", "_run", "bin").agg(F.min("voff").alias("chunk_beg"), F.max("next_voff").alias("chunk_end"), F.max("_ends").alias("_last")).withColumn("_first", F.col("_run") == 1)
    inner = runs.where("NOT _first AND NOT _last").select("contig", "bin", "chunk_beg", "chunk_end")
    border = runs.where("_first OR _last")  # two rows a stretch at most
    order = W.partitionBy("contig").orderBy("_s", "_run")
    goes_on = F.col("_first") & F.col("bin").eqNullSafe(F.lag("bin").over(order)) & (F.row_number().over(order) > 1)
    border = border.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order))
    return inner.union(border.groupBy("contig", "_run", "bin").agg(F.min("chunk_beg").alias("chunk_beg"), F.max("chunk_end").alias("chunk_end")).select("contig", "bin", "chunk_beg", "chunk_end"))


def compress_bins(chunks: DataFrame, scheme: Scheme = STANDARD) -> DataFrame:
    """Fold bins whose chunks span little of the file into their parents, from the leaves up, where the
    parent exists; then join chunks that share a block.  Folding works on one row per bin: ``bin`` stays
    the original, ``_at`` is where it has moved to.  Chunks, far fewer than records, are written first."""
    chunks = materialise(chunks, "chunks")
    bins = chunks.groupBy("contig", "bin").agg(F.min("chunk_beg").alias("_lo"), F.max("chunk_end").alias("_hi")).withColumn("_at", F.col("bin"))
    bins = bins.repartition("contig")  # one row a bin: all levels are folded where they are
    for level in range(scheme.n_levels, 0, -1):
        own = (F.col("_at") >= scheme.first(level)) & (F.col("_at") < scheme.first(level + 1))
        here = W.partitionBy("contig", "_at")
        span = F.shiftright(F.max("_hi").over(here), 16) - F.shiftright(F.min("_lo").over(here), 16)
        bins = bins.withColumn("_span", span).withColumn("_up", F.when(own, scheme.parent(F.col("_at"))).otherwise(F.col("_at")))
        parent_there = F.max(F.col("_at") == F.col("_up")).over(W.partitionBy("contig", "_up"))
        bins = bins.withColumn("_there", parent_there).withColumn("_at", F.when(own & F.col("_there") & (F.col("_span") < FOLD), F.col("_up")).otherwise(F.col("_at")))
    moved = chunks.join(bins.select("contig", "bin", "_at"), ["contig", "bin"])
    return merge_chunks(moved.select("contig", F.col("_at").alias("bin"), "chunk_beg", "chunk_end"))


def merge_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks of a bin joined where the next begins in the block that the last ends in, or before."""
    order = W.partitionBy("contig", "bin").orderBy("chunk_beg", "chunk_end")
    reach = F.max("chunk_end").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = chunks.withColumn("_new", F.when(reach.isNull() | (F.shiftright("chunk_beg", 16) > F.shiftright(reach, 16)), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(order))
    return marked.groupBy("contig", "bin", "_run").agg(F.min("chunk_beg").alias("chunk_beg"), F.max("chunk_end").alias("chunk_end")).drop("_run")


def index_stats(records: DataFrame, unmapped: Column) -> DataFrame:
    """(contig, off_beg, off_end, n_mapped, n_unmapped) of each contig; records without one are counted
    under a null contig."""
    return records.groupBy("contig").agg(
        F.min("voff").alias("off_beg"), F.max("next_voff").alias("off_end"), F.count(F.when(~unmapped, 1)).alias("n_mapped"), F.count(F.when(unmapped, 1)).alias("n_unmapped")
    )


def merge_indexes(linear: DataFrame, chunks: DataFrame, stats: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One index from the unions of partial ones: least offsets, joined chunks, summed counts."""
    one = linear.groupBy("contig", "win").agg(F.min("voff").alias("voff"))
    two = stats.groupBy("contig").agg(F.min("off_beg").alias("off_beg"), F.max("off_end").alias("off_end"), F.sum("n_mapped").alias("n_mapped"), F.sum("n_unmapped").alias("n_unmapped"))
    return one, merge_chunks(chunks), two


def query_chunks(linear: DataFrame, chunks: DataFrame, contig, beg: int, end: int, scheme: Scheme = STANDARD) -> DataFrame:
    """File ranges that can hold records of a region: the chunks of its bins, cut by the linear index
    and joined where they touch. Columns chunk_beg, chunk_end."""
    low = linear.where((F.col("contig") == contig) & (F.col("win") >= beg >> scheme.min_shift)).agg(F.min_by("voff", "win").alias("_low"))
    # the root holds what crosses a border of the widest bins, behind the scheme's reach as well
    wanted = chunks.where((F.col("contig") == contig) & ((F.col("bin") == 0) | F.array_contains(scheme.reg2bins(F.lit(beg), F.lit(end)), F.col("bin"))))
    cut = wanted.crossJoin(F.broadcast(low)).where(F.col("chunk_end") > F.col("_low"))  # one row; null if no record lies that far
    cut = cut.select(F.lit(contig).alias("contig"), F.lit(0).alias("bin"), F.greatest("chunk_beg", "_low").alias("chunk_beg"), "chunk_end")
    return merge_chunks(cut).select("chunk_beg", "chunk_end").orderBy("chunk_beg")


def running_offsets(blocks: DataFrame, size: str = "isize", order: str = "coffset") -> DataFrame:
    """Blocks with ``uoffset``, the inflated bytes before each. Sizes are summed per stretch of the
    file first, so that no task adds up all blocks one by one."""
    stretch = F.floor(F.col(order) / (1 << 30))
    rows = blocks.withColumn("_s", stretch)
    sums = rows.groupBy("_s").agg(F.sum(size).alias("_t"))
    base = sums.select("_s", F.coalesce(F.sum("_t").over(W.orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    within = F.coalesce(F.sum(size).over(W.partitionBy("_s").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_w", within).join(base, "_s").withColumn("uoffset", (F.col("_w") + F.col("_base")).cast("long")).drop("_s", "_w", "_base")


def block_of(blocks: DataFrame, pos: int) -> DataFrame:
    """The block that holds an inflated position."""
    return blocks.where((F.col("uoffset") <= pos) & (F.col("uoffset") + F.col("isize") > pos))


def coverage_estimate(linear: DataFrame) -> DataFrame:
    """(contig, win, coverage): compressed bytes between a window's offset and the next's, or an eighth
    of the inflated bytes plus one within a block; neighbours get a 256th plus one; the first two and
    last two windows get one more. A contig's last window has no next one and no share of its own.

    ``linear`` may lack windows that have the offset of the next one given (``window_offsets``): shares are
    told on the rows given, and windows are made behind the last sort."""
    order = W.partitionBy("contig").orderBy("win")
    after = F.lead("voff").over(order)
    c1, c2 = F.shiftright("voff", 16), F.shiftright(after, 16)
    own = F.when(after.isNull() | (after == F.col("voff")), 0).when(c1 == c2, F.shiftright(after - F.col("voff"), 3) + 1).otherwise(c2 - c1)
    first = F.coalesce(F.lag("win").over(order) + 1, F.lit(0))
    rows = linear.withColumns({"_own": own.cast("long"), "_from": first, "_last": F.max("win").over(W.partitionBy("contig"))})
    leak = lambda own: F.when(own > 0, F.shiftright(own, 8) + 1).otherwise(F.lit(0).cast("long"))
    # of the windows up to a row's only its own has a share; the one behind it is its own row only if given
    right = F.when(F.lead("win").over(order) == F.col("win") + 1, F.lead("_own").over(order))
    rows = rows.withColumns({"_left": leak(F.lag("_own").over(order)), "_right": leak(right), "_next": leak(F.col("_own"))})
    rows = rows.select("contig", F.col("win").alias("_to"), "_from", "_last", "_own", "_left", "_right", "_next", F.explode(F.sequence("_from", "win")).alias("win"))
    x = F.col("win")
    edge = F.when((x < 2) | (x > F.col("_last") - 2), 1).otherwise(0)
    share = F.when(x == F.col("_to"), F.col("_own") + F.col("_right")).when(x == F.col("_to") - 1, F.col("_next")).otherwise(0)
    return rows.select("contig", "win", (share + F.when(x == F.col("_from"), F.col("_left")).otherwise(0) + edge).cast("long").alias("coverage"))


def order_violations(records: DataFrame, order: str = "voff", bits: int = FILE_BITS) -> DataFrame:
    """Records that begin before their predecessor on the contig does."""
    rows = before(records, ["contig"], [order], F.shiftright(F.col(order).cast("long"), bits), "beg", "_before")
    return rows.where(F.col("beg") < F.col("_before")).drop("_before")


def contig_runs(records: DataFrame, order: str = "voff") -> DataFrame:
    """(contig, runs): over how many separate stretches a contig's records are spread; more than one
    means that the file is not grouped by contig."""
    per = records.groupBy("contig").agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
    ends = per.withColumn("_reach", F.max("hi").over(W.orderBy("lo").rowsBetween(W.unboundedPreceding, -1)))
    return ends.select("contig", F.when(F.col("_reach") > F.col("lo"), 2).otherwise(1).alias("runs"))


def first_seen(records: DataFrame, order: str = "voff") -> DataFrame:
    """(contig, refid): contigs numbered by their first record."""
    return records.groupBy("contig").agg(F.min(order).alias("_first")).select("contig", (F.dense_rank().over(W.orderBy("_first")) - 1).cast("int").alias("refid"))


def index_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either index that the other lacks, with ``side``."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
