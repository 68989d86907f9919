"""Order-dependent columns over long groups without one task per group.

A group (a contig, say) is cut into stretches of its order.  Windows run within a stretch; what reaches
into it from before comes from one row per stretch, over which a second window runs.  Both the window
and the join with that row deal records out by the same keys, so that records are shuffled once.
Groups may be null, and are then a group like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.shared import dealt, pieces

STRETCH = "__stretch"


def _with_base(rows: DataFrame, by: list[str], total: Column, base) -> DataFrame:
    """Rows with ``__base``: what ``base`` makes, over the stretches before, of each stretch's total."""
    totals = rows.groupBy(*by, STRETCH).agg(total.alias("__total"))
    order = W.partitionBy(*by).orderBy(STRETCH)
    names = {c: f"__of_{k}" for k, c in enumerate([*by, STRETCH])}
    bases = totals.withColumn("__base", base(order)).drop("__total").withColumnsRenamed(names)
    same = [rows[c].eqNullSafe(bases[n]) for c, n in names.items()]
    met = same[0]
    for one in same[1:]:
        met = met & one
    return rows.join(bases, met).drop(*names.values())


def before(rows: DataFrame, by: list[str], order: list[str], stretch: Column, value: str, out: str) -> DataFrame:
    """Adds ``out``: the value of the row before in its group. ``order`` must tell rows apart, and
    ``stretch`` must not fall in it."""
    rows = rows.withColumn(STRETCH, stretch)
    within = W.partitionBy(*by, STRETCH).orderBy(*order)
    last = F.max_by(F.struct(value), F.struct(*order))
    rows = _with_base(rows, by, last, lambda o: F.lag("__total").over(o))
    found = F.when(F.row_number().over(within) > 1, F.lag(value).over(within)).otherwise(F.col("__base")[value])
    return rows.withColumn(out, found).drop(STRETCH, "__base")


def running(rows: DataFrame, by: list[str], order: list[str], stretch: Column, value: str, out: str, most: bool = False) -> DataFrame:
    """Adds ``out``: the sum (or with ``most`` the greatest) of the values of all rows before in the group;
    null for a group's first row."""
    rows = rows.withColumn(STRETCH, stretch)
    fold = F.max if most else F.sum
    ahead = lambda o: o.rowsBetween(W.unboundedPreceding, -1)
    rows = _with_base(rows, by, fold(value), lambda o: fold("__total").over(ahead(o)))
    within = fold(value).over(ahead(W.partitionBy(*by, STRETCH).orderBy(*order)))
    both = F.greatest(within, F.col("__base")) if most else F.coalesce(within + F.col("__base"), within, F.col("__base"))
    return rows.withColumn(out, both).drop(STRETCH, "__base")


def _own_islands(rows: DataFrame, order: list[str], bits: int) -> DataFrame:
    """Adds the stretch and ``__own``, the begin of the first row of a row's island within its stretch."""
    rows = dealt(rows.withColumn(STRETCH, F.shiftright("beg", bits)), "contig", STRETCH)
    here = W.partitionBy("contig", STRETCH).orderBy(*order)
    reach = F.max("end").over(here.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("__new", F.when(reach.isNull() | (F.col("beg") > reach), F.col("beg")))
    return rows.withColumn("__own", F.max("__new").over(here.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def _joined_islands(rows: DataFrame, bits: int) -> DataFrame:
    """Rows of ``_own_islands`` with ``island`` instead: the begin of the first row of all stretches' island.

    Of a stretch's own islands only the last can reach into later stretches.  One row per stretch tells how
    far those before reach and where their chain began; whatever begins within that reach belongs to it."""
    per = rows.groupBy(F.col("contig").alias("__contig"), F.col(STRETCH).alias("__at")).agg(F.max("end").alias("__end"), F.max_by("__own", "end").alias("__beg"))
    ahead = W.partitionBy("__contig").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
    crossing = F.col("__end") >= F.shiftleft(F.col("__at").cast("long") + 1, bits)
    per = per.withColumn("__reach", F.max(F.when(crossing, F.col("__end"))).over(ahead))
    begins = F.when(crossing & (F.col("__reach").isNull() | (F.col("__beg") > F.col("__reach"))), F.col("__beg"))
    per = per.withColumn("__chain", F.max(begins).over(ahead)).drop("__end", "__beg")
    met = rows.join(per, rows["contig"].eqNullSafe(per["__contig"]) & (rows[STRETCH] == per["__at"]))
    island = F.when(F.col("__own") <= F.col("__reach"), F.col("__chain")).otherwise(F.col("__own"))
    return met.withColumn("island", island).drop("__contig", "__at", "__reach", "__chain", "__own", STRETCH)


def islands(rows: DataFrame, order: list[str], bits: int) -> DataFrame:
    """Adds ``island``: rows (contig, beg, end) of a contig that overlap or touch, directly or through others,
    have one, the begin of the first of them. ``order`` begins with beg; a stretch is 2^bits positions."""
    return _joined_islands(_own_islands(rows, order, bits), bits)


def united(rows: DataFrame, bits: int) -> DataFrame:
    """(contig, beg, end, n) of the islands of rows (contig, beg, end): each stretch is united by itself before
    stretches are."""
    tasks = pieces(rows)
    own = _own_islands(rows, ["beg", "end"], bits)
    own = own.groupBy("contig", STRETCH, "__own").agg(F.min("beg").alias("beg"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))
    found = _joined_islands(own, bits)
    found = found.repartition(tasks, "contig", "island") if tasks else found
    return found.groupBy("contig", "island").agg(F.min("beg").alias("beg"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("island")
