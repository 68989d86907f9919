"""Sharding over fixed virtual slots [native].

Records (id and text) hash into a fixed number of virtual slots.  Bytes are summed per slot, and a small versioned
table maps slots to shards.  Moving a slot is one edited row of that table; records never rehash.

Law ``bytes``: version 1 deals slots out in turn, and ``rebalance`` edits it into version 2, which
moves slots until the shards' bytes are near equal.  Law ``key`` (``grow``): a slot's shard follows
from the slot and the shard count alone, and a further shard takes slots only into itself.

Defined results: a null text counts no bytes; rows of one id or of none are dealt out by their texts;
repeated rows share a slot and get places of their own, but a record that more than ``REPEATS`` rows
repeat is dealt over all slots by its rows' numbers, so that it does not outweigh a shard; an empty table gives an empty result and a map whose slots
all hold nothing.  Columns besides the id and the text are ignored, whatever their names.

Scale: one scan of the texts, aggregations that leave the records repeated very often and at most
``n_slots`` rows, and one shuffle of (id, size, checksum) by slot.  The slot map has ``n_slots`` rows whatever the input, so it may be
broadcast and folded in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.shared import materialise
from spanforge.sources.tables import table

N_SLOTS = 4096
REPEATS = 1024
SEED = "virtual-slot"


def slot_of(key: Column, n_slots: int = N_SLOTS) -> Column:
    """The virtual slot of a key."""
    return F.pmod(F.xxhash64(F.lit(SEED), key), F.lit(n_slots)).cast("int")


def initial_map(spark: SparkSession, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """Version 1 of a slot map: slots dealt out in turn. Columns: version, vslot, shard."""
    return spark.range(n_slots).select(
        F.lit(1).alias("version"), F.col("id").cast("int").alias("vslot"), F.pmod("id", F.lit(n_shards)).cast("int").alias("shard")
    )


def grow(slot_map: DataFrame, n_shards: int) -> DataFrame:
    """The next version with shard ``n_shards`` added: of the slots in hash order every
    (n_shards + 1)-th moves to it, and no other slot moves."""
    turn = F.row_number().over(W.orderBy(F.xxhash64(F.lit("grow"), F.lit(n_shards), "vslot"), "vslot"))
    return slot_map.select(
        (F.col("version") + 1).alias("version"),
        "vslot",
        F.when(F.pmod(turn, F.lit(n_shards + 1)) == 0, F.lit(n_shards)).otherwise(F.col("shard")).cast("int").alias("shard"),
    )


def slot_usage(rows: DataFrame, size: str) -> DataFrame:
    """Bytes and rows per slot in use. Columns: vslot, slot_bytes, slot_rows."""
    return rows.groupBy("vslot").agg(F.sum(size).alias("slot_bytes"), F.count(F.lit(1)).alias("slot_rows"))


def rebalance(slot_map: DataFrame, usage: DataFrame, n_shards: int) -> DataFrame:
    """The next version of the map, edited to near-equal bytes.

    In every shard slots stay, largest first, while they fit under the mean; the rest move, largest
    first, each to the shard that is lightest at that moment.  All of it works on slot rows, whose
    number is fixed.  Columns: version, vslot, shard, slot_bytes, slot_rows.
    """
    full = slot_map.join(F.broadcast(usage), "vslot", "left").fillna(0, ["slot_bytes", "slot_rows"])
    heavy_first = W.partitionBy("shard").orderBy(F.desc("slot_bytes"), "vslot")
    target = F.ceil(F.sum("slot_bytes").over(W.partitionBy()) / F.lit(n_shards))
    marked = full.withColumn("_target", target).withColumn("_stays", F.sum("slot_bytes").over(heavy_first) <= F.col("_target"))
    plan = marked.agg(
        *[F.coalesce(F.sum(F.when(F.col("_stays") & (F.col("shard") == s), F.col("slot_bytes"))), F.lit(0)).alias(f"_l{s}") for s in range(n_shards)],
        F.sort_array(F.collect_list(F.when(~F.col("_stays"), F.struct((-F.col("slot_bytes")).alias("b"), F.col("vslot").alias("v"))))).alias("_moved"),
    ).select(
        F.expr(
            "aggregate(_moved, struct(array(" + ", ".join(f"_l{s}" for s in range(n_shards)) + ") AS loads, cast(array() AS array<struct<v:int,s:int>>) AS moves), "
            "(a, x) -> struct("
            "transform(a.loads, (w, i) -> if(i = array_position(a.loads, array_min(a.loads)) - 1, w - x.b, w)) AS loads, "
            "concat(a.moves, array(struct(x.v AS v, cast(array_position(a.loads, array_min(a.loads)) - 1 AS int) AS s))) AS moves), a -> a.moves)"
        ).alias("_moves")
    )
    moves = plan.select(F.explode("_moves").alias("m")).select(F.col("m.v").alias("vslot"), F.col("m.s").alias("_to"))
    return marked.join(F.broadcast(moves), "vslot", "left").select(
        (F.col("version") + 1).alias("version"), "vslot", F.coalesce("_to", "shard").alias("shard"), "slot_bytes", "slot_rows"
    )


def shard(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> tuple[DataFrame, DataFrame]:
    """Assign every row to a shard under law ``bytes``.

    Returns (rows, slot map).  Rows: the id, size, text_crc32, vslot, shard, slot (place in the
    shard, gapless from 0 in order of vslot and id).  Map: both versions.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = (F.octet_length(text).cast("long") + 1).alias("size")
    # a row's number is fixed once it is written
    rows = materialise(docs.select(F.col(id_col).alias("_id"), size, F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_t"), F.monotonically_increasing_id().alias("_row")), "shard-rows")
    often = rows.groupBy("_id", "_t").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > REPEATS)
    often = materialise(often.select(F.col("_id").alias("_oid"), F.col("_t").alias("_ot")), "repeated")
    turn = F.lit(0).cast("long")
    if not often.isEmpty():
        rows = rows.join(often, rows["_id"].eqNullSafe(often["_oid"]) & (rows["_t"] == often["_ot"]), "left")
        turn = F.when(F.col("_ot").isNotNull(), F.col("_row")).otherwise(turn)
    rows = rows.select("_id", "size", "text_crc32", slot_of(F.struct(F.col("_id"), F.col("_t"), turn.alias("turn")), n_slots).alias("vslot"))
    first = initial_map(docs.sparkSession, n_shards, n_slots)
    second = materialise(rebalance(first, slot_usage(rows, "size"), n_shards), "slot-map")
    base = F.sum("slot_rows").over(W.partitionBy("shard").orderBy("vslot").rowsBetween(W.unboundedPreceding, -1))
    places = second.select("vslot", "shard", F.coalesce(base, F.lit(0)).alias("_base"))
    within = F.row_number().over(W.partitionBy("vslot").orderBy("_id", "text_crc32", "size")) - 1
    placed = rows.withColumn("_in", within).join(F.broadcast(places), "vslot")
    out = placed.select(F.col("_id").alias(id_col), "size", "text_crc32", "vslot", "shard", (F.col("_base") + F.col("_in")).cast("long").alias("slot"))
    return out, first.unionByName(second.select("version", "vslot", "shard"))


def op4_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over shards 0 to 15, sizes near equal."""
    rows, _ = shard(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")
