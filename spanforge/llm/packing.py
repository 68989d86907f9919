"""Best-fit packing with exact complements.

Documents become pieces of at most ``CAPACITY`` tokens.  Only the number of pieces of each length
matters for a plan, so the plan is made from at most ``CAPACITY`` counts: for each length, longest
first, the gap it leaves is looked up among the sums of one, two and three available lengths, and a
combination that fills it exactly is used as often as counts allow.  A gap that no combination fills
takes the best-fitting length, and what remains of the gap is looked up again.  Sums of at most two
lengths and of one make other plans; the one with the fewest sequences is taken (on even ground the one
that looks up most).

A plan is a list of layouts (lengths and how often) with the number of sequences of each.  A piece
finds its place from its rank among the pieces of its length, so no task ever holds more than a
bucket of one length, however common the length: buckets are as many as keep them at some
``BUCKET_PIECES`` if all pieces have one length, and a piece's follows from its id, place and checksum,
so that pieces of one id, or of none, are dealt out too.

Defined results: a null text is empty and still has its end token; only documents longer than a
sequence are cut, into full pieces behind a first one that may be shorter; ties between equal
lengths go by id and piece; repeated rows are pieces of their own; an empty table packs to nothing.
Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.llm.tokens import encode_as_library
from spanforge.shared import materialise
from spanforge.sources.tables import table

CAPACITY = 1024
BUCKETS = 256
BUCKET_PIECES = 1 << 17
END = 2
VOCABULARY = "byte_bpe_50k.json"

Layout = tuple[tuple[int, int], ...]


def _complement(count: np.ndarray, gap: int, most: int = 3) -> tuple[int, ...] | None:
    """At most ``most`` (one to three) available lengths that sum to ``gap``, the largest first; None if
    none do."""
    if count[gap]:
        return (gap,)
    if most == 1:
        return None
    there = count[: gap + 1] > 0
    a = np.arange((gap + 1) // 2, gap)
    two = a[there[a] & there[gap - a] & ((2 * a != gap) | (count[a] > 1))]
    if len(two):
        return int(two[-1]), int(gap - two[-1])
    if most == 2:
        return None
    for first in np.flatnonzero(there[: max(gap - 1, 0)])[::-1].tolist():
        rest = gap - first
        if 3 * first < gap:
            break
        b = np.arange((rest + 1) // 2, min(first, rest - 1) + 1)
        if not len(b):
            continue
        b = b[there[b] & there[rest - b]]
        for second in b[::-1].tolist():
            trio = (first, second, rest - second)
            if all(count[x] >= trio.count(x) for x in trio):
                return trio
    return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Layout, int]]:
    """Layouts and their number of sequences for so many pieces of each length: of the plans that look up
    sums of up to three, two and one lengths, one with the fewest sequences."""
    return min((_plan(counts, capacity, most) for most in (3, 2, 1)), key=lambda p: sum(n for _, n in p))


def _plan(counts: dict[int, int], capacity: int, most: int) -> list[tuple[Layout, int]]:
    count = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        count[length] = n
    out: list[tuple[Layout, int]] = []
    if count[capacity]:
        out.append((((capacity, 1),), int(count[capacity])))
        count[capacity] = 0
    for length in range(capacity - 1, 0, -1):
        while count[length]:
            layout = _fill(count, length, capacity, most)
            n = min(int(count[x]) // k for x, k in layout.items())
            for x, k in layout.items():
                count[x] -= n * k
            out.append((tuple(sorted(layout.items(), reverse=True)), n))
    return out


def _fill(count: np.ndarray, length: int, capacity: int, most: int) -> dict[int, int]:
    """The lengths of one sequence that begins with ``length``: whenever one, two or three available
    lengths fill its gap exactly they end it; until then the gap takes the length that fits it best."""
    left = count.copy()
    left[length] -= 1
    parts, gap = [length], capacity - length
    while gap:
        exact = _complement(left, gap, most)
        if exact is not None:
            parts += exact
            break
        fits = np.flatnonzero(left[: gap + 1])
        if not len(fits):
            break
        best = int(fits[-1])
        left[best] -= 1
        parts.append(best)
        gap -= best
    return {x: parts.count(x) for x in parts}


def token_pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end: int = END, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, piece, start, length, ids_crc32 and, if asked for, ids) of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                cols: list[list] = [[] for _ in range(6)]
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.array([*encode_as_library(vocabulary, text or ""), end], np.dtype("<u4"))
                    first = len(ids) % capacity or capacity
                    begs = [0, *range(first, len(ids), capacity)]
                    for k, (x, y) in enumerate(zip(begs, [*begs[1:], len(ids)], strict=True)):
                        for col, v in zip(cols, (doc, k, x, y - x, zlib.crc32(ids[x:y].tobytes()), ids[x:y].astype(np.int32) if with_ids else None), strict=True):
                            col.append(v)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
                arrays = [pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays[: 5 + with_ids], names=["_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, "_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def _places(layouts: list[tuple[Layout, int]]) -> tuple[np.ndarray, ...]:
    """For each run of ranks within a length: key (length and first rank), copies per sequence, first
    sequence, offset in the sequence. At most one run per length and layout."""
    used: dict[int, int] = {}
    runs, sequence = [], 0
    for layout, n in layouts:
        offset = 0
        for length, k in layout:
            runs.append((length, used.get(length, 0), k, sequence, offset))
            used[length] = used.get(length, 0) + n * k
            offset += length * k
        sequence += n
    runs.sort()
    return tuple(np.array(c, np.int64) for c in zip(*runs, strict=True)) if runs else tuple(np.zeros(0, np.int64) for _ in range(5))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces (columns _id, piece, length and others)."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    runs = pieces.sparkSession.sparkContext.broadcast(_places(plan(counts, capacity)))
    buckets = max(BUCKETS, sum(counts.values()) // BUCKET_PIECES)
    bucket = pieces.withColumn("_b", F.pmod(F.xxhash64("_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = bucket.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n"))
    base = F.coalesce(F.sum("_n").over(W.partitionBy("length").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("length", "_b", base.alias("_base"))
    order = W.partitionBy("length", "_b").orderBy("_id", "piece", "ids_crc32")
    ranked = bucket.withColumn("_rank", F.row_number().over(order) - 1).join(sizes, ["length", "_b"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_base")).select(*pieces.columns, "_rank")
    at = ranked.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length_, rank_, copies, sequence, offset = runs.value
        key = (length_ << 44) + rank_
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (at, b.num_columns - 1))
            k = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            nth = rank - rank_[k]
            found = [sequence[k] + nth // copies[k], offset[k] + nth % copies[k] * length]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(x, pa.int64()) for x in found)], names=[*b.schema.names[:-1], "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of every sequence; a sequence is at most ``CAPACITY`` tokens."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in its sequence."""
    pieces = materialise(token_pieces(table(spark, sf_dir, "documents"), with_ids=False), "pieces")
    return pack(pieces).withColumnRenamed("_id", "doc_id").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
