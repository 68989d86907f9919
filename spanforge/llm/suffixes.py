"""Removal of repeated substrings by longest-previous-factor arrays over sharded suffix arrays.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts anywhere else, the same
document included (matches never cross documents).  With ``keep_first`` only the later copies go.  A
window of ``LENGTH`` bytes has an earlier copy if its longest previous factor, the longest match that
starts earlier, reaches ``LENGTH``; that is found at the nearest smaller positions before and after it
in suffix order.  Its source is then the copy to be marked too, where all copies go.

Equal texts are one text with a count and the smallest id of its rows: copies of a whole text, however
many, meet nothing but that count.

One suffix array of a corpus would not fit a task, so suffixes are dealt out by content:

1. *Units.*  Each window of ``LENGTH`` bytes has an anchor, the least hash (leftmost of equals) among
   its ``REACH`` substrings of ``LENGTH - REACH + 1`` bytes.  Equal windows have equal anchors, so
   windows that share an anchor's content meet.  Consecutive windows with one anchor are one unit.
2. *Classes.*  A unit whose core (what all windows of its group share) occurs once repeats nothing and
   is discarded, as in prefix doubling with discarding.  Units that are equal as a whole are one class:
   all their windows repeat, and one of them, the first, stands for the class from there on.
3. *Longest previous factors.*  Of what is left, groups with a common core meet in one task with the
   bytes of their windows.  Ranks are doubled from 8 bytes to ``LENGTH``; the suffix order that they
   give, its previous and next smaller positions and the common prefixes with those make the array.
   Groups of more than ``GROUP`` units are split by a finer grid of offsets first (their cores grow
   towards ``LENGTH``), and pass through step 2 again, however large they were.

Names of substrings are 64-bit hashes; windows are compared by rank, not by hash, except within a
class and in groups that had to be split down to single windows.  Texts are named by 128 bits.

Defined results: a null text is empty; texts shorter than ``LENGTH`` bytes repeat nothing; rows with
equal id and text are copies of each other and are cut alike: with ``keep_first`` all rows of a text's
smallest id count as its first, and all others lose it whole.  Rows with a null id are documents like
others and come first.  Ties between texts of one id go by the order in which they were numbered.
Other columns are ignored.

Scale: texts are shuffled three times, to meet their copies, to fetch windows' bytes and to be cut;
everything else moves some 40 bytes per 128 bytes of text once, then only what repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.shared import drop_written, materialise
from spanforge.sources.tables import table

LENGTH = 400
REACH = 256
GRIDS = (64, 16, 4, 1)
GROUP = 256
SEGMENT = 1 << 20
BATCH = 1 << 19

_M1, _M2, _M3, _M4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _M1 + b * _M2 + _M3
    x ^= x >> np.uint64(32)
    x *= _M4
    x ^= x >> np.uint64(29)
    return x


class Names:
    """64-bit names of a byte string's substrings, from names of all substrings of 1, 2, 4, ... bytes."""

    def __init__(self, text: bytes, longest: int) -> None:
        one = np.frombuffer(text, np.uint8).astype(np.uint64)
        self.levels = [_mix(one, one)]
        while (2 << len(self.levels) - 1) <= min(longest, len(text)):
            last, step = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(_mix(last[:-step], last[step:]))

    def of(self, at: np.ndarray, length: int) -> np.ndarray:
        """Names of the substrings of one length at these places."""
        k = length.bit_length() - 1
        level = self.levels[k]
        return _mix(level[at], level[at + (length - (1 << k))]) + np.uint64(length)

    def of_each(self, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """As ``of``, each place with its own length."""
        out = np.zeros(len(at), np.uint64)
        k = np.frexp(lengths)[1] - 1
        for j in np.unique(k):
            m = k == j
            level = self.levels[j]
            out[m] = _mix(level[at[m]], level[at[m] + lengths[m] - (1 << j)]) + lengths[m].astype(np.uint64)
        return out


def anchored_units(text: bytes, length: int, reach: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor, least offset, greatest offset, core name, full name) of the units of a text, segment by
    segment. An offset is the anchor's distance from a window's start."""
    for s in range(0, len(text) - length + 1, SEGMENT):
        part = text[s : s + SEGMENT + length - 1]
        names = Names(part, length + reach)
        core = names.of(np.arange(len(part) - (length - reach)), length - reach + 1)
        least = (core >> np.uint64(24) << np.uint64(24)) | np.arange(len(core), dtype=np.uint64)
        step = 1
        while step < reach:
            by = min(step, reach - step)
            least = np.minimum(least[:-by], least[by:])
            step += by
        anchor = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        low = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        high = np.r_[low[1:], len(anchor)] - 1
        a = anchor[low]
        yield a + s, a - high, a - low, core[a], names.of_each(low, high - low + length)


UNIT = "core long, full long, d long, t long, a long, o1 int, o2 int"


def _units(length: int, reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, t = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            parts: list[tuple[np.ndarray, ...]] = []
            for i, text in enumerate(b.column(2)):
                raw = text.as_py() or b""
                if len(raw) < length:
                    continue
                for a, o1, o2, core, full in anchored_units(raw, length, reach):
                    parts.append((core.view(np.int64), full.view(np.int64), np.full(len(a), d[i]), np.full(len(a), t[i]), a, o1.astype(np.int32), o2.astype(np.int32)))
                if sum(len(p[0]) for p in parts[-64:]) > 50_000 or len(parts) > 2000:
                    yield _batch(parts)
                    parts = []
            if parts:
                yield _batch(parts)

    return run


def _batch(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["core", "full", "d", "t", "a", "o1", "o2"])


def classify(units: DataFrame) -> DataFrame:
    """Units whose core occurs more than once, with ``n`` (size of the class), ``first`` (whether the
    unit is the class's first) and ``kinds`` (classes with this core)."""
    most = units.count()  # of a written table: the files' footers
    again = materialise(units.groupBy("core").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("core"), "cores", most // 2)
    left = materialise(units.join(again, "core"), "repeated", most)
    place = F.struct("d", "t", (F.col("a") - F.col("o2")).alias("w"))
    # aggregates are written before they are joined, so that a join may split a core or class that is in
    # a large share of all rows
    classes = materialise(left.groupBy("core", "full").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("_least")), "sizes", most)
    kinds = materialise(classes.groupBy("core").agg(F.count(F.lit(1)).alias("kinds")), "kinds", most // 2)
    told = classes.join(kinds, "core")
    out = left.join(told, ["core", "full"]).withColumn("first", F.col("_least") == place).drop("_least")
    out = materialise(out, "classes", most)
    for done in (left, again, classes, kinds):
        drop_written(units.sparkSession, done)
    return out


def _contexts(length: int):
    """The bytes of units' windows: rows (d, t, text, units) to (unit, rep, ctx, g)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                text, units = b.column(2)[k].as_py(), b.column(3)[k].as_py()
                ctx = [text[u["a"] - u["o2"] : u["a"] - u["o1"] + length] for u in units]
                m = len(units)
                cols = [pa.array([u["core"] for u in units], pa.int64()), pa.array([u["full"] for u in units], pa.int64()), pa.array([b.column(0)[k].as_py()] * m, pa.int64()), pa.array([b.column(1)[k].as_py()] * m, pa.int64())]
                cols += [pa.array([u["a"] for u in units], pa.int64()), *(pa.array([u[c] for u in units], pa.int32()) for c in ("o1", "o2")), pa.array([u["rep"] for u in units], pa.bool_()), pa.array(ctx, pa.binary()), pa.array([u["g"] for u in units], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["core", "full", "d", "t", "a", "o1", "o2", "rep", "ctx", "g"])

    return run


def _split(length: int, grid: int):
    """Units with their bytes to units of a finer grid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(9)]
            for _, _, d, t, a, o1, o2, rep, ctx in zip(*(c.to_pylist() for c in b.columns), strict=True):
                names, start = Names(ctx, length + grid), a - o2
                for j in range(o1 // grid, o2 // grid + 1):
                    p1, p2 = max(j * grid, o1), min(j * grid + grid - 1, o2)
                    core = names.of(np.array([a - j * grid - start]), length - grid + 1).view(np.int64)[0]
                    low, size = a - p2 - start, p2 - p1 + length
                    full = names.of(np.array([low]), size).view(np.int64)[0]
                    for col, v in zip(cols, (core, full, d, t, a, p1, p2, rep, ctx[low : low + size]), strict=True):
                        col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], names=b.schema.names)

    return run


class Suffixes:
    """Windows of ``length`` bytes at ``starts`` of a text (at least 8 bytes of padding behind the last of
    them) in suffix order: ranks of all substrings of 8, 16, ... bytes, and the windows' own."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, length: int) -> None:
        self.text, self.starts, self.length = text, starts, length
        packed = np.zeros(len(text) - 7, np.uint64)
        for k in range(8):
            packed = (packed << np.uint64(8)) | text[k : len(text) - 7 + k]
        rank = np.unique(packed, return_inverse=True)[1]
        self.levels, size = [rank], 8
        while size * 2 <= length:
            key = rank[: len(rank) - size] * np.int64(int(rank.max()) + 1) + rank[size:]
            rank = np.unique(key, return_inverse=True)[1]
            self.levels.append(rank)
            size *= 2
        key = rank[starts] * np.int64(int(rank.max()) + 1) + rank[starts + length - size]
        self.rank = np.unique(key, return_inverse=True)[1]

    def common(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of windows, ``length`` at most."""
        a, b = self.starts[one], self.starts[other]
        out = np.where(self.rank[one] == self.rank[other], self.length, 0)
        at = np.flatnonzero(out == 0)
        for k in range(len(self.levels) - 1, -1, -1):
            size, rank = 8 << k, self.levels[k]
            at_ = at[out[at] + size <= self.length]
            out[at_[rank[a[at_] + out[at_]] == rank[b[at_] + out[at_]]]] += size
        for _ in range(7):
            at = at[out[at] < self.length]
            at = at[self.text[a[at] + out[at]] == self.text[b[at] + out[at]]]
            out[at] += 1
        return out

    def previous_factors(self, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest-previous-factor array of the windows (lengths up to ``length``) and each one's
        source, a window with a smaller position that it is found at (-1: none)."""
        order = np.lexsort((position, self.rank))
        n = len(order)
        before = smaller_before(position[order])
        after = n - 1 - smaller_before(position[order][::-1])[::-1]
        factor, source = np.zeros(n, np.int64), np.full(n, -1)
        for near in (before, after):
            at = np.flatnonzero((near >= 0) & (near < n))
            windows, others = order[at], order[near[at]]
            length = self.common(windows, others)
            more = length > factor[windows]
            factor[windows[more]], source[windows[more]] = length[more], others[more]
        return factor, source


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each value the place of the nearest smaller one before it, or -1.  All chains of larger ones are
    followed at once: what a larger one skipped is larger still."""
    found = np.arange(-1, len(values) - 1)
    todo = np.arange(len(values))
    while len(todo):
        todo = todo[found[todo] >= 0]
        todo = todo[values[found[todo]] > values[todo]]
        found[todo] = found[found[todo]]
    return found


def _ranges(length: int, keep_first: bool):
    """Groups of units with their bytes, sorted by core, to byte ranges (t, beg, end)."""

    def solve(rows: list[tuple]) -> pa.RecordBatch | None:
        pad = b"\0" * 8
        text = np.frombuffer(b"".join(r[8] + pad for r in rows), np.uint8)
        sizes = np.array([len(r[8]) for r in rows])
        begs = np.cumsum(sizes + 8) - sizes - 8
        count = sizes - length + 1
        unit = np.repeat(np.arange(len(rows)), count)
        k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        d, t, start = (np.array([r[i] for r in rows]) for i in (2, 3, 4))
        start = start - np.array([r[6] for r in rows])
        w = start[unit] + k
        position = np.empty(len(w), np.int64)
        position[np.lexsort((w, t[unit], d[unit]))] = np.arange(len(w))
        factor, source = Suffixes(text, begs[unit] + k, length).previous_factors(position)
        hit = factor >= length
        if not keep_first:
            hit[source[hit]] = True
            hit &= ~np.array([r[7] for r in rows])[unit]
        at = np.flatnonzero(hit)
        if not len(at):
            return None
        new = np.r_[True, (np.diff(at) != 1) | (unit[at][1:] != unit[at][:-1])]
        first, last = at[new], at[np.r_[np.flatnonzero(new)[1:], len(at)] - 1]
        return pa.RecordBatch.from_arrays([pa.array(t[unit[first]], pa.int64()), pa.array(w[first], pa.int64()), pa.array(w[last] + length, pa.int64())], names=["t", "beg", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, core = 0, None
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[0] != core and size > BATCH:
                    if (out := solve(rows)) is not None:
                        yield out
                    rows, size = [], 0
                core = r[0]
                rows.append(r)
                size += len(r[8])
        if rows and (out := solve(rows)) is not None:
            yield out

    return run


def _text_key(text_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]


def _row_id(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))


def repeated_ranges(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """(h1, h2, d, n, ranges) of every distinct text that repeats anything: its name, its smallest id, its
    rows, and the byte ranges to remove from one of them (overlapping ones not merged, null if none)."""
    spark, made = docs.sparkSession, []

    def written(df: DataFrame, name: str) -> DataFrame:
        made.append(materialise(df, name))
        return made[-1]

    h1, h2 = _text_key(text_col)
    rows = docs.where(F.octet_length(F.col(text_col)) >= length).select(h1.alias("h1"), h2.alias("h2"), _row_id(id_col).alias("d"), F.col(text_col).cast("binary").alias("text"))
    texts = rows.groupBy("h1", "h2").agg(F.min("d").alias("d"), F.count(F.lit(1)).alias("n"), F.first("text").alias("text"))
    # a text's number is fixed once it is written
    texts = written(texts.withColumn("t", F.monotonically_increasing_id()), "texts")
    units = materialise(texts.select("d", "t", "text").mapInArrow(_units(length, reach), UNIT), "units")
    told = classify(units)
    made.append(told)
    drop_written(spark, units)
    window = [F.col("t"), (F.col("a") - F.col("o2")).alias("beg"), (F.col("a") - F.col("o1") + length).alias("end")]
    whole = (F.col("n") > 1) & ~F.col("first") if keep_first else F.col("n") > 1
    found = [told.where(whole).select(*window)]
    # what a suffix array has to decide: units alone in their class, and one of each other class beside them
    open_ = (F.col("kinds") > 1) & ((F.col("n") == 1) | F.col("first"))
    # such a unit stands for each class of its core, so the core's group is as large as it has classes
    unit = F.struct("core", "full", "a", "o1", "o2", (F.col("n") > 1).alias("rep"), F.col("kinds").alias("g"))
    wanted = told.where(open_).groupBy("t").agg(F.collect_list(unit).alias("units"))
    fields = UNIT + ", rep boolean, ctx binary"
    parts = written(texts.select("d", "t", "text").join(wanted, "t").select("d", "t", "text", "units").mapInArrow(_contexts(length), fields + ", g long"), "windows")
    for grid in (*GRIDS, 0):
        large = F.col("g") > GROUP if grid else F.lit(False)
        dealt = parts.where(~large).drop("g").repartition("core").sortWithinPartitions("core")
        found.append(written(dealt.mapInArrow(_ranges(length, keep_first), "t long, beg long, end long"), "ranges"))
        if not grid or parts.where(large).isEmpty():
            break
        finer = written(parts.where(large).drop("g").mapInArrow(_split(length, grid), fields), "windows")
        # a unit that stood for a class still does; its parts count as repeated
        told = classify(finer)
        made.append(told)
        whole = (F.col("n") > 1) & ~F.col("first") if keep_first else (F.col("n") > 1) & ~F.col("rep")
        found.append(told.where(whole).select(*window))
        parts = written(told.where(open_).withColumn("rep", F.col("rep") | (F.col("n") > 1)).select(*finer.columns, F.col("kinds").alias("g")), "windows")
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    lists = every.groupBy("t").agg(F.collect_list(F.struct("beg", "end")).alias("ranges"))
    out = materialise(texts.select("t", "h1", "h2", "d", "n").join(lists, "t", "left").where("n > 1 OR ranges IS NOT NULL").drop("t"), "repeats")
    for done in made:
        drop_written(spark, done)
    return out


def merged(ranges: list[dict] | None) -> list[tuple[int, int]]:
    """Ranges (beg, end), sorted and merged where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for beg, end in sorted((r["beg"], r["end"]) for r in ranges or ()):
        if out and beg <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((beg, end))
    return out


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without these merged spans."""
    out, at = [], 0
    for beg, end in spans:
        out.append(text[at:beg])
        at = end
    return b"".join([*out, text[at:]])


def with_ranges(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """(every column of docs, __ranges): the rows with the byte ranges to remove from them, as a list or null."""
    repeats = repeated_ranges(docs, length, keep_first, id_col, text_col, reach)
    repeats = repeats.select(*(F.col(c).alias(f"__row_{c}") for c in repeats.columns))
    keyed = docs.withColumns(dict(zip(("__row_h1", "__row_h2"), _text_key(text_col), strict=True))).join(repeats, ["__row_h1", "__row_h2"], "left")
    gone = F.col("__row_d") != _row_id(id_col) if keep_first else F.col("__row_n") > 1
    whole = F.array(F.struct(F.lit(0).cast("long").alias("beg"), F.octet_length(F.col(text_col)).cast("long").alias("end")))
    ranges = F.when(gone, whole).otherwise(F.col("__row_ranges"))
    return keyed.withColumn("__ranges", ranges).drop(*repeats.columns)


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the strings of 400 bytes that start more than once in the table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = with_ranges(docs).select("doc_id", F.col("text").cast("binary").alias("text"), "__ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(4)]
            for text, ranges in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw, spans = text or b"", merged(ranges)
                kept = cut(raw, spans)
                for col, v in zip(cols, (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()), strict=True):
                    col.append(v)
            arrays = [b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


OP3_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(b[i + 1:i + 400]) AS k FROM (SELECT doc_id, b, unnest(range(0, n - 399)) AS i FROM d WHERE n >= 400) x),
r AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
h AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w WHERE k IN (SELECT k FROM r)),
g AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM h),
s AS (SELECT doc_id, min(i) AS beg, max(i) + 400 AS fin FROM g GROUP BY doc_id, g),
e AS (SELECT doc_id, beg, fin, coalesce(lag(fin) OVER (PARTITION BY doc_id ORDER BY beg), 0) AS prev FROM s),
k AS (SELECT e.doc_id, string_agg(hex(b[prev + 1:beg]), '' ORDER BY beg) AS head, max(fin) AS last, sum(fin - beg) AS gone, count(*) AS spans FROM e JOIN d ON d.doc_id = e.doc_id GROUP BY e.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(CASE WHEN gone IS NULL THEN b ELSE unhex(head || hex(b[last + 1:n])) END) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
