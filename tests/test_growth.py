"""Steps whose cost must not outgrow their input."""

import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from spanforge import shared
from spanforge.operators import indexing, intervals, merging
from spanforge.sources import bgzf, cram, textfiles


def test_paired_many_records_of_one_position():
    r = random.Random(5)
    kinds = [(f"{i}>{j}", str(j), (1, 4, 8, 0)[(i + j) % 4]) for i in range(7) for j in range(9)]
    rows = [(r.choice("ABCDE"), *r.choice(kinds)) for _ in range(60_000)]
    began = time.time()
    out = merging.paired(rows, merging.BOTH_REF)
    assert sum(map(len, out)) == len(rows) and time.time() - began < 20  # some two minutes when it was quadratic


def test_coverage_of_given_windows(spark):
    rows = spark.createDataFrame([(c, b * 3000, b * 3000 + 9000, v << 16, (v + 1) << 16) for c in (1, 2) for v, b in enumerate((2, 9, 10, 60, 61, 62, 300))], "contig int, beg long, end long, voff long, next_voff long")
    tell = lambda w: sorted(map(tuple, indexing.coverage_estimate(w).collect()))
    assert tell(indexing.window_offsets(rows)) == tell(indexing.linear_index(rows))


def test_index_of_windows_with_gaps(spark, tmp_path):
    rows = spark.createDataFrame([(0, 5, 50), (0, 8, 80), (2, 0, 7)], "refid int, win int, voff long")
    bins = spark.createDataFrame([(0, 4681, 3, 9), (0, 4681, 20, 30)], "refid int, bin int, chunk_beg long, chunk_end long")
    stats = spark.createDataFrame([(0, 3, 30, 4, 0)], "refid int, off_beg long, off_end long, n_mapped long, n_unmapped long")
    textfiles.write_index(f"{tmp_path}/x.tbi", ["a", "b", "c"], bins, rows, stats, textfiles.LAYOUTS["bed"])
    plain = textfiles.parse_index(bgzf.read_bytes(f"{tmp_path}/x.tbi"))
    assert plain["linear"] == [(0, k, 50 if k < 6 else 80) for k in range(9)] + [(2, 0, 7)]
    back = textfiles.load_index(spark, f"{tmp_path}/x.tbi")
    for name in ("bins", "linear", "stats", "contigs"):
        assert sorted(map(tuple, back[name].collect())) == plain[name]


def test_header_look_alike_is_refused_early():
    head = struct.pack("<i", 1 << 20) + b"\0\0\0\0\0\0\x01" + cram.itf8(1 << 19) + b"\x05\x03" + b"\x01" * (1 << 20)
    began = time.time()
    for _ in range(300):
        with pytest.raises(bgzf.BlockError):
            cram.Container(head)
    assert time.time() - began < 5  # each took half a million numbers


def test_unions_in_pieces(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(shared, "PIECE", 200)
    r = random.Random(1)
    rows = spark.createDataFrame([(r.randrange(3), b, b + r.randrange(1, 4000)) for b in (r.randrange(1 << 18) for _ in range(300))], "contig int, beg long, end long")
    rows.coalesce(1).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    assert shared.pieces(rows) > 4
    got = sorted(map(tuple, intervals.merge_regions(rows, 12).select("contig", "beg", "end", F.col("n").cast("int")).collect()))
    want = []
    for c, b, e in sorted(map(tuple, rows.collect())):
        if want and want[-1][0] == c and b <= want[-1][2]:
            want[-1] = (c, want[-1][1], max(e, want[-1][2]), want[-1][3] + 1)
        else:
            want.append((c, b, e, 1))
    assert got == want
