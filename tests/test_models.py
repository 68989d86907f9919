"""Base modifications, base alignment quality, and binary variants built by hand."""

import struct

import pytest
from pyspark.sql import functions as F

from spanforge.functions import models
from spanforge.sources import bcf, bgzf


def test_modifications():
    seq = "ACGCTCA"
    assert models.modifications(seq, "C+m,0,1;", [0, 255], False) == [(1, "C", "+", "m", 0.5 / 256), (5, "C", "+", "m", 255.5 / 256)]
    assert models.modifications(seq, "C+mh?,1;", [10, 20], False) == [(3, "C", "+", "m", 10.5 / 256), (3, "C", "+", "h", 20.5 / 256)]
    assert models.modifications(seq, "N+76792,2;", None, False) == [(2, "N", "+", "76792", None)]
    # stored reverse: read direction is TGAGCGT, whose only C is at 4 and is stored at 2
    assert models.modifications(seq, "C+m,0;", None, True) == [(2, "C", "+", "m", None)]
    assert models.modifications(seq, "", None, False) == []
    for bad in ("C+m,9;", "X+m,0;", "C*m,0;"):
        with pytest.raises(ValueError):
            models.modifications(seq, bad, None, False)


def test_modification_column(spark):
    df = spark.createDataFrame([("ACGC", "C+m,1;", [200], 0), ("ACGC", None, None, 0), (None, "C+m,0;", None, 0)], "seq string, mm string, ml array<int>, flag int")
    out = [r[0] for r in df.select(models.base_modifications(F.col("seq"), F.col("mm"), F.col("ml"), F.col("flag"))).collect()]
    assert out[0][0]["qpos"] == 3 and out[1] is None and out[2] is None


def test_alignment_quality():
    ref = "ACGTTGCATTTTTTGCAGGATCCATG"
    same = models.alignment_quality(ref, ref[3:20], [40] * 17, list(range(3, 20)))
    assert min(same[2:-2]) >= 25
    # a read with a base of the run deleted, aligned without a gap: behind the run nothing fits
    read = ref[3:9] + ref[10:21]
    wrong = models.alignment_quality(ref, read, [40] * len(read), list(range(3, 3 + len(read))))
    assert max(wrong[-6:]) <= 10 < min(same[2:-2])
    assert models.alignment_quality(ref, "AC", [30, 30], [-1, -1]) == [30, 30] and models.alignment_quality("", "A", [9], [0]) == [9]


def test_alignment_quality_column(spark):
    ref = "ACGTTGCATTTTTTGCAGGATCCATG"
    rows = [(ref, 100, ref[3:15], "I" * 12, "12M", 103), (ref, 100, "ACGT", "IIII", "2M5N2M", 100), (ref, 100, "ACGT", None, "4M", 100), (ref, 100, "ACG", "III", "2S1M", 140)]
    df = spark.createDataFrame(rows, "r string, rb long, s string, q string, c string, p long")
    out = [x[0] for x in df.select(models.base_alignment_quality(*[F.col(c) for c in ("r", "rb", "s", "q", "c", "p")])).collect()]
    assert len(out[0]) == 12 and out[1:] == ["IIII", None, "III"]


def _short(values, kind="b"):
    return bytes([len(values) << 4 | {"b": 1, "h": 2, "i": 3}[kind]]) + struct.pack(f"<{len(values)}{kind}", *values)


def _string(s):
    raw = s.encode()
    return (bytes([len(raw) << 4 | 7]) if len(raw) < 15 else bytes([0xF7]) + _short([len(raw)])) + raw


def test_bcf(spark, tmp_path):
    head = '##fileformat=VCFv4.2\n##FILTER=<ID=q10,Description="x">\n##INFO=<ID=DP,Number=1,Type=Integer,Description="d">\n##INFO=<ID=DB,Number=0,Type=Flag,Description="f">\n##FORMAT=<ID=GT,Number=1,Type=String,Description="g">\n##FORMAT=<ID=AD,Number=R,Type=Integer,Description="a">\n##contig=<ID=c1,length=100>\n##contig=<ID=c2,length=50>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n'
    raw = head.encode() + b"\0"

    def record(contig, pos, ref, alts, qual, filters, info, fields):
        shared = struct.pack("<iii", contig, pos, len(ref)) + (struct.pack("<f", qual) if qual is not None else struct.pack("<I", 0x7F800001))
        shared += struct.pack("<II", (1 + len(alts)) << 16 | len(info), len(fields) << 24 | 2)
        shared += _string("rs1" if contig == 0 else ".") + b"".join(map(_string, (ref, *alts))) + (_short(filters) if filters else b"\0") + b"".join(_short([k]) + v for k, v in info)
        own = b"".join(_short([k]) + v for k, v in fields)
        return struct.pack("<II", len(shared), len(own)) + shared + own

    gt = bytes([2 << 4 | 1]) + struct.pack("<4b", 2, 5, 0, -127)
    ad = bytes([2 << 4 | 2]) + struct.pack("<4h", 3, 300, -32768, -32767)
    body = record(0, 9, "ACG", ["A", "T" * 20], 30.5, [0], [(2, _short([77])), (3, b"\0")], [(4, gt), (5, ad)]) + record(1, 4, "G", [], None, [], [], [(4, gt)])
    path = str(tmp_path / "a.bcf")
    with open(path, "wb") as f:
        whole = b"BCF\2\2" + struct.pack("<I", len(raw)) + raw + body
        f.write(b"".join(bgzf.deflate(whole[k : k + 100]) for k in range(0, len(whole), 100)) + bgzf.EOF)
    a, b = bcf.read_bcf(spark, path).orderBy("contig").collect()
    assert (a["contig"], a["pos"], a["end"], a["id"], a["ref"], a["alts"], a["qual"], a["filters"], a["info"]) == ("c1", 9, 12, "rs1", "ACG", ["A", "T" * 20], 30.5, ["PASS"], {"DP": "77", "DB": None})
    assert [s["fields"] for s in a["samples"]] == [{"GT": "0|1", "AD": "3,300"}, {"GT": ".", "AD": "."}]
    assert a["samples"][0]["gt"]["alleles"] == [0, 1] and a["samples"][0]["gt"]["phased"]
    assert (b["contig"], b["id"], b["alts"], b["qual"], b["filters"]) == ("c2", None, [], None, [])


def test_mapping_quality_cap(spark):
    ref = "ACGTACGTACGTACGTACGT"
    cap = lambda seq, cigar, q=40, pos=100: models.capped_mapping_quality(ref, 100, seq, [q] * len(seq), cigar, pos)
    assert cap(ref, "20M") == 40
    one = cap("T" + ref[1:], "20M")
    two = cap("TT" + ref[2:], "20M")
    assert 40 > one > two and cap("T" * 20, "20M") == -1
    assert cap("T" + ref[1:], "20M", 12) == 40 and cap("N" + ref[1:], "20M") == 40
    assert cap("TTTTT" + ref[:10], "5S10M") < 40 and cap(ref[:10], "3H10M") < 40 and cap(ref + "AAAA", "24M") == 40
    df = spark.createDataFrame([(ref, 100, ref, "I" * 20, "20M", 100), (ref, 100, None, "I", "1M", 100)], "r string, rb long, s string, q string, c string, p long")
    assert [x[0] for x in df.select(models.mapping_quality_cap(*[F.col(c) for c in ("r", "rb", "s", "q", "c", "p")])).collect()] == [40, None]


def test_genotype_likelihoods(spark):
    hom = models.genotype_likelihoods([0] * 20, [30] * 20, [0, 1] * 10, 4)
    assert hom[0, 0] == 0 and hom[1, 1] > 100 and 0 < hom[0, 1] < hom[1, 1]
    het = models.genotype_likelihoods([0] * 10 + [1] * 10, [30] * 20, [0, 1] * 10, 4)
    assert het.argmin() in (1, 4) and het[0, 0] == pytest.approx(het[1, 1]) and (het == het.T).all()
    alone = models.genotype_likelihoods([0] * 9 + [1], [30] * 10, [0] * 10, 2, dependency=1.0)
    errors = models._more_errors(10, 30)
    assert alone[0, 0] == pytest.approx(errors[0]) and alone[1, 1] == pytest.approx(errors[:9].sum())
    assert errors[0] == pytest.approx(-10 * __import__("math").log10(1 - 0.999**10))
    assert not models.genotype_likelihoods([], [], [], 3).any()
    df = spark.createDataFrame([([0, 1], [30, 30], [0, 1])], "a array<int>, q array<int>, s array<int>")
    row = df.select(models.position_likelihoods(F.col("a"), F.col("q"), F.col("s"), 2)).first()[0]
    assert len(row) == 3 and row[1] == min(row)


def test_slice_index(spark, tmp_path):
    import gzip

    from spanforge.operators import intervals
    from spanforge.sources import textfiles

    path = str(tmp_path / "a.crai.gz")
    with gzip.open(path, "wt") as f:
        f.write("0\t1\t100\t500\t20\t99\n0\t90\t50\t700\t20\t88\n1\t5\t10\t900\t20\t77\n")
    rows = textfiles.read_slice_index(spark, path).withColumnRenamed("refid", "contig")
    assert [r["container"] for r in intervals.region_query(rows, 0, 95, 96).collect()] == [500, 700]
