"""Blocked files and formats: round trips, and reads in many partitions against reads in one."""

import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from spanforge.sources import alignments, bcf, bgzf, textfiles


@pytest.fixture(scope="module")
def lines():
    r = random.Random(5)
    out = ["#header"] + [f"c{r.randint(1, 3)}\t{k * 10}\t{k * 10 + r.randint(1, 30)}\t" + "x" * r.randint(0, 400) for k in range(4000)]
    return out


def test_codec_and_find():
    data = os.urandom(300_000)
    blocked = bgzf.compress(data)
    assert blocked.endswith(bgzf.EOF) and bgzf.decompress(blocked) == data
    offsets = [o for o, _ in bgzf.blocks_of(blocked)]
    for k in range(0, offsets[2] + 1, 97):
        assert bgzf.find_block(blocked, k, True) == next(o for o in offsets if o >= k)
    # a payload that holds a block's bytes, stored: the false header is refused
    inner = bgzf.deflate(b"inner" * 10)
    outer = bgzf.compress(inner * 3, level=0)
    assert bgzf.find_block(outer, 1, True) == bgzf.block_size(outer)
    broken = bytearray(blocked)
    broken[40] ^= 1
    with pytest.raises(bgzf.BlockError):
        bgzf.decompress(bytes(broken))
    assert bgzf.decompress(bgzf.compress(b"")) == b""


def test_find_backwards_and_split():
    data = os.urandom(200_000)
    blocked = bgzf.compress(data)
    offsets = [o for o, _ in bgzf.blocks_of(blocked)]
    for at in (*offsets, *(o + 1 for o in offsets), *(o + 700 for o in offsets[:-1])):
        assert bgzf.find_block_before(blocked, at, True) == max((o for o in offsets if o < at), default=None)
    assert bgzf.find_block_before(blocked, whole_file=True) == offsets[-1] and bgzf.find_block_before(b"", whole_file=True) is None
    outer = bgzf.compress(bgzf.deflate(b"inner" * 10) * 3, level=0, end=False)
    assert bgzf.find_block_before(outer, whole_file=True) == 0
    block = bgzf.deflate(b"some text of a block")
    for at in (0, 4, 20):
        head, tail = bgzf.split_block(block, at)
        assert bgzf.decompress(head + tail) == b"some text of a block" and (bgzf.inflate(head) if head else b"") == b"some text of a block"[:at]
    with pytest.raises(bgzf.BlockError, match="no place"):
        bgzf.split_block(block, 21)


@pytest.mark.parametrize("blocked", [True, False])
def test_lines_in_any_split(spark, tmp_path, lines, blocked):
    text = "\n".join(lines).encode() + b"\n"
    path = str(tmp_path / ("a.gz" if blocked else "a.txt"))
    with open(path, "wb") as f:
        f.write(b"".join(bgzf.deflate(text[k : k + 5000]) for k in range(0, len(text), 5000)) + bgzf.EOF if blocked else text)
    for split in (1 << 30, 40_000, 7_001):
        got = sorted((r["coffset"], r["uoffset"], r["line"]) for r in bgzf.lines(spark, path, split).collect())
        assert [g[2] for g in got] == lines
    feats = textfiles.read_features(spark, path, "bed", blocked_offsets=True)
    assert feats.count() == len(lines) - 1


def test_every_byte_split_without_spark(tmp_path, lines):
    some = lines[:60]
    text = "\n".join(some).encode()
    blocked = b"".join(bgzf.deflate(text[k : k + 700]) for k in range(0, len(text), 700)) + bgzf.EOF
    for name, data in (("a.gz", blocked), ("a.txt", text)):
        path = str(tmp_path / name)
        with open(path, "wb") as f:
            f.write(data)
        for split in (*range(1, 40, 7), 333, 1024, 5000):
            got = []
            for p in bgzf.ranges([path], split):
                got += [r[3] for r in bgzf._line_rows(p)]
            assert got == some, (name, split)


def test_write_and_block_table(spark, tmp_path, lines):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).repartition(3)
    bgzf.write(df, out)
    parts = sorted(p for p in os.listdir(out) if p.startswith("part"))
    assert len(parts) == 3 and not [p for p in os.listdir(out) if p.startswith(".")and not p.endswith(".crc")]
    whole = b"".join(open(f"{out}/{p}", "rb").read() for p in parts)
    assert sorted(bgzf.decompress(whole).decode().splitlines()) == sorted(lines)
    path = f"{out}/{parts[0]}"
    assert bgzf.ends_well(path)
    rows = bgzf.blocks(spark, path).orderBy("coffset").collect()
    at = 0
    for r in rows:
        assert r["uoffset"] == at
        at += r["isize"]
    index = bgzf.block_index_bytes([(r["coffset"], r["uoffset"]) for r in rows[1:]])
    assert bgzf.parse_block_index(index) == [(r["coffset"], r["uoffset"]) for r in rows]
    data = bgzf.decompress(open(path, "rb").read())
    assert bgzf.decompress(bgzf.section(path, 100, 5000)) == data[100:5000]


def _reads(n):
    r = random.Random(9)
    rows = []
    for k in range(n):
        size = r.randint(1, 60)
        seq = "".join(r.choice("ACGTN") for _ in range(size))
        rows.append((f"read{k}", r.choice((0, 16, 99, 147)), r.choice(("chr1", "chr2")), k * 3, r.randint(0, 60), f"{size}M", "=" if k % 2 else "*", k * 3 + 5, 20, seq, "".join(chr(33 + r.randint(0, 40)) for _ in seq), k))
    return rows


def test_bam_round_trip(spark, tmp_path):
    sam = str(tmp_path / "a.sam")
    with open(sam, "w") as f:
        f.write("@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:100000\n@SQ\tSN:chr2\tLN:90000\n")
        for n, fl, c, p, q, cig, rn, mp, t, s, ql, k in _reads(900):
            f.write("\t".join(map(str, (n, fl, c, p + 1, q, cig, rn, mp + 1, t, s, ql, f"NM:i:{k}", "RG:Z:g1", "XA:A:c", "XF:f:1.5", "XB:B:s,1,-2"))) + "\n")
    rows = alignments.read_sam(spark, sam)
    contigs = [("chr1", 100000), ("chr2", 90000)]
    out = str(tmp_path / "bam")
    alignments.write_bam(rows.repartition(3), out, "@HD\tVN:1.6\n", contigs)
    one = str(tmp_path / "a.bam")
    with open(one, "wb") as f:
        for p in ["header.gz", *sorted(p for p in os.listdir(out) if p.startswith("part"))]:
            f.write(open(f"{out}/{p}", "rb").read().removesuffix(bgzf.EOF))
        f.write(bgzf.EOF)
    cols = ["qname", "flag", "rname", "pos", "mapq", "cigar_text", "rnext", "mate_pos", "tlen", "seq", "qual"]
    key = lambda df: sorted(map(tuple, df.select(*cols).collect()))
    want = key(rows)
    for split in (1 << 30, 9000, 2500):
        got = alignments.read_bam(spark, one, split)
        assert key(got) == want, split
    few = alignments.read_bam(spark, one, 9000, columns=["pos", "qual"])
    assert few.columns == ["pos", "qual"] and sorted(map(tuple, few.collect())) == sorted((w[3], w[10]) for w in want)
    with pytest.raises(ValueError, match="nothing"):
        alignments.read_bam(spark, one, columns=["nothing"])
    tags = {r["qname"]: r["tags"] for r in got.select("qname", "tags").collect()}
    assert tags["read7"]["NM"]["value"] == "7" and tags["read7"]["XB"]["value"] == "s,1,-2" and tags["read7"]["XF"]["value"] == "1.5"
    assert [tuple(r) for r in alignments.bam_contigs(spark, one).orderBy("refid").collect()] == [(0, "chr1", 100000), (1, "chr2", 90000)]
    back = [r[0] for r in alignments.sam_text(rows).collect()]
    assert back[0].split("\t")[:11] == open(sam).read().splitlines()[3].split("\t")[:11]


def test_fastq_and_fasta(spark, tmp_path):
    reads = [(n, s, q) for n, _, _, _, _, _, _, _, _, s, q, _ in _reads(500)]
    path = str(tmp_path / "a.fq")
    with open(path, "w") as f:
        for n, s, q in reads:
            f.write(f"@{n} some comment\n{s}\n+\n{q}\n")
    for split in (1 << 30, 3000, 517):
        got = sorted((r["name"], r["seq"], r["qual"]) for r in textfiles.read_fastq(spark, path, split).collect())
        assert got == sorted(reads), split
    fa = str(tmp_path / "a.fa")
    with open(fa, "w") as f:
        for n, s, _ in reads:
            f.write(f">{n} x\n" + "\n".join(s[k : k + 10] for k in range(0, len(s), 10)) + "\n")
    for split in (1 << 30, 700):
        got = sorted((r["name"], r["seq"]) for r in textfiles.read_fasta(spark, fa, split).collect())
        assert got == sorted((n, s) for n, s, _ in reads), split
    index = textfiles.sequence_index(open(fa).read().splitlines(keepends=True))
    text = open(fa, "rb").read()
    for (name, length, offset, per, width), (n, s, _) in zip(index, reads, strict=True):
        assert (name, length) == (n, len(s))
        k = length - 1
        assert text[offset + k // per * width + k % per : offset + k // per * width + k % per + 1].decode() == s[k]


VCF = """##fileformat=VCFv4.2
##INFO=<ID=END,Number=1,Type=Integer,Description="End">
##contig=<ID=c1,length=1000>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2
c1\t10\trs1\tACG\tA,T\t30\tPASS\tDP=3;DB\tGT:DP\t0/1:5\t./.:.
c1\t20\t.\tA\t<DEL>\t.\tq10;s50\tEND=50\tGT\t1|1\t0
c1\t30\t.\tA\t.\t5.5\t.\t.\tGT:DP\t0/0\t1/2:7
"""


def test_vcf(spark, tmp_path):
    path = str(tmp_path / "a.vcf")
    with open(path, "w") as f:
        f.write(VCF)
    rows = textfiles.read_vcf(spark, path).orderBy("pos").collect()
    assert [(r["pos"], r["end"], r["id"], r["alts"], r["qual"], r["filters"]) for r in rows] == [(9, 12, "rs1", ["A", "T"], 30.0, ["PASS"]), (19, 50, None, ["<DEL>"], None, ["q10", "s50"]), (29, 30, None, [], 5.5, [])]
    assert rows[0]["samples"][0]["gt"]["alleles"] == [0, 1] and rows[0]["samples"][1]["gt"]["alleles"] == [None, None]
    assert rows[1]["samples"][0]["gt"]["phased"] and rows[2]["samples"][0]["fields"] == {"GT": "0/0"}
    want = [*VCF.splitlines()[4:6], VCF.splitlines()[6].replace("0/0", "0/0:.")]  # a field that a sample lacks is written as missing
    assert [r[0] for r in textfiles.vcf_text(textfiles.read_vcf(spark, path)).collect()] == want
    assert [r[0] for r in textfiles.vcf_text(textfiles.read_vcf(spark, path).drop("samples")).collect()] == ["\t".join(x.split("\t")[:8]) for x in want]
    feats = textfiles.read_features(spark, path, "vcf").orderBy("beg").collect()
    assert [(f["beg"], f["end"]) for f in feats] == [(9, 12), (19, 50), (29, 30)]


def test_index_bytes_and_formats():
    layout = textfiles.LAYOUTS["bed"]
    tables = {"bins": [(0, 4681, 5, 90), (0, 4681, 100, 200), (1, 0, 300, 400)], "linear": [(0, 0, 5), (0, 1, 9), (1, 0, 300)], "stats": [(0, 5, 200, 7, 1)]}
    got = textfiles.parse_index(textfiles.index_bytes(["c1", "c2"], tables["bins"], tables["linear"], tables["stats"], layout))
    assert got["contigs"] == [(0, "c1"), (1, "c2")] and got["bins"] == tables["bins"] and got["linear"] == tables["linear"] and got["stats"] == tables["stats"]
    said = {b"@HD\tVN:1\n": "sam", b"@r1\nAC\n+\nII\n": "fastq", b">s\nAC\n": "fasta", VCF.encode(): "vcf", b"c\t1\t2\n": "bed", b"BAM\1": "bam", b"": "empty", b"words": "text", b"c\tx\ty\t1\t2\t.\t+\t.\ta=b\n": "gff"}
    for data, name in said.items():
        assert textfiles.detect_format(data) == name
        assert textfiles.detect_format(bgzf.compress(data) if data else data) == ("blocked " + name if data else name)


def test_indexed_query(spark, tmp_path):
    from pyspark.sql import functions as F

    from spanforge.operators import indexing

    r = random.Random(11)
    rows = sorted((c, b, b + r.randint(1, 30_000)) for c in ("c1", "c2") for b in (r.randint(0, 3_000_000) for _ in range(2500)))
    text = ("#head\n" + "".join(f"{c}\t{b}\t{e}\tname{k}\n" for k, (c, b, e) in enumerate(rows))).encode()
    path = str(tmp_path / "a.bed.gz")
    with open(path, "wb") as f:
        f.write(b"".join(bgzf.deflate(text[k : k + 3000]) for k in range(0, len(text), 3000)) + bgzf.EOF)
    feats = textfiles.filed_features(textfiles.read_features(spark, path, "bed", blocked_offsets=True))
    linear, chunks = indexing.linear_index(feats), indexing.compress_bins(indexing.bin_chunks(feats))
    index = str(tmp_path / "a.tbi")
    ids = {"c1": 0, "c2": 1}
    number = F.when(F.col("contig") == "c1", 0).otherwise(1)
    stats = indexing.index_stats(feats, F.lit(False))
    textfiles.write_index(index, ["c1", "c2"], chunks.withColumn("refid", number), linear.withColumn("refid", number), stats.withColumn("refid", number), textfiles.LAYOUTS["bed"])
    back = textfiles.load_index(spark, index)
    names = back["contigs"]
    chunks, linear = (back[k].join(names, "refid") for k in ("bins", "linear"))
    assert back["stats"].count() == 2 and linear.count() == back["linear"].count() > 300
    for contig, beg, end in (("c1", 0, 5), ("c1", 1_000_000, 1_020_000), ("c2", 2_999_000, 4_000_000), ("c2", 0, 3_100_000), ("c2", 9_000_000, 9_000_010)):
        got = sorted((x["contig"], x["beg"], x["end"]) for x in textfiles.query_file(spark, path, "bed", chunks, linear, contig, beg, end).collect())
        assert got == [x for x in rows if x[0] == contig and x[1] < end and x[2] > beg], (contig, beg, end)
    assert ids and bgzf.read_bytes(path) == text
    table = bgzf.blocks(spark, path)
    bgzf.write_block_index(table, str(tmp_path / "a.gzi"))
    assert bgzf.load_block_index(spark, str(tmp_path / "a.gzi")).count() == table.count()


def test_fetch_bases(tmp_path):
    path = str(tmp_path / "a.fa")
    seqs = {"s1": "ACGTACGTAC" * 7 + "TT", "s2": "GG"}
    text = "".join(f">{n}\n" + "".join(s[k : k + 10] + "\n" for k in range(0, len(s), 10)) for n, s in seqs.items())
    with open(path, "w") as f:
        f.write(text)
    for entry in textfiles.sequence_index(text.splitlines(keepends=True)):
        s = seqs[entry[0]]
        for beg, end in ((0, 5), (8, 23), (-4, 99), (len(s) - 1, len(s)), (50, 50), (900, 950)):
            assert textfiles.fetch_bases(path, entry, beg, end) == s[max(beg, 0) : max(end, 0)]


def test_skip_goes_by_place(spark, tmp_path):
    """Lines equal to a skipped one stay, in plain and blocked files, each file by itself."""
    body = "c\t5\t9\nc\t5\t9\nx\t1\t2\nc\t5\t9\n"
    plain, blocked = str(tmp_path / "a.txt"), str(tmp_path / "b.gz")
    with open(plain, "w") as f:
        f.write(body)
    with open(blocked, "wb") as f:
        f.write(bgzf.compress(body.encode()))
    layout = textfiles.Layout(1, 2, 3, skip=2)
    for path in (plain, blocked):
        assert sorted(r["contig"] for r in textfiles.read_features(spark, path, layout).collect()) == ["c", "x"]
    assert textfiles.read_features(spark, f"{plain},{blocked}", layout).count() == 4
    assert textfiles.read_features(spark, plain, textfiles.Layout(1, 2, 3, skip=9)).count() == 0
    packed = str(tmp_path / "c.gz")
    with open(packed, "wb") as f:
        f.write(gzip.compress(body.encode()))
    with pytest.raises(ValueError, match="no place"):
        textfiles.read_features(spark, packed, layout)
    assert textfiles.read_features(spark, packed, textfiles.Layout(1, 2, 3)).count() == 4


def test_headers_are_read_no_further(spark, tmp_path, monkeypatch):
    for name, data in (("a.vcf", VCF.encode()), ("a.vcf.gz", bgzf.compress(VCF.encode())), ("b.vcf.gz", gzip.compress(VCF.encode()))):
        path = str(tmp_path / name)
        with open(path, "wb") as f:
            f.write(data)
        assert textfiles.variant_header(spark, path) == "\n".join(VCF.splitlines()[:4])
        assert textfiles.read_vcf(spark, path).count() == 3


def test_sections_with_and_without_an_index(spark, tmp_path):
    data = bytes(random.Random(5).randbytes(300_000))
    path = str(tmp_path / "a.gz")
    with open(path, "wb") as f:
        f.write(bgzf.compress(data))
    bgzf.write_block_index(bgzf.blocks(spark, path), path + ".gzi")
    index = bgzf.load_block_index(spark, path + ".gzi")
    assert index.count() == len(list(bgzf.blocks_of(open(path, "rb").read())))
    for beg, end in ((0, 10), (65_279, 65_281), (100_000, 250_000), (299_990, 400_000), (5, 5)):
        assert bgzf.decompress(bgzf.section(path, beg, end)) == bgzf.decompress(bgzf.section(path, beg, end, index)) == data[beg:end]
    plain = str(tmp_path / "a.bin")
    with open(plain, "wb") as f:
        f.write(data)
    again = bgzf.blocks_by_index(spark, plain, index).orderBy("uoffset").collect()
    assert b"".join(bgzf.inflate(bytes(r["block"])) for r in again) == data


def test_bcf_round_trip_of_odd_values(spark, tmp_path):
    header = """##fileformat=VCFv4.2
##contig=<ID=c1,length=1000>
##FILTER=<ID=q10,Description="x">
##INFO=<ID=I,Number=.,Type=Integer,Description="x">
##INFO=<ID=F,Number=.,Type=Float,Description="x">
##INFO=<ID=S,Number=1,Type=String,Description="x">
##INFO=<ID=B,Number=0,Type=Flag,Description="x">
##FORMAT=<ID=GT,Number=1,Type=String,Description="x">
##FORMAT=<ID=V,Number=.,Type=Integer,Description="x">
##FORMAT=<ID=W,Number=.,Type=Float,Description="x">
##FORMAT=<ID=T,Number=1,Type=String,Description="x">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2
"""
    long = "ACGT" * 20
    body = [
        f"c1\t1\t.\t{long}\tA\t.\t.\t.\tGT:V:W:T\t0|1:1,2,3:0.5:ab\t.:.:.:.",
        "c1\t5\tr\tA\tC,G,T\t7.5\tPASS\tI=1,.,-70000,300;F=1.5,.;S=text;B\tGT:V\t1/2/3:.\t0:40000,-5",
        "c1\t9\t.\tA\t.\t0\tq10\tI=-119\tGT\t./.\t1",
    ]
    path = str(tmp_path / "a.vcf")
    with open(path, "w") as f:
        f.write(header + "\n".join(body) + "\n")
    rows = textfiles.read_vcf(spark, path)
    bcf.write_bcf(rows, str(tmp_path / "out"), header)
    bgzf.join_parts(str(tmp_path / "out"), str(tmp_path / "a.bcf"))
    back = bcf.read_bcf(spark, str(tmp_path / "a.bcf"))
    lines = lambda df: sorted(r[0] for r in textfiles.vcf_text(df).collect())
    assert lines(back) == lines(rows) == sorted(body)
    few = bcf.read_bcf(spark, str(tmp_path / "a.bcf"), columns=["pos", "ref"])
    assert few.columns == ["pos", "ref"] and sorted(map(tuple, few.collect())) == sorted(map(tuple, back.select("pos", "ref").collect()))
    with pytest.raises(Exception, match="KeyError"):
        bcf.write_bcf(rows.withColumn("contig", F.lit("nowhere")), str(tmp_path / "no"), header)


def test_bcf_in_any_split(tmp_path):
    header = "##fileformat=VCFv4.2\n##contig=<ID=c1>\n##contig=<ID=c2>\n##FORMAT=<ID=GT,Number=1,Type=String>\n##FORMAT=<ID=T,Number=1,Type=String>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n"
    r = random.Random(11)
    numbered, contigs, samples = bcf.dictionaries(header)
    strings, contig_ids = {v: k for k, v in numbered.items()}, {v: k for k, v in contigs.items()}
    raw, head = b"", header.encode() + b"\0"
    for k in range(300):
        fields = [[("GT", r.choice(("0/1", "1|1"))), ("T", "x" * r.choice((0, 3, 2500)))] for _ in samples]
        row = {"contig": r.choice(("c1", "c2")), "pos": k, "id": r.choice((None, "rs" * r.randint(1, 30))), "ref": "A" * r.choice((1, 40)), "alts": ["C"], "qual": None, "filters": None, "info": {}, "samples": [{"sample": s, "fields": f} for s, f in zip(samples, fields, strict=True)]}
        raw += bcf.encode(row, strings, contig_ids, {}, 2)
    data = b"BCF\2\2" + len(head).to_bytes(4, "little") + head + raw
    path = str(tmp_path / "a.bcf")
    with open(path, "wb") as f:
        f.write(b"".join(bgzf.deflate(data[k : k + 700]) for k in range(0, len(data), 700)) + bgzf.EOF)
    want = None
    for split in (1 << 30, 9001, 1777, 300):
        got = [row[1] for p in bgzf.ranges([path], split) for row in bcf._rows(p)]
        assert got == list(range(300)), split
        rows = [row for p in bgzf.ranges([path], split) for row in bcf._rows(p)]
        want = want or rows
        assert rows == want
    with open(path, "wb") as f:
        f.write(bgzf.compress(b"no variants here"))
    with pytest.raises(bgzf.BlockError):
        list(bcf._rows(bgzf.ranges([path], 1 << 20)[0]))


def test_region_lists_of_odd_lines(spark):
    lines = ["c1", "c1\t5", "c1 5 9 name", "# no", "", "  c2\t7\t9", "c3\tx\t9", "c4\t0\t5", "c5\t1,000\t2,000"]
    rows = spark.createDataFrame([(x,) for x in lines], "line string")
    got = sorted((r["contig"], r["beg"], r["end"], r["payload"]) for r in textfiles.regions_of(rows, "tab").collect())
    assert got == [("c1", 0, 1 << 35, ""), ("c1", 4, 5, ""), ("c1", 4, 9, "name"), ("c2", 6, 9, ""), ("c5", 999, 2000, "")]
    rows = spark.createDataFrame([(x,) for x in ("c1", "c1:5", "c1:5-", "c1:5-9 x y", "c1:", "c1:0-3")], "line string")
    assert sorted((r["beg"], r["end"], r["payload"]) for r in textfiles.regions_of(rows, "reg").collect()) == [(0, 1 << 35, ""), (4, 5, ""), (4, 9, "x y"), (4, 1 << 35, "")]
    with pytest.raises(ValueError, match="kind"):
        textfiles.regions_of(rows, "nothing")
