"""Operators and functions against plain models, with nulls, ties, repeats and empty tables."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanforge.functions import regions, sequence, stats, variants
from spanforge.functions.bins import STANDARD, Scheme
from spanforge.operators import checksum, headers, indexing, intervals, merging, pairing, pileup, stretches

SPANS = "contig int, beg long, end long"


def spans(spark, rows, fields=SPANS):
    return spark.createDataFrame(rows, fields)


def rand_spans(seed, n, width=200_000):
    r = random.Random(seed)
    return [(r.randint(1, 3), b, b + r.choice((0, 1, r.randint(1, 50_000)))) for b in (r.randint(0, width) for _ in range(n))]


def test_interval_join_model(spark):
    records, regs = rand_spans(1, 300), [(c, b, e + 1) for c, b, e in rand_spans(2, 80)] + [(None, 1, 5), (1, 5, 5), (1, None, 9)]
    edge = [(1, 16383, 16384), (1, 16384, 16385), (2, (1 << 29) - 1, 1 << 29), (2, 1 << 29, (1 << 29) + 5), (2, 1 << 33, (1 << 33) + 9), (2, (1 << 29) - 9, 1 << 34)]
    records += edge
    regs += edge
    meets = lambda a, b: a[0] == b[0] and None not in b and b[2] > b[1] and max(a[2], a[1] + 1) > b[1] and b[2] > a[1]
    want = sorted((*a, b[1], b[2]) for a in records for b in regs if meets(a, b))
    df, rg = spans(spark, records), spans(spark, regs)
    assert sorted(map(tuple, intervals.interval_join(df, rg).select("contig", "beg", "end", "_beg", "_end").collect())) == want
    inside = [a for a in records if any(meets(a, b) for b in regs)]
    assert sorted(map(tuple, intervals.interval_semi(df, rg).collect())) == sorted(inside)
    assert sorted(map(tuple, intervals.interval_anti(df, rg).collect())) == sorted(a for a in records if a not in inside)
    assert intervals.interval_join(df, rg.limit(0)).count() == 0 and intervals.interval_anti(df, rg.limit(0)).count() == len(records)


def test_extra_columns_with_clashing_names(spark):
    df = spans(spark, [(1, 5, 9)]).withColumn("name", F.lit("left"))
    rg = spans(spark, [(1, 0, 20)]).withColumn("payload", F.lit("right"))
    assert intervals.interval_join(df, rg).select("name", "payload").first() == ("left", "right")


@settings(max_examples=200, deadline=None)
@given(st.integers(0, (1 << 29) - 2), st.integers(1, 1 << 20), st.integers(0, (1 << 29) - 2), st.integers(1, 1 << 20))
def test_bins_of_overlaps(b1, n1, b2, n2):
    def smallest(b, e):
        for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
            if b >> shift == (e - 1) >> shift:
                return first + (b >> shift)
        return 0

    e1, e2 = min(b1 + n1, 1 << 29), min(b2 + n2, 1 << 29)
    every = [first + k for shift, first in ((29, 0), (26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)) for k in range(b2 >> shift, ((e2 - 1) >> shift) + 1)]
    assert len(every) == len(set(every))
    if e1 > b2 and e2 > b1:
        assert smallest(b1, e1) in every


def test_bin_tree(spark):
    b = F.col("b")
    rows = spark.range(0, 37449, 7).select(F.col("id").cast("int").alias("b"))
    out = rows.select("b", STANDARD.bin2beg(b).alias("lo"), STANDARD.bin2end(b).alias("hi"), STANDARD.parent(b).alias("up"), STANDARD.children(b).alias("down"), STANDARD.parents(b).alias("all"), STANDARD.level(b).alias("k")).collect()
    for r in out:
        assert STANDARD.first(r["k"]) <= r["b"]
        assert r["all"][-1:] == ([0] if r["b"] else [])
        assert all((c - 1) >> 3 == r["b"] for c in r["down"]) and len(r["down"]) == (8 if r["k"] < 5 else 0)
    again = spark.createDataFrame([(r["lo"], r["hi"], r["b"]) for r in out], "lo long, hi long, b int")
    assert again.where(STANDARD.reg2bin(F.col("lo"), F.col("hi")) != F.col("b")).count() == 0
    assert Scheme(14, 6).reach == 1 << 32 and STANDARD.pseudo_bin == 37450


def test_merge_and_complement(spark):
    rows = rand_spans(3, 200)
    out = {}
    for c, b, e in sorted(rows):
        runs = out.setdefault(c, [])
        if runs and b <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], e), runs[-1][2] + 1)
        else:
            runs.append((b, e, 1))
    want = sorted((c, *r) for c, rs in out.items() for r in rs)
    df = spans(spark, rows)
    assert sorted(map(tuple, intervals.merge_regions(df).select("contig", "beg", "end", "n").collect())) == want
    for bits in (6, 13):
        assert sorted(map(tuple, intervals.merge_regions(df, bits).select("contig", "beg", "end", "n").collect())) == want
    contigs = spark.createDataFrame([(1, 400_000), (2, 400_000), (3, 400_000), (4, 10)], "contig int, length long")
    gaps = {tuple(r) for r in intervals.complement(df, contigs).collect()}
    assert (4, 0, 10) in gaps
    for c, b, e in gaps:
        assert not any(x[0] == c and x[1] < e and x[2] > b for x in want)
    assert {tuple(r) for r in intervals.complement(df, contigs, 9).collect()} == gaps
    assert intervals.merge_regions(df.limit(0)).count() == 0
    whole = spans(spark, rows + [(None, 5, 9), (None, 9, 12)])
    assert intervals.merge_regions(whole, 8).where("contig IS NULL").select("beg", "end", "n").collect() == [(5, 12, 2)]


def test_stretches(spark):
    """Columns over long groups do not depend on where stretches end."""
    r = random.Random(21)
    rows = [(r.choice((1, 2, None)), k * 7, r.randint(0, 50)) for k in range(300)]
    df = spark.createDataFrame(rows, "contig int, at long, v int")
    for bits in (3, 6, 40):
        out = stretches.before(df, ["contig"], ["at"], F.shiftright("at", bits), "v", "b")
        out = stretches.running(out, ["contig"], ["at"], F.shiftright("at", bits), "v", "s")
        out = stretches.running(out, ["contig"], ["at"], F.shiftright("at", bits), "v", "m", most=True)
        last, total, most = {}, {}, {}
        for x in sorted(out.collect(), key=lambda x: x["at"]):
            c = x["contig"]
            assert (x["b"], x["s"], x["m"]) == (last.get(c), total.get(c), most.get(c))
            last[c], total[c], most[c] = x["v"], total.get(c, 0) + x["v"], max(most.get(c, 0), x["v"])


def test_chunks_and_order_by_stretch(spark):
    r = random.Random(22)
    spots = sorted((c, r.randint(0, 3_000_000)) for c in (1, 2) for _ in range(300))
    filed = [(c, b, b + r.choice((10, 30_000)), k * 50 << 16, (k + 1) * 50 << 16) for k, (c, b) in enumerate(spots)]
    df = spark.createDataFrame(filed, SPANS + ", voff long, next_voff long")
    whole = sorted(map(tuple, indexing.bin_chunks(df, bits=60).collect()))
    runs = []
    for c, b, e, lo, hi in filed:
        k = next((b >> w) + o for w, o in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1), (29, 0)) if b >> w == (e - 1) >> w)
        if runs and runs[-1][:2] == [c, k]:
            runs[-1][3] = hi
        else:
            runs.append([c, k, lo, hi])
    assert whole == sorted(map(tuple, runs))
    for bits in (22, 24, 26):
        assert sorted(map(tuple, indexing.bin_chunks(df, bits=bits).collect())) == whole
        mixed = df.withColumn("beg", F.col("beg") + F.when(F.col("voff") % 7 == 0, 100_000).otherwise(0))
        assert indexing.order_violations(mixed, bits=bits).count() == indexing.order_violations(mixed, bits=60).count()


def test_linear_index_and_query(spark):
    r = random.Random(4)
    rows = sorted((c, b, b + r.randint(1, 40_000)) for c in (1, 2) for b in (r.randint(0, 2_000_000) for _ in range(150)))
    filed = [(c, b, e, k * 100 << 16, (k + 1) * 100 << 16) for k, (c, b, e) in enumerate(rows)]
    df = spark.createDataFrame(filed, SPANS + ", voff long, next_voff long")
    linear = {(x["contig"], x["win"]): x["voff"] for x in indexing.linear_index(df).collect()}
    for c in (1, 2):
        mine = [f for f in filed if f[0] == c]
        last = max((f[2] - 1) >> 14 for f in mine)
        nxt = None
        for w in range(last, -1, -1):
            here = [f[3] for f in mine if f[1] >> 14 <= w <= (f[2] - 1) >> 14]
            nxt = min(here) if here else nxt
            assert linear[c, w] == nxt
    chunks = indexing.bin_chunks(df)
    for table in (chunks, indexing.compress_bins(chunks)):
        for lo, hi in ((0, 10), (500_000, 620_000), (1_999_000, 2_000_000)):
            found = indexing.query_chunks(indexing.linear_index(df), table, 1, lo, hi).collect()
            for f in filed:
                if f[0] == 1 and f[1] < hi and f[2] > lo:
                    assert any(a <= f[3] and f[4] <= z for a, z in found)
    halves = [df.where("voff % 200 >= 0 AND beg < 1000000"), df.where("beg >= 1000000")]
    parts = [indexing.index_stats(h, F.lit(False)) for h in halves]
    _, _, merged = indexing.merge_indexes(indexing.linear_index(df), chunks, parts[0].unionByName(parts[1]))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, indexing.index_stats(df, F.lit(False)).collect()))


def test_depth(spark):
    rows = rand_spans(6, 120, 3000)
    want = {}
    for c, b, e in rows:
        for p in range(b, max(e, b + 1)):
            want[c, p] = want.get((c, p), 0) + 1
    got = {(r["contig"], r["pos"]): r["depth"] for r in pileup.depth(spans(spark, rows)).collect()}
    assert got == want
    tens = {}
    for c, b, e in rows:
        for w in range(b // 10, (max(e, b + 1) - 1) // 10 + 1):
            tens[c, w * 10] = tens.get((c, w * 10), 0) + 1
    assert {(r["contig"], r["pos"]): r["depth"] for r in pileup.depth(spans(spark, rows), 10).collect()} == tens
    far = spans(spark, [(1, 65530, 65550), (1, 131070, 131075), (1, 0, 200_000)])
    assert pileup.depth(far).agg(F.sum("depth")).first()[0] == 20 + 5 + 200_000


def test_exact_cap(spark):
    rows = [(1, 0, 10, 0), (1, 0, 10, 1), (1, 5, 20, 2), (1, 10, 12, 3), (1, 10, 30, 4), (2, 0, 5, 5)]
    df = spark.createDataFrame(rows, SPANS + ", voff long")
    assert sorted(r["voff"] for r in pileup.capped(df, 2, ["contig", "beg", "end", "voff"]).collect()) == [0, 1, 3, 4, 5]
    r = random.Random(23)
    rows = sorted((c, b, b + r.randint(1, 60)) for c in (1, 2) for b in (r.randint(0, 3000) for _ in range(250)))
    rows = [(*x, k) for k, x in enumerate(rows)]
    kept, active = [], {}
    for c, b, e, k in rows:
        live = active[c] = [x for x in active.get(c, []) if x > b]
        if len(live) < 3:
            live.append(e)
            kept.append(k)
    df = spark.createDataFrame(rows, SPANS + ", voff long")
    for bits in (5, 20):
        assert sorted(x["voff"] for x in pileup.capped(df, 3, ["contig", "beg", "end", "voff"], bits).collect()) == kept


def test_pileup(spark):
    rows = [("a", 1, 10, 0, "2M1I2M2D1M", "ACGTAC", "IIIIII"), ("b", 1, 12, 0, "1S3M2N1M", "ACGTA", "#####"), ("c", 1, 0, 4, "3M", "AAA", "III"), ("d", None, 0, 0, "3M", "AAA", "III"), ("e", 1, 50, 0, "2I2M", "GGCC", "IIII")]
    df = spark.createDataFrame(rows, "qname string, contig int, pos long, flag int, c string, seq string, qual string").withColumn("cigar", sequence.parse_cigar(F.col("c")))
    got = {(r["qname"], r["ref_pos"]): r for r in pileup.pileup(df).collect()}
    assert sorted(k for k in got if k[0] == "a") == [("a", p) for p in range(10, 17)]
    a = {p: got["a", p] for p in range(10, 17)}
    assert [a[p]["base"] for p in range(10, 17)] == ["A", "C", "T", "A", None, None, "C"]
    assert [a[p]["indel"] for p in range(10, 17)] == [0, 1, 0, -2, 0, 0, 0]
    assert [a[p]["is_del"] for p in range(10, 17)] == [False] * 4 + [True, True, False]
    assert a[10]["is_head"] and a[16]["is_tail"] and not a[11]["is_head"]
    assert got["b", 12]["base"] == "C" and got["b", 15]["is_refskip"] and got["b", 17]["base"] == "A"
    assert ("e", 50) in got and got["e", 50]["base"] == "C" and not any(k[0] in "cd" for k in got)
    assert pileup.pileup_columns(df).where("ref_pos = 12").first()["depth"] == 2


def test_overlapping_mates(spark):
    rows = [("t", 1, 1, 5, "A", 30), ("t", 2, 1, 5, "A", 20), ("t", 1, 1, 6, "A", 30), ("t", 2, 1, 6, "C", 20), ("t", 1, 1, 7, "A", 9), ("u", 1, 1, 5, "A", 150), ("u", 2, 1, 5, "A", 150)]
    out = {(r["qname"], r["mate"], r["ref_pos"]): r["base_qual"] for r in pileup.merge_overlapping_mates(spark.createDataFrame(rows, "qname string, mate int, contig int, ref_pos int, base string, base_qual int")).collect()}
    assert out == {("t", 1, 5): 50, ("t", 2, 5): 0, ("t", 1, 6): 24, ("t", 2, 6): 0, ("t", 1, 7): 9, ("u", 1, 5): 200, ("u", 2, 5): 0}


def test_checksums(spark):
    texts = ["", "a", "@r\nACGT\n+\nIIII\n", "é" * 40, "x" * 700]
    got = checksum._hashes([t.encode() for t in texts])
    assert got.tolist() == [checksum.text_hash(t.encode()) for t in texts]
    reads = spark.createDataFrame([(f"n{k}/1", "ACGT" * (k % 5 + 1), "IIII" * (k % 5 + 1)) for k in range(200)], "name string, seq string, qual string")
    one = checksum.fastq_checksum(reads)
    aligned = reads.select(F.regexp_replace("name", "/1", "").alias("qname"), F.lit(16).alias("flag"), sequence.reverse_complement(F.col("seq")).alias("seq"), F.reverse("qual").alias("qual"))
    assert checksum.same_checksum(one, checksum.read_checksum(aligned)).first()["same"]
    assert not checksum.same_checksum(one, checksum.fastq_checksum(reads.where("name <> 'n7/1'"))).first()["same"]
    twice = reads.union(reads.limit(1))
    assert not checksum.same_checksum(one, checksum.fastq_checksum(twice)).first()["same"]
    assert checksum.fastq_checksum(reads.limit(0)).first()["checksum"] == 0


def test_templates(spark):
    rows = [("a", 65, None), ("a", 129, None), ("b", 65, "x;"), ("b", 129, None), ("c", 65, "x;"), ("c", 65 | 2048, None), ("c", 129, None), ("d", 0, None), ("e", 129, None)]
    df = spark.createDataFrame(rows, "qname string, flag int, sa string")
    got = {r["qname"]: r["complete"] for r in pairing.complete_templates(df, ["qname"]).collect()}
    assert got == {"a": True, "b": False, "c": True, "d": True, "e": False}
    assert [r["secondary"] for r in pairing.assembled(df, ["qname"]).where("qname = 'c'").collect()] == [False, True, False]


def test_sequence_functions(spark):
    row = spark.range(1).select(
        sequence.reverse_complement(F.lit("ACGTNrY")), sequence.flag_names(F.lit(99)), sequence.flag_value(F.lit("paired,READ2")), sequence.flag_value(F.lit("77")), sequence.phred64_to_33(F.lit("@h")),
        sequence.solexa64_to_33(F.lit(";h")), sequence.bare_name(F.lit("@r1/2 comment")), sequence.base_count(F.lit("AcGT"), "C"),
    ).first()
    assert tuple(row)[:5] == ("RyNACGT", "PAIRED,PROPER_PAIR,MREVERSE,READ1", 129, 77, "!I")
    assert row[5] == chr(int(33 - 5 + 10 * 1.0 * __import__("math").log10(1 + 10**0.5))) + "I" and row[6] == "r1" and row[7] == 1
    with pytest.raises(Exception, match="quality out of range"):
        spark.range(1).select(sequence.phred64_to_33(F.lit("!"))).collect()
    tags = sequence.parse_tags(F.split(F.lit("NM:i:3 RG:Z:a:b XX:Q:1 NM:i:4 XB:B:c,1,2"), " "))
    t = spark.range(1).select(tags.alias("t")).select(sequence.tag_value(F.col("t"), "NM", "int"), sequence.tag_value(F.col("t"), "RG"), sequence.tag_array(F.col("t"), "XB"), F.map_keys(sequence.without_tag(sequence.with_tag(F.col("t"), "NM", "i", F.lit(9)), "RG")), sequence.tag_value(F.col("t"), "ZZ")).first()
    assert (t[0], t[1], t[2], sorted(t[3]), t[4]) == (3, "a:b", [1.0, 2.0], ["NM", "XB"], None)


CLASSES = [
    ("A", "C", 1), ("A", "a", 0), ("A", ".", 0), ("A", "X", 0), ("A", "*", 32), ("A", "<*>", 0), ("A", "<NON_REF>", 0), ("A", "<DEL>", 8), ("AC", "AT", 1), ("AC", "TG", 2), ("A", "AT", 4), ("ACG", "A", 4), ("A", "A[2:3[", 16), ("ACG", "ACG", 0),
    ("ACGT", "TCGA", 2), ("CA", "ATG", 8), ("T", "ATG", 8), ("T", "AGT", 4), ("ACGT", "AGGT", 1), ("GACT", "GT", 4), ("ACT", "GG", 8),
]


def test_variant_classes(spark):
    df = spark.createDataFrame(CLASSES, "ref string, alt string, want int")
    bad = df.withColumn("got", variants.allele_class(F.col("ref"), F.col("alt"))).where("got <> want").collect()
    assert not bad
    both = spark.range(1).select(variants.variant_class(F.lit("A"), F.array(F.lit("C"), F.lit("AT"))), variants.variant_class(F.lit("A"), F.array().cast("array<string>"))).first()
    assert tuple(both) == (5, 0)


def test_genotypes(spark):
    said = [("0/0", 0), ("1/1", 1), ("0|1", 2), ("1/2", 3), ("0", 4), ("2", 5), ("./1", 6), ("./.", 6), ("2/1/1", 3)]
    df = spark.createDataFrame(said, "g string, want int").withColumn("p", variants.parse_genotype(F.col("g")))
    assert df.where(variants.genotype_class(F.col("p.alleles")) != F.col("want")).count() == 0
    row = df.agg(F.collect_list("p.alleles").alias("all")).select(variants.allele_counts(F.col("all"), F.lit(3))).first()
    assert row[0] == [4, 7, 3]
    row = spark.range(1).select(variants.counts_from_info(F.lit(10), F.array(F.lit(3), F.lit(2))), variants.keep_alleles(F.array(F.lit(True), F.lit(False), F.lit(True)), F.array(*[F.lit(k) for k in range(6)]), "G"), variants.keep_alleles(F.array(F.lit(True), F.lit(False)), F.array(F.lit(None).cast("int")), "A")).first()
    assert row[0] == [5, 3, 2] and row[1] == [0, 3, 5] and row[2] == [None]


def test_region_strings():
    contigs = {"chr1": 1000, "chr2": 500, "a:1": 50, "HLA:01:02": 70, "b": 9, "b:2": 8}
    r = lambda s, **k: (lambda x: (x.contig, x.beg, x.end))(regions.parse_region(s, contigs, **k))
    assert r("chr1") == ("chr1", 0, 1000) and r("chr1:100") == ("chr1", 99, 1000) and r("chr1:100", one_position=True) == ("chr1", 99, 100)
    assert r("chr1:1,00-2e2") == ("chr1", 99, 200) and r("chr1:-100") == ("chr1", 0, 100) and r("chr1:100-") == ("chr1", 99, 1000) and r("chr1:0.1k-200") == ("chr1", 99, 200)
    assert r("a:1") == ("a:1", 0, 50) and r("{a:1}:5-6") == ("a:1", 4, 6) and r("HLA:01:02:3-4") == ("HLA:01:02", 2, 4)
    for bad in ("b:2", "nosuch", "chr1:500-100", "chr1:x", "{chr1", "chr1:5-6-7", "chr1:0-5"):
        with pytest.raises(regions.RegionError):
            r(bad)
    assert [x.contig for x in regions.parse_regions("chr1:1-2,chr2", contigs)] == ["chr1", "chr2"]
    assert regions.parse_decimal("1.5M")[0] == 1_500_000 and regions.parse_decimal("1,234x") == (1234, 5)


def test_statistics():
    assert stats.fisher(3, 1, 1, 3) == pytest.approx((0.9857142857, 0.2428571429, 0.4857142857))
    assert stats.fisher(0, 0, 0, 0) == (1.0, 1.0, 1.0)
    assert stats.gamma_p(2.5, 1.3) + stats.gamma_q(2.5, 1.3) == pytest.approx(1) and stats.gamma_p(1, 2) == pytest.approx(1 - 2.718281828459045**-2)
    assert stats.beta_i(2, 3, 0.4) == pytest.approx(0.5248) and stats.beta_i(2, 3, 0) == 0 and stats.beta_i(2, 3, 1) == 1


def test_pairing_model(spark):
    """Every record is in exactly one row, no row has a source twice, equal records share a row, and
    nothing pairs that the mode forbids."""
    r = random.Random(8)
    pool = [("A>C", "C", 1), ("A>G", "G", 1), ("A>AT", "AT", 4), ("AC>A", "A", 4), ("A>.", "", 0), ("A><X>", "<X>", 8)]
    for mode in (0, merging.SNPS, merging.INDELS, merging.BOTH, merging.BOTH_REF, merging.ANY, merging.SOME):
        for _ in range(60):
            records = [(s, *v) for s in ("x", "y", "z") for v in r.sample(pool, r.randint(0, 3))]
            rows = merging.paired(records, mode)
            assert sorted((s, k) for row in rows for s, k in row) == sorted((s, k) for s, k, _, _ in records)
            kinds = {k: c for _, k, _, c in records}
            for row in rows:
                assert len({s for s, _ in row}) == len(row)
                for _, a in row:
                    for _, b in row:
                        assert a == b or merging.pair_score(kinds[a], kinds[b], mode)
            if not mode:
                assert len(rows) == len(set(kinds))
    rows = [("x", 1, 5, "A", ["C"]), ("y", 1, 5, "A", ["G"]), ("y", 1, 6, "A", ["C"])]
    df = spark.createDataFrame(rows, "source string, contig int, pos long, ref string, alts array<string>")
    assert merging.merge_scored(df, merging.SNPS).groupBy("pos", "row").count().count() == 2
    assert merging.merge_scored(df.limit(0), merging.SNPS).count() == 0


def test_headers(spark):
    h = headers.parse_header(spark, "@HD\tVN:1.6\n@SQ\tSN:c1\tLN:10\n@SQ\tSN:c2\tLN:20\n@RG\tID:g\tLB:l\n@PG\tID:p\n@CO\tfree: text\n")
    h = headers.add_program(headers.update_line(headers.add_line(h, "SQ", SN="c3", LN="5"), "SQ", "SN", "c2", LN="21"), "p", "2")
    text = [r["value"] for r in headers.header_text(h).collect()]
    assert "@SQ\tSN:c2\tLN:21" in text and "@CO\tfree: text" in text and "@PG\tID:p.1\tPN:p\tVN:2\tPP:p" in text
    assert [tuple(r) for r in headers.contigs_of(h).orderBy("refid").collect()] == [(0, "c1", 10), (1, "c2", 21), (2, "c3", 5)]
    assert headers.remove_lines(h, "SQ", "SN", "c1").where("type = 'SQ'").count() == 2 and headers.remove_except(h, "SQ", "SN", ["c3"]).where("type = 'SQ'").count() == 1
    assert headers.remove_tag(h, "RG", "ID", "g", "LB").where("type = 'RG'").first()["tags"] == {"ID": "g"}
    assert headers.nth_line(h, "SQ", 1).first()["tags"]["SN"] == "c2"
    v = headers.parse_variant_header(spark, '##fileformat=VCFv4\n##INFO=<ID=A,Number=1,Type=Integer,Description="x, y">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1')
    w = headers.parse_variant_header(spark, '##fileformat=VCFv4\n##INFO=<ID=A,Number=2,Type=Float,Description="z">\n##INFO=<ID=B,Number=0,Type=Flag,Description="b">')
    m = {(r["kind"], r["id"]): r["number"] for r in headers.merge_headers(v, w).collect()}
    assert m[("INFO", "A")] == "1" and ("INFO", "B") in m and ("samples", "s1") in m


def test_streaming(spark, tmp_path):
    from spanforge.streaming import arrivals

    rows = [(k % 3, k * 100, k * 100 + 50, k << 16, (k + 1) << 16, "a") for k in range(300)]
    df = spark.createDataFrame(rows, SPANS + ", voff long, next_voff long, kind string")
    path = str(tmp_path / "in")
    for k in range(3):
        df.where(F.col("beg") % 300 == k * 100).write.mode("append").parquet(path)
    stream = arrivals.arriving(spark, path, df.schema, 1)
    for name, frame, want in (("stats", arrivals.running_stats(stream, F.lit(False)), indexing.index_stats(df, F.lit(False))), ("lin", arrivals.running_linear(stream), None)):
        q = frame.writeStream.outputMode("complete").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        got = spark.table(name)
        if want is not None:
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        else:
            assert got.count() == 6
