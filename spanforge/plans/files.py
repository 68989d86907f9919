"""Queries that write files in the shared folder and read them back, and further queries over fields and
headers; each with the SQL that says what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import filterlang, sequence, variants
from spanforge.functions.bins import overlaps
from spanforge.operators import headers, indexing, intervals, pairing
from spanforge.plans import genome
from spanforge.plans.catalogue import FILED, REC, VAR, query
from spanforge.shared import materialise, new_path, pieces
from spanforge.sources import alignments, bcf, bgzf, cram, textfiles
from spanforge.sources.tables import table

SPLIT = 1 << 16


def _file(lines: DataFrame, name: str, header: str = "") -> str:
    """Lines (one column) below a header as one blocked file; its path."""
    folder = new_path(lines.sparkSession, name)
    bgzf.write(lines, folder)
    if header:
        with bgzf.open_output(f"{folder}/header.gz") as f:
            f.write(bgzf.compress(header.encode(), end=False))
    bgzf.join_parts(folder, f"{folder}.gz")
    return f"{folder}.gz"


# --- blocks -------------------------------------------------------------------------------------

_LINE = "(p_partkey || chr(9) || p_name || chr(9) || p_size)"


def _part_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [F.col(c).cast("string") for c in ("p_partkey", "p_name", "p_size")]
    return table(spark, sf_dir, "part").orderBy("p_partkey").select(F.concat_ws("\t", *fields).alias("value"))


@query(f"SELECT p_size AS size, count(*) AS n, CAST(sum(length({_LINE})) AS BIGINT) AS chars FROM part GROUP BY 1")
def blocked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written as a folder of blocked files and read back in ranges."""
    folder = new_path(spark, "lines")
    bgzf.write(_part_lines(spark, sf_dir), folder)
    size = F.get(F.split("line", "\t"), F.lit(2)).cast("int")
    return bgzf.lines(spark, folder, SPLIT).groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("chars"))


@query(f"SELECT CAST(sum(length({_LINE}) + 1) AS BIGINT) AS bytes, CAST(sum(length({_LINE}) + 1) AS BIGINT) AS last_end, CAST(0 AS BIGINT) AS bad FROM part")
def block_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of a file: inflated sizes, running offsets, checksums."""
    blocks = bgzf.blocks(spark, _file(_part_lines(spark, sf_dir), "blocks"), SPLIT)
    return blocks.agg(F.sum("isize").alias("bytes"), F.max(F.col("uoffset") + F.col("isize")).alias("last_end"), F.count(F.when(F.crc32("data") != F.col("crc32"), 1)).alias("bad"))


@query(f"SELECT substr(string_agg({_LINE} || chr(10), '' ORDER BY p_partkey), 1002, 3000) AS bytes FROM part")
def file_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inflated bytes 1001 to 4000 of a file, found by its block index."""
    path = _file(_part_lines(spark, sf_dir), "section")
    bgzf.write_block_index(bgzf.blocks(spark, path), path + ".gzi")
    cut = bgzf.section(path, 1001, 4001, bgzf.load_block_index(spark, path + ".gzi"))
    return spark.createDataFrame([(bgzf.decompress(cut).decode(),)], "bytes string")


@query(f"WITH b AS (SELECT p_partkey, sum(length({_LINE}) + 1) OVER (ORDER BY p_partkey) AS e FROM part) SELECT CAST(max(e) AS BIGINT) AS bytes, CAST(1 + (max(e) - 1) // 1000 AS BIGINT) AS blocks FROM b")
def recompressed_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain file compressed with the borders of an index, here one every thousand bytes."""
    path = new_path(spark, "plain") + ".txt"
    with bgzf.open_output(path) as f:
        f.write(bgzf.read_bytes(_file(_part_lines(spark, sf_dir), "plain")))
    size = bgzf.open_file(path)[2]
    index = spark.range(0, size, 1000).select(F.col("id").alias("coffset"), F.col("id").alias("uoffset"))
    blocks = bgzf.blocks_by_index(spark, path, index)
    inflated = F.udf(lambda b: len(bgzf.inflate(bytes(b))), "long")
    return blocks.agg(F.sum(inflated("block")).alias("bytes"), F.count(F.lit(1)).alias("blocks"))


@query("WITH b AS (SELECT o_orderkey, o_custkey, coalesce(sum(o_custkey) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM (SELECT o_orderkey, max(o_custkey) AS o_custkey FROM orders GROUP BY 1) o) SELECT o_orderkey AS coffset, CAST(u AS BIGINT) AS uoffset FROM b WHERE u <= 123456 AND u + o_custkey > 123456")
def block_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block that holds an inflated position."""
    blocks = table(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("coffset")).agg(F.max("o_custkey").alias("isize"))
    return indexing.block_of(indexing.running_offsets(blocks), 123_456).select("coffset", "uoffset")


# --- text formats -------------------------------------------------------------------------------


@query(f'{REC} SELECT CAST(contig AS VARCHAR) AS contig, beg, "end", count(*) AS n FROM rec GROUP BY 1, 2, 3')
def bed_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as a blocked BED file, read as features."""
    lines = genome.records(spark, sf_dir).select(F.concat_ws("\t", *(F.col(c).cast("string") for c in ("contig", "beg", "end", "qname"))).alias("value"))
    return textfiles.read_bed(spark, _file(lines, "bed", "# header\n")).groupBy("contig", "beg", "end").agg(F.count(F.lit(1)).alias("n"))


@query('SELECT \'c\' || (p_partkey % 100) AS contig, p_partkey * 1000 AS beg, p_partkey * 1000 + p_size AS "end", p_type AS type, CAST(p_partkey AS VARCHAR) AS id FROM part')
def gff_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of a GFF file: closed intervals from one, attributes as a map."""
    k = F.col("p_partkey")
    fields = [F.concat(F.lit("c"), (k % 100).cast("string")), F.lit("src"), F.col("p_type"), (k * 1000 + 1).cast("string"), (k * 1000 + F.col("p_size")).cast("string"), F.lit("."), F.lit("+"), F.lit("."), F.concat(F.lit("ID="), k.cast("string"), F.lit(";Name=x"))]
    rows = textfiles.read_gff(spark, _file(table(spark, sf_dir, "part").select(F.concat_ws("\t", *fields)), "gff", "##gff-version 3\n"))
    return rows.select("contig", "beg", "end", "type", F.element_at("attributes", F.lit("ID")).alias("id"))


@query("SELECT p_size AS beg, count(*) AS n FROM part WHERE p_partkey >= 3 GROUP BY 1")
def skipped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features behind a file's first lines, which are skipped by their place and not by what they say."""
    k = F.col("p_partkey")
    lines = table(spark, sf_dir, "part").orderBy(k).select(F.concat_ws("\t", F.lit("c"), (F.col("p_size") + 1).cast("string"), (F.col("p_size") + 1).cast("string")))
    rows = textfiles.read_features(spark, _file(lines, "skip"), textfiles.Layout(1, 2, 3, skip=3))
    return rows.groupBy(F.col("beg").cast("int").alias("beg")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH r AS (SELECT p_partkey AS k, p_partkey % 7 AS kind, p_partkey * 10 AS a, p_partkey * 10 + p_size AS b FROM part)
SELECT k, 'c' || kind AS contig, CAST(CASE kind WHEN 2 THEN 0 WHEN 3 THEN a ELSE a + 1 - 1 END AS BIGINT) AS beg, CAST(CASE kind WHEN 0 THEN a + 1 WHEN 1 THEN b WHEN 2 THEN 34359738368 WHEN 3 THEN b WHEN 4 THEN a + 1 WHEN 5 THEN 34359738368 ELSE b END AS BIGINT) AS "end" FROM r WHERE NOT (kind IN (1, 3, 6) AND b <= a)"""
)
def region_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region lists of all kinds: tab (one base, and closed), a contig alone, bed, vcf, and strings (open and closed)."""
    k, kind = F.col("p_partkey"), F.col("p_partkey") % 7
    s = lambda c: c.cast("string")
    name, a, b, one = F.concat(F.lit("c"), s(kind)), s(k * 10), s(k * 10 + F.col("p_size")), s(k * 10 + 1)
    rows = table(spark, sf_dir, "part")
    out = None
    for n, (form, line) in enumerate([("tab", F.concat_ws("\t", name, one)), ("tab", F.concat_ws(" ", name, one, b)), ("reg", name), ("bed", F.concat_ws("\t", name, a, b)), ("vcf", F.concat_ws("\t", name, one)), ("reg", F.concat(name, F.lit(":"), one, F.lit("-"))), ("reg", F.concat(name, F.lit(":"), one, F.lit("-"), b))]):
        tail = F.lit("") if form == "vcf" or n in (0, 2) else F.concat(F.lit("\t"), s(k))
        lines = rows.where(kind == n).select(F.concat(F.lit("  ") if n == 1 else F.lit(""), line, tail).alias("line"))
        one_ = textfiles.regions_of(lines.union(spark.createDataFrame([("# comment",), ("",)], "line string")), form)
        out = one_ if out is None else out.union(one_)
    # lines without a payload are told by their place
    key = F.when(F.col("contig") == "c2", F.lit(None)).otherwise(F.floor(F.col("beg") / 10))
    told = out.withColumn("k", key.cast("long"))
    alone = rows.where(kind == 2).select(F.col("p_partkey").alias("k"), F.lit("c2").alias("contig"))
    whole = told.where("contig = 'c2'").select("contig", "beg", "end").distinct().join(alone, "contig").select("k", "contig", "beg", "end")
    return told.where("contig <> 'c2'").select("k", "contig", "beg", "end").union(whole)


# --- sequences and reads ------------------------------------------------------------------------


@query("SELECT p_partkey AS k, upper(replace(p_name, ' ', '')) AS seq, length(replace(p_name, ' ', '')) AS n, repeat('I', length(replace(p_name, ' ', ''))) AS qual FROM part")
def fastq_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads written as a blocked FASTQ file and read back in ranges."""
    seq = F.upper(F.replace("p_name", F.lit(" "), F.lit("")))
    text = F.rtrim(sequence.fastq_text(F.concat(F.lit("r"), F.col("p_partkey").cast("string"), F.lit(" of parts")), seq, F.repeat(F.lit("I"), F.length(seq))), F.lit("\n"))
    reads = textfiles.read_fastq(spark, _file(table(spark, sf_dir, "part").select(text), "fastq"), SPLIT)
    return reads.select(F.substr("name", F.lit(2)).cast("long").alias("k"), "seq", F.length("seq").cast("long").alias("n"), "qual")


@query("SELECT doc_id AS k, regexp_replace(text, '[^A-Za-z]', '', 'g') AS seq, CAST(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS BIGINT) AS length FROM documents")
def fasta_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of sixty letters a line written as a blocked FASTA file and read back in ranges. The comment
    begins with a sign that tells a null text from an empty one."""
    letters = F.coalesce(F.regexp_replace("text", "[^A-Za-z]", ""), F.lit(""))
    name, lang = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.regexp_replace("lang", r"\s", " "), F.lit(""))
    text = F.concat(F.lit(">s"), name, F.when(F.col("text").isNull(), " - ").otherwise(" + "), lang, F.lit("\n"), F.regexp_replace(letters, "(.{60})(?=.)", "$1\n"))
    rows = textfiles.read_fasta(spark, _file(table(spark, sf_dir, "documents").select(text), "fasta"), SPLIT)
    there = F.col("comment").startswith("+")
    return rows.select(F.substr("name", F.lit(2)).try_cast("long").alias("k"), F.when(there, F.col("seq")).alias("seq"), F.when(there, F.col("length")).alias("length"))


# --- alignments ---------------------------------------------------------------------------------

_CIGARS = ("10M", "3S7M", "4M2I4M", "5M3D5M")


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    pick = F.get(F.array(*[F.lit(c) for c in _CIGARS]), (k % 4).cast("int"))
    entry = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value"))
    tags = F.map_from_arrays(F.array(F.lit("NM"), F.lit("RG")), F.array(entry("i", F.col("l_linenumber")), entry("Z", F.col("l_returnflag"))))
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("q"), k.cast("string")).alias("qname"), F.when(F.col("l_linenumber") % 2 == 0, 147).otherwise(99).alias("flag"), F.concat(F.lit("c"), (F.col("l_suppkey") % 5).cast("string")).alias("rname"), (F.col("l_partkey") * 3).alias("pos"), (k % 60).cast("int").alias("mapq"),
        pick.alias("cigar_text"), F.concat(F.lit("c"), (F.col("l_suppkey") % 5).cast("string")).alias("rnext"), (F.col("l_partkey") * 3 + 50).alias("mate_pos"), F.lit(60).cast("long").alias("tlen"), F.lit("ACGTACGTAC").alias("seq"), F.lit("IIIIIHHHHH").alias("qual"), tags.alias("tags"),
    )


_CONTIGS = [(f"c{k}", 10_000_000) for k in range(5)]
_SAM_HEADER = "@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in _CONTIGS)
_READS_SQL = """SELECT 'c' || l_suppkey % 5 AS rname, l_returnflag AS rg, CASE l_orderkey % 4 WHEN 0 THEN '10M' WHEN 1 THEN '3S7M' WHEN 2 THEN '4M2I4M' ELSE '5M3D5M' END AS cigar, count(*) AS n, CAST(sum(l_partkey * 3) AS BIGINT) AS pos,
CAST(sum(l_orderkey % 60) AS BIGINT) AS mapq, CAST(sum(CASE WHEN l_linenumber % 2 = 0 THEN 147 ELSE 99 END) AS BIGINT) AS flags, CAST(sum(l_linenumber) AS BIGINT) AS nm, CAST(sum(l_partkey * 3 + 50) AS BIGINT) AS mates, count(DISTINCT l_orderkey) AS names FROM lineitem GROUP BY 1, 2, 3"""


def _told(reads: DataFrame) -> DataFrame:
    return reads.groupBy("rname", sequence.tag_value(F.col("tags"), "RG").alias("rg"), F.col("cigar_text").alias("cigar")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos"), F.sum("mapq").alias("mapq"), F.sum("flag").alias("flags"), F.sum(sequence.tag_value(F.col("tags"), "NM", "long")).alias("nm"), F.sum("mate_pos").alias("mates"), F.countDistinct("qname").alias("names")
    )


@query(_READS_SQL)
def sam_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments written as a blocked text file and read back."""
    return _told(alignments.read_sam(spark, _file(alignments.sam_text(_reads(spark, sf_dir)), "sam", _SAM_HEADER)))


@query(_READS_SQL)
def bam_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments written as a binary file and read back in ranges."""
    folder = new_path(spark, "bam")
    alignments.write_bam(_reads(spark, sf_dir), folder, _SAM_HEADER, _CONTIGS)
    bgzf.join_parts(folder, folder + ".bam")
    return _told(alignments.read_bam(spark, folder + ".bam", 1 << 18))


@query(_READS_SQL)
def cram_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments written as a file of containers and read back in ranges."""
    folder = new_path(spark, "cram")
    cram.write_cram(_reads(spark, sf_dir), folder, _SAM_HEADER)
    bgzf.join_parts(folder, folder + ".cram")
    return _told(cram.read_cram(spark, folder + ".cram", split=1 << 18))


@query(
    """SELECT rg, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos FROM (SELECT l_returnflag AS rg, l_suppkey % 5 AS c, l_partkey * 3 AS pos, CASE l_orderkey % 4 WHEN 0 THEN 10 WHEN 1 THEN 7 WHEN 2 THEN 8 ELSE 13 END AS rlen FROM lineitem) x
WHERE c = 2 AND pos < 900 AND pos + rlen > 300 GROUP BY 1"""
)
def cram_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments of one region, from the containers that an index names."""
    folder = new_path(spark, "cram")
    tasks = max(8, pieces(table(spark, sf_dir, "lineitem")) or 0)
    cram.write_cram(_reads(spark, sf_dir).repartitionByRange(tasks, "rname", "pos").sortWithinPartitions("rname", "pos"), folder, _SAM_HEADER)
    bgzf.join_parts(folder, folder + ".cram")
    index = cram.container_index(cram.read_cram(spark, folder + ".cram", split=1 << 18, columns=["flag", "refid", "pos", "cigar_text", "coffset"]))
    found = cram.query_cram(spark, folder + ".cram", index, 2, 300, 900)
    return found.groupBy(sequence.tag_value(F.col("tags"), "RG").alias("rg")).agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos"))


@query(
    """SELECT l_returnflag AS rg, count(*) AS n FROM (SELECT *, CASE l_orderkey % 4 WHEN 0 THEN 10 WHEN 1 THEN 7 WHEN 2 THEN 8 ELSE 13 END AS rlen FROM lineitem) x
WHERE l_linenumber % 2 = 1 AND rlen <= 10 AND l_orderkey % 60 > 20 AND (l_linenumber >= 3 OR l_returnflag = 'R') AND 'c' || l_suppkey % 5 = 'c1' AND l_partkey * 3 + rlen < 3000 AND l_partkey * 3 + 1 > 30 AND l_orderkey % 4 <> 3 GROUP BY 1"""
)
def filter_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments that pass an expression over flags, positions, lengths, tags and names."""
    rows = _reads(spark, sf_dir).withColumns({"cigar": sequence.parse_cigar(F.col("cigar_text")), "library": F.lit("lib")})
    said = 'flag.read1 && !flag.read2 && rlen <= 10 && qlen == 10 && mapq > 20 && ([NM] >= 3 || [RG] == "R") && rname == "c1" && endpos < 3000 && pos > 30 && cigar !~ "D" && library == "lib" && length(seq) == 10'
    found = filterlang.passing(rows, said, filterlang.alignment_symbols(rows))
    return found.groupBy(sequence.tag_value(F.col("tags"), "RG").alias("rg")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(k AS INTEGER) AS refid, 'c' || k AS contig, CAST(10000000 AS BIGINT) AS length FROM range(5) t(k)")
def sam_header_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's contig dictionary from its header, of which no more is read than there is."""
    path = _file(alignments.sam_text(_reads(spark, sf_dir)), "sam", _SAM_HEADER)
    return headers.contigs_of(headers.parse_header(spark, alignments.sam_header(spark, path)))


# --- variants -----------------------------------------------------------------------------------

_VCF_HEADER = (
    "##fileformat=VCFv4.2\n" + "".join(f"##contig=<ID=c{k},length=1000000>\n" for k in range(50)) + '##FILTER=<ID=q10,Description="Low">\n##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">\n##INFO=<ID=AF,Number=1,Type=Float,Description="Share">\n##INFO=<ID=DB,Number=0,Type=Flag,Description="Known">\n'
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">\n##FORMAT=<ID=AD,Number=R,Type=Integer,Description="Depths">\n' + headers.sample_line(["s1", "s2"]) + "\n"
)


def _called(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = F.col("rec")
    text = lambda c: c.cast("string")
    info = F.map_concat(F.create_map(F.lit("DP"), text(rec % 300), F.lit("AF"), F.when(rec % 2 == 0, "0.5").otherwise("0.25")), F.when(rec % 3 == 0, F.create_map(F.lit("DB"), F.lit(None).cast("string"))).otherwise(F.create_map().cast("map<string,string>")))
    sample = lambda name, gt: F.struct(F.lit(name).alias("sample"), F.map_from_arrays(F.array(F.lit("GT"), F.lit("AD")), F.array(gt, F.concat(text(rec % 200), F.lit(","), F.when(rec % 5 == 0, ".").otherwise(text(rec % 7))))).alias("fields"))
    samples = F.array(sample("s1", F.when(rec % 4 == 0, "0|1").otherwise("./.")), sample("s2", F.when(rec % 4 == 1, "1/1").otherwise("0")))
    v = genome.variants(spark, sf_dir)
    return v.select(
        F.concat(F.lit("c"), text(F.col("contig"))).alias("contig"), F.col("pos").alias("pos"), F.concat(F.lit("rs"), text(rec)).alias("id"), "ref", F.array("alt").alias("alts"),
        F.when(rec % 6 != 0, (rec % 90).cast("double")).alias("qual"), F.when(rec % 2 == 0, F.array(F.lit("PASS"))).otherwise(F.array(F.lit("q10"))).alias("filters"), info.alias("info"), samples.alias("samples"),
    )


_CALLED_SQL = f"""{VAR} SELECT 'c' || contig AS contig, ref, alt, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos, CAST(sum(rec % 300) AS BIGINT) AS dp, count(*) FILTER (WHERE rec % 3 = 0) AS db, CAST(sum(CASE WHEN rec % 6 <> 0 THEN rec % 90 END) AS DOUBLE) AS qual,
count(*) FILTER (WHERE rec % 2 = 1) AS low, count(*) FILTER (WHERE rec % 4 = 0) AS phased, CAST(sum(rec % 200) * 2 AS BIGINT) AS ad0, CAST(2 * sum(CASE WHEN rec % 5 <> 0 THEN rec % 7 END) AS BIGINT) AS ad1, CAST(sum(rec) AS BIGINT) AS ids FROM v GROUP BY 1, 2, 3"""


def _calls_told(rows: DataFrame) -> DataFrame:
    depths = variants.format_values(F.col("samples"), "AD", "long")
    at = lambda k: F.sum(F.aggregate(depths, F.lit(None).cast("long"), lambda a, d: F.when(F.get(d, F.lit(k)).isNull(), a).otherwise(F.coalesce(a, F.lit(0)) + F.get(d, F.lit(k)))))
    return rows.groupBy("contig", "ref", F.get("alts", F.lit(0)).alias("alt")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos"), F.sum(F.element_at("info", F.lit("DP")).cast("long")).alias("dp"), F.count(F.when(F.map_contains_key("info", "DB"), 1)).alias("db"), F.sum("qual").alias("qual"),
        F.count(F.when(variants.has_filter(F.col("filters"), ["q10"]), 1)).alias("low"), F.count(F.when(F.get("samples", F.lit(0))["gt"]["phased"], 1)).alias("phased"), at(0).alias("ad0"), at(1).alias("ad1"), F.sum(F.substr("id", F.lit(3)).cast("long")).alias("ids"),
    )


@query(_CALLED_SQL)
def vcf_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants with samples written as a blocked text file and read back."""
    return _calls_told(textfiles.read_vcf(spark, _file(textfiles.vcf_text(_called(spark, sf_dir)), "vcf", _VCF_HEADER)))


@query(_CALLED_SQL)
def bcf_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants with samples written as a binary file and read back."""
    folder = new_path(spark, "bcf")
    bcf.write_bcf(_called(spark, sf_dir), folder, _VCF_HEADER)
    bgzf.join_parts(folder, folder + ".bcf")
    return _calls_told(bcf.read_bcf(spark, folder + ".bcf"))


@query(
    f"""{VAR}, p AS (SELECT rec, pos, ref, alt, (SELECT max(i) FROM range(0, 12) t(i) WHERE i <= least(length(ref), length(alt)) AND left(ref, i) = left(alt, i)) AS pre FROM v),
q AS (SELECT *, pos + CASE WHEN alt LIKE '<%' THEN 0 ELSE pre END AS t FROM p)
SELECT rec, CAST(pos AS BIGINT) AS beg0, CAST(pos + 1 AS BIGINT) AS end0, CAST(pos + length(ref) AS BIGINT) AS end1, CAST(t AS BIGINT) AS beg2, CAST(greatest(pos + length(ref), t + 1) AS BIGINT) AS end2 FROM q"""
)
def overlap_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intervals by which variants meet regions, in all three modes."""
    v = genome.variants(spark, sf_dir).withColumn("alts", F.array("alt"))
    m = [intervals.overlap_interval(k, F.col("pos").cast("long"), F.col("ref"), F.col("alts")) for k in range(3)]
    return v.select("rec", m[0][0].alias("beg0"), m[0][1].alias("end0"), m[1][1].alias("end1"), m[2][0].alias("beg2"), m[2][1].alias("end2"))


@query(
    f"""{VAR} SELECT ref, alt, count(*) AS n, (length(ref) <> length(alt) AND alt NOT LIKE '<%' AND alt <> '*' AND alt NOT LIKE '%[%' AND (left(ref, 1) = left(alt, 1) OR right(ref, 1) = right(alt, 1)) AND (starts_with(ref, alt) OR starts_with(alt, ref) OR (length(ref) = 1 AND right(alt, 1) = ref) OR (length(alt) = 1 AND right(ref, 1) = alt))) AS as_indel,
NOT (length(ref) <> length(alt) AND alt NOT LIKE '<%' AND alt <> '*' AND alt NOT LIKE '%[%' AND (starts_with(ref, alt) OR starts_with(alt, ref) OR (length(ref) = 1 AND right(alt, 1) = ref) OR (length(alt) = 1 AND right(ref, 1) = alt))) AS as_snp FROM v WHERE length(ref) = 1 OR length(alt) = 1 GROUP BY 1, 2"""
)
def target_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which variants may stand for a target's alleles: an indel's and a single base's."""
    v = genome.variants(spark, sf_dir).where("length(ref) = 1 OR length(alt) = 1")
    match = lambda *alleles: variants.matches_target_alleles(F.array(*[F.lit(a) for a in alleles]), F.col("ref"), F.array("alt"))
    return v.select("ref", "alt", match("A", "AT").alias("as_indel"), match("A", "T").alias("as_snp")).groupBy("ref", "alt", "as_indel", "as_snp").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS k, 'GT:AD:DP' || chr(9) || '0/1:' || o_custkey || ',.:' || CASE WHEN o_custkey % 2 = 0 THEN o_custkey || ',1' ELSE '.' END || chr(9) || './.:.:7' AS with_dp, 'GT' || chr(9) || '0/1' || chr(9) || './.' AS without_ad, o_custkey AS first_ad FROM orders")
def format_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FORMAT fields read, set and removed."""
    k = F.col("o_custkey")
    sample = lambda name, keys, values: F.struct(F.lit(name).alias("sample"), F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*values)).alias("fields"))
    samples = F.array(sample("a", ["GT", "AD"], [F.lit("0/1"), F.concat(k.cast("string"), F.lit(",."))]), sample("b", ["GT", "AD"], [F.lit("./."), F.lit(".")]))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", samples.alias("samples"))
    values = F.array(F.when(k % 2 == 0, F.array(k.cast("string"), F.lit("1"))), F.array(F.lit("7")))
    none = F.lit(None).cast("array<array<string>>")
    first = F.get(F.get(variants.format_values(F.col("samples"), "AD", "long"), F.lit(0)), F.lit(0))
    return rows.select(F.col("o_orderkey").alias("k"), variants.sample_text(variants.set_format(F.col("samples"), "DP", values)).alias("with_dp"), variants.sample_text(variants.set_format(F.col("samples"), "AD", none)).alias("without_ad"), first.alias("first_ad"))


@query("SELECT o_orderkey AS k, 'DP=' || (o_custkey + 1) || ';DB;AF=0.5' AS changed, 'DB' AS removed, 'DP=' || o_custkey || ';DB;SOMATIC' AS flagged, CASE WHEN o_custkey % 2 = 0 THEN 'rs1' ELSE 'x;rs1' END AS id, 'G' AS ref, 'A,T' AS alts FROM orders")
def info_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INFO fields set, added and removed; ID and alleles changed."""
    k = F.col("o_custkey")
    info = variants.parse_info(F.concat(F.lit("DP="), k.cast("string"), F.lit(";DB")))
    rows = table(spark, sf_dir, "orders").withColumn("info", info)
    i = F.col("info")
    changed = variants.set_info(variants.set_info(i, "DP", k + 1), "AF", F.lit("0.5"))
    ref, alts = variants.set_alleles(F.array(F.lit("G"), F.lit("A"), F.lit("T")))
    old = F.when(k % 4 == 0, F.lit(".")).when(k % 2 == 0, F.lit("rs1")).otherwise(F.lit("x"))
    return rows.select(F.col("o_orderkey").alias("k"), variants.info_text(changed).alias("changed"), variants.info_text(variants.remove_info(i, "DP")).alias("removed"), variants.info_text(variants.set_info(i, "SOMATIC", None)).alias("flagged"), variants.add_id(old, "rs1").alias("id"), ref.alias("ref"), F.array_join(alts, ",").alias("alts"))


# --- headers, tags, read groups -----------------------------------------------------------------


@query("SELECT CAST(unnest(range(5)) AS BIGINT) AS n, unnest(['##fileformat=VCFv4.3', '##FILTER=<ID=q20,Description=\"Lower\">', '##INFO=<ID=DP,Number=1,Type=Integer,Description=\"Depth\">', '##contig=<ID=' || (SELECT r_name FROM region WHERE r_regionkey = 1) || '>', '#CHROM' || chr(9) || 'POS' || chr(9) || 'ID' || chr(9) || 'REF' || chr(9) || 'ALT' || chr(9) || 'QUAL' || chr(9) || 'FILTER' || chr(9) || 'INFO' || chr(9) || 'FORMAT' || chr(9) || 's1' || chr(9) || 's2']) AS line")
def variant_header_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A variant header under another version, with definitions added and removed and one more sample."""
    name = table(spark, sf_dir, "region").where("r_regionkey = 1").first()["r_name"]
    text = '##fileformat=VCFv4.2\n##FILTER=<ID=q10,Description="Low">\n##FILTER=<ID=q20,Description="Lower">\n##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">\n' + headers.sample_line(["s1"]) + "\n"
    d = headers.set_version(headers.parse_variant_header(spark, text), "VCFv4.3")
    d = headers.append_definition(headers.remove_definitions(d, "FILTER", "q10"), f"##contig=<ID={name}>")
    d = headers.append_definition(d, '##INFO=<ID=DP,Number=1,Type=Integer,Description="Again">')
    d = headers.add_sample(d, "s2")
    return spark.createDataFrame(list(enumerate(headers.variant_header_text(d).splitlines())), "n long, line string")


@query("SELECT DISTINCT kind, id FROM (SELECT 'contig' AS kind, n_name AS id FROM nation WHERE n_regionkey < 3 UNION ALL SELECT 'contig', n_name FROM nation WHERE n_regionkey > 1) x")
def header_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of two headers, each once."""
    n = table(spark, sf_dir, "nation")
    null = F.lit(None).cast("string")
    side = lambda rows: rows.select(F.col("n_nationkey").alias("pos"), F.lit("contig").alias("kind"), F.col("n_name").alias("id"), null.alias("number"), null.alias("type"), null.alias("description"), F.concat(F.lit("##contig=<ID="), F.col("n_name"), F.lit(">")).alias("line"))
    return headers.merge_headers(side(n.where("n_regionkey < 3")), side(n.where("n_regionkey > 1"))).select("kind", "id")


@query("SELECT c_custkey AS k, CASE WHEN c_nationkey % 2 = 0 THEN 'lib' || c_nationkey ELSE '' END AS library FROM customer")
def read_group_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library of each record's read group."""
    text = "".join(f"@RG\tID:g{k}" + (f"\tLB:lib{k}" if k % 2 == 0 else "") + "\n" for k in range(25))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("g"), F.col("c_nationkey").cast("string")).alias("rg"))
    return headers.libraries(rows, headers.parse_header(spark, text)).select("k", "library")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE CAST(s_suppkey AS VARCHAR) END AS sm, CASE WHEN s_suppkey % 3 = 0 THEN 'L' WHEN s_suppkey % 2 = 0 THEN s_name ELSE CAST(s_suppkey AS VARCHAR) END AS lb, 'UNKNOWN' AS pl FROM supplier")
def read_group_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read groups with their missing fields filled."""
    k = F.col("s_suppkey")
    null = F.lit(None).cast("string")
    groups = table(spark, sf_dir, "supplier").select(k.cast("string").alias("id"), F.when(k % 2 == 0, F.col("s_name")).alias("sm"), F.when(k % 3 == 0, "L").alias("lb"), null.alias("pl"), null.alias("pu"))
    return pairing.read_group_fields(groups).select("id", "sm", "lb", "pl")


@query("SELECT o_orderkey AS k, CAST(o_custkey AS BIGINT) AS nm, 'x:y' AS rg, CAST(NULL AS VARCHAR) AS none, CAST(o_custkey AS DOUBLE) + 1.5 AS arr, CAST(o_custkey * 2 AS BIGINT) AS set_nm, 2 AS left_ FROM orders")
def aux_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional fields parsed, read, set and removed; the first of equal tags counts."""
    n = F.col("o_custkey").cast("string")
    fields = F.array(F.concat(F.lit("NM:i:"), n), F.lit("RG:Z:x:y"), F.concat(F.lit("BX:B:f,"), n, F.lit(",1.5")), F.lit("NM:i:9"), F.lit("bad"))
    rows = table(spark, sf_dir, "orders").withColumn("tags", sequence.parse_tags(fields))
    t = F.col("tags")
    total = F.aggregate(sequence.tag_array(t, "BX"), F.lit(0.0), lambda a, x: a + x)
    return rows.select(F.col("o_orderkey").alias("k"), sequence.tag_value(t, "NM", "long").alias("nm"), sequence.tag_value(t, "RG").alias("rg"), sequence.tag_value(t, "XX").alias("none"), total.alias("arr"), sequence.tag_value(sequence.with_tag(t, "NM", "i", F.col("o_custkey") * 2), "NM", "long").alias("set_nm"), F.size(sequence.without_tag(t, "RG")).alias("left_"))


@query("SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_type END AS qual, substr(p_name, 4, p_size % 3) AS inserted FROM part")
def original_qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Qualities restored from a tag where there is one, and inserted bases."""
    tags = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("OQ"), F.upper("p_name"))).otherwise(F.create_map(F.lit("XX"), F.lit("x")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), sequence.restored_quality(tags, F.col("p_type")).alias("qual"), sequence.insertion_text(F.col("p_name"), F.lit(2), F.col("p_size") % 3).alias("inserted"))


# --- positions ----------------------------------------------------------------------------------


@query(f'{REC} SELECT beg, "end", qname, line FROM rec WHERE contig = 5 AND "end" > 1500000')
def seek_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a contig from a position on."""
    return intervals.seek(genome.records(spark, sf_dir), 5, 1_500_000).select("beg", "end", "qname", "line")


@query(f"{FILED} SELECT contig, max(next_voff) AS off_end FROM f GROUP BY 1")
def max_mapped_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each contig's records end in the file."""
    return indexing.index_stats(genome.filed(spark, sf_dir), F.lit(False)).select("contig", "off_end")


@query("SELECT CAST(user_id AS BIGINT) AS contig, CAST(CASE WHEN max(hi) OVER (ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > lo THEN 2 ELSE 1 END AS INTEGER) AS runs FROM (SELECT user_id, min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY 1) x")
def contig_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether contigs' records lie together in the file."""
    return indexing.contig_runs(table(spark, sf_dir, "events").select(F.col("user_id").alias("contig"), F.col("event_id").alias("voff")), "voff")


@query("SELECT p_partkey AS k, (p_partkey + p_size > 1000 AND 1200 > p_partkey) AS meets FROM part")
def byte_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which byte ranges share a byte with one range."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), overlaps(F.col("p_partkey"), F.col("p_partkey") + F.col("p_size"), F.lit(1000), F.lit(1200)).alias("meets"))


@query(f'{REC} SELECT CAST(contig AS VARCHAR) AS contig, beg, "end", count(*) AS n FROM rec WHERE contig = 5 AND beg < 700000 AND "end" > 500000 GROUP BY 1, 2, 3')
def indexed_file_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region of a sorted, blocked and indexed file: only the blocks that the index names are read."""
    rows = genome.records(spark, sf_dir).orderBy("contig", "beg", "end")
    path = _file(rows.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in ("contig", "beg", "end", "qname")))), "indexed")
    filed = textfiles.filed_features(textfiles.read_features(spark, path, "bed", blocked_offsets=True))
    found = textfiles.query_file(spark, path, "bed", indexing.bin_chunks(filed), indexing.linear_index(filed), "5", 500_000, 700_000)
    return found.groupBy("contig", "beg", "end").agg(F.count(F.lit(1)).alias("n"))


@query(f'{REC} SELECT CAST(contig AS VARCHAR) AS contig, count(*) AS n_mapped, CAST((max("end") - 1) >> 14 AS BIGINT) + 1 AS n_windows FROM rec GROUP BY 1')
def index_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coordinate index written as a file and read back: records and windows of each contig."""
    rows = genome.records(spark, sf_dir).orderBy("contig", "beg", "end")
    path = _file(rows.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in ("contig", "beg", "end", "qname")))), "indexed")
    filed = textfiles.filed_features(textfiles.read_features(spark, path, "bed", blocked_offsets=True)).drop("line")
    filed = materialise(filed, "filed")
    ids = indexing.first_seen(filed)
    names = [r["contig"] for r in ids.orderBy("refid").collect()]  # contigs
    numbered = lambda df: df.join(ids, "contig")
    textfiles.write_index(path + ".tbi", names, numbered(indexing.bin_chunks(filed)), numbered(indexing.window_offsets(filed)), numbered(indexing.index_stats(filed, F.lit(False))), textfiles.LAYOUTS["bed"])
    index = textfiles.load_index(spark, path + ".tbi")
    windows = index["linear"].groupBy("refid").agg(F.count(F.lit(1)).alias("n_windows"))
    return index["stats"].join(windows, "refid").join(index["contigs"], "refid").select("contig", "n_mapped", "n_windows")
