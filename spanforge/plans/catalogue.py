"""Queries over the operators, and the DuckDB SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import filterlang, regions, sequence, stats, variants
from spanforge.functions.bins import STANDARD, Scheme, split_offset, virtual_offset
from spanforge.operators import checksum, headers, indexing, intervals, merging, pairing, pileup, quality
from spanforge.plans import genome
from spanforge.plans.genome import FILED_SQL, RECORDS_SQL, REGIONS_SQL, VARIANTS_SQL
from spanforge.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


REC = f"WITH rec AS ({RECORDS_SQL}), reg AS ({REGIONS_SQL})"
FILED = f"WITH f AS ({FILED_SQL})"
VAR = f"WITH v AS ({VARIANTS_SQL})"


def _bin_sql(beg: str, end: str) -> str:
    last = f"greatest({end} - 1, {beg})"
    cases = " ".join(f"WHEN ({beg} >> {s}) = ({last} >> {s}) THEN ({beg} >> {s}) + {o}" for s, o in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)))
    return f"CASE {cases} ELSE 0 END"


# --- bins ---------------------------------------------------------------------------------------


@query(f"{REC} SELECT CAST({_bin_sql('beg', '"end"')} AS INTEGER) AS bin, count(*) AS n FROM rec GROUP BY 1")
def reg2bin_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records each bin holds."""
    return genome.records(spark, sf_dir).select(STANDARD.reg2bin(F.col("beg"), F.col("end")).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"{REC}, x AS ("
    + " UNION ALL ".join(f'SELECT unnest(range((beg >> {s}) + {o}, (("end" - 1) >> {s}) + {o} + 1)) AS bin FROM reg' for s, o in ((29, 0), (26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)))
    + ") SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n FROM x GROUP BY 1"
)
def reg2bins_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many regions overlap each bin."""
    r = genome.regions(spark, sf_dir)
    return r.select(F.explode(STANDARD.reg2bins(F.col("beg"), F.col("end"))).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


_LEVEL = "CASE WHEN b >= 4681 THEN 5 WHEN b >= 585 THEN 4 WHEN b >= 73 THEN 3 WHEN b >= 9 THEN 2 WHEN b >= 1 THEN 1 ELSE 0 END"


@query(
    f"""{REC}, x AS (SELECT DISTINCT {_bin_sql('beg', '"end"')} AS b FROM reg), y AS (SELECT b, {_LEVEL} AS k FROM x),
z AS (SELECT b, k, (CAST(power(8, k) AS BIGINT) - 1) // 7 AS o, 29 - 3 * k AS s FROM y)
SELECT CAST(b AS INTEGER) AS bin, CAST(k AS INTEGER) AS level, CAST(CASE WHEN b > 0 THEN (b - 1) >> 3 ELSE -1 END AS INTEGER) AS parent, CAST((b - o) << s AS BIGINT) AS beg,
  CAST((b - o + 1) << s AS BIGINT) AS bin_end, CAST(CASE WHEN k < 5 THEN 8 ELSE 0 END AS INTEGER) AS n_children, CAST(k AS INTEGER) AS n_parents, CAST(1 << (s - 14) AS INTEGER) AS n_windows FROM z"""
)
def bin_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bin in use with its place in the tree."""
    b = F.col("bin")
    rows = genome.regions(spark, sf_dir).select(STANDARD.reg2bin(F.col("beg"), F.col("end")).alias("bin")).distinct()
    return rows.select(
        "bin", STANDARD.level(b).alias("level"), F.coalesce(STANDARD.parent(b), F.lit(-1)).alias("parent"), STANDARD.bin2beg(b).alias("beg"), STANDARD.bin2end(b).alias("bin_end"),
        F.size(STANDARD.children(b)).alias("n_children"), F.size(STANDARD.parents(b)).alias("n_parents"), F.size(STANDARD.bin2lins(b)).alias("n_windows"),
    )


@query(
    f"""{REC} SELECT region_id, CAST((beg >> 14) AS INTEGER) AS win, CAST((beg >> 14) + 4681 AS INTEGER) AS leaf,
CAST((("end" - 1) >> 14) - (beg >> 14) + 1 AS INTEGER) AS n_windows, CAST(6 AS INTEGER) AS n_levels, CAST((beg << 16) | (region_id % 65536) AS BIGINT) AS voff, beg AS coffset, CAST(region_id % 65536 AS INTEGER) AS uoffset FROM reg"""
)
def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows, leaves and virtual offsets of regions' begins."""
    beg = F.col("beg")
    voff = virtual_offset(beg, F.col("region_id") % 65536)
    c, u = split_offset(voff)
    return genome.regions(spark, sf_dir).select(
        "region_id", STANDARD.pos2lin(beg).alias("win"), STANDARD.pos2bin(beg).alias("leaf"), F.size(STANDARD.reg2lins(beg, F.col("end"))).alias("n_windows"),
        F.size(STANDARD.pos2bins(beg)).alias("n_levels"), voff.alias("voff"), c.alias("coffset"), u.alias("uoffset"),
    )


@query(
    f"""{REC} SELECT CAST(CASE {" ".join(f'WHEN (beg >> {s}) = (("end" - 1) >> {s}) THEN (beg >> {s}) + {o}' for s, o in ((12, 37449), (15, 4681), (18, 585), (21, 73), (24, 9), (27, 1)))} ELSE 0 END AS INTEGER) AS bin, count(*) AS n FROM rec GROUP BY 1"""
)
def reg2bin_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As reg2bin_assign, in a scheme of six levels over leaves of 4096."""
    return genome.records(spark, sf_dir).select(Scheme(12, 6).reg2bin(F.col("beg"), F.col("end")).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


# --- interval joins and sets --------------------------------------------------------------------

_MEETS = 'rec.contig = reg.contig AND rec."end" > reg.beg AND reg."end" > rec.beg'


@query(f'{REC} SELECT region_id, count(*) AS n, CAST(sum(rec.beg) AS BIGINT) AS sum_beg FROM rec JOIN reg ON {_MEETS} GROUP BY 1')
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping records of each region, counted."""
    pairs = intervals.interval_join(genome.records(spark, sf_dir).select("contig", "beg", "end"), genome.regions(spark, sf_dir))
    return pairs.groupBy("region_id").agg(F.count(F.lit(1)).alias("n"), F.sum("beg").alias("sum_beg"))


@query(f'{REC} SELECT contig, count(*) AS n, CAST(sum(beg) AS BIGINT) AS sum_beg FROM rec WHERE EXISTS (SELECT 1 FROM reg WHERE {_MEETS}) GROUP BY 1')
def interval_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records inside any region, per contig; each counts once."""
    kept = intervals.interval_semi(genome.records(spark, sf_dir).select("contig", "beg", "end"), genome.regions(spark, sf_dir))
    return kept.groupBy("contig").agg(F.count(F.lit(1)).alias("n"), F.sum("beg").alias("sum_beg"))


@query(f'{REC} SELECT contig, count(*) AS n, CAST(sum(beg) AS BIGINT) AS sum_beg FROM rec WHERE NOT EXISTS (SELECT 1 FROM reg WHERE {_MEETS}) GROUP BY 1')
def interval_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records outside all regions, per contig."""
    kept = intervals.interval_anti(genome.records(spark, sf_dir).select("contig", "beg", "end"), genome.regions(spark, sf_dir))
    return kept.groupBy("contig").agg(F.count(F.lit(1)).alias("n"), F.sum("beg").alias("sum_beg"))


@query(f'{REC} SELECT region_id, contig, beg, "end" FROM reg WHERE NOT EXISTS (SELECT 1 FROM rec WHERE {_MEETS})')
def missed_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions without a record."""
    return intervals.missed_regions(genome.regions(spark, sf_dir), genome.records(spark, sf_dir)).select("region_id", "contig", "beg", "end")


_MERGED = """m AS (SELECT contig, beg, "end", max("end") OVER (PARTITION BY contig ORDER BY beg, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM rec),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR beg > p THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY beg, "end" ROWS UNBOUNDED PRECEDING) AS g FROM m),
u AS (SELECT contig, min(beg) AS beg, max("end") AS "end", count(*) AS n FROM g GROUP BY contig, g)"""


@query(f'{REC}, {_MERGED} SELECT contig, beg, "end", n FROM u')
def regions_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of records' intervals."""
    return intervals.merge_regions(genome.records(spark, sf_dir)).select("contig", "beg", "end", "n")


@query(f'{REC}, {_MERGED} SELECT contig, beg, "end", n FROM u')
def regions_merge_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of records' intervals, over short stretches."""
    return intervals.merge_regions(genome.records(spark, sf_dir), bits=17).select("contig", "beg", "end", F.col("n").cast("long").alias("n"))


@query(
    f"""{REC}, {_MERGED}, c AS (SELECT DISTINCT s_suppkey AS contig, CAST(30000000 AS BIGINT) AS length FROM supplier),
e AS (SELECT contig, beg, "end" FROM u UNION ALL SELECT contig, 0, 0 FROM c UNION ALL SELECT contig, length, length FROM c),
x AS (SELECT contig, lag("end") OVER (PARTITION BY contig ORDER BY beg, "end") AS a, beg AS b FROM e) SELECT contig, CAST(a AS BIGINT) AS beg, CAST(b AS BIGINT) AS "end" FROM x WHERE b > a"""
)
def regions_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the records leave of their contigs."""
    contigs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("contig"), F.lit(30_000_000).cast("long").alias("length")).distinct()
    return intervals.complement(genome.records(spark, sf_dir), contigs)


@query(f'{REC} SELECT contig, beg, "end", qname, line FROM rec WHERE contig = 5 AND beg < 700000 AND "end" > 500000')
def region_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one region."""
    return intervals.region_query(genome.records(spark, sf_dir), 5, 500_000, 700_000).select("contig", "beg", "end", "qname", "line")


@query(f'{REC} SELECT region_id, rec.contig, rec.beg, rec."end", qname FROM rec JOIN reg ON {_MEETS}')
def separate_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by region, once for each."""
    return intervals.interval_join(genome.records(spark, sf_dir), genome.regions(spark, sf_dir)).select("region_id", "contig", "beg", "end", "qname")


@query(
    f"""{REC}, t AS (SELECT DISTINCT contig, 'c' || contig || ':' || (beg + 1) || CASE contig % 3 WHEN 0 THEN '' WHEN 1 THEN '-' ELSE '-' || "end" END AS s FROM reg)
SELECT s, regexp_extract(s, '^(.*):', 1) AS name, CAST(regexp_extract(s, ':(\\d+)', 1) AS BIGINT) - 1 AS beg,
  CASE WHEN NOT contains(s, '-') THEN CAST(regexp_extract(s, ':(\\d+)', 1) AS BIGINT) WHEN s LIKE '%-' THEN 34359738368 ELSE CAST(regexp_extract(s, '-(\\d+)$', 1) AS BIGINT) END AS "end" FROM t"""
)
def parse_region_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region strings as intervals."""
    c = F.col("contig")
    tail = F.when(c % 3 == 0, F.lit("")).when(c % 3 == 1, F.lit("-")).otherwise(F.concat(F.lit("-"), F.col("end").cast("string")))
    text = F.concat(F.lit("c"), c.cast("string"), F.lit(":"), (F.col("beg") + 1).cast("string"), tail)
    rows = genome.regions(spark, sf_dir).select(text.alias("s")).distinct().withColumn("p", regions.region_parts(F.col("s")))
    return rows.select("s", F.col("p.contig").alias("name"), F.col("p.beg").alias("beg"), F.col("p.end").alias("end"))


@query(
    f"""{REC}, x AS (SELECT *, greatest(beg % 7919 - 50, 0) AS lo, beg % 9973 AS hi FROM reg)
SELECT region_id, substring(text, CAST(least(lo, length(text)) + 1 AS BIGINT), CAST(greatest(least(hi, length(text)) - least(lo, length(text)), 0) AS BIGINT)) AS bases FROM x JOIN documents ON doc_id = region_id % (SELECT max(doc_id) + 1 FROM documents)"""
)
def sequence_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of sequences by name and interval, clipped to the sequence."""
    seqs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.col("text").alias("seq"))
    names = seqs.agg(F.max("name") + 1).first()[0]
    r = genome.regions(spark, sf_dir).withColumns({"lo": F.col("beg") % 7919 - 50, "hi": F.col("beg") % 9973, "name": F.col("region_id") % names})
    return r.join(seqs, "name").select("region_id", regions.fetch(F.col("seq"), F.col("lo"), F.col("hi")).alias("bases"))


@query(f'{REC} SELECT region_id, greatest(beg - 1, 0) AS text_beg, greatest("end", 1) AS text_end, greatest(beg, 0) AS bed_beg FROM reg')
def text_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of 1-based and 0-based text records as intervals."""
    one, zero = regions.text_interval(F.col("beg"), F.col("end"), False), regions.text_interval(F.col("beg"), F.col("end"), True)
    return genome.regions(spark, sf_dir).select("region_id", one[0].alias("text_beg"), one[1].alias("text_end"), zero[0].alias("bed_beg"))


# --- indexes ------------------------------------------------------------------------------------

_LINEAR = """l AS (SELECT contig, win, min(voff) AS voff FROM (SELECT contig, voff, unnest(range(beg >> 14, (("end" - 1) >> 14) + 1)) AS win FROM f) x GROUP BY 1, 2),
lw AS (SELECT contig, unnest(range(0, max(win) + 1)) AS win FROM l GROUP BY contig),
li AS (SELECT lw.contig, lw.win, first_value(l.voff IGNORE NULLS) OVER (PARTITION BY lw.contig ORDER BY lw.win ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS voff FROM lw LEFT JOIN l ON l.contig = lw.contig AND l.win = lw.win)"""


@query(f"{FILED}, {_LINEAR} SELECT contig, CAST(win AS INTEGER) AS win, voff FROM li")
def linear_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linear index of all records."""
    return indexing.linear_index(genome.filed(spark, sf_dir))


_CHUNKS = f"""b AS (SELECT *, {_bin_sql('beg', '"end"')} AS bin FROM f),
c1 AS (SELECT *, CASE WHEN bin IS NOT DISTINCT FROM lag(bin) OVER (PARTITION BY contig ORDER BY voff) THEN 0 ELSE 1 END AS nw FROM b),
c2 AS (SELECT *, sum(nw) OVER (PARTITION BY contig ORDER BY voff ROWS UNBOUNDED PRECEDING) AS run FROM c1),
ch0 AS (SELECT contig, bin, min(voff) AS chunk_beg, max(next_voff) AS chunk_end FROM c2 GROUP BY contig, bin, run)"""


@query(f"{FILED}, {_CHUNKS} SELECT contig, CAST(bin AS INTEGER) AS bin, chunk_beg, chunk_end FROM ch0")
def bin_index_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of each bin."""
    return indexing.bin_chunks(genome.filed(spark, sf_dir)).select("contig", "bin", "chunk_beg", "chunk_end")


def _folds() -> str:
    out, firsts = "", (0, 1, 9, 73, 585, 4681, 37449)
    for n, k in enumerate(range(5, 0, -1)):
        out += f""",
sp{n} AS (SELECT contig, bin, (max(chunk_end) >> 16) - (min(chunk_beg) >> 16) AS span FROM ch{n} GROUP BY 1, 2),
sm{n} AS (SELECT s.contig, s.bin, (s.bin - 1) >> 3 AS up FROM sp{n} s WHERE s.bin >= {firsts[k]} AND s.bin < {firsts[k + 1]} AND span < 65536 AND EXISTS (SELECT 1 FROM sp{n} t WHERE t.contig = s.contig AND t.bin = (s.bin - 1) >> 3)),
ch{n + 1} AS (SELECT c.contig, coalesce(up, c.bin) AS bin, chunk_beg, chunk_end FROM ch{n} c LEFT JOIN sm{n} s ON s.contig = c.contig AND s.bin = c.bin)"""
    return out


@query(
    f"""{FILED}, {_CHUNKS}{_folds()},
r AS (SELECT *, max(chunk_end) OVER (PARTITION BY contig, bin ORDER BY chunk_beg, chunk_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM ch5),
q AS (SELECT *, sum(CASE WHEN p IS NULL OR (chunk_beg >> 16) > (p >> 16) THEN 1 ELSE 0 END) OVER (PARTITION BY contig, bin ORDER BY chunk_beg, chunk_end ROWS UNBOUNDED PRECEDING) AS run FROM r)
SELECT contig, CAST(bin AS INTEGER) AS bin, min(chunk_beg) AS chunk_beg, max(chunk_end) AS chunk_end FROM q GROUP BY contig, bin, run"""
)
def bin_index_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of each bin after folding and joining."""
    return indexing.compress_bins(indexing.bin_chunks(genome.filed(spark, sf_dir))).select("contig", "bin", "chunk_beg", "chunk_end")


@query(f"{FILED} SELECT contig, min(voff) AS off_beg, max(next_voff) AS off_end, count(*) FILTER (WHERE flag & 16 = 0) AS n_mapped, count(*) FILTER (WHERE flag & 16 <> 0) AS n_unmapped FROM f GROUP BY 1")
def idxstats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets and record counts per contig (bit 16 stands for unmapped here)."""
    return indexing.index_stats(genome.filed(spark, sf_dir), F.col("flag").bitwiseAND(F.lit(16)) != 0)


@query(f"{FILED}, {_LINEAR}, s AS (SELECT contig, min(voff) AS a, max(next_voff) AS z, count(*) AS n FROM f GROUP BY 1) SELECT li.contig, CAST(count(*) AS BIGINT) AS n_windows, CAST(sum(li.voff >> 16) AS BIGINT) AS sum_blocks, any_value(a) AS off_beg, any_value(z) AS off_end, any_value(n) AS n FROM li JOIN s ON s.contig = li.contig GROUP BY 1")
def index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves of a file indexed apart and merged. Windows between the halves' records are filled
    after merging."""
    rows = genome.filed(spark, sf_dir)
    parts = [rows.where(F.col("voff") % 2_000_000 < 1_000_000), rows.where(F.col("voff") % 2_000_000 >= 1_000_000)]
    never = F.lit(False)
    raw = [p.select("contig", "voff", F.explode(STANDARD.reg2lins(F.col("beg"), F.col("end"))).alias("win")) for p in parts]
    linear, _, told = indexing.merge_indexes(
        raw[0].unionByName(raw[1]), indexing.bin_chunks(parts[0]).unionByName(indexing.bin_chunks(parts[1])), indexing.index_stats(parts[0], never).unionByName(indexing.index_stats(parts[1], never))
    )
    points = linear.select("contig", (F.col("win").cast("long") * STANDARD_WINDOW).alias("beg"), (F.col("win").cast("long") * STANDARD_WINDOW + 1).alias("end"), "voff")
    filled = indexing.linear_index(points)
    sums = filled.groupBy("contig").agg(F.count(F.lit(1)).alias("n_windows"), F.sum(F.shiftright("voff", 16)).alias("sum_blocks"))
    return sums.join(told, "contig").select("contig", "n_windows", "sum_blocks", "off_beg", "off_end", (F.col("n_mapped") + F.col("n_unmapped")).alias("n"))


STANDARD_WINDOW = 1 << STANDARD.min_shift


@query(f"{FILED}, {_LINEAR}, {_CHUNKS}, w AS (SELECT min_by(voff, win) AS low FROM li WHERE contig = 5 AND win >= 500000 >> 14), k AS (SELECT greatest(chunk_beg, low) AS cb, chunk_end AS ce FROM ch0, w WHERE contig = 5 AND chunk_end > low AND bin IN ({', '.join(str(b) for s, o in ((29, 0), (26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)) for b in range((500000 >> s) + o, (699999 >> s) + o + 1))})), r AS (SELECT *, max(ce) OVER (ORDER BY cb, ce ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM k), q AS (SELECT *, sum(CASE WHEN p IS NULL OR (cb >> 16) > (p >> 16) THEN 1 ELSE 0 END) OVER (ORDER BY cb, ce ROWS UNBOUNDED PRECEDING) AS run FROM r) SELECT min(cb) AS chunk_beg, max(ce) AS chunk_end FROM q GROUP BY run")
def index_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File ranges of a region, from bins and linear index."""
    rows = genome.filed(spark, sf_dir)
    return indexing.query_chunks(indexing.linear_index(rows), indexing.bin_chunks(rows), 5, 500_000, 700_000)


@query("SELECT o_orderkey AS coffset, o_custkey AS isize, CAST(coalesce(sum(o_custkey) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS uoffset FROM (SELECT o_orderkey, max(o_custkey) AS o_custkey FROM orders GROUP BY 1) o")
def block_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running inflated offsets of blocks."""
    blocks = table(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("coffset")).agg(F.max("o_custkey").alias("isize"))
    return indexing.running_offsets(blocks)


@query(
    f"""{FILED}, {_LINEAR}, n AS (SELECT *, lead(voff) OVER (PARTITION BY contig ORDER BY win) AS nx, max(win) OVER (PARTITION BY contig) AS mx FROM li),
o AS (SELECT *, CASE WHEN nx IS NULL OR nx = voff THEN 0 WHEN (nx >> 16) = (voff >> 16) THEN ((nx - voff) >> 3) + 1 ELSE (nx >> 16) - (voff >> 16) END AS own FROM n),
k AS (SELECT *, lag(own) OVER (PARTITION BY contig ORDER BY win) AS a, lead(own) OVER (PARTITION BY contig ORDER BY win) AS z FROM o)
SELECT contig, CAST(win AS INTEGER) AS win, CAST(own + CASE WHEN a > 0 THEN (a >> 8) + 1 ELSE 0 END + CASE WHEN z > 0 THEN (z >> 8) + 1 ELSE 0 END + CASE WHEN win < 2 OR win > mx - 2 THEN 1 ELSE 0 END AS BIGINT) AS coverage FROM k"""
)
def coverage_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of windows, estimated from the linear index."""
    return indexing.coverage_estimate(indexing.window_offsets(genome.filed(spark, sf_dir)))


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id, CAST(floor(value) AS BIGINT) AS v, lag(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) x WHERE v < p")
def sort_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records out of order."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("contig"), F.floor("value").cast("long").alias("beg"), F.col("event_id").alias("voff"))
    return indexing.order_violations(e).select(F.col("voff").alias("event_id"), F.col("contig").alias("user_id"))


@query("SELECT n_name AS contig, CAST(dense_rank() OVER (ORDER BY f) - 1 AS INTEGER) AS refid FROM (SELECT n_name, min(s_suppkey) AS f FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1) x")
def first_seen_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs numbered as they are first seen."""
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return indexing.first_seen(rows.select(F.col("n_name").alias("contig"), F.col("s_suppkey").alias("voff")))


@query(f"{FILED}, a AS (SELECT contig, win FROM (SELECT contig, unnest(range(beg >> 14, ((\"end\" - 1) >> 14) + 1)) AS win FROM f) x GROUP BY 1, 2), b AS (SELECT contig, win FROM a WHERE win % 7 <> 0 UNION ALL SELECT -1, 1) SELECT contig, CAST(win AS INTEGER) AS win, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT contig, CAST(win AS INTEGER), 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def index_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two indexes do not share."""
    a = genome.filed(spark, sf_dir).select("contig", F.explode(STANDARD.reg2lins(F.col("beg"), F.col("end"))).alias("win")).distinct()
    b = a.where("win % 7 <> 0").union(spark.createDataFrame([(-1, 1)], a.schema))
    return indexing.index_diff(a, b)


# --- pairing, templates, checksums --------------------------------------------------------------


def _mates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "lineitem")
    side = lambda k: rows.where(F.col("l_linenumber") == k).groupBy(F.col("l_orderkey").alias("qname")).agg(F.min("l_partkey").alias("part"), F.max("l_quantity").alias("qty"))
    return side(1), side(2)


_MATES = "WITH a AS (SELECT l_orderkey AS qname, min(l_partkey) AS part, max(l_quantity) AS qty FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), b AS (SELECT l_orderkey AS qname, min(l_partkey) AS part, max(l_quantity) AS qty FROM lineitem WHERE l_linenumber = 2 GROUP BY 1)"


@query(f"{_MATES} SELECT a.qname, a.part AS part_1, a.qty AS qty_1, b.part AS part_2, b.qty AS qty_2 FROM a JOIN b ON a.qname = b.qname")
def mate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mates joined by name."""
    a, b = _mates(spark, sf_dir)
    return pairing.mate_pairs(a, b, ["qname"], ["part", "qty"])


@query(f"{_MATES} SELECT * FROM a WHERE qname NOT IN (SELECT qname FROM b) UNION ALL SELECT * FROM b WHERE qname NOT IN (SELECT qname FROM a)")
def unpaired_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads whose mate is missing."""
    return pairing.unpaired(*_mates(spark, sf_dir), ["qname"])


_SA = "CASE WHEN CAST(floor(price) AS BIGINT) % 5 = 0 THEN 'x;' WHEN CAST(floor(price) AS BIGINT) % 11 = 0 THEN 'x;y;' END"


@query(
    f"""{REC}, t AS (SELECT qname, CASE WHEN flag & 128 <> 0 THEN 2 ELSE 1 END AS mate, 1 + length(coalesce({_SA}, '')) // 2 AS expected FROM rec),
x AS (SELECT qname, count(*) AS n, count(*) FILTER (WHERE mate = 1) AS n1, count(*) FILTER (WHERE mate = 2) AS n2, max(expected) FILTER (WHERE mate = 1) AS e1, max(expected) FILTER (WHERE mate = 2) AS e2 FROM t GROUP BY 1)
SELECT qname, n AS n_records, (n1 >= coalesce(e1, 1) AND n2 >= coalesce(e2, 1)) AS complete FROM x"""
)
def template_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all records of a template are there."""
    p = F.floor("price").cast("long")
    rows = genome.records(spark, sf_dir).withColumn("sa", F.when(p % 5 == 0, F.lit("x;")).when(p % 11 == 0, F.lit("x;y;")))
    return pairing.complete_templates(rows, ["qname"])


@query(f"{REC} SELECT contig, count(*) AS n FROM rec WHERE flag & 2816 = 0 GROUP BY 1")
def primary_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary records per contig."""
    return genome.records(spark, sf_dir).where(sequence.is_primary(F.col("flag"))).groupBy("contig").agg(F.count(F.lit(1)).alias("n"))


_FLAG_SQL = "concat_ws(','," + ", ".join(f"CASE WHEN flag & {1 << i} <> 0 THEN '{n}' END" for i, n in enumerate(sequence.FLAG_NAMES)) + ")"


@query(f"{REC} SELECT CAST(flag AS INTEGER) AS flag, {_FLAG_SQL} AS names, CAST(flag AS INTEGER) AS back, count(*) AS n FROM rec GROUP BY flag")
def flag_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags by name and back."""
    rows = genome.records(spark, sf_dir).groupBy("flag").agg(F.count(F.lit(1)).alias("n")).withColumn("names", sequence.flag_names(F.col("flag")))
    return rows.select("flag", "names", sequence.flag_value(F.col("names")).alias("back"), "n")


_ROW = "o_orderkey || '|' || o_custkey || '|' || o_orderstatus"
_SUM = "CAST(sum(CAST(('0x' || substr(md5({0}), 1, 8)) AS BIGINT)) % 18446744073709551616 AS DECIMAL(20,0))"
_TEXT = f"CAST({_SUM} AS VARCHAR)"


@query(f"SELECT o_orderstatus, count(*) AS n, {_TEXT.format(_ROW)} AS checksum FROM orders GROUP BY 1")
def checksum_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-independent checksums of rows."""
    text = F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), checksum.summed(checksum.md5_hash(text)).cast("string").alias("checksum"))


@query(
    f"SELECT a.n AS n_left, a.c AS checksum_left, b.n AS n_right, b.c AS checksum_right, (a.n = b.n AND a.c = b.c) AS same FROM (SELECT count(*) AS n, {_TEXT.format(_ROW)} AS c FROM orders) a, (SELECT count(*) AS n, {_TEXT.format(_ROW)} AS c FROM orders WHERE o_orderkey <> 7) b"
)
def lossless_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables held against each other by checksum; one lacks a row."""
    text = F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus")
    side = lambda df: df.agg(F.count(F.lit(1)).alias("n"), checksum.summed(checksum.md5_hash(text)).cast("string").alias("checksum"))
    o = table(spark, sf_dir, "orders")
    return checksum.same_checksum(side(o), side(o.where("o_orderkey <> 7")))


@query("SELECT CAST(sum(CAST('0x' || substr(md5(text), 1, 8) AS BIGINT)) % 4294967296 AS BIGINT) AS lane0, CAST(sum(CAST('0x' || substr(md5(text), 9, 8) AS BIGINT)) % 4294967296 AS BIGINT) AS lane1, CAST(sum(CAST('0x' || substr(md5(text), 17, 8) AS BIGINT)) % 4294967296 AS BIGINT) AS lane2, CAST(sum(CAST('0x' || substr(md5(text), 25, 8) AS BIGINT)) % 4294967296 AS BIGINT) AS lane3 FROM documents")
def checksum_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-lane md5 checksum of texts."""
    return table(spark, sf_dir, "documents").agg(*checksum.md5_lanes(F.col("text")))


_H1 = "((h + c) % 18446744073709551616)"
_H2 = f"(xor({_H1}, {_H1} >> 23) * 2388976653695081527 % 18446744073709551616)"


@query(
    f"""WITH t AS (SELECT '@' || p_partkey || chr(10) || upper(p_name) || chr(10) || '+' || chr(10) || p_name || chr(10) AS t FROM part),
h AS (SELECT list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(string_split(t, ''), lambda x: CAST(ord(x) AS HUGEINT))), lambda h, c: xor({_H2}, {_H2} >> 47)) AS h FROM t)
SELECT count(*) AS n, CAST(CAST(sum(h) % 18446744073709551616 AS HUGEINT) AS VARCHAR) AS checksum FROM h"""
)
def checksum_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64-bit record checksum of reads made from parts' names."""
    p = table(spark, sf_dir, "part")
    return checksum.fastq_checksum(p.select(F.col("p_partkey").cast("string").alias("name"), F.upper("p_name").alias("seq"), F.col("p_name").alias("qual"))).withColumn("checksum", F.col("checksum").cast("string"))


@query("WITH a AS (SELECT o_custkey, o_orderstatus FROM orders), b AS (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 50 <> 0) SELECT o_custkey, o_orderstatus, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)")
def multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that one of two multisets has more often."""
    o = table(spark, sf_dir, "orders")
    return checksum.multiset_diff(o.select("o_custkey", "o_orderstatus"), o.where("o_orderkey % 50 <> 0").select("o_custkey", "o_orderstatus"))


# --- pileup -------------------------------------------------------------------------------------


@query(f'{REC}, w AS (SELECT contig, unnest(range(beg // 1000, ("end" - 1) // 1000 + 1)) AS w FROM rec) SELECT contig, CAST(w * 1000 AS BIGINT) AS pos, count(*) AS depth FROM w GROUP BY 1, 2')
def pileup_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth in windows of a thousand."""
    return pileup.depth(genome.records(spark, sf_dir), 1000)


@query(f'{REC}, x AS (SELECT *, row_number() OVER (PARTITION BY contig, beg ORDER BY "end", qname, line, price) AS n FROM rec) SELECT contig, beg, count(*) AS n FROM x WHERE n <= 3 GROUP BY 1, 2')
def depth_cap_per_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three records per start (an approximation of the depth cap)."""
    return pileup.cap_per_start(genome.records(spark, sf_dir), ["end", "qname", "line", "price"], 3).groupBy("contig", "beg").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""{FILED.replace("WITH f", "WITH RECURSIVE f")}, r AS (SELECT contig, beg, "end", row_number() OVER (PARTITION BY contig ORDER BY voff) AS k FROM f),
s AS (SELECT contig, k, ["end"] AS ends, CAST(1 AS BIGINT) AS kept FROM r WHERE k = 1
UNION ALL SELECT s.contig, r.k, CASE WHEN len(list_filter(s.ends, lambda x: x > r.beg)) < 5 THEN list_append(list_filter(s.ends, lambda x: x > r.beg), r."end") ELSE list_filter(s.ends, lambda x: x > r.beg) END,
  s.kept + CASE WHEN len(list_filter(s.ends, lambda x: x > r.beg)) < 5 THEN 1 ELSE 0 END FROM s JOIN r ON r.contig = s.contig AND r.k = s.k + 1)
SELECT contig, max(kept) AS n FROM s GROUP BY 1"""
)
def depth_cap_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The depth cap in file order."""
    cols = ["contig", "beg", "end", "voff"]
    return pileup.capped(genome.filed(spark, sf_dir), 5, cols).groupBy("contig").agg(F.count(F.lit(1)).alias("n"))


_CIGARS = ("5M2D4M", "3S6M1I2M", "4M3N5M", "10M", "2H7=1X2M3S", "6M2P1I3M")


def _alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = F.get(F.array(*[F.lit(c) for c in _CIGARS]), (F.col("p_partkey") % len(_CIGARS)).cast("int"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("qname"), (F.col("p_partkey") % 20).alias("contig"), (F.col("p_partkey") % 97).alias("pos"), F.when(F.col("p_partkey") % 13 == 0, 4).otherwise(0).alias("flag"),
        pick.alias("cigar_text"), F.rpad(F.translate(F.upper("p_name"), " ", "N"), 13, "ACGT").alias("seq"), F.lit("IIIIIHHHHHGGG").alias("qual"),
    ).withColumn("cigar", sequence.parse_cigar(F.col("cigar_text")))


@query(
    "WITH a AS (SELECT p_partkey % 20 AS contig, p_partkey % 97 AS pos, p_partkey % 6 AS c FROM part WHERE p_partkey % 13 <> 0), s(c, o) AS (VALUES "
    + ", ".join(f"({c}, {o})" for c, offsets in enumerate(((*range(11),), (*range(8),), (*range(12),), (*range(10),), (*range(10),), (*range(9),))) for o in offsets)
    + ") SELECT contig, CAST(pos + o AS BIGINT) AS ref_pos, count(*) AS depth FROM a JOIN s ON s.c = a.c GROUP BY 1, 2"
)
def pileup_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth from alignments' CIGAR strings."""
    return pileup.pileup_columns(_alignments(spark, sf_dir)).select("contig", "ref_pos", "depth")


# per CIGAR: reference offset, read offset (-1 in a gap), skipped, indel behind
_COVERED = (
    [(k, k, 0, -2 * (k == 4)) for k in range(5)] + [(5, -1, 0, 0), (6, -1, 0, 0)] + [(k, k - 2, 0, 0) for k in range(7, 11)],
    [(k, k + 3, 0, int(k == 5)) for k in range(6)] + [(6, 10, 0, 0), (7, 11, 0, 0)],
    [(k, k, 0, 0) for k in range(4)] + [(k, -1, 1, 0) for k in (4, 5, 6)] + [(k, k - 3, 0, 0) for k in range(7, 12)],
    [(k, k, 0, 0) for k in range(10)],
    [(k, k, 0, 0) for k in range(10)],
    [(k, k, 0, int(k == 5)) for k in range(6)] + [(k, k + 1, 0, 0) for k in range(6, 9)],
)


@query(
    "WITH a AS (SELECT p_partkey % 20 AS contig, p_partkey % 97 AS pos, p_partkey % 6 AS c FROM part WHERE p_partkey % 13 <> 0), s(c, o, q, sk, ind) AS (VALUES "
    + ", ".join(f"({c}, {o}, {q}, {k}, {i})" for c, rows in enumerate(_COVERED) for o, q, k, i in rows)
    + ") SELECT contig, CAST(pos + o AS BIGINT) AS ref_pos, count(*) FILTER (WHERE q >= 0) AS n_bases, count(*) FILTER (WHERE q < 0) AS n_gaps, count(*) FILTER (WHERE sk = 1) AS n_skips, CAST(sum(ind) AS BIGINT) AS indels, CAST(coalesce(sum(CASE WHEN q < 0 THEN NULL WHEN q < 5 THEN 40 WHEN q < 10 THEN 39 ELSE 38 END), -1) AS BIGINT) AS qual FROM a JOIN s ON s.c = a.c GROUP BY 1, 2"
)
def pileup_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases, gaps and indels over each position."""
    p = pileup.pileup(_alignments(spark, sf_dir))
    return p.groupBy("contig", "ref_pos").agg(F.count("base").alias("n_bases"), F.count(F.when(F.col("is_del"), 1)).alias("n_gaps"), F.count(F.when(F.col("is_refskip"), 1)).alias("n_skips"), F.sum("indel").alias("indels"), F.coalesce(F.sum("base_qual"), F.lit(-1)).alias("qual"))


@query(
    "WITH a AS (SELECT p_partkey, p_partkey % 20 AS contig, p_partkey % 97 AS pos, p_partkey % 6 AS c, substr(translate(upper(p_name), ' ', 'N') || 'ACGTACGTACGTA', 1, 13) AS seq FROM part WHERE p_partkey % 13 <> 0), s(c, o, q) AS (VALUES "
    + ", ".join(f"({c}, {o}, {q})" for c, rows in enumerate(_COVERED) for o, q, _, _ in rows if q >= 0)
    + "), b AS (SELECT contig, CASE WHEN q < 5 THEN 40 WHEN q < 10 THEN 39 ELSE 38 END AS qual, substr(seq, CAST(q + 1 AS INTEGER), 1) = substr(reverse(seq), CAST(q + 1 AS INTEGER), 1) AS same FROM a JOIN s ON s.c = a.c)"
    " SELECT contig, CAST(m AS INTEGER) AS mate, CAST(sum(CASE WHEN m = 2 THEN 0 WHEN same THEN least(2 * qual, 200) ELSE floor(qual * 0.8) END) AS BIGINT) AS q, count(*) AS n FROM b, (VALUES (1), (2)) t(m) GROUP BY 1, 2"
)
def mate_overlap_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Qualities after merging what both mates of a template cover."""
    a = _alignments(spark, sf_dir)
    both = a.withColumn("mate", F.lit(1)).unionByName(a.withColumn("mate", F.lit(2)).withColumn("seq", F.reverse("seq")))
    out = pileup.merge_overlapping_mates(pileup.pileup(both).where("NOT is_del"))
    return out.groupBy("contig", "mate").agg(F.sum("base_qual").alias("q"), F.count(F.lit(1)).alias("n"))


@query(
    f"""{REC}, r AS (SELECT *, CAST(qname % 3 AS INTEGER) AS s FROM rec), w AS (SELECT contig, s, unnest(range(beg // 1000, ("end" - 1) // 1000 + 1)) AS w FROM r)
SELECT contig, CAST(w * 1000 AS BIGINT) AS pos, count(*) FILTER (WHERE s = 0) AS s0, count(*) FILTER (WHERE s = 1) AS s1, count(*) FILTER (WHERE s = 2) AS s2 FROM w GROUP BY 1, 2"""
)
def multi_sample_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of several samples side by side."""
    r = genome.records(spark, sf_dir)
    return pileup.multi_depth({f"s{k}": r.where(F.col("qname") % 3 == k) for k in range(3)}, 1000)


# --- qualities, tags, sequences -----------------------------------------------------------------

_CODES = "list_transform(string_split(text, ''), lambda c: ord(c))"


@query(f"WITH c AS (SELECT lang, length(text) AS n, {_CODES} AS a FROM documents) SELECT lang, count(*) AS n_reads, CAST(sum(n) AS BIGINT) AS n_bases, CAST(min(list_min(a)) AS INTEGER) AS q_min, CAST(max(list_max(a)) AS INTEGER) AS q_max, CAST(sum(list_sum(a)) AS BIGINT) AS q_sum, CAST(sum(list_sum(a)) // sum(n) AS BIGINT) AS q_mean FROM c GROUP BY 1")
def qual_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character statistics of strings."""
    return quality.quality_stats(table(spark, sf_dir, "documents"), "text", ["lang"], every=True)


@query("WITH x AS (SELECT p_partkey, CAST(p_size + 20 AS BIGINT) AS lo, CAST(p_size + 20 + p_partkey % 60 AS BIGINT) AS hi FROM part) SELECT p_partkey, CAST(CASE WHEN lo >= 33 AND hi <= 78 THEN 0 WHEN lo >= 64 AND hi <= 109 THEN 1 WHEN lo >= 59 AND hi <= 109 THEN 2 WHEN abs((lo + hi) / 2 - 104) < abs((lo + hi) / 2 - 73) THEN 1 ELSE 0 END AS INTEGER) AS encoding FROM x")
def qual_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest encoding from range and mean."""
    lo = F.col("p_size") + 20
    hi = lo + F.col("p_partkey") % 60
    return table(spark, sf_dir, "part").select("p_partkey", quality.encoding_of(lo, hi, (lo + hi) / 2).alias("encoding"))


@query("WITH x AS (SELECT DISTINCT l_linenumber AS n, CAST(l_quantity AS INTEGER) AS q FROM lineitem) SELECT n, q, chr(q + 69 - 31) AS phred, chr(CAST(floor(33.0 + (q + 5) + 10 * log10(1 + pow(10.0, -(q + 5) / 10.0))) AS INTEGER)) AS solexa FROM x")
def qual_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Qualities of other encodings as +33."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("int").alias("q")).distinct()
    text = F.chr((F.col("q") + 69).cast("long"))
    return rows.select("n", "q", sequence.phred64_to_33(text).alias("phred"), sequence.solexa64_to_33(text).alias("solexa"))


@query("SELECT unnest(json_keys(props)) AS tag, count(*) AS n FROM events WHERE props IS NOT NULL GROUP BY 1")
def tag_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each key occurs."""
    return quality.tag_frequency(table(spark, sf_dir, "events").select(F.from_json("props", "map<string,string>").alias("tags")).where("tags IS NOT NULL"))


@query("SELECT p_partkey, reverse(translate(upper(p_name), 'ACGTMRWSYKVHDBN', 'TGCAKYWSRMBDHVN')) AS seq FROM (SELECT p_partkey, replace(upper(p_name), 'U', 'T') AS p_name FROM part)")
def revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reverse complements."""
    return table(spark, sf_dir, "part").select("p_partkey", sequence.reverse_complement(F.replace(F.upper("p_name"), F.lit("U"), F.lit("T"))).alias("seq"))


_CIGAR = "(p_size || 'M' || (p_partkey % 7 + 1) || 'I' || (p_size % 5 + 1) || 'D' || (p_partkey % 3 + 2) || 'S')"


@query(f"SELECT p_partkey, {_CIGAR} AS cigar, CAST(p_size + p_partkey % 7 + 1 + p_partkey % 3 + 2 AS INTEGER) AS query_length, CAST(p_size + p_size % 5 + 1 AS INTEGER) AS reference_length, p_partkey + p_size + p_size % 5 + 1 AS end_pos, p_partkey + p_size + p_size % 5 + 1 AS text_end FROM part")
def cigar_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and ends from CIGAR strings."""
    n, k = F.col("p_size"), F.col("p_partkey")
    text = F.concat(n.cast("string"), F.lit("M"), (k % 7 + 1).cast("string"), F.lit("I"), (n % 5 + 1).cast("string"), F.lit("D"), (k % 3 + 2).cast("string"), F.lit("S"))
    rows = table(spark, sf_dir, "part").select("p_partkey", text.alias("cigar")).withColumn("ops", sequence.parse_cigar(F.col("cigar")))
    ops = F.col("ops")
    return rows.select("p_partkey", "cigar", sequence.query_length(ops).alias("query_length"), sequence.reference_length(ops).alias("reference_length"), sequence.end_position(F.col("p_partkey"), ops, F.lit(0)).alias("end_pos"), sequence.text_end_position(F.col("p_partkey"), ops).alias("text_end"))


@query("SELECT p_partkey, CAST(length(regexp_replace(p_name, '[^GCgc]', '', 'g')) AS INTEGER) AS gc, length(p_name) AS n FROM part")
def base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G and C in sequences."""
    return table(spark, sf_dir, "part").select("p_partkey", sequence.base_count(F.col("p_name"), "GC").alias("gc"), F.length("p_name").cast("long").alias("n"))


@query(
    """WITH r AS (SELECT o_custkey AS qname, CASE WHEN o_orderkey % 4 = 3 THEN 0 WHEN o_orderkey % 2 = 0 THEN 65 ELSE 129 END AS flag, o_orderkey AS k FROM orders WHERE o_orderkey % 5 <> 0),
m AS (SELECT *, CASE WHEN flag & 1 = 0 THEN 0 WHEN flag & 64 <> 0 THEN 1 ELSE 2 END AS mate FROM r), p AS (SELECT qname FROM m WHERE mate > 0 GROUP BY 1 HAVING count(DISTINCT mate) = 2)
SELECT CAST(CASE WHEN mate = 0 OR p.qname IS NULL THEN 3 ELSE mate END AS INTEGER) AS which, count(*) AS n, CAST(sum(length('@' || m.qname || CASE mate WHEN 0 THEN '' WHEN 1 THEN '/1' ELSE '/2' END) + 1 + length(CAST(k AS VARCHAR)) * 2 + 4) AS BIGINT) AS chars FROM m LEFT JOIN p ON p.qname = m.qname GROUP BY 1"""
)
def fastq_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads split by mate, with orphans apart."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 5 <> 0")
    k = F.col("o_orderkey")
    flag = F.when(k % 4 == 3, 0).when(k % 2 == 0, 65).otherwise(129)
    reads = o.select(F.lit("rg").alias("rg"), F.col("o_custkey").cast("string").alias("qname"), flag.alias("flag"), k.cast("string").alias("seq"), k.cast("string").alias("qual"))
    return pairing.export_fastq(reads).groupBy("which").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


# --- filter language ----------------------------------------------------------------------------


def _filtered(name: str, expression: str, where: str, source: str, key: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        return filterlang.passing(df, expression).groupBy(key).agg(F.count(F.lit(1)).alias("n"))

    run.__name__ = f"filter_expr_{name}"
    run.__doc__ = f"Rows for which {expression!r} is true."
    query(f"SELECT {key}, count(*) AS n FROM {source} WHERE {where} GROUP BY 1")(run)


_filtered("numeric", "l_quantity * 2 > 50 && l_discount < 0.05", "l_quantity * 2 > 50 AND l_discount < 0.05", "lineitem", "l_suppkey")
_filtered("precedence", "l_linenumber == 1 || l_linenumber == 2 && l_quantity < 10", "(l_linenumber = 1 OR l_linenumber = 2) AND l_quantity < 10", "lineitem", "l_suppkey")
_filtered("bits", "(l_orderkey & 6) == 4 || (l_partkey ^ l_suppkey) % 5 == 0", "(l_orderkey & 6) = 4 OR xor(l_partkey, l_suppkey) % 5 = 0", "lineitem", "l_linenumber")
_filtered("sums", "l_quantity + l_linenumber - 2 >= 25 && (l_discount * 100 + 1) / 2 != 3", "l_quantity + l_linenumber - 2 >= 25 AND (l_discount * 100 + 1) / 2 <> 3", "lineitem", "l_suppkey")
_filtered("order", "l_linenumber <= 3 && l_quantity >= 10 && l_partkey < 1000 || l_tax > 0.05", "l_linenumber <= 3 AND l_quantity >= 10 AND l_partkey < 1000 OR l_tax > 0.05", "lineitem", "l_suppkey")
_filtered("string", 'l_returnflag == "R" && l_linestatus != "O"', "l_returnflag = 'R' AND l_linestatus <> 'O'", "lineitem", "l_suppkey")
_filtered("regex", 'p_name =~ "^[[:alpha:]]+ .*[aeiou]$" || p_type !~ "[[:upper:]]{3}"', "regexp_matches(p_name, '^[A-Za-z]+ .*[aeiou]$') OR NOT regexp_matches(p_type, '[A-Z]{3}')", "part", "p_size")
_filtered("function", "length(p_name) >= 6 && max(p_name) > 110 && avg(p_brand) > 70", "length(p_name) >= 6 AND list_max(list_transform(string_split(p_name, ''), lambda c: ord(c))) > 110 AND list_avg(list_transform(string_split(p_brand, ''), lambda c: ord(c))) > 70", "part", "p_size")
_filtered("unary", "!(l_quantity > 25) && -l_discount < -0.04 && ~l_linenumber == -3", "NOT l_quantity > 25 AND l_discount > 0.04 AND l_linenumber = 2", "lineitem", "l_suppkey")


# --- variants -----------------------------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN e > p_size THEN e ELSE p_size + length(p_brand) END AS v_end FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, p_brand, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 80 ELSE NULL END AS e FROM part)")
def variant_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of variants, from INFO END or the reference allele."""
    info = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("DP=3;END="), (F.col("p_partkey") % 80).cast("string"))).otherwise(F.lit("DP=3;XEND=9"))
    return table(spark, sf_dir, "part").select("p_partkey", variants.variant_end(F.col("p_size").cast("long"), F.col("p_brand"), info).alias("v_end"))


@query(
    f"""{VAR}, p AS (SELECT ref, alt, count(*) AS n FROM v GROUP BY 1, 2),
k AS (SELECT *, (SELECT max(i) FROM range(0, 12) t(i) WHERE i <= least(length(ref), length(alt)) AND left(ref, i) = left(alt, i)) AS pre FROM p),
r AS (SELECT *, substr(ref, pre + 1) AS r, substr(alt, pre + 1) AS a FROM k),
s AS (SELECT *, (SELECT max(i) FROM range(0, 12) t(i) WHERE i <= greatest(least(length(r), length(a)) - 1, 0) AND right(r, i) = right(a, i)) AS suf FROM r),
q AS (SELECT *, left(r, length(r) - suf) AS rr, left(a, length(a) - suf) AS aa FROM s)
SELECT ref, alt, n, CAST(CASE WHEN alt = '*' THEN 32 WHEN length(ref) = 1 AND length(alt) = 1 THEN CASE WHEN alt = ref THEN 0 ELSE 1 END WHEN alt LIKE '<%' THEN 8
  WHEN r = '' AND a = '' THEN 0 WHEN r = '' THEN CASE WHEN a LIKE '[%' OR a LIKE ']%' THEN 16 ELSE 4 END WHEN a = '' THEN 4
  WHEN length(aa) = 1 THEN CASE WHEN length(rr) = 1 THEN 1 WHEN right(rr, 1) = right(aa, 1) THEN 4 ELSE 8 END
  WHEN length(rr) = 1 THEN CASE WHEN right(rr, 1) = right(aa, 1) THEN 4 ELSE 8 END WHEN length(rr) = length(aa) THEN 2 ELSE 8 END AS INTEGER) AS kind FROM q"""
)
def variant_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of variants."""
    v = genome.variants(spark, sf_dir)
    return v.withColumn("kind", variants.variant_class(F.col("ref"), F.array("alt"))).groupBy("ref", "alt", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"{VAR} SELECT kind, count(*) AS n FROM (SELECT CASE WHEN length(ref) = 1 AND length(alt) = 1 AND alt <> '*' THEN 'snp' ELSE 'other' END AS kind FROM v) x GROUP BY 1")
def snp_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-base variants and others."""
    v = genome.variants(spark, sf_dir)
    return v.select(F.when(variants.is_snp(F.col("ref"), F.array("alt")), "snp").otherwise("other").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"{VAR} SELECT alt, regexp_extract(alt, '[\\[\\]]([^\\[\\]:]+):', 1) AS contig, CAST(regexp_extract(alt, ':(\\d+)', 1) AS BIGINT) AS pos, count(*) AS n FROM v WHERE contains(alt, '[') GROUP BY 1, 2, 3")
def breakend_mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other sides of breakends."""
    v = genome.variants(spark, sf_dir).withColumn("m", variants.breakend_mate(F.col("alt"))).where("m IS NOT NULL")
    return v.groupBy("alt", F.col("m.contig").alias("contig"), F.col("m.pos").alias("pos")).agg(F.count(F.lit(1)).alias("n"))


_GT = "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_custkey % 3 ELSE o_orderkey % 3 END AS a, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey % 3 END AS b, o_orderkey % 6 = 0 AS hap FROM orders"


def _genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    a = F.when(k % 4 == 0, c % 3).otherwise(k % 3).cast("int")
    b = F.when(c % 5 != 0, c % 3).cast("int")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(k % 6 == 0, F.array(a)).otherwise(F.array(a, b)).alias("alleles"))


@query(
    f"""WITH g AS ({_GT}) SELECT CAST(CASE WHEN hap THEN CASE WHEN a = 0 THEN 4 ELSE 5 END WHEN b IS NULL THEN 6 WHEN a = 0 AND b = 0 THEN 0 WHEN a = 0 OR b = 0 THEN 2 WHEN a = b THEN 1 ELSE 3 END AS INTEGER) AS kind, count(*) AS n FROM g GROUP BY 1"""
)
def genotype_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of genotypes."""
    return _genotypes(spark, sf_dir).select(variants.genotype_class(F.col("alleles")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH g AS ({_GT}), x AS (SELECT a AS allele FROM g UNION ALL SELECT b FROM g WHERE NOT hap) SELECT CAST(allele AS INTEGER) AS allele, count(*) AS n FROM x WHERE allele IS NOT NULL GROUP BY 1")
def allele_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alleles counted over genotypes."""
    rows = _genotypes(spark, sf_dir).withColumns({"contig": F.lit(1), "pos": F.lit(1)})
    return merging.count_alleles(rows).select("allele", "n")


@query(f"WITH g AS ({_GT}) SELECT o_orderkey, CAST((a + 1) * 2 AS INTEGER) AS c0, CAST(CASE WHEN hap THEN -1 WHEN b IS NULL THEN 1 ELSE (b + 1) * 2 + 1 END AS INTEGER) AS c1, CAST(a AS INTEGER) AS a0 FROM g")
def genotype_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genotypes as codes and back."""
    codes = variants.encode_genotype(F.col("alleles"), F.lit(True))
    rows = _genotypes(spark, sf_dir).withColumn("codes", codes)
    return rows.select("o_orderkey", F.get("codes", F.lit(0)).alias("c0"), F.coalesce(F.get("codes", F.lit(1)), F.lit(-1)).alias("c1"), F.get(variants.decode_genotype(F.col("codes")), F.lit(0)).alias("a0"))


@query(
    f"""WITH g AS ({_GT}), s AS (SELECT o_custkey % 40 AS site, list(a) AS xs, list(b) FILTER (WHERE NOT hap) AS ys FROM g JOIN orders USING (o_orderkey) GROUP BY 1),
k AS (SELECT site, list_contains(xs, 1) OR list_contains(ys, 1) AS k1, list_contains(xs, 2) OR list_contains(ys, 2) AS k2 FROM s)
SELECT site, concat_ws(',', 'r', CASE WHEN k1 THEN 'x' END, CASE WHEN k2 THEN 'y' END) AS per_allele, concat_ws(',', CASE WHEN k1 THEN 'x' END, CASE WHEN k2 THEN 'y' END) AS per_alt,
  concat_ws(',', '00', CASE WHEN k1 THEN '01' END, CASE WHEN k1 THEN '11' END, CASE WHEN k2 THEN '02' END, CASE WHEN k1 AND k2 THEN '12' END, CASE WHEN k2 THEN '22' END) AS per_genotype FROM k"""
)
def trim_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-allele values after removing alleles that no genotype has."""
    sites = _genotypes(spark, sf_dir).groupBy((F.col("o_custkey") % 40).alias("site")).agg(F.collect_list("alleles").alias("genotypes")).withColumn("alts", F.array(F.lit("x"), F.lit("y")))
    keep = F.col("keep")
    lits = lambda *v: F.array(*[F.lit(x) for x in v])
    return merging.unused_alleles(sites).select(
        "site", F.array_join(variants.keep_alleles(keep, lits("r", "x", "y"), "R"), ",").alias("per_allele"), F.array_join(variants.keep_alleles(keep, lits("x", "y"), "A"), ",").alias("per_alt"),
        F.array_join(variants.keep_alleles(keep, lits("00", "01", "11", "02", "12", "22"), "G"), ",").alias("per_genotype"),
    )


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN 'PASS' ELSE 'q10,s50' END AS filters, (o_orderkey % 3 = 2) AS has_q10, (o_orderkey % 3 <> 2) AS passes, CASE WHEN o_orderkey % 3 = 2 THEN 'q10,s50,lowDP' ELSE 'lowDP' END AS added FROM orders")
def filter_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FILTER values tested and changed."""
    k = F.col("o_orderkey") % 3
    f = variants.parse_filters(F.when(k == 0, F.lit(".")).when(k == 1, F.lit("PASS")).otherwise(F.lit("q10;s50")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(f, ",").alias("filters"), variants.has_filter(f, ["q10"]).alias("has_q10"), variants.has_filter(f, ["PASS"]).alias("passes"), F.array_join(variants.add_filter(f, "lowDP"), ",").alias("added"))


@query("SELECT o_orderkey, o_custkey AS dp, CAST(o_custkey % 7 AS DOUBLE) / 10 AS af0, o_orderkey % 2 = 0 AS db FROM orders")
def info_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INFO strings as typed columns, by a header's definitions."""
    header = '##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth, total">\n##INFO=<ID=AF,Number=A,Type=Float,Description="Share">\n##INFO=<ID=DB,Number=0,Type=Flag,Description="Known">'
    text = F.concat(F.lit("DP="), F.col("o_custkey").cast("string"), F.lit(";AF=0."), (F.col("o_custkey") % 7).cast("string"), F.lit(",."), F.when(F.col("o_orderkey") % 2 == 0, F.lit(";DB")).otherwise(F.lit("")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", variants.parse_info(text).alias("info"))
    typed = headers.typed_info(rows, headers.parse_variant_header(spark, header))
    return typed.select("o_orderkey", F.col("info_DP").cast("long").alias("dp"), F.get("info_AF", F.lit(0)).alias("af0"), F.col("info_DB").alias("db"))


_SOURCES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query(
    f"""{VAR}, x AS (SELECT *, upper(ref) || '>' || upper(alt) AS k, row_number() OVER (PARTITION BY source, contig, pos, upper(ref), upper(alt) ORDER BY rec) AS nth FROM v)
SELECT contig, pos, CAST(nth AS INTEGER) AS copy, {", ".join(f"coalesce(max(rec) FILTER (WHERE source = '{s}'), -1) AS \"{s}\"" for s in _SOURCES)}, count(*) AS n_sources FROM x GROUP BY contig, pos, k, nth"""
)
def synced_merge_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal variants of five tables side by side."""
    v = genome.variants(spark, sf_dir).withColumn("alts", F.array("alt"))
    return merging.merge_exact(v, list(_SOURCES), "rec", ["rec"]).drop("variant").fillna(-1)


@query(
    f"""{VAR}, x AS (SELECT *, row_number() OVER (PARTITION BY source, contig, pos ORDER BY rec) AS nth FROM v)
SELECT contig, pos, CAST(nth AS INTEGER) AS copy, {", ".join(f"coalesce(max(rec) FILTER (WHERE source = '{s}'), -1) AS \"{s}\"" for s in _SOURCES)}, count(*) AS n_sources FROM x GROUP BY contig, pos, nth"""
)
def synced_merge_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of one position side by side."""
    v = genome.variants(spark, sf_dir).withColumn("alts", F.array("alt"))
    return merging.merge_any(v, list(_SOURCES), "rec", ["rec"]).fillna(-1)


@query(
    f"""{VAR}, y AS (SELECT *, CASE WHEN length(ref) = 1 AND length(alt) = 1 AND alt <> '*' AND alt <> ref THEN 'class 1' ELSE upper(ref) || '>' || upper(alt) END AS k FROM v WHERE length(ref) = 1 AND length(alt) = 1),
x AS (SELECT *, row_number() OVER (PARTITION BY source, contig, pos, k ORDER BY rec) AS nth FROM y)
SELECT contig, pos, CAST(nth AS INTEGER) AS copy, {", ".join(f"coalesce(max(rec) FILTER (WHERE source = '{s}'), -1) AS \"{s}\"" for s in _SOURCES)}, count(*) AS n_sources FROM x GROUP BY contig, pos, k, nth"""
)
def synced_merge_snps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-base variants of one position side by side; the rest pair if equal."""
    v = genome.variants(spark, sf_dir).where("length(ref) = 1 AND length(alt) = 1").withColumn("alts", F.array("alt"))
    return merging.merge_by_class(v, list(_SOURCES), "rec", ["rec"], variants.SNP | variants.MNP).drop("variant").fillna(-1)


@query()
def synced_merge_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored merge of single-base variants and indels; tests hold it against a model."""
    v = genome.variants(spark, sf_dir).withColumn("alts", F.array("alt"))
    return merging.merge_scored(v, merging.BOTH)


@query("SELECT DISTINCT c_nationkey AS sample FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def sample_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that two tables share."""
    return merging.sample_intersection([table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("sample")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("sample"))])


@query("SELECT n_nationkey, s FROM (SELECT n_nationkey, string_agg(sample, ',' ORDER BY sample) AS s FROM (SELECT n_nationkey, 'S' || (n_nationkey + k) % 4 AS sample FROM nation, range(3) t(k)) x WHERE sample IN ('S0', 'S2') GROUP BY 1)")
def sample_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of variants, cut to two names."""
    samples = F.array(*[F.struct(F.concat(F.lit("S"), ((F.col("n_nationkey") + k) % 4).cast("string")).alias("sample"), F.lit("0/1").alias("gt")) for k in range(3)])
    v = merging.subset_samples(table(spark, sf_dir, "nation").withColumn("samples", samples), ["S0", "S2"])
    return v.select("n_nationkey", F.array_join(F.array_sort(F.transform("samples", lambda s: s["sample"])), ",").alias("s"))


# --- dictionaries and statistics ----------------------------------------------------------------


@query(f"{REC} SELECT s_name AS contig_name, n FROM supplier JOIN (SELECT contig, count(*) AS n FROM rec GROUP BY 1) x ON s_suppkey = contig")
def contig_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contig names looked up by number."""
    n = genome.records(spark, sf_dir).groupBy("contig").agg(F.count(F.lit(1)).alias("n"))
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("contig"), F.col("s_name").alias("contig_name"))
    return n.join(names, "contig").select("contig_name", "n")


@query("SELECT DISTINCT source, lang FROM documents")
def header_uniq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header lines without repeats."""
    return headers.unique_lines(table(spark, sf_dir, "documents"), ["source", "lang"])


@query(
    """WITH t AS (SELECT l_suppkey AS k, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'O') AS a, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus <> 'O') AS b, count(*) FILTER (WHERE l_returnflag <> 'R' AND l_linestatus = 'O') AS c, count(*) FILTER (WHERE l_returnflag <> 'R' AND l_linestatus <> 'O') AS d FROM lineitem GROUP BY 1),
u AS (SELECT *, unnest(range(greatest(0, a + b + a + c - (a + b + c + d)), least(a + b, a + c) + 1)) AS i FROM t),
p AS (SELECT k, a, i, exp(lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - CASE WHEN i < 2 THEN 0 ELSE lgamma(i + 1) END - CASE WHEN a + b - i < 2 THEN 0 ELSE lgamma(a + b - i + 1) END - CASE WHEN a + c - i < 2 THEN 0 ELSE lgamma(a + c - i + 1) END - CASE WHEN d - a + i < 2 THEN 0 ELSE lgamma(d - a + i + 1) END) AS p FROM u)
SELECT k AS supplier, round(sum(p) FILTER (WHERE i <= a), 6) AS p_left, round(sum(p) FILTER (WHERE i >= a), 6) AS p_right FROM p GROUP BY k"""
)
def fisher_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fisher's exact test of a 2x2 table per supplier."""
    r, o = F.col("l_returnflag") == "R", F.col("l_linestatus") == "O"
    n = lambda c: F.count(F.when(c, 1))
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg(n(r & o).alias("a"), n(r & ~o).alias("b"), n(~r & o).alias("c"), n(~r & ~o).alias("d"))
    t = t.withColumn("p", stats.fisher_exact(F.col("a"), F.col("b"), F.col("c"), F.col("d")))
    return t.select("supplier", F.round("p.left", 6).alias("p_left"), F.round("p.right", 6).alias("p_right"))


@query("SELECT p_partkey, round(lgamma(p_size + 0.5), 9) AS lg FROM part")
def gamma_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logarithm of the gamma function."""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(stats.lgamma(F.col("p_size") + 0.5), 9).alias("lg"))
