"""Text formats: variants, features, reads and sequences."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StructType

from spanforge.functions.regions import text_interval
from spanforge.functions.sequence import parse_cigar, text_end_position
from spanforge.functions.variants import info_text, parse_filters, parse_genotype, parse_info, sample_text, variant_end
from spanforge.sources import bgzf


@dataclass(frozen=True)
class Layout:
    """Where a tab-separated feature file keeps contig, begin and end (columns from 1; no end: 0), the
    sign of its comment lines, how many lines to skip, and whether begins count from 0."""

    contig: int
    beg: int
    end: int
    comment: str = "#"
    skip: int = 0
    zero_based: bool = False


# Layouts of well-known formats.
LAYOUTS = {"gff": Layout(1, 4, 5), "bed": Layout(1, 2, 3, zero_based=True), "psl": Layout(15, 17, 18, zero_based=True), "sam": Layout(3, 4, 0, "@"), "vcf": Layout(1, 2, 0)}


def read_features(spark: SparkSession, path: str, layout: Layout | str, blocked_offsets: bool = False) -> DataFrame:
    """(contig, beg, end, line) of a feature file; lines that do not parse are left out. With
    ``blocked_offsets`` the lines carry their file offsets (coffset, uoffset)."""
    at = LAYOUTS[layout] if isinstance(layout, str) else layout
    if at.skip:
        rows = bgzf.after_skipped(spark, path, at.skip)
        return features_of(rows if blocked_offsets else rows.select("line"), layout)
    return features_of(bgzf.lines(spark, path) if blocked_offsets else bgzf.text_lines(spark, path), layout)


def features_of(rows: DataFrame, layout: Layout | str) -> DataFrame:
    """(contig, beg, end, line, and offsets if there) of lines in a column ``line``."""
    name = layout if isinstance(layout, str) else ""
    at = LAYOUTS[layout] if isinstance(layout, str) else layout
    offsets = [c for c in ("coffset", "uoffset") if c in rows.columns]
    rows = rows.where(~F.col("line").startswith(at.comment) & (F.col("line") != "")).withColumn("_f", F.split("line", "\t"))
    field = lambda k: F.get("_f", F.lit(k - 1))
    beg, end = text_interval(field(at.beg).try_cast("long"), field(at.end).try_cast("long") if at.end else F.lit(None).cast("long"), at.zero_based)
    if name == "sam":
        end = text_end_position(beg, parse_cigar(field(6)))
    elif name == "vcf":
        end = variant_end(beg, field(4), field(8))
    elif not at.end:
        end = beg + 1
    rows = rows.select(field(at.contig).alias("contig"), beg.alias("beg"), end.cast("long").alias("end"), "line", *offsets)
    return rows.where("contig IS NOT NULL AND contig <> '' AND beg IS NOT NULL AND end IS NOT NULL AND end >= beg")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """contig, beg, end, name, score, strand."""
    f = F.split("line", "\t")
    return read_features(spark, path, "bed").select("contig", "beg", "end", F.get(f, F.lit(3)).alias("name"), F.get(f, F.lit(4)).try_cast("double").alias("score"), F.get(f, F.lit(5)).alias("strand"))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """contig, beg (0-based), end, source, type, score, strand, phase, attributes (a map)."""
    f = F.split("line", "\t")
    col = lambda k: F.get(f, F.lit(k))
    return read_features(spark, path, "gff").select("contig", "beg", "end", col(1).alias("source"), col(2).alias("type"), col(5).try_cast("double").alias("score"), col(6).alias("strand"), col(7).alias("phase"), F.str_to_map(col(8), F.lit(";"), F.lit("=")).alias("attributes"))


def variant_header(spark: SparkSession, path: str) -> str:
    """The header of a variant file: one document, read by the driver."""
    return "\n".join(bgzf.leading_lines(spark, path, lambda line: line.startswith("#")))


def read_vcf(spark: SparkSession, path: str, samples: list[str] | None = None) -> DataFrame:
    """contig, pos (0-based), end, id, ref, alts, qual, filters, info (a map), samples (array of sample, gt,
    and fields as a map). Sample names come from the header unless given."""
    if samples is None:
        heads = [h for h in variant_header(spark, path).splitlines() if h.startswith("#CHROM")]
        samples = heads[0].split("\t")[9:] if heads else []
    rows = bgzf.text_lines(spark, path).where(~F.col("line").startswith("#") & (F.col("line") != "")).select(F.split("line", "\t").alias("f"))
    at = lambda k: F.get("f", F.lit(k))
    pos = at(1).cast("long") - 1
    names = F.array(*[F.lit(s) for s in samples]).cast("array<string>")
    fields = lambda s: F.map_from_arrays(F.slice(F.split(at(8), ":"), F.lit(1), F.size(F.split(s, ":"))), F.split(s, ":"))
    genotype = lambda s: F.struct(s["n"].alias("sample"), parse_genotype(F.element_at(fields(s["v"]), F.lit("GT"))).alias("gt"), fields(s["v"]).alias("fields"))
    sampled = F.transform(F.zip_with(names, F.slice("f", 10, 1 << 30), lambda n, v: F.struct(n.alias("n"), v.alias("v"))), genotype)
    return rows.select(
        at(0).alias("contig"), pos.alias("pos"), variant_end(pos, at(3), at(7)).alias("end"), F.when(at(2) != ".", at(2)).alias("id"), at(3).alias("ref"),
        F.when(at(4) == ".", F.array().cast("array<string>")).otherwise(F.split(at(4), ",")).alias("alts"), at(5).try_cast("double").alias("qual"), parse_filters(at(6)).alias("filters"), parse_info(at(7)).alias("info"), sampled.alias("samples"),
    )


def vcf_text(variants: DataFrame) -> DataFrame:
    """Lines (value) of variants, with FORMAT and samples if there is a column ``samples`` and it holds any."""
    dot = lambda c: F.when(F.coalesce(c, F.lit("")) == "", F.lit(".")).otherwise(c)
    qual = F.when(F.col("qual") == F.floor("qual"), F.floor("qual").cast("string")).otherwise(F.col("qual").cast("string"))
    fields = ["contig", (F.col("pos") + 1).cast("string"), dot(F.col("id")), "ref", dot(F.array_join("alts", ",")), dot(qual), dot(F.array_join("filters", ";")), info_text(F.col("info"))]
    if "samples" in variants.columns:
        fields.append(F.when(F.size("samples") > 0, sample_text(F.col("samples"))))
    return variants.select(F.concat_ws("\t", *fields).alias("value"))


def _fastq_rows(p) -> Iterator[tuple]:
    held: list[tuple[int, int, bool, str]] = []
    for item in bgzf.lines_between(p.path, p.beg, p.end, p.blocked):
        held.append(item)
        while len(held) >= 4:
            a, b, c, d = (h[3] for h in held[:4])
            if not (a.startswith("@") and c.startswith("+") and len(b) == len(d)):
                held.pop(0)  # not yet at a record
                continue
            if not held[0][2]:
                return
            name, _, comment = a[1:].partition(" ")
            yield name, comment or None, b, d
            held = held[4:]
        if held and not held[0][2] and len(held) >= 4:
            return


def _fasta_rows(p) -> Iterator[tuple]:
    name, comment, parts, live = None, None, [], False
    for _, _, owned, line in bgzf.lines_between(p.path, p.beg, p.end, p.blocked):
        if line.startswith(">"):
            if live:
                seq = "".join(parts)
                yield name, comment, seq, len(seq)
            name, _, rest = line[1:].partition(" ")
            comment, parts, live = rest or None, [], owned
            if not owned:
                return
        elif live:
            parts.append("".join(line.split()))
    if live:
        seq = "".join(parts)
        yield name, comment, seq, len(seq)


class FastqSource(DataSource):
    """``spark.read.format("fastq").load(path)``: four-line records."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "name string, comment string, seq string, qual string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return bgzf._Reader(self.options, _fastq_rows, schema)


class FastaSource(DataSource):
    """``spark.read.format("fasta").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "name string, comment string, seq string, length long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return bgzf._Reader(self.options, _fasta_rows, schema)


def read_fastq(spark: SparkSession, path: str, split: int = bgzf.SPLIT) -> DataFrame:
    """Reads of a FASTQ file, plain or blocked."""
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq").option("split", split).load(path)


def read_fasta(spark: SparkSession, path: str, split: int = bgzf.SPLIT) -> DataFrame:
    """Sequences of a FASTA file, plain or blocked."""
    spark.dataSource.register(FastaSource)
    return spark.read.format("fasta").option("split", split).load(path)


def sequence_index(lines: list[str]) -> list[tuple[str, int, int, int, int]]:
    """(name, length, offset, bases per line, bytes per line) of sequences in a FASTA file's lines (with
    their ends). Lines of one sequence but the last must be equally long."""
    out: list[tuple[str, int, int, int, int]] = []
    at, short = 0, False
    for line in lines:
        size = len(line.encode())
        if line.startswith(">"):
            out.append((line[1:].split()[0] if line[1:].split() else "", 0, at + size, 0, 0))
            short = False
        elif out:
            bases = len("".join(line.split()))
            name, length, offset, per, width = out[-1]
            if bases and short:
                raise ValueError(f"lines of {name} differ in length")
            if not per:
                per, width = bases, size
            short = bases < per
            if bases > per:
                raise ValueError(f"lines of {name} differ in length")
            out[-1] = (name, length + bases, offset, per, width)
        at += size
    return out


def parse_index(data: bytes) -> dict[str, list[tuple]]:
    """A coordinate index file (inflated) as rows: ``contigs`` (refid, name), ``bins`` (refid, bin,
    chunk_beg, chunk_end), ``linear`` (refid, win, voff), ``stats`` (refid, off_beg, off_end, n_mapped,
    n_unmapped) and ``scheme`` (min_shift, n_levels)."""
    magic, at = data[:4], 4
    i32 = lambda k: struct.unpack_from("<i", data, k)[0]
    out: dict[str, list[tuple]] = {"contigs": [], "bins": [], "linear": [], "stats": [], "scheme": []}
    shift, levels = 14, 5
    deep = magic == b"CSI\1"
    if deep:
        shift, levels, extra = struct.unpack_from("<iii", data, at)
        at += 12 + extra
    elif magic not in (b"TBI\1", b"BAI\1"):
        raise ValueError("no index of a known kind")
    n_ref = i32(at)
    at += 4
    if magic == b"TBI\1":
        size = i32(at + 24)
        names = data[at + 28 : at + 28 + size].split(b"\0")[:n_ref]
        out["contigs"] = [(k, n.decode()) for k, n in enumerate(names)]
        at += 28 + size
    out["scheme"].append((shift, levels))
    pseudo = ((1 << 3 * (levels + 1)) - 1) // 7 + 1
    for ref in range(n_ref):
        n_bins, at = i32(at), at + 4
        for _ in range(n_bins):
            b, at = struct.unpack_from("<I", data, at)[0], at + 4
            at += 8 * deep
            n, at = i32(at), at + 4
            pairs = list(struct.iter_unpack("<QQ", data[at : at + 16 * n]))
            at += 16 * n
            if b == pseudo:
                out["stats"].append((ref, *pairs[0], *pairs[1]))
            else:
                out["bins"] += [(ref, b, *p) for p in pairs]
        if not deep:
            n, at = i32(at), at + 4
            out["linear"] += [(ref, k, v) for k, (v,) in enumerate(struct.iter_unpack("<Q", data[at : at + 8 * n]))]
            at += 8 * n
    return out


def index_stream(contigs: list[str], bins: Iterator[tuple], linear: Iterator[tuple], stats: list[tuple], n_bins: dict[int, int], n_chunks: dict[tuple[int, int], int], n_linear: dict[int, int], layout: Layout, kind: int = 0) -> Iterator[bytes]:
    """The bytes of an index file (inflated) for a text layout, from rows of ``parse_index`` in order of
    refid and bin or window, and how many there are of each."""
    names = b"".join(c.encode() + b"\0" for c in contigs)
    yield b"TBI\1" + struct.pack("<8i", len(contigs), kind | (0x10000 if layout.zero_based else 0), layout.contig, layout.beg, layout.end, ord(layout.comment), layout.skip, len(names)) + names
    told = {s[0]: s[1:] for s in stats}
    for ref in range(len(contigs)):
        yield struct.pack("<i", n_bins.get(ref, 0) + (ref in told))
        for _ in range(n_bins.get(ref, 0)):
            _, b, *pair = next(bins)
            n = n_chunks[ref, b]
            yield struct.pack("<Ii", b, n) + struct.pack("<QQ", *pair)
            for _ in range(n - 1):
                yield struct.pack("<QQ", *next(bins)[2:])
        if ref in told:
            yield struct.pack("<IiQQQQ", 37450, 2, *told[ref])
        yield struct.pack("<i", n_linear.get(ref, 0))
        for _ in range(n_linear.get(ref, 0)):
            yield struct.pack("<Q", next(linear)[2])


def index_bytes(contigs: list[str], bins: list[tuple], linear: list[tuple], stats: list[tuple], layout: Layout, kind: int = 0) -> bytes:
    """An index file (inflated) as ``index_stream`` makes it, from lists of rows."""
    from collections import Counter

    chunks = Counter((r[0], r[1]) for r in bins)
    return b"".join(index_stream(contigs, iter(sorted(bins)), iter(sorted(linear)), stats, Counter(r for r, _ in chunks), chunks, Counter(r[0] for r in linear), layout, kind))


_INDEX = {
    "contigs": "refid int, contig string",
    "bins": "refid int, bin int, chunk_beg long, chunk_end long",
    "linear": "refid int, win int, voff long",
    "stats": "refid int, off_beg long, off_end long, n_mapped long, n_unmapped long",
    "scheme": "min_shift int, n_levels int",
}


def contig_places(path: str) -> tuple[dict[str, list[tuple]], list[tuple[int, int, int]], bool]:
    """(contigs and scheme as ``parse_index`` gives them, (refid, begin, end) of each contig's inflated bytes,
    whether chunks carry offsets of their own) of a blocked or plain index file, which is passed block by block:
    no more than a block and a header is held."""
    data, base, at = b"", 0, 0  # one block, where it begins, and the place at hand, in inflated bytes
    blocked = bgzf.is_blocked(path)
    system, inner, size = bgzf.open_file(path)

    def source() -> Iterator[bytes]:
        if blocked:
            yield from (bgzf.inflate(block) for _, block in bgzf.read_blocks_between(path, 0, 1 << 62))
            return
        with system.open_input_file(inner) as f:
            yield from (f.read_at(min(1 << 20, size - k), k) for k in range(0, size, 1 << 20))

    more = source()

    def block_at_hand() -> None:
        nonlocal data, base
        while base + len(data) <= at:
            base += len(data)
            data = next(more, None)
            if data is None:
                raise ValueError("index is cut short")

    def take(n: int) -> bytes:
        nonlocal at
        out = b""
        while len(out) < n:
            block_at_hand()
            piece = data[at - base : at - base + n - len(out)]
            out, at = out + piece, at + len(piece)
        return out

    def skip(n: int) -> None:
        nonlocal at
        at += n

    i32 = lambda: struct.unpack("<i", take(4))[0]
    out: dict[str, list[tuple]] = {"contigs": [], "scheme": []}
    magic, shift, levels = take(4), 14, 5
    deep = magic == b"CSI\1"
    if deep:
        shift, levels, extra = struct.unpack("<iii", take(12))
        skip(extra)
    elif magic not in (b"TBI\1", b"BAI\1"):
        raise ValueError("no index of a known kind")
    n_ref = i32()
    if magic == b"TBI\1":
        skip(24)
        names = take(i32()).split(b"\0")[:n_ref]
        out["contigs"] = [(k, n.decode()) for k, n in enumerate(names)]
    out["scheme"].append((shift, levels))
    places = []
    for ref in range(n_ref):
        beg = at
        for _ in range(i32()):
            skip(4 + 8 * deep)
            skip(16 * i32())
        if not deep:
            skip(8 * i32())
        places.append((ref, beg, at))
    return out, places, deep


def parse_contig(data: bytes, deep: bool, levels: int) -> tuple[list, list, list, list, tuple | None]:
    """(bins, begins, ends of chunks, offsets of windows, statistics) of one contig's bytes in an index file."""
    at, bins, begs, ends, told = 4, [], [], [], None
    pseudo = ((1 << 3 * (levels + 1)) - 1) // 7 + 1
    for _ in range(struct.unpack_from("<i", data)[0]):
        b = struct.unpack_from("<I", data, at)[0]
        at += 4 + 8 * deep
        n = struct.unpack_from("<i", data, at)[0]
        pairs = struct.unpack_from(f"<{2 * n}Q", data, at + 4)
        at += 4 + 16 * n
        if b == pseudo:
            told = pairs[:4]
        else:
            bins += [b] * n
            begs += pairs[::2]
            ends += pairs[1::2]
    linear = [] if deep else list(struct.unpack_from(f"<{struct.unpack_from('<i', data, at)[0]}Q", data, at + 4))
    return bins, begs, ends, linear, told


def load_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a coordinate index file, by the names of ``parse_index``. The driver looks where contigs
    begin; tasks read and parse them, one at a time."""
    found, places, deep = contig_places(path)
    levels, blocked = found["scheme"][0][1], bgzf.is_blocked(path)
    out = {name: spark.createDataFrame(found[name], _INDEX[name]) for name in ("contigs", "scheme")}
    if blocked and places:
        # where the block of each begin is, told from the blocks' sizes alone
        starts, at = [], 0
        todo = iter(places)
        ref, beg, end = next(todo)
        for offset, block in bgzf.read_blocks_between(path, 0, 1 << 62):
            size = struct.unpack("<I", block[-4:])[0]
            while at <= beg < at + size:
                starts.append((ref, offset, beg - at, end - beg))
                if (following := next(todo, None)) is None:
                    break
                ref, beg, end = following
            if len(starts) == len(places):
                break
            at += size
    else:
        starts = [(ref, beg, 0, end - beg) for ref, beg, end in places]
    table = spark.createDataFrame(starts, "refid int, _block long, _skip int, _size long").repartition(max(1, min(len(starts) // 16, 4 * spark.sparkContext.defaultParallelism)))

    def bytes_of(block: int, skip: int, size: int) -> bytes:
        if not blocked:
            system, inner, _ = bgzf.open_file(path)
            with system.open_input_file(inner) as f:
                return f.read_at(size, block)
        parts, held = [], 0
        for _, raw in bgzf.read_blocks_between(path, block, 1 << 62):
            parts.append(bgzf.inflate(raw))
            held += len(parts[-1])
            if held >= skip + size:
                break
        return b"".join(parts)[skip : skip + size]

    def part(name: str) -> DataFrame:
        import pyarrow as pa

        def run(batches):
            for b in batches:
                for ref, *where in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    bins, begs, ends, linear, told = parse_contig(bytes_of(*where), deep, levels)
                    if name == "bins":
                        columns = [[ref] * len(bins), bins, begs, ends]
                    elif name == "linear":
                        columns = [[ref] * len(linear), range(len(linear)), linear]
                    else:
                        columns = [[v] for v in (ref, *told)] if told else [[]] * 5
                    fields = [f.split() for f in _INDEX[name].split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if f[1] == "int" else pa.int64()) for c, f in zip(columns, fields, strict=True)], names=[f[0] for f in fields])

        return table.mapInArrow(run, _INDEX[name])

    return out | {name: part(name) for name in ("bins", "linear", "stats")}


def write_index(path: str, contigs: list[str], bins: DataFrame, linear: DataFrame, stats: DataFrame, layout: Layout) -> None:
    """Write tables with refid as a blocked index file. Contigs are put into bytes where their rows are, one at
    a time, and parts are joined. A window that ``linear`` lacks has the offset of the next one it has."""
    import pyarrow as pa

    spark = bins.sparkSession
    ids = spark.range(len(contigs)).select(F.col("id").cast("int").alias("refid"))
    chunks = bins.groupBy("refid").agg(F.sort_array(F.collect_list(F.struct("bin", "chunk_beg", "chunk_end"))).alias("_bins"))
    windows = linear.groupBy("refid").agg(F.sort_array(F.collect_list(F.struct("win", "voff"))).alias("_linear"))
    told = stats.select("refid", F.array("off_beg", "off_end", "n_mapped", "n_unmapped").alias("_told"))
    rows = ids.join(chunks, "refid", "left").join(windows, "refid", "left").join(told, "refid", "left").orderBy("refid")

    def run(batches):
        for whole in batches:
            for k in range(whole.num_rows):
                b = whole.slice(k, 1)
                one = lambda name, field: b.column(name).flatten().field(field).to_pylist() if b.column(name)[0].is_valid else []  # noqa: E731, B023
                bin_, beg, end, told_ = one("_bins", 0), one("_bins", 1), one("_bins", 2), b.column("_told")[0].as_py()
                borders = [i for i in range(len(bin_)) if not i or bin_[i] != bin_[i - 1]] + [len(bin_)]
                out = [struct.pack("<i", len(borders) - 1 + (told_ is not None))]
                for i, j in zip(borders, borders[1:], strict=False):
                    out.append(struct.pack(f"<Ii{2 * (j - i)}Q", bin_[i], j - i, *(v for pair in zip(beg[i:j], end[i:j], strict=True) for v in pair)))
                if told_ is not None:
                    out.append(struct.pack("<IiQQQQ", 37450, 2, *told_))
                wins, last = one("_linear", 0), -1
                out.append(struct.pack("<i", wins[-1] + 1 if wins else 0))
                for win, voff in zip(wins, one("_linear", 1), strict=True):
                    out.append(struct.pack("<Q", voff) * (win - last))
                    last = win
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["value"])

    folder = f"{path}-parts"
    bgzf.write(rows.mapInArrow(run, "value binary"), folder)
    head = next(index_stream(contigs, iter(()), iter(()), [], {}, {}, {}, layout))
    with bgzf.open_output(f"{folder}/header.gz") as f:
        f.write(bgzf.compress(head, end=False))
    bgzf.join_parts(folder, path)


REGION_KINDS = ("bed", "tab", "reg", "vcf")
FARTHEST = 1 << 35  # Fixed value: where a region without an end ends.


def regions_of(rows: DataFrame, kind: str) -> DataFrame:
    """(contig, beg, end 0-based half-open, payload) of lines of a region list.

    ``bed``: contig, 0-based begin, end. ``tab``: contig, 1-based begin, inclusive end or none (one base).
    ``vcf``: contig, 1-based position. ``reg``: contig:from-to, contig:from (one base), contig:from- (to
    the end). A contig alone is the whole contig; blank lines and comments are left out, as are lines
    that do not parse. Payload is what follows on the line."""
    if kind not in REGION_KINDS:
        raise ValueError(f"no region lists of kind {kind}")
    text = F.ltrim("line")
    rows = rows.select(text.alias("line")).where("line <> '' AND NOT startswith(line, '#')")
    number = lambda c: F.regexp_replace(c, ",", "").try_cast("long")
    if kind == "reg":
        part = lambda k: F.regexp_extract("line", r"^([^:\s]+)(?::([0-9,]+)(-?)([0-9,]*))?", k)
        beg, last = number(part(2)), number(part(4))
        end = F.when(last.isNotNull(), last).when(part(3) == "-", F.lit(FARTHEST)).otherwise(beg)
        contig, rest = part(1), F.trim(F.regexp_extract("line", r"^\S+\s*(.*)$", 1))
        alone = ~F.regexp_extract("line", r"^(\S+)", 1).contains(":")
    else:
        f = F.split("line", r"\s+")
        at = lambda k: F.get(f, F.lit(k))
        beg, last = number(at(1)), F.lit(None).cast("long") if kind == "vcf" else number(at(2))
        contig, alone = at(0), at(1).isNull() | (at(1) == "")
        beg = beg + 1 if kind == "bed" else beg
        end = F.coalesce(last, beg) if kind != "bed" else last
        taken = F.when(last.isNull(), 2).otherwise(3)
        rest = F.array_join(F.slice(f, taken + 1, F.greatest(F.size(f) - taken, F.lit(0))), "\t")
    found = rows.select(contig.alias("contig"), F.when(alone, 0).otherwise(beg - 1).cast("long").alias("beg"), F.when(alone, FARTHEST).otherwise(end).cast("long").alias("end"), rest.alias("payload"))
    return found.where("contig <> '' AND beg >= 0 AND end > beg")


def read_regions(spark: SparkSession, path: str, kind: str = "bed") -> DataFrame:
    """Regions of a file, by one of ``REGION_KINDS``."""
    return regions_of(bgzf.text_lines(spark, path), kind)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(line) of a file of names: without blank lines."""
    return bgzf.text_lines(spark, path).select(F.trim("line").alias("line")).where("line <> ''")


def filed_features(features: DataFrame) -> DataFrame:
    """Features read with offsets as records (contig, beg, end, line, voff, next_voff): the next record is
    the contig's next one in the file, found by stretches of the file read backwards."""
    from spanforge.functions.bins import virtual_offset
    from spanforge.operators.indexing import FILE_BITS
    from spanforge.operators.stretches import before

    rows = features.withColumn("voff", virtual_offset(F.col("coffset"), F.col("uoffset"))).withColumn("_back", -F.col("voff"))
    rows = before(rows, ["contig"], ["_back"], F.shiftright("_back", FILE_BITS), "voff", "_after")
    return rows.withColumn("next_voff", F.coalesce("_after", F.col("voff") + 1)).drop("coffset", "uoffset", "_back", "_after")


def query_file(spark: SparkSession, path: str, layout: Layout | str, chunks: DataFrame, linear: DataFrame, contig, beg: int, end: int) -> DataFrame:
    """Features of a blocked, indexed file that overlap a region; only the blocks that the index names
    are read. chunks and linear: tables with contig, as made by ``operators.indexing``."""
    from spanforge.operators.indexing import query_chunks

    ranges = [tuple(r) for r in query_chunks(linear, chunks, contig, beg, end).collect()]  # of one region: few
    lines = bgzf.chunk_lines(spark, path, ranges)
    found = features_of(lines, layout)
    return found.where((F.col("contig") == contig) & (F.col("beg") < end) & (F.col("end") > beg))


def fetch_bases(path: str, index: tuple[str, int, int, int, int], beg: int, end: int) -> str:
    """Bases [beg, end) of a sequence in a plain FASTA file, by its entry of ``sequence_index``."""
    _, length, offset, per, width = index
    beg, end = max(beg, 0), min(end, length)
    if beg >= end:
        return ""
    system, inner, _ = bgzf.open_file(path)
    first, last = offset + beg // per * width + beg % per, offset + (end - 1) // per * width + (end - 1) % per
    with system.open_input_file(inner) as f:
        return "".join(f.read_at(last + 1 - first, first).decode().split())


def read_slice_index(spark: SparkSession, path: str) -> DataFrame:
    """A container index (gzip text): refid, beg (0-based), end, container, slice, size."""
    f = F.split("value", "\t")
    at = lambda k: F.get(f, F.lit(k)).cast("long")
    rows = spark.read.text(path).where("value <> ''")
    return rows.select(at(0).cast("int").alias("refid"), (at(1) - 1).alias("beg"), (at(1) - 1 + at(2)).alias("end"), at(3).alias("container"), at(4).alias("slice"), at(5).alias("size"))


def detect_format(data: bytes) -> str:
    """The format of a file by its first bytes; of blocked and gzip files that of what is inside."""
    if bgzf.block_size(data) is not None:
        try:
            return "blocked " + detect_format(bgzf.inflate(data[: bgzf.block_size(data)]))
        except (bgzf.BlockError, struct.error):
            return "blocked"
    if data[:2] == b"\x1f\x8b":
        import zlib

        return "gzip " + detect_format(zlib.decompressobj(31).decompress(data, 4096))
    for magic, name in ((b"BAM\1", "bam"), (b"CRAM", "cram"), (b"BCF\2", "bcf"), (b"BAI\1", "bai"), (b"TBI\1", "tbi"), (b"CSI\1", "csi")):
        if data.startswith(magic):
            return name
    text = data[:4096].decode("utf-8", "replace")
    first = text.split("\n")[0]
    fields = first.split("\t")
    if text.startswith("##fileformat=VCF") or text.startswith("#CHROM"):
        return "vcf"
    if text[:1] == "@" and len(fields[0]) == 3 and len(fields) > 1:
        return "sam"
    if text[:1] == "@":
        return "fastq"
    if text[:1] == ">":
        return "fasta"
    if text.startswith("##gff"):
        return "gff"
    if len(fields) >= 11 and fields[1].isdigit() and fields[3].isdigit():
        return "sam"
    if len(fields) >= 8 and fields[3].isdigit() and fields[4].isdigit():
        return "gff"
    if len(fields) >= 3 and fields[1].isdigit() and fields[2].isdigit():
        return "bed"
    return "text" if text else "empty"
