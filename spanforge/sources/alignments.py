"""Alignment files: SAM text and BAM binary, read in parallel, and written."""

from __future__ import annotations

import functools
import operator
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StructType

from spanforge.functions.sequence import parse_cigar, parse_tags
from spanforge.sources import bgzf

# Codes of bases and of CIGAR operations in the binary format.
BASES = "=ACMGRSVTWYHKDBN"
OPERATIONS = "MIDNSHP=XB"
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4, "d": 8}
_FORMATS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f", "d": "d"}

SCHEMA = "qname string, flag int, refid int, rname string, pos long, mapq int, cigar_text string, mate_refid int, rnext string, mate_pos long, tlen long, seq string, qual string, tags map<string,struct<type:string,value:string>>, coffset long, uoffset int"


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of SAM text (plain, gzip or blocked files), in ``SCHEMA`` without the file offsets. pos
    is 0-based, -1 if there is none."""
    lines = bgzf.text_lines(spark, path).where(~F.col("line").rlike("^@[A-Z]{2}\t") & (F.col("line") != ""))
    f = F.split("line", "\t")
    at = lambda k: F.get(F.col("f"), F.lit(k))
    rows = lines.select(f.alias("f"))
    return rows.select(
        at(0).alias("qname"), at(1).cast("int").alias("flag"), at(2).alias("rname"), (at(3).cast("long") - 1).alias("pos"), at(4).cast("int").alias("mapq"), at(5).alias("cigar_text"),
        F.when(at(6) == "=", at(2)).otherwise(at(6)).alias("rnext"), (at(7).cast("long") - 1).alias("mate_pos"), at(8).cast("long").alias("tlen"), at(9).alias("seq"), at(10).alias("qual"), parse_tags(F.slice("f", 12, 1 << 30)).alias("tags"),
    ).withColumn("cigar", parse_cigar(F.col("cigar_text")))


def sam_text(rows: DataFrame) -> DataFrame:
    """Lines (value) of alignments."""
    star = lambda c: F.coalesce(F.col(c), F.lit("*"))
    tags = F.transform(F.map_entries("tags"), lambda e: F.concat(e["key"], F.lit(":"), e["value"]["type"], F.lit(":"), e["value"]["value"]))
    next_ = F.when((F.col("rnext") == F.col("rname")) & (F.col("rnext") != "*"), "=").otherwise(star("rnext"))
    fields = ["qname", F.col("flag").cast("string"), star("rname"), (F.col("pos") + 1).cast("string"), F.col("mapq").cast("string"), star("cigar_text"), next_, (F.col("mate_pos") + 1).cast("string"), F.col("tlen").cast("string"), star("seq"), star("qual"), F.when(F.size("tags") > 0, F.array_join(tags, "\t"))]
    return rows.select(F.concat_ws("\t", *fields).alias("value"))


def sam_header(spark: SparkSession, path: str) -> str:
    """The header lines of SAM text. A header is one document, read by the driver."""
    return "\n".join(bgzf.leading_lines(spark, path, lambda line: re.match(r"@[A-Z]{2}\t", line)))


def parse_bam_header(data: bytes) -> tuple[str, list[tuple[str, int]], int]:
    """(text, contigs with lengths, bytes used) from the inflated start of a file."""
    if data[:4] != b"BAM\1":
        raise bgzf.BlockError("not a binary alignment file")
    size = struct.unpack_from("<i", data, 4)[0]
    text, at = data[8 : 8 + size].split(b"\0")[0].decode(), 8 + size
    contigs, at = [], at + 4
    for _ in range(struct.unpack_from("<i", data, at - 4)[0]):
        n = struct.unpack_from("<i", data, at)[0]
        contigs.append((data[at + 4 : at + 3 + n].decode(), struct.unpack_from("<i", data, at + 4 + n)[0]))
        at += 8 + n
    return text, contigs, at


def bam_header_bytes(text: str, contigs: list[tuple[str, int]]) -> bytes:
    """The inflated header of a binary file."""
    raw = text.encode()
    names = b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", length) for n, length in contigs)
    return b"BAM\1" + struct.pack("<i", len(raw)) + raw + struct.pack("<i", len(contigs)) + names


def _read_header(path: str) -> tuple[str, list[tuple[str, int]], tuple[int, int]]:
    """Header and where the first record starts: (text, contigs, (coffset, uoffset))."""

    def parse(data: bytes) -> tuple[tuple[str, list[tuple[str, int]]], int]:
        text, contigs, used = parse_bam_header(data)
        return (text, contigs), used

    (text, contigs), *first = bgzf.header_between(path, parse)
    return text, contigs, tuple(first)


def _tags(data: bytes, at: int, end: int) -> dict[str, tuple[str, str]]:
    out: dict[str, tuple[str, str]] = {}
    while at + 3 <= end:
        name, kind = data[at : at + 2].decode("latin1"), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            stop = data.index(b"\0", at)
            value, at = data[at:stop].decode("latin1"), stop + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            numbers = struct.unpack_from(f"<{n}{_FORMATS[sub]}", data, at + 5)
            value, at = ",".join([sub, *(f"{x:g}" if sub == "f" else str(x) for x in numbers)]), at + 5 + n * _SIZES[sub]
        elif kind == "A":
            value, at = chr(data[at]), at + 1
        else:
            number = struct.unpack_from("<" + _FORMATS[kind], data, at)[0]
            value, at = f"{number:g}" if kind in "fd" else str(number), at + _SIZES[kind]
            kind = "f" if kind in "fd" else "i"
        out.setdefault(name, (kind, value))
    return out


def decode_record(data: bytes, at: int, contigs: list[tuple[str, int]], wanted: set[str] | None = None) -> tuple:
    """One record (its size field at ``at``) as a row of ``SCHEMA`` without offsets; bases, qualities and
    tags are None unless wanted."""
    size = struct.unpack_from("<i", data, at)[0]
    end, at = at + 4 + size, at + 4
    refid, pos, l_name, mapq, _, n_ops, flag, l_seq, mate, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", data, at)
    at += 32
    name, at = data[at : at + l_name - 1].decode("latin1"), at + l_name
    cigar, at = _cigar_text(data[at : at + 4 * n_ops]), at + 4 * n_ops
    packed, at = data[at : at + (l_seq + 1) // 2], at + (l_seq + 1) // 2
    seq = ("".join([_PAIRS[b] for b in packed])[:l_seq] or "*") if wanted is None or "seq" in wanted else None
    raw, at = data[at : at + l_seq], at + l_seq
    qual = None
    if wanted is None or "qual" in wanted:
        qual = "*" if not l_seq or raw[0] == 255 else raw.translate(_LETTERS).decode("latin1")
    tags = _tags(data, at, end) if wanted is None or "tags" in wanted else None
    contig = lambda k: contigs[k][0] if k >= 0 else "*"
    return name, flag, refid, contig(refid), pos, mapq, cigar, mate, contig(mate), mate_pos, tlen, seq, qual, tags


def _bin(beg: int, end: int) -> int:
    end = max(end - 1, beg)
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if beg >> shift == end >> shift:
            return first + (beg >> shift)
    return 0


def tag_values(tags: dict | None) -> Iterator[tuple[bytes, bytes, bytes]]:
    """(key, type, binary value) of a row's tags, in order of their keys."""
    for key, entry in sorted((tags or {}).items()):
        kind, value = entry["type"], entry["value"]
        if kind in "ZH":
            yield key.encode(), kind.encode(), value.encode("latin1") + b"\0"
        elif kind == "A":
            yield key.encode(), b"A", value.encode("latin1")[:1]
        elif kind == "B":
            sub, *numbers = value.split(",")
            yield key.encode(), b"B", sub.encode() + struct.pack(f"<i{len(numbers)}{_FORMATS[sub]}", len(numbers), *(float(x) if sub == "f" else int(x) for x in numbers))
        elif kind in "fd":
            yield key.encode(), b"f", struct.pack("<f", float(value))
        elif int(value) < 1 << 31:
            yield key.encode(), b"i", struct.pack("<i", int(value))
        else:
            yield key.encode(), b"I", struct.pack("<I", int(value))


_CODES = bytes(BASES.find(chr(c)) if chr(c) in BASES else 15 for c in range(256))
_UPPER = bytes(c << 4 & 0xF0 for c in range(256))
_SCORES = bytes(max(c - 33, 0) for c in range(256))
_LETTERS = bytes(min(q + 33, 255) for q in range(256))
_PAIRS = [BASES[b >> 4] + BASES[b & 15] for b in range(256)]


@functools.lru_cache(1 << 14)
def _packed_cigar(text: str | None) -> tuple[bytes, int]:
    """(packed operations, positions of the reference) of a CIGAR."""
    ops, digits = [], ""
    for c in "" if text in (None, "*") else text:
        if c.isdigit():
            digits += c
        else:
            ops.append(int(digits) << 4 | OPERATIONS.index(c))
            digits = ""
    return struct.pack(f"<{len(ops)}I", *ops), sum(o >> 4 for o in ops if OPERATIONS[o & 15] in "MDN=X")


@functools.lru_cache(1 << 14)
def _cigar_text(packed: bytes) -> str:
    return "".join(f"{o >> 4}{OPERATIONS[o & 15]}" for (o,) in struct.iter_unpack("<I", packed)) or "*"


def encode_record(row: dict, refids: dict[str, int]) -> bytes:
    """A row of ``SCHEMA`` as a binary record, size field included."""
    name = (row["qname"] or "*").encode()[:254] + b"\0"
    ops, length = _packed_cigar(row["cigar_text"])
    seq = "" if row["seq"] in (None, "*") else row["seq"].upper()
    codes = seq.encode("latin1", "replace").translate(_CODES) + b"\0" * (len(seq) % 2)
    qual = b"\xff" * len(seq) if row["qual"] in (None, "*") else row["qual"].encode("latin1").translate(_SCORES)
    pos = row["pos"] if row["pos"] is not None else -1
    tags = b"".join(key + kind + value for key, kind, value in tag_values(row["tags"]))
    core = struct.pack(
        "<iiBBHHHiiii", refids.get(row["rname"], -1), pos, len(name), row["mapq"] or 0, _bin(max(pos, 0), max(pos, 0) + max(length, 1)), len(ops) // 4, row["flag"] or 0, len(seq), refids.get(row["rnext"], -1),
        row["mate_pos"] if row["mate_pos"] is not None else -1, row["tlen"] or 0,
    )
    body = core + name + ops + bytes(map(operator.add, codes[::2].translate(_UPPER), codes[1::2])) + qual + tags
    return struct.pack("<i", len(body)) + body


def _plausible(data: bytes, at: int, n_ref: int, whole: bool, depth: int = 3) -> bool | None:
    """Whether a chain of records may start at ``at``; None if the data ends before that can be told. ``whole``:
    the file ends with the data, and so must the chain."""
    for _ in range(depth):
        if at + 36 > len(data):
            return at == len(data) if whole else None
        size, refid, pos, l_name, _, _, n_ops, _, l_seq, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
        if not (32 < size < 1 << 26 and -1 <= refid < n_ref and -1 <= mate < n_ref and pos >= -1 and mate_pos >= -1 and l_name > 1 and l_seq >= 0 and 32 + l_name + 4 * n_ops + (l_seq + 1) // 2 + l_seq <= size):
            return False
        name = data[at + 36 : at + 36 + l_name]
        if len(name) == l_name and (name[-1] != 0 or any(c < 33 or c > 126 for c in name[:-1])):
            return False
        at += 4 + size
    return True


def _record_size(data: bytes, at: int) -> int | None:
    return 4 + struct.unpack_from("<i", data, at)[0] if at + 4 <= len(data) else None


def _bam_rows(p, wanted: list[str]) -> Iterator[tuple]:
    _, contigs, first = _read_header(p.path)
    plausible = lambda d, k, whole: _plausible(d, k, len(contigs), whole)
    found = bgzf.records_between(p.path, p.beg, p.end, first, _record_size, plausible)
    columns = set(wanted)
    rows = ((*decode_record(data, at, contigs, columns), coffset, uoffset) for data, at, coffset, uoffset in found)
    return bgzf.picked(rows, list(bgzf.columns_of(SCHEMA)), wanted)


class BamSource(DataSource):
    """``spark.read.format("bam").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return bgzf._Reader(self.options, functools.partial(_bam_rows, wanted=schema.names), schema)


def read_bam(spark: SparkSession, path: str, split: int = bgzf.SPLIT, columns: list[str] | None = None) -> DataFrame:
    """Alignments of a binary file, with a parsed CIGAR; only the named columns of ``SCHEMA`` are decoded."""
    spark.dataSource.register(BamSource)
    return with_cigar(spark.read.format("bam").schema(bgzf.narrowed(SCHEMA, columns)).option("split", split).load(path))


def with_cigar(rows: DataFrame) -> DataFrame:
    """With a parsed CIGAR if its text was read."""
    return rows.withColumn("cigar", parse_cigar(F.col("cigar_text"))) if "cigar_text" in rows.columns else rows


def bam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """(refid, contig, length) of a binary file's header."""
    _, contigs, _ = _read_header(path)
    return spark.createDataFrame([(k, n, size) for k, (n, size) in enumerate(contigs)], "refid int, contig string, length long")


def write_bam(rows: DataFrame, path: str, text: str, contigs: list[tuple[str, int]]) -> None:
    """Write alignments as a folder of blocked parts. The header is a part of its own, before the
    records' parts: concatenated in order of their names they are one binary file."""
    refids = {n: k for k, (n, _) in enumerate(contigs)}
    kept = rows.select("qname", "flag", "rname", "pos", "mapq", "cigar_text", "rnext", "mate_pos", "tlen", "seq", "qual", "tags")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = b"".join(encode_record(r, refids) for r in bgzf.records_of(b))
            yield pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], names=["value"])

    system, inner = bgzf.fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
    system.create_dir(inner, recursive=True)
    with system.open_output_stream(f"{inner}/header.gz", compression=None) as f:
        f.write(bgzf.compress(bam_header_bytes(text, contigs), end=False))
    bgzf.write(kept.mapInArrow(encoded, "value binary"), path)


def with_offsets(rows: DataFrame) -> Column:
    """The virtual offset of a record read from a binary file."""
    from spanforge.functions.bins import virtual_offset

    return virtual_offset(rows["coffset"], rows["uoffset"])
