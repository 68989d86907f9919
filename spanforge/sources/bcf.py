"""Binary variant files (BCF): header dictionaries and typed records, read to the schema of VCF, and written.

Strings and contigs are numbers into dictionaries that the header defines, so every task reads the
header.  Files split at any byte: a task looks for a chain of records whose contig, number of samples,
lengths and types of id and reference allele fit the header, and owns what starts in its range.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StructType

from spanforge.functions.variants import parse_genotype, variant_end
from spanforge.sources import bgzf

_KINDS = {1: ("b", 1), 2: ("h", 2), 3: ("i", 4), 5: ("f", 4), 7: ("s", 1)}
_MISSING = {1: -128, 2: -32768, 3: -2147483648}
_FLOAT_MISSING, _FLOAT_END = 0x7F800001, 0x7F800002

SCHEMA = "contig string, pos long, id string, ref string, alts array<string>, qual double, filters array<string>, info map<string,string>, samples array<struct<sample:string,fields:map<string,string>>>"


def dictionaries(text: str) -> tuple[dict[int, str], dict[int, str], list[str]]:
    """(strings, contigs, samples) of a header; PASS is string 0, and IDX overrides the order."""
    strings, contigs, samples = {0: "PASS"}, {}, []
    seen = {"PASS"}
    for line in text.splitlines():
        if line.startswith("#CHROM"):
            samples = line.split("\t")[9:]
        m = re.match(r"##(FILTER|INFO|FORMAT|contig)=<(.*)>", line)
        if not m:
            continue
        name, index = re.search(r"\bID=([^,>]+)", m[2])[1], re.search(r"\bIDX=(\d+)", m[2])
        table = contigs if m[1] == "contig" else strings
        if m[1] != "contig" and name in seen and not index:
            continue
        seen.add(name)
        table[int(index[1]) if index else (max(table) + 1 if table else 0)] = name
    return strings, contigs, samples


def _typed(data: bytes, at: int) -> tuple[int, int, int]:
    """(kind, number of values, offset behind) of a type descriptor."""
    kind, n, at = data[at] & 15, data[at] >> 4, at + 1
    if n == 15:
        (n,), at = _values(data, at + 1, data[at] & 15, 1), at + 1 + _KINDS[data[at] & 15][1]
    return kind, n, at


def _values(data: bytes, at: int, kind: int, n: int) -> list:
    """``n`` values; a missing one is None and the vector's end cuts the rest."""
    if not n or not kind:
        return []
    if kind == 7:
        return [data[at : at + n].split(b"\0")[0].decode("utf-8", "replace")]
    if kind == 5:
        bits = struct.unpack_from(f"<{n}I", data, at)
        numbers = struct.unpack_from(f"<{n}f", data, at)
        out = []
        for b, x in zip(bits, numbers, strict=True):
            if b == _FLOAT_END:
                break
            out.append(None if b == _FLOAT_MISSING else x)
        return out
    out = []
    for x in struct.unpack_from(f"<{n}{_KINDS[kind][0]}", data, at):
        if x == _MISSING[kind] + 1:
            break
        out.append(None if x == _MISSING[kind] else x)
    return out


def _text(values: list) -> str:
    return ",".join("." if v is None else f"{v:g}" if isinstance(v, float) else str(v) for v in values) or "."


def _genotype(codes: list) -> str:
    out = ""
    for k, c in enumerate(codes):
        out += ("|" if (c or 0) & 1 else "/") if k else ""
        out += "." if c is None or c >> 1 == 0 else str((c >> 1) - 1)
    return out or "."


def decode(data: bytes, at: int, strings: dict[int, str], contigs: dict[int, str], samples: list[str], wanted: set[str] | None = None) -> tuple[tuple, int]:
    """(row of ``SCHEMA``, offset behind) of the record at ``at``; samples are None unless wanted."""
    shared, own = struct.unpack_from("<II", data, at)
    k = at + 8
    contig, pos, _, qual, packed, packed2 = struct.unpack_from("<iiiIII", data, k)
    n_alleles, n_info, n_fields, n_samples = packed >> 16, packed & 0xFFFF, packed2 >> 24, packed2 & 0xFFFFFF
    k += 24

    def one(k: int) -> tuple[list, int]:
        kind, n, k = _typed(data, k)
        return _values(data, k, kind, n), k + n * (_KINDS[kind][1] if kind else 0)

    name, k = one(k)
    alleles = []
    for _ in range(n_alleles):
        a, k = one(k)
        alleles += a or ["."]
    filters, k = one(k)
    info: dict[str, str | None] = {}
    for _ in range(n_info):
        key, k = one(k)
        kind, n, _ = _typed(data, k)
        v, k = one(k)
        info[strings[key[0]]] = _text(v) if n and kind else None
    fields: list[dict[str, str]] = [{} for _ in range(n_samples)]
    k = at + 8 + shared
    for _ in range(n_fields if wanted is None or "samples" in wanted else 0):
        key, k = one(k)
        kind, n, k = _typed(data, k)
        width = n * (_KINDS[kind][1] if kind else 0)
        for s in range(n_samples):
            v = _values(data, k + s * width, kind, n)
            fields[s][strings[key[0]]] = _genotype(v) if strings[key[0]] == "GT" else _text(v)
        k += n_samples * width
    score = None if qual == _FLOAT_MISSING else struct.unpack("<f", struct.pack("<I", qual))[0]
    row = (contigs[contig], pos, name[0] if name and name[0] != "." else None, alleles[0] if alleles else "N", alleles[1:], score, [strings[x] for x in filters if x is not None], info, [(s, list(f.items())) for s, f in zip(samples, fields, strict=False)] if wanted is None or "samples" in wanted else None)
    return row, at + 8 + shared + own


def _parse_header(data: bytes) -> tuple[tuple, int]:
    """(dictionaries, bytes used) of the inflated start of a file."""
    if data[:3] != b"BCF"[: len(data)]:
        raise bgzf.BlockError("not a binary variant file")
    used = 9 + struct.unpack_from("<I", data, 5)[0]
    return (dictionaries(data[9:used].split(b"\0")[0].decode()) if used <= len(data) else None), used


def _record_size(data: bytes, at: int) -> int | None:
    return 8 + sum(struct.unpack_from("<II", data, at)) if at + 8 <= len(data) else None


def _plausible(data: bytes, at: int, contigs: dict[int, str], n_samples: int, whole: bool, depth: int = 3) -> bool | None:
    """Whether a chain of records may start at ``at``; None if the data ends before that can be told. ``whole``:
    the file ends with the data, and so must the chain."""
    for _ in range(depth):
        if at + 36 > len(data):
            return at == len(data) if whole else None
        shared, own, contig, pos, length, _, packed, packed2 = struct.unpack_from("<IIiiiIII", data, at)
        if not (26 <= shared < 1 << 28 and contig in contigs and pos >= -1 and length >= 0 and packed2 & 0xFFFFFF == n_samples and (own == 0 or (n_samples and packed2 >> 24))):
            return False
        k = at + 32
        for what in ("id", "ref")[: 1 + (packed >> 16 > 0)]:
            try:
                kind, n, k = _typed(data, k)
            except (IndexError, struct.error):
                return False if whole else None
            except (KeyError, TypeError, ValueError):
                return False
            if not isinstance(n, int) or k + n > at + 8 + shared or not (kind == 7 or (what == "id" and kind == n == 0)):
                return False
            k += n
        at += 8 + shared + own
    return True


def _rows(p, wanted: list[str] | None = None) -> Iterator[tuple]:
    tables, *first = bgzf.header_between(p.path, _parse_header)
    _, contigs, samples = tables
    names = list(bgzf.columns_of(SCHEMA))
    plausible = lambda d, k, whole: _plausible(d, k, contigs, len(samples), whole)
    found = bgzf.records_between(p.path, p.beg, p.end, tuple(first), _record_size, plausible)
    columns = set(wanted or names)
    rows = (decode(data, at, *tables, columns)[0] for data, at, _, _ in found)
    return bgzf.picked(rows, names, wanted or names)


class BcfSource(DataSource):
    """``spark.read.format("bcf").load(path)``; several paths are joined by commas."""

    @classmethod
    def name(cls) -> str:
        return "bcf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return bgzf._Reader(self.options, functools.partial(_rows, wanted=schema.names), schema)


def read_bcf(spark: SparkSession, path: str, split: int = bgzf.SPLIT, columns: list[str] | None = None) -> DataFrame:
    """Variants of binary files, with ``end`` and parsed genotypes as read_vcf gives them; only the named
    columns of ``SCHEMA`` are decoded, and ``end`` needs pos, ref and info."""
    spark.dataSource.register(BcfSource)
    rows = spark.read.format("bcf").schema(bgzf.narrowed(SCHEMA, columns)).option("split", split).load(path)
    said = F.when(F.map_contains_key("info", "END"), F.concat(F.lit("END="), F.element_at("info", F.lit("END"))))
    sampled = F.transform("samples", lambda s: F.struct(s["sample"].alias("sample"), parse_genotype(F.element_at(s["fields"], F.lit("GT"))).alias("gt"), s["fields"].alias("fields")))
    if {"pos", "ref", "info"} <= set(rows.columns):
        rows = rows.withColumn("end", variant_end(F.col("pos"), F.col("ref"), said))
    return rows.withColumn("samples", sampled) if "samples" in rows.columns else rows


def kinds_of(text: str) -> dict[tuple[str, str], str]:
    """The types of a header's INFO and FORMAT fields, by (INFO or FORMAT, id)."""
    found = re.findall(r"##(INFO|FORMAT)=<(.*)>", text)
    return {(kind, re.search(r"\bID=([^,>]+)", said)[1]): (re.search(r"\bType=(\w+)", said) or [None, "String"])[1] for kind, said in found}


def _descriptor(kind: int, n: int) -> bytes:
    return bytes([n << 4 | kind]) if n < 15 else bytes([0xF0 | kind]) + _integers([n])


def _width(values: list[int | None]) -> int:
    known = [v for v in values if v is not None]
    low, high = min(known, default=0), max(known, default=0)
    return 1 if -120 <= low and high <= 127 else 2 if -32760 <= low and high <= 32767 else 3


def _packed(kind: int, values: list[int | None], n: int) -> bytes:
    """``n`` integers of a kind, the vector's end behind the last given."""
    end = [_MISSING[kind] + 1] * (n - len(values))
    return struct.pack(f"<{n}{_KINDS[kind][0]}", *[_MISSING[kind] if v is None else v for v in values], *end)


def _integers(values: list[int | None]) -> bytes:
    kind = _width(values)
    return _descriptor(kind, len(values)) + _packed(kind, values, len(values))


def _floats(values: list[float | None], n: int) -> bytes:
    bits = [_FLOAT_MISSING if v is None else struct.unpack("<I", struct.pack("<f", v))[0] for v in values]
    return struct.pack(f"<{n}I", *bits, *[_FLOAT_END] * (n - len(bits)))


def _string(text: str) -> bytes:
    raw = text.encode()
    return _descriptor(7, len(raw)) + raw


def _numbers(text: str, make) -> list:
    return [None if x in (".", "") else make(x) for x in text.split(",")]


def _field(kind: str, key: str, texts: list[str | None]) -> bytes:
    """The typed values of one FORMAT field over all samples, padded to the longest."""
    if key == "GT":
        rows = []
        for t in texts:
            alleles = re.findall(r"([/|]?)(\d+|\.)", t or ".")
            rows.append([(0 if a == "." else int(a) + 1 << 1) | (sep == "|") for sep, a in alleles])
    elif kind == "Integer":
        rows = [_numbers(t or ".", int) for t in texts]
    elif kind == "Float":
        rows = [_numbers(t or ".", float) for t in texts]
        n = max(map(len, rows), default=0)
        return _descriptor(5, n) + b"".join(_floats(r, n) for r in rows)
    else:
        raw = [(t or ".").encode() for t in texts]
        n = max(map(len, raw), default=0)
        return _descriptor(7, n) + b"".join(r.ljust(n, b"\0") for r in raw)
    n, width = max(map(len, rows), default=0), _width([v for r in rows for v in r])
    return _descriptor(width, n) + b"".join(_packed(width, r, n) for r in rows)


def encode(row: dict, strings: dict[str, int], contigs: dict[str, int], kinds: dict[tuple[str, str], str], n_samples: int) -> bytes:
    """One record of a row of ``SCHEMA``."""
    alleles = [row["ref"], *(row["alts"] or [])]
    info, samples = dict(row["info"] or {}), row["samples"] or []
    end = int(info["END"]) if (info.get("END") or "").isdigit() else row["pos"] + len(row["ref"])
    keys = list(dict.fromkeys(k for s in samples for k in dict(s["fields"] or {})))
    qual = _FLOAT_MISSING if row["qual"] is None else struct.unpack("<I", struct.pack("<f", row["qual"]))[0]
    shared = struct.pack("<iiiIII", contigs[row["contig"]], row["pos"], end - row["pos"], qual, len(alleles) << 16 | len(info), len(keys) << 24 | n_samples)
    shared += _string(row["id"] or ".") + b"".join(map(_string, alleles)) + (_integers([strings[f] for f in row["filters"]]) if row["filters"] else b"\0")
    for key, value in info.items():
        kind = kinds.get(("INFO", key), "String")
        shared += _integers([strings[key]])
        if value is None or kind == "Flag":
            shared += b"\0"
        elif kind == "Integer":
            shared += _integers(_numbers(value, int))
        elif kind == "Float":
            numbers = _numbers(value, float)
            shared += _descriptor(5, len(numbers)) + _floats(numbers, len(numbers))
        else:
            shared += _string(value)
    own = b""
    for key in keys:
        texts = [dict(s["fields"] or {}).get(key) for s in samples]
        own += _integers([strings[key]]) + _field(kinds.get(("FORMAT", key), "String"), key, texts + [None] * (n_samples - len(texts)))
    return struct.pack("<II", len(shared), len(own)) + shared + own


def write_bcf(rows: DataFrame, path: str, text: str) -> None:
    """Write variants (the columns of ``SCHEMA``) as a folder of blocked parts under a header that names their
    contigs, filters and fields; a name that it lacks is refused. The header is a part of its own, before
    the others: concatenated in order of their names they are one file (``bgzf.join_parts``)."""
    numbered, contigs, samples = dictionaries(text)
    strings, contig_ids, kinds = {v: k for k, v in numbered.items()}, {v: k for k, v in contigs.items()}, kinds_of(text)
    if "samples" not in rows.columns:
        rows = rows.withColumn("samples", F.array().cast("array<struct<sample:string,fields:map<string,string>>>"))
    rows = rows.select("contig", F.col("pos").cast("long").alias("pos"), "id", "ref", "alts", F.col("qual").cast("double").alias("qual"), "filters", "info", F.transform("samples", lambda s: F.struct(s["sample"].alias("sample"), s["fields"].alias("fields"))).alias("samples"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = b"".join(encode(r, strings, contig_ids, kinds, len(samples)) for r in bgzf.records_of(b))
            yield pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], names=["value"])

    system, inner = bgzf.fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
    system.create_dir(inner, recursive=True)
    head = text.encode() + b"\0"
    with system.open_output_stream(f"{inner}/header.gz", compression=None) as f:
        f.write(bgzf.compress(b"BCF\2\2" + struct.pack("<I", len(head)) + head, end=False))
    bgzf.write(rows.mapInArrow(encoded, "value binary"), path)
