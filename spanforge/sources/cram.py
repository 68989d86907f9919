"""Alignments in containers of columns (CRAM 3.0): read in parallel, and written.

A file is a chain of containers; a container's header has a checksum and names its length, so a task that
begins in the middle of a file looks for the first header whose checksum holds, and owns the containers
that start in its range.  A container is decoded as a whole: it is the unit of memory.

Bases that agree with the reference are taken from a plain FASTA file with its index (``.fai``) beside it,
of which the span of a slice is read, or from the slice itself.  A span whose checksum differs is refused;
so are containers that need a reference when none is given, and block codecs of later versions.  Reading
gives the schema of binary alignments: coffset is the container's offset, uoffset the record's number in
it.  MD and NM are given where they are stored and not made up; a read without a name is called by its number.

Written files need no reference: bases are stored as they are.  Runs of ``=`` and ``X`` come back as ``M``.
"""

from __future__ import annotations

import bz2
import functools
import hashlib
import lzma
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StructType

from spanforge.functions.sequence import end_position
from spanforge.sources import alignments, bgzf
from spanforge.sources.codecs import Bits, Bytes, itf8, ltf8, rans

# The first bytes of a file, the container that ends one, kinds of blocks.
MAGIC = b"CRAM\x03\x00"  # 20 bytes of the file's name follow
EOF = bytes.fromhex("0f000000ffffffff0fe0454f4600000000010005bdd94f0001000606010001000100ee63014b")
_HEADER, _COMPRESSION, _SLICE, _EXTERNAL, _CORE = 0, 1, 2, 4, 5
_BYTES = {"FC", "BA", "BS", "QS"}
_ARRAYS = {"RN", "SC", "IN", "BB", "QQ"}
RECORDS = 10_000  # records of a written container


_LETTERS = bytes(33 if q == 255 else min(q + 33, 255) for q in range(256))


class Container:
    """The header of a container at ``at``; raises if there is none."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        s = Bytes(data, at)
        (self.length,) = struct.unpack("<i", s.take(4))
        self.refid, self.start, self.span, self.records = (s.itf8() for _ in range(4))
        self.counter, _, self.blocks = s.ltf8(), s.ltf8(), s.itf8()
        n = s.itf8()
        if self.length < 0 or self.blocks < 1 or not 0 <= n <= self.length or s.at + n > len(data):
            raise bgzf.BlockError("no container")
        self.landmarks = []
        for _ in range(n):  # they rise: bytes that only look like a header are refused early
            self.landmarks.append(s.itf8())
            if not (self.landmarks[-2] if self.landmarks[1:] else -1) < self.landmarks[-1] <= self.length:
                raise bgzf.BlockError("no container")
        if zlib.crc32(data[at : s.at]) != struct.unpack("<I", s.take(4))[0]:
            raise bgzf.BlockError("no container")
        self.size = s.at - at

    @property
    def ends_file(self) -> bool:
        return self.refid == -1 and self.start == 0x454F46 and not self.records


def _block(s: Bytes) -> tuple[int, int, bytes]:
    """(kind, content id, inflated data) of the next block."""
    beg = s.at
    method, kind, content, packed, size = s.byte(), s.byte(), s.itf8(), s.itf8(), s.itf8()
    data = s.take(packed)
    if zlib.crc32(s.data[beg : s.at]) != struct.unpack("<I", s.take(4))[0]:
        raise bgzf.BlockError("a block's checksum differs")
    codecs: dict[int, Callable[[bytes], bytes]] = {0: bytes, 1: lambda d: zlib.decompress(d, 47), 2: bz2.decompress, 3: lzma.decompress, 4: rans}
    if method not in codecs:
        raise bgzf.BlockError(f"blocks of codec {method} cannot be read")
    out = codecs[method](data) if size else b""
    if len(out) != size:
        raise bgzf.BlockError("a block's size differs")
    return kind, content, out


def places_of_headers(window: bytes, n_refs: int) -> list[int]:
    """Where a container's header may begin, as far as its first eight bytes tell: the length is below 2^28
    and the contig is one of the file's, or -1 or -2. A checksum has to settle it."""
    w = np.frombuffer(window, np.uint8).astype(np.int32)
    if len(w) < 8:
        return list(range(len(w)))
    first, second, third, fourth = (w[k : len(w) - 7 + k] for k in (4, 5, 6, 7))
    refid = np.where(first < 0x80, first, np.where(first < 0xC0, (first & 0x3F) << 8 | second, np.where(first < 0xE0, (first & 0x1F) << 16 | second << 8 | third, (first & 0x0F) << 24 | second << 16 | third << 8 | fourth)))
    negative = (first == 0xFF) & (second == 0xFF) & (third == 0xFF) & (fourth == 0xFF)
    known = np.flatnonzero((w[3 : len(w) - 4] < 0x10) & (((first < 0xF0) & (refid < n_refs)) | negative))
    return known.tolist() + list(range(len(w) - 7, len(w)))


def _first_container(f, beg: int, end: int, size: int, n_refs: int) -> int:
    """The offset of the first container in [beg, end); ``end`` if there is none."""
    head_room = 1 << 18  # no header is longer
    for base in range(beg, end, 1 << 22):
        window = f.read_at(min((1 << 22) + head_room, size - base), base)
        for k in places_of_headers(window[: (1 << 22) + 7], n_refs):
            if k >= 1 << 22 or base + k >= end:
                break
            try:
                head = Container(window, k)
            except (bgzf.BlockError, IndexError, struct.error):
                continue
            if base + k + head.size + head.length <= size:
                return base + k
    return end


def containers_between(path: str, beg: int, end: int, n_refs: int) -> Iterator[tuple[int, Container, bytes]]:
    """(offset, header, blocks) of the containers that start in [beg, end) of a file of ``n_refs`` contigs."""
    system, inner, size = bgzf.open_file(path)
    with system.open_input_file(inner) as f:
        end = min(end, size)
        at = _first_container(f, beg, end, size, n_refs) if beg > len(MAGIC) + 20 else len(MAGIC) + 20
        while at < end:
            head = Container(f.read_at(min(1 << 18, size - at), at))
            if not head.ends_file:
                yield at, head, f.read_at(head.length, at + head.size)
            at += head.size + head.length


def file_header(path: str) -> str:
    """The header lines of a file, which are its first container."""
    system, inner, _ = bgzf.open_file(path)
    with system.open_input_file(inner) as f:
        if f.read_at(5, 0) != MAGIC[:5]:
            raise bgzf.BlockError(f"{path}: not a file of containers of version 3")
    _, _, raw = next(containers_between(path, 0, 1 << 62, 0))
    data = _block(Bytes(raw))[2]
    return data[4 : 4 + struct.unpack_from("<i", data)[0]].split(b"\0")[0].decode()


def contigs_of(text: str) -> list[tuple[str, int]]:
    """(name, length) of the contigs of header lines."""
    said = [dict(part.split(":", 1) for part in line.split("\t")[1:] if ":" in part) for line in text.splitlines() if line.startswith("@SQ\t")]
    return [(s["SN"], int(s["LN"])) for s in said]


def read_groups(text: str) -> list[str]:
    return re.findall(r"^@RG\t(?:.*\t)?ID:([^\t\n]+)", text, re.M)


class Compression:
    """A container's compression header: what is preserved, and how each series is encoded."""

    def __init__(self, data: bytes) -> None:
        s = Bytes(data)
        self.names, self.delta, self.referenced, self.codes, self.lists = True, True, True, b"\x1b" * 5, [[]]
        s.itf8()
        for _ in range(s.itf8()):
            key = s.take(2)
            if key == b"SM":
                self.codes = s.take(5)
            elif key == b"TD":
                lines = s.take(s.itf8()).split(b"\0")[:-1]
                self.lists = [[line[k : k + 3] for k in range(0, len(line), 3)] for line in lines] or [[]]
            else:
                setattr(self, {b"RN": "names", b"AP": "delta", b"RR": "referenced"}[key], s.byte() != 0)
        s.itf8()
        self.series = {s.take(2).decode(): self._encoding(s) for _ in range(s.itf8())}
        s.itf8()
        self.tags = {s.itf8().to_bytes(3, "big"): self._encoding(s) for _ in range(s.itf8())}
        self.bases = {}
        for ref, code in zip("ACGTN", self.codes, strict=True):
            others = [b for b in "ACGTN" if b != ref]
            self.bases[ref] = {code >> (6 - 2 * k) & 3: b for k, b in enumerate(others)}

    @staticmethod
    def _encoding(s: Bytes) -> tuple[int, bytes]:
        return s.itf8(), s.take(s.itf8())


def _numbers(data: bytes) -> Iterator[int]:
    """The numbers of a stream of them; it is inflated, so a slice's are decoded at once. At the stream's end
    it says so as ``Bytes`` does."""
    raw, n = np.frombuffer(data, np.uint8), len(data)
    if n and raw.max() < 0x80:
        yield from data
    else:
        stream = Bytes(data)
        while stream.at < n:
            yield stream.itf8()
    raise IndexError("stream is cut short")


def _reader(encoding: tuple[int, bytes], what: str, core: Bits, external: dict[int, Bytes]) -> Callable[[], object]:
    """A function that gives a series' next value: ``int``, ``byte`` or ``array``."""
    codec, raw = encoding
    p = Bytes(raw)
    if codec == 1:
        stream = external.setdefault(p.itf8(), Bytes(b""))
        return stream.itf8 if what == "int" else stream.byte
    if codec == 3:
        symbols, lengths = p.numbers(), p.numbers()
        order = sorted(zip(lengths, symbols, strict=True))
        if len(order) == 1 and order[0][0] == 0:
            return lambda: order[0][1]
        words, code, before = {}, 0, order[0][0] if order else 0
        for length, symbol in order:
            code <<= length - before
            words[length, code] = symbol
            code, before = code + 1, length

        def word() -> int:
            code = length = 0
            while (length, code) not in words:
                code, length = code << 1 | core.take(1), length + 1
            return words[length, code]

        return word
    if codec == 4:
        size = _reader((p.itf8(), p.take(p.itf8())), "int", core, external)
        inner = (p.itf8(), p.take(p.itf8()))
        if inner[0] == 1:
            stream = external.setdefault(Bytes(inner[1]).itf8(), Bytes(b""))
            return lambda: stream.take(size())
        one = _reader(inner, "byte", core, external)
        return lambda: bytes(one() for _ in range(size()))
    if codec == 5:
        stop, stream = p.byte(), external.setdefault(p.itf8(), Bytes(b""))
        return lambda: stream.until(stop)
    if codec == 6:
        offset, bits = p.itf8(), p.itf8()
        return lambda: core.take(bits) - offset
    if codec == 7:
        offset, k = p.itf8(), p.itf8()

        def subexponential() -> int:
            n = core.ones()
            return (core.take(k) if n == 0 else 1 << (n + k - 1) | core.take(n + k - 1)) - offset

        return subexponential
    if codec in (2, 8):
        offset, m = p.itf8(), p.itf8()
        m = 1 << m if codec == 8 else m
        bits = (m - 1).bit_length()

        def golomb() -> int:
            n, rest = core.ones(), 0
            short = (1 << bits) - m
            if bits:
                rest = core.take(bits - 1)
                if rest >= short:
                    rest = (rest << 1 | core.take(1)) - short
            return n * m + rest - offset

        return golomb
    if codec == 9:
        offset = p.itf8()

        def gamma() -> int:
            n = core.zeros()
            return (1 << n | core.take(n)) - offset

        return gamma
    raise bgzf.BlockError(f"values of encoding {codec} cannot be read")


def _streams(encoding: tuple[int, bytes]) -> list[int]:
    """The content ids of the external streams that an encoding reads."""
    codec, raw = encoding
    p = Bytes(raw)
    if codec == 1:
        return [p.itf8()]
    if codec == 4:
        return [k for _ in range(2) for k in _streams((p.itf8(), p.take(p.itf8())))]
    if codec == 5:
        p.byte()
        return [p.itf8()]
    return []


class Reference:
    """Bases of sequences of a FASTA file by its index, which is read once."""

    def __init__(self, path: str | None) -> None:
        self.path, self.index = path, {}
        if path:
            for line in bgzf.read_bytes(path + ".fai").decode().splitlines():
                name, *numbers = line.split("\t")[:5]
                self.index[name] = (name, *map(int, numbers))

    def span(self, contig: str, beg: int, end: int) -> str | None:
        """Bases [beg, end), in capitals; None without a file or an entry."""
        from spanforge.sources.textfiles import fetch_bases

        return fetch_bases(self.path, self.index[contig], beg, end).upper() if contig in self.index else None


class _Slice:
    """The records of one slice."""

    def __init__(self, s: Bytes, form: Compression, contigs: list[tuple[str, int]], groups: list[str], reference: Reference) -> None:
        kind, _, raw = _block(s)
        if kind != _SLICE:
            raise bgzf.BlockError("no slice")
        h = Bytes(raw)
        self.refid, self.start, self.span, self.n, self.counter = h.itf8(), h.itf8(), h.itf8(), h.itf8(), h.ltf8()
        n_blocks, _, embedded, md5 = h.itf8(), h.numbers(), h.itf8(), h.take(16)
        self.form, self.contigs, self.groups, self.reference = form, contigs, groups, reference
        core, external = Bits(b""), {}
        for _ in range(n_blocks):
            kind, content, data = _block(s)
            if kind == _CORE:
                core.data = data
            else:
                external[content] = Bytes(data)
        self.known: tuple[int, int, str] | None = None  # (refid, begin, bases) of the span at hand
        if self.refid >= 0 and embedded >= 0:
            self.known = (self.refid, self.start - 1, external[embedded].data.decode().upper())
        elif self.refid >= 0 and form.referenced:
            bases = reference.span(contigs[self.refid][0], self.start - 1, self.start - 1 + self.span)
            if bases is not None:
                if any(md5) and hashlib.md5(bases.encode()).digest() != md5:
                    raise bgzf.BlockError(f"the reference of {contigs[self.refid][0]} is not the one that was used")
                self.known = (self.refid, self.start - 1, bases)
        kinds = {name: "byte" if name in _BYTES else "array" if name in _ARRAYS else "int" for name in form.series}
        self.read = {name: _reader(e, kinds[name], core, external) for name, e in form.series.items() if e[0]}
        # a stream that no other series reads is decoded ahead
        used = [b for e in (*form.series.values(), *form.tags.values()) for b in _streams(e)]
        for name, e in form.series.items():
            own = _streams(e)
            if e[0] == 1 and kinds[name] == "int" and used.count(own[0]) == 1 and own[0] in external:
                self.read[name] = _numbers(external[own[0]].data).__next__
        self.tags = {name: _reader(e, "array", core, external) for name, e in form.tags.items()}
        self.plain = {name: external.get(Bytes(e[1]).itf8()) for name, e in form.series.items() if e[0] == 1}

    def _array(self, name: str, n: int) -> bytes:
        """The next ``n`` values of a series of bytes."""
        if self.plain.get(name) is not None:
            return self.plain[name].take(n)
        return bytes(self.read[name]() for _ in range(n))

    def _bases(self, refid: int, beg: int, n: int) -> str:
        """Bases of the reference; N behind the contig's end."""
        if self.known is None or self.known[0] != refid or beg < self.known[1] or beg + n > self.known[1] + len(self.known[2]):
            length = self.contigs[refid][1]
            near = self.reference.span(self.contigs[refid][0], beg, min(length, beg + n + (1 << 16)))
            if near is None:
                raise bgzf.BlockError(f"bases of {self.contigs[refid][0]} need a reference")
            self.known = (refid, beg, near)
        at = beg - self.known[1]
        return self.known[2][at : at + n].ljust(n, "N")

    def _features(self, refid: int, pos: int, length: int, bare: bool) -> tuple[list[str], list, dict[int, int]]:
        """(bases, CIGAR operations, single qualities by place) of a mapped read."""
        get, seq, ops, quals = self.read, [], [], {}
        at, ref, place = 0, pos, 0  # in the read, in the reference, of the last feature

        def add(op: str, n: int) -> None:
            if n and ops and ops[-1][0] == op:
                ops[-1][1] += n
            elif n:
                ops.append([op, n])

        def match(upto: int) -> None:
            nonlocal at, ref
            n = upto - at
            if n > 0:
                seq.append("" if bare else self._bases(refid, ref, n))
                add("M", n)
                at, ref = at + n, ref + n

        for _ in range(get["FN"]()):
            code = chr(get["FC"]())
            place += get["FP"]()
            if code == "Q":
                quals[place - 1] = get["QS"]()
                continue
            if code == "q":
                quals |= dict(enumerate(get["QQ"](), place - 1))
                continue
            match(place - 1)
            if code in "XB":
                if code == "X":
                    under, symbol = self._bases(refid, ref, 1), get["BS"]()
                    base = self.form.bases[under if under in "ACGTN" else "N"][symbol]
                else:
                    base, quals[at] = chr(get["BA"]()), get["QS"]()
                seq.append(base)
                add("M", 1)
                at, ref = at + 1, ref + 1
            elif code in "SIib":
                text = chr(get["BA"]()) if code == "i" else get[{"S": "SC", "I": "IN", "b": "BB"}[code]]().decode("latin1")
                seq.append(text)
                add({"S": "S", "I": "I", "i": "I", "b": "M"}[code], len(text))
                at += len(text)
                ref += len(text) if code == "b" else 0
            elif code in "DNPH":
                n = get[{"D": "DL", "N": "RS", "P": "PD", "H": "HC"}[code]]()
                add(code, n)
                ref += n if code in "DN" else 0
            else:
                raise bgzf.BlockError(f"no feature {code}")
        match(length)
        return seq, ops, quals

    def records(self) -> list[dict]:
        get, form, out = self.read, self.form, []
        pos = self.start
        for k in range(self.n):
            r: dict = {"flag": get["BF"](), "kept": get["CF"](), "next": None, "name": None, "mate_refid": -1, "mate_pos": -1, "tlen": 0}
            refid = r["refid"] = get["RI"]() if self.refid == -2 else self.refid
            length = get["RL"]()
            pos = pos + get["AP"]() if form.delta else get["AP"]()
            r["pos"], group = pos - 1, get["RG"]()
            if form.names:
                r["name"] = get["RN"]().decode("latin1")
            if r["kept"] & 2:
                mate = get["MF"]()
                r["flag"] |= 0x20 * (mate & 1) | 0x8 * (mate >> 1 & 1)
                if not form.names:
                    r["name"] = get["RN"]().decode("latin1")
                r["mate_refid"], r["mate_pos"], r["tlen"] = get["NS"](), get["NP"]() - 1, get["TS"]()
            elif r["kept"] & 4:
                r["next"] = k + get["NF"]() + 1
            raw = b"".join(tag + self.tags[tag]() for tag in form.lists[get["TL"]()])
            r["tags"] = alignments._tags(raw, 0, len(raw))
            if 0 <= group < len(self.groups):
                r["tags"].setdefault("RG", ("Z", self.groups[group]))
            bare, quals, ops, r["mapq"] = bool(r["kept"] & 8), {}, [], 0
            if not r["flag"] & 4:
                seq, ops, quals = self._features(refid, r["pos"], length, bare)
                r["mapq"] = get["MQ"]()
            else:
                seq = [] if bare else [self._array("BA", length).decode("latin1")]
            r["cigar"] = "".join(f"{n}{op}" for op, n in ops) or "*"
            r["seq"] = "*" if bare else "".join(seq) or "*"
            raw = self._array("QS", length) if r["kept"] & 1 else bytes(quals.get(i, 255) for i in range(length)) if quals else b""
            r["qual"] = "*" if not raw or raw[0] == 255 and not quals else raw.translate(_LETTERS).decode("latin1")
            r["end"] = r["pos"] + sum(n for op, n in ops if op in "MDN")
            out.append(r)
        self._join_mates(out)
        return out

    def _join_mates(self, rows: list[dict]) -> None:
        """Names, mates and template lengths of records that name the next of their template."""
        led = {r["next"] for r in rows}
        for k, r in enumerate(rows):
            if r["next"] is None or k in led:
                continue
            chain = [k]
            while rows[chain[-1]]["next"] is not None:
                chain.append(rows[chain[-1]]["next"])
            told = [rows[i] for i in chain]
            beg, end = min(t["pos"] for t in told), max(t["end"] for t in told)
            alike = all(t["refid"] == told[0]["refid"] >= 0 and not t["flag"] & 4 for t in told)
            first = next((t for t in told if t["pos"] == beg and t["flag"] & 0x40), next(t for t in told if t["pos"] == beg))
            name = r["name"] or str(self.counter + k + 1)
            for t, mate in zip(told, told[1:] + told[:1], strict=True):
                t["name"] = t["name"] or name
                t["mate_refid"], t["mate_pos"] = mate["refid"], mate["pos"]
                t["flag"] |= 0x20 * (mate["flag"] >> 4 & 1) | 0x8 * (mate["flag"] >> 2 & 1)
                t["tlen"] = (end - beg if t is first else beg - end) if alike else 0
        for k, r in enumerate(rows):
            r["name"] = r["name"] or str(self.counter + k + 1)


def decode(head: Container, raw: bytes, contigs: list[tuple[str, int]], groups: list[str], reference: Reference) -> Iterator[dict]:
    """The records of a container."""
    s = Bytes(raw)
    kind, _, data = _block(s)
    if kind != _COMPRESSION:
        return
    form = Compression(data)
    for landmark in head.landmarks:
        yield from _Slice(Bytes(raw, landmark), form, contigs, groups, reference).records()


def _rows(p, reference: Reference, wanted: list[str] | None = None) -> Iterator[tuple]:
    names = list(bgzf.columns_of(alignments.SCHEMA))
    return bgzf.picked(_whole_rows(p, reference), names, wanted or names)


def _whole_rows(p, reference: Reference) -> Iterator[tuple]:
    text = file_header(p.path)
    contigs, groups = contigs_of(text), read_groups(text)
    name = lambda k: contigs[k][0] if k >= 0 else "*"
    for at, head, raw in containers_between(p.path, p.beg, p.end, len(contigs)):
        for k, r in enumerate(decode(head, raw, contigs, groups, reference)):
            yield r["name"], r["flag"], r["refid"], name(r["refid"]), r["pos"], r["mapq"], r["cigar"], r["mate_refid"], name(r["mate_refid"]), r["mate_pos"], r["tlen"], r["seq"], r["qual"], r["tags"], at, k


class _Reader(bgzf._Reader):
    """Ranges of files, or those containers of one file whose offsets the option ``containers`` names."""

    def __init__(self, options: dict, rows, schema: StructType) -> None:
        super().__init__(options, rows, schema)
        self.places = [int(k) for k in options["containers"].split(",") if k] if "containers" in options else None

    def partitions(self) -> list[bgzf._Range]:
        if self.places is None:
            return super().partitions()
        return [bgzf._Range(self.paths[0], at, at + 1, False) for at in self.places] or [bgzf._Range(self.paths[0], 0, 0, False)]


class CramSource(DataSource):
    """``spark.read.format("cram").option("reference", fasta).load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "cram"

    def schema(self) -> str:
        return alignments.SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        path = self.options.get("reference")
        return _Reader(self.options, lambda p: _rows(p, Reference(path), schema.names), schema)


def read_cram(spark: SparkSession, path: str, reference: str | None = None, split: int = bgzf.SPLIT, columns: list[str] | None = None) -> DataFrame:
    """Alignments of a file of containers, with a parsed CIGAR; only the named columns leave the tasks."""
    return _loaded(spark, path, reference, split, columns)


def _loaded(spark: SparkSession, path: str, reference: str | None, split: int, columns: list[str] | None, **options: str) -> DataFrame:
    spark.dataSource.register(CramSource)
    reader = spark.read.format("cram").schema(bgzf.narrowed(alignments.SCHEMA, columns)).option("split", split).options(**options)
    reader = reader.option("reference", reference) if reference else reader
    return alignments.with_cigar(reader.load(path))


def container_index(rows: DataFrame) -> DataFrame:
    """(refid, beg, end, container) of a file's containers and their mapped reads, from what ``read_cram`` gives."""
    placed = rows.where("refid >= 0 AND pos >= 0")
    return placed.groupBy("refid", F.col("coffset").alias("container")).agg(F.min("pos").alias("beg"), F.max(end_position(F.col("pos"), F.col("cigar"), F.col("flag"))).alias("end")).select("refid", "beg", "end", "container")


def query_cram(spark: SparkSession, path: str, index: DataFrame, refid: int, beg: int, end: int, reference: str | None = None) -> DataFrame:
    """Alignments that overlap a region; only the containers that an index names are read. index: the columns
    of ``container_index``, which ``read_slice_index`` gives as well."""
    near = index.where((F.col("refid") == refid) & (F.col("beg") < end) & (F.col("end") > beg))
    places = [r[0] for r in near.select("container").distinct().orderBy("container").collect()]  # of one region: few
    rows = _loaded(spark, path, reference, bgzf.SPLIT, None, containers=",".join(map(str, places)))
    return rows.where((F.col("refid") == refid) & (F.col("pos") < end) & (end_position(F.col("pos"), F.col("cigar"), F.col("flag")) > beg))


# --- writing ------------------------------------------------------------------------------------

_INTS = ("BF", "CF", "RI", "RL", "AP", "RG", "MF", "NS", "NP", "TS", "TL", "FN", "FP", "DL", "RS", "PD", "HC", "MQ")
_IDS = {name: k for k, name in enumerate((*_INTS, "FC", "BA", "QS", "RN", "SC", "IN", "BB"), 1)}
_SIZES = 64  # content ids of the lengths of a series of arrays are its own and this


def pack_block(kind: int, content: int, data: bytes) -> bytes:
    """A block, deflated where that makes it smaller."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    packed = c.compress(data) + c.flush()
    method, body = (1, packed) if len(packed) < len(data) else (0, data)
    raw = bytes([method, kind]) + itf8(content) + itf8(len(body)) + itf8(len(data)) + body
    return raw + struct.pack("<I", zlib.crc32(raw))


def pack_container(blocks: list[bytes], refid: int, start: int, span: int, n: int, counter: int, bases: int, landmarks: list[int]) -> bytes:
    body = b"".join(blocks)
    head = struct.pack("<i", len(body)) + b"".join(map(itf8, (refid, start, span, n))) + ltf8(counter) + ltf8(bases) + itf8(len(blocks)) + itf8(len(landmarks)) + b"".join(map(itf8, landmarks))
    return head + struct.pack("<I", zlib.crc32(head)) + body


def pack_header(text: str) -> bytes:
    """What begins a file: its mark and the container of its header lines."""
    raw = text.encode()
    return MAGIC + bytes(20) + pack_container([pack_block(_HEADER, 0, struct.pack("<i", len(raw)) + raw)], 0, 0, 0, 0, 0, 0, [0])


def _sized(own: int) -> bytes:
    """The encoding of arrays with their lengths in a stream beside them."""
    part = lambda k: b"\x01" + itf8(len(itf8(k))) + itf8(k)
    body = part(own + _SIZES) + part(own)
    return b"\x04" + itf8(len(body)) + body


def int_encoding(values: list[int], content: int) -> tuple[bytes, bytes | None]:
    """(encoding, external data) of a series of numbers: one value throughout is a word of no bits and
    takes no data, all else goes to a stream of its own, which is deflated."""
    if len(set(values)) == 1:
        body = itf8(1) + itf8(values[0]) + itf8(1) + itf8(0)
        return b"\x03" + itf8(len(body)) + body, None
    where = itf8(content)
    return b"\x01" + itf8(len(where)) + where, b"".join(map(itf8, values))


@functools.lru_cache(1 << 14)
def _operations(cigar: str) -> list[tuple[str, int]]:
    return [(m[1], int(m[0])) for m in re.findall(r"(\d+)([MIDNSHP=XB])", cigar)]


def encode(rows: list[dict], refids: dict[str, int], counter: int) -> bytes:
    """A container of rows of the schema of binary alignments."""
    out: dict[int, bytearray] = {}
    lists: dict[bytes, int] = {}
    tags: dict[bytes, int] = {}
    ints: dict[str, list[int]] = {name: [] for name in _INTS}

    def put(name: str, value: int) -> None:
        ints[name].append(value)

    def put_array(own: int, value: bytes) -> None:
        out.setdefault(own + _SIZES, bytearray()).extend(itf8(len(value)))
        out.setdefault(own, bytearray()).extend(value)

    bases = 0
    for row in rows:
        flag, seq = row["flag"] or 0, "" if row["seq"] in (None, "*") else row["seq"]
        ops = _operations(row["cigar_text"] or "")
        qual = "" if row["qual"] in (None, "*") or not seq else row["qual"]
        mapped = not flag & 4
        length = len(seq) or (sum(n for op, n in ops if op in "MIS=X") if mapped else 0)
        bases += length
        put("BF", flag)
        put("CF", 2 | bool(qual) | 8 * (not seq))
        put("RI", refids.get(row["rname"], -1))
        put("RL", length)
        put("AP", (row["pos"] if row["pos"] is not None else -1) + 1)
        put("RG", -1)
        out.setdefault(_IDS["RN"], bytearray()).extend((row["qname"] or "*").encode() + b"\0")
        put("MF", flag >> 5 & 1 | (flag >> 3 & 1) << 1)
        put("NS", refids.get(row["rnext"], -1))
        put("NP", (row["mate_pos"] if row["mate_pos"] is not None else -1) + 1)
        put("TS", row["tlen"] or 0)
        line = b""
        for key, kind, value in alignments.tag_values(row["tags"]):
            tag = key + kind
            line += tag
            put_array(tags.setdefault(tag, 1000 + 2 * _SIZES * len(tags)), value)
        put("TL", lists.setdefault(line, len(lists)))
        if mapped:
            at, place, features = 0, 0, []
            for op, n in ops:
                if op in "M=X":
                    if seq:
                        features.append((at + 1, "b", seq[at : at + n]))
                    at += n
                elif op in "SI":
                    features.append((at + 1, op, seq[at : at + n] or "N" * n))
                    at += n
                elif op in "DNPH":
                    features.append((at + 1, op, n))
            put("FN", len(features))
            for where, code, value in features:
                out.setdefault(_IDS["FC"], bytearray()).append(ord(code))
                put("FP", where - place)
                place = where
                if isinstance(value, int):
                    put({"D": "DL", "N": "RS", "P": "PD", "H": "HC"}[code], value)
                else:
                    put_array(_IDS[{"S": "SC", "I": "IN", "b": "BB"}[code]], value.encode("latin1"))
            put("MQ", row["mapq"] or 0)
        else:
            out.setdefault(_IDS["BA"], bytearray()).extend(seq.encode("latin1"))
        if qual:
            out.setdefault(_IDS["QS"], bytearray()).extend(qual.encode("latin1").translate(alignments._SCORES))
    listed = b"".join(line + b"\0" for line in lists)
    kept = b"RN\x01AP\x00RR\x00SM" + b"\x1b" * 5 + b"TD" + itf8(len(listed)) + listed
    series = b"".join(name.encode() + b"\x01\x01" + itf8(_IDS[name]) for name in ("FC", "BA", "QS"))
    for name, values in ints.items():
        encoding, data = int_encoding(values, _IDS[name])
        series += name.encode() + encoding
        if data:
            out[_IDS[name]] = bytearray(data)
    series += b"RN\x05\x02\x00" + itf8(_IDS["RN"]) + b"".join(name.encode() + _sized(_IDS[name]) for name in ("SC", "IN", "BB"))
    tagged = b"".join(itf8(int.from_bytes(t, "big")) + _sized(own) for t, own in tags.items())
    form = b"".join(itf8(len(itf8(n) + m)) + itf8(n) + m for n, m in ((5, kept), (len(_INTS) + 7, series), (len(tags), tagged)))
    blocks = [pack_block(_CORE, 0, b""), *(pack_block(_EXTERNAL, k, bytes(data)) for k, data in out.items())]
    head = b"".join(map(itf8, (-2, 0, 0, len(rows)))) + ltf8(counter) + itf8(len(blocks)) + itf8(len(out)) + b"".join(map(itf8, out)) + itf8(-1) + bytes(16)
    first = pack_block(_COMPRESSION, 0, form)
    return pack_container([first, pack_block(_SLICE, 0, head), *blocks], -2, 0, 0, len(rows), counter, bases, [len(first)])


def write_cram(rows: DataFrame, path: str, text: str) -> None:
    """Write alignments as a folder of parts under header lines that name their contigs. The first part is
    the header and the last the container that ends a file: in order of their names they are one file
    (``bgzf.join_parts``). Records are numbered in their part."""
    refids = {n: k for k, (n, _) in enumerate(contigs_of(text))}
    kept = rows.select("qname", "flag", "rname", "pos", "mapq", "cigar_text", "rnext", "mate_pos", "tlen", "seq", "qual", "tags")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = 0
        for b in batches:
            for at in range(0, b.num_rows, RECORDS):
                some = bgzf.records_of(b.slice(at, RECORDS))
                yield pa.RecordBatch.from_arrays([pa.array([encode(some, refids, counter)], pa.binary())], names=["value"])
                counter += len(some)

    system, inner = bgzf.fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
    system.create_dir(inner, recursive=True)
    for name, data in (("header.cram", pack_header(text)), ("trailer.cram", EOF)):
        with system.open_output_stream(f"{inner}/{name}", compression=None) as f:
            f.write(data)
    bgzf.write(kept.mapInArrow(encoded, "value binary"), path, blocked=False)
