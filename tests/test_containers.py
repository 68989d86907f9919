"""Files of containers: round trips in any split, and containers made by hand against their records."""

import collections
import hashlib
import random
import struct

import pytest

from spanforge.sources import alignments, bgzf, cram
from spanforge.sources.codecs import Bits, Bytes, itf8, ltf8, rans

HEADER = "@HD\tVN:1.6\n@SQ\tSN:c1\tLN:5000\n@SQ\tSN:c2\tLN:90000\n@RG\tID:g0\tSM:s\n@RG\tSM:s\tID:g1\n"
CONTIGS = [("c1", 5000), ("c2", 90000)]
COLS = ["qname", "flag", "rname", "pos", "mapq", "cigar_text", "rnext", "mate_pos", "tlen", "seq", "qual"]


@pytest.mark.parametrize("value", [0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28, 2**31 - 1, -1, -(2**31)])
def test_numbers(value):
    for pack, read in ((itf8, Bytes.itf8), (ltf8, Bytes.ltf8)):
        s = Bytes(pack(value) + b"x")
        assert read(s) == value and s.take(1) == b"x"
    big = value << 31
    assert Bytes(ltf8(big)).ltf8() == big


def _table(counts):
    """Frequencies that add up to 4096 and their first slots, with the bytes that state them."""
    total, freq = sum(counts.values()), {}
    for s in sorted(counts):
        freq[s] = max(1, counts[s] * 4096 // total)
    top = max(freq, key=freq.get)
    freq[top] += 4096 - sum(freq.values())
    first, at, raw = {}, 0, []
    for s, f in freq.items():
        first[s], at = at, at + f
        raw.append((s, bytes([f]) if f < 128 else bytes([f >> 8 | 128, f & 255])))
    return freq, first, _listed(raw)


def _listed(entries):
    out, symbols, run = b"", [s for s, _ in entries], 0
    for k, (s, body) in enumerate(entries):
        if run:
            run -= 1
        else:
            out += bytes([s])
            if k and s == symbols[k - 1] + 1:
                run = next(n for n in range(len(symbols) - k) if k + n + 1 == len(symbols) or symbols[k + n + 1] != s + n + 1)
                out += bytes([run])
        out += body
    return out + b"\0"


def _rans(data, order):
    q = len(data) // 4
    if order:
        before = {k: 0 if k in (0, q, 2 * q, 3 * q) else data[k - 1] for k in range(len(data))}
        places = [(j, j * q + i) for i in range(q) for j in range(4)] + [(3, k) for k in range(4 * q, len(data))]
    else:
        before, places = dict.fromkeys(range(len(data)), 0), [(k & 3, k) for k in range(len(data))]
    counts = collections.defaultdict(collections.Counter)
    for k, b in enumerate(data):
        counts[before[k]][b] += 1
    tables = {c: _table(n) for c, n in sorted(counts.items())}
    stated = _listed([(c, t[2]) for c, t in tables.items()]) if order else tables[0][2]
    states, emitted = [1 << 23] * 4, []
    for j, k in reversed(places):
        freq, first, _ = tables[before[k]]
        f, x = freq[data[k]], states[j]
        while x >= (1 << 19) * f:
            emitted.append(x & 255)
            x >>= 8
        states[j] = (x // f << 12) + x % f + first[data[k]]
    body = stated + struct.pack("<4I", *states) + bytes(reversed(emitted))
    return struct.pack("<BII", order, len(body), len(data)) + body


@pytest.mark.parametrize("order", [0, 1])
def test_range_codec(order):
    r = random.Random(order)
    for data in (b"a", b"abcd", b"aaaaaaaaa", bytes(r.choices(b"\0\1\2\3\4ACGTacgt\xff", k=4001)), bytes(r.randrange(256) for _ in range(3000)), b"the words of a text, " * 50):
        assert rans(_rans(data, order)) == data


def _reads(n):
    r = random.Random(3)
    for k in range(n):
        seq = "".join(r.choices("ACGTN", k=20))
        cigar = r.choice(("20M", "3S17M", "5M2I13M", "10M4D10M", "2H6M100N4M1P10M", "*"))
        flag, contig = (77, "*") if cigar == "*" else (99, r.choice(("c1", "c2")))
        yield (f"read{k}", flag, contig, k if contig != "*" else -1, k % 61 if contig != "*" else 0, cigar, contig, k + 50 if contig != "*" else -1, r.choice((0, 70, -70)), seq if k % 17 else "*", "".join(chr(33 + r.randrange(60)) for _ in range(20)) if k % 17 and k % 5 else "*")


def test_round_trip_in_any_split(spark, tmp_path, monkeypatch):
    rows = [(*row, {"NM": ("i", str(k % 5)), "RG": ("Z", "g1"), "XB": ("B", "s,1,-2"), "XA": ("A", "c")} if k % 3 else None) for k, row in enumerate(_reads(700))]
    want = sorted(r[:11] for r in rows)
    monkeypatch.setattr(cram, "RECORDS", 60)
    schema = "qname string, flag int, rname string, pos long, mapq int, cigar_text string, rnext string, mate_pos long, tlen long, seq string, qual string, tags map<string,struct<type:string,value:string>>"
    df = spark.createDataFrame(rows, schema)
    as_dict = [r.asDict(recursive=True) for r in df.collect()]
    path = str(tmp_path / "a.cram")
    refids = {n: k for k, (n, _) in enumerate(CONTIGS)}
    with open(path, "wb") as f:
        f.write(cram.pack_header(HEADER) + b"".join(cram.encode(as_dict[k : k + 60], refids, k) for k in range(0, 700, 60)) + cram.EOF)
    for split in (1 << 30, 5000, 777):
        got = [row for p in bgzf.ranges([path], split) for row in cram._rows(p, cram.Reference(None))]
        assert sorted((*r[:2], *r[3:7], r[8], *r[9:13]) for r in got) == want, split
    folder = str(tmp_path / "out")
    cram.write_cram(df.repartition(3), folder, HEADER)
    bgzf.join_parts(folder, folder + ".cram")
    back = cram.read_cram(spark, folder + ".cram", split=4000)
    assert sorted(map(tuple, back.select(*COLS).collect())) == want
    tags = {r["qname"]: r["tags"] for r in back.select("qname", "tags").collect()}
    assert tags["read1"]["XB"]["value"] == "s,1,-2" and tags["read1"]["RG"]["value"] == "g1" and not tags["read0"]
    few = cram.read_cram(spark, folder + ".cram", columns=["pos", "qname"])
    assert few.columns == ["qname", "pos"] and sorted(map(tuple, few.collect())) == sorted((w[0], w[3]) for w in want)
    ordered = str(tmp_path / "ordered")
    cram.write_cram(df.orderBy("rname", "pos").coalesce(1), ordered, HEADER)
    bgzf.join_parts(ordered, ordered + ".cram")
    index = cram.container_index(cram.read_cram(spark, ordered + ".cram"))
    assert index.count() > 9
    for refid, beg, end in ((0, 100, 160), (1, 0, 1), (1, 690, 5000), (0, 4000, 4001)):
        found = cram.query_cram(spark, ordered + ".cram", index, refid, beg, end)
        span = {"20M": 20, "3S17M": 17, "5M2I13M": 18, "10M4D10M": 24, "2H6M100N4M1P10M": 120}
        near = [w for w in want if w[2] == CONTIGS[refid][0] and w[3] < end and w[3] + span[w[5]] > beg]
        assert sorted(map(tuple, found.select(*COLS).collect())) == near
    empty = str(tmp_path / "none")
    cram.write_cram(df.limit(0), empty, HEADER)
    bgzf.join_parts(empty, empty + ".cram")
    assert cram.read_cram(spark, empty + ".cram").count() == 0


def _bits(*parts):
    """Bytes of (value, bits)."""
    text = "".join(f"{v:0{n}b}" for v, n in parts if n)
    return int(text.ljust(-(-len(text) // 8) * 8, "0") or "0", 2).to_bytes(-(-len(text) // 8), "big")


def _param(codec, *numbers):
    body = b"".join(n if isinstance(n, bytes) else itf8(n) for n in numbers)
    return itf8(codec) + itf8(len(body)) + body


def _slice_file(path, reference, md5):
    """Three reads on c1 against a reference: a pair whose second is named by distance, with a substitution,
    a deletion and an insertion; lengths are one symbol, positions differences of six bits."""
    one = lambda v: _param(3, 1, v, 1, 0)  # noqa: E731  one symbol of no bits
    series = {
        "BF": _param(3, 3, 67, 147, 16, 3, 1, 2, 2), "CF": _param(3, 3, 4, 0, 5, 3, 2, 2, 1), "RL": one(10), "AP": _param(6, 0, 6), "RG": one(1), "NF": one(0), "TL": one(0), "FN": _param(9, 1), "FC": _param(1, 20),
        "FP": _param(7, 0, 1), "BS": _param(1, 21), "DL": one(2), "IN": _param(5, b"\0", 22), "MQ": _param(1, 23), "QS": _param(1, 24), "MF": one(0), "NS": one(-1), "NP": one(0), "TS": one(0),
    }
    kept = b"RN\0AP\1RR\1SM" + bytes([0x1B] * 5) + b"TD" + itf8(4) + b"NMC\0"
    tags = {b"NMC": _param(4, one(1), _param(1, 25))}
    listed = b"".join(k.encode() + e for k, e in series.items())
    tagged = b"".join(itf8(int.from_bytes(k, "big")) + e for k, e in tags.items())
    form = b"".join(itf8(len(itf8(n) + m)) + itf8(n) + m for n, m in ((5, kept), (len(series), listed), (1, tagged)))
    # canonical words: BF 67 has one bit less than the others; CF 5 has one bit
    bf, cf = {67: (0, 1), 16: (2, 2), 147: (3, 2)}, {5: (0, 1), 0: (2, 2), 4: (3, 2)}
    gamma = lambda v: [(0, (v + 1).bit_length() - 1), (v + 1, (v + 1).bit_length())]
    sub = lambda v: [(0, 1), (v, 1)] if v < 2 else [((1 << (v.bit_length() - 1)) - 1 << 1, v.bit_length()), (v - (1 << (v.bit_length() - 1)), v.bit_length() - 1)]
    core = _bits(
        bf[67], cf[5], (0, 6), *gamma(2), *sub(3), *sub(4),  # at the slice's start: a substitution at 3, a deletion before 7
        bf[147], cf[0], (20, 6), *gamma(1), *sub(4),  # twenty on: an insertion of two at 4
        bf[16], cf[0], (5, 6), *gamma(0),
    )
    external = {20: b"XDI", 21: b"\1", 22: b"TT\0", 23: bytes([30, 31, 32]), 24: bytes(range(10)), 25: b"\1\2\3"}
    start, span = 101, 60
    digest = hashlib.md5(reference[start - 1 : start - 1 + span].encode()).digest() if md5 else bytes(15) + b"\1"
    head = b"".join(map(itf8, (0, start, span, 3))) + ltf8(7) + itf8(1 + len(external)) + itf8(len(external)) + b"".join(map(itf8, external)) + itf8(-1) + digest
    first = cram.pack_block(1, 0, form)
    packed = []
    for k, data in external.items():
        body = _rans(data, k % 2)
        raw = bytes([4, 4]) + itf8(k) + itf8(len(body)) + itf8(len(data)) + body
        packed.append(raw + struct.pack("<I", cram.zlib.crc32(raw)))
    blocks = [first, cram.pack_block(2, 0, head), cram.pack_block(5, 0, core), *packed]
    with open(path, "wb") as f:
        f.write(cram.pack_header(HEADER) + cram.pack_container(blocks, 0, start, span, 3, 7, 30, [len(first)]) + cram.EOF)


def test_container_by_hand(tmp_path):
    r = random.Random(8)
    bases = "".join(r.choices("ACGT", k=5000))
    fasta, path = str(tmp_path / "r.fa"), str(tmp_path / "a.cram")
    with open(fasta, "w") as f:
        f.write(">c1\n" + "\n".join(bases[k : k + 70] for k in range(0, 5000, 70)) + "\n")
    with open(fasta + ".fai", "w") as f:
        f.write("c1\t5000\t4\t70\t71\n")
    _slice_file(path, bases, True)
    p = bgzf.ranges([path], 1 << 30)[0]
    got = list(cram._rows(p, cram.Reference(fasta)))
    a, b, c = bases[100:], bases[120:], bases[125:]
    changed = [x for x in "ACGTN" if x != a[2]][1]
    quals = "".join(chr(33 + k) for k in range(10))
    assert [g[:14] for g in got] == [
        ("8", 67 | 32, 0, "c1", 100, 30, "6M2D4M", 0, "c1", 120, 28, a[:2] + changed + a[3:6] + a[8:12], quals, {"NM": ("i", "1"), "RG": ("Z", "g1")}),
        ("8", 147, 0, "c1", 120, 31, "3M2I5M", 0, "c1", 100, -28, b[:3] + "TT" + b[3:8], "*", {"NM": ("i", "2"), "RG": ("Z", "g1")}),
        ("10", 16, 0, "c1", 125, 32, "10M", -1, "*", -1, 0, c[:10], "*", {"NM": ("i", "3"), "RG": ("Z", "g1")}),
    ]
    with pytest.raises(bgzf.BlockError, match="need a reference"):
        list(cram._rows(p, cram.Reference(None)))
    _slice_file(path, bases, False)
    with pytest.raises(bgzf.BlockError, match="not the one"):
        list(cram._rows(p, cram.Reference(fasta)))
    data = bytearray(open(path, "rb").read())
    data[-len(cram.EOF) - 6] ^= 1
    with open(path, "wb") as f:
        f.write(data)
    with pytest.raises(bgzf.BlockError, match="checksum"):
        list(cram._rows(p, cram.Reference(fasta)))


def test_encoding_by_values():
    encoding, data = cram.int_encoding([-7] * 5, 9)
    read = cram._reader((encoding[0], encoding[2:]), "int", Bits(b""), {})
    assert data is None and [read(), read()] == [-7, -7]
    encoding, data = cram.int_encoding([1, 300, -1], 9)
    read = cram._reader((encoding[0], encoding[2:]), "int", Bits(b""), {9: Bytes(data)})
    assert [read() for _ in range(3)] == [1, 300, -1] and cram.int_encoding([], 9)[1] == b""


def test_encodings_of_bits():
    golomb = cram._reader((8, itf8(0) + itf8(2)), "int", Bits(_bits((0b110, 3), (0b01, 2), (0b0, 1), (0b11, 2))), {})
    assert [golomb(), golomb()] == [9, 3]
    third = cram._reader((2, itf8(1) + itf8(3)), "int", Bits(_bits((0b10, 2), (0b10, 2), (0b0, 1), (0b0, 1))), {})
    assert [third(), third()] == [3, -1]
    with pytest.raises(bgzf.BlockError, match="encoding 77"):
        cram._reader((77, b""), "int", Bits(b""), {})
    assert cram.read_groups(HEADER) == ["g0", "g1"] and cram.contigs_of(HEADER) == CONTIGS
    assert cram.Container(cram.EOF).ends_file
    assert alignments.SCHEMA.startswith("qname")
