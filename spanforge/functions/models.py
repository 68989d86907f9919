"""Base modifications and base alignment quality: per-read functions over Arrow batches."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_OPPOSITE = str.maketrans("ACGTUN", "TGCAAN")
MODIFICATION = "array<struct<qpos:int,base:string,strand:string,code:string,prob:double>>"


def modifications(seq: str, mm: str, ml: list[int] | None, reverse: bool) -> list[tuple[int, str, str, str, float | None]]:
    """(position in ``seq``, canonical base, strand, code, probability) of each modified base.

    ``mm`` lists, per base, strand and code, how many bases of that kind are skipped before the next
    modified one, counted in read direction; ``ml`` has a byte per call, calls with several codes one per
    code. A byte b stands for the middle of its range, (b + 0.5) / 256; without ``ml`` it is unknown."""
    read = seq.upper()[::-1].translate(_OPPOSITE) if reverse else seq.upper()
    out, used = [], 0
    for entry in filter(None, mm.split(";")):
        head, *skips = entry.split(",")
        m = re.fullmatch(r"([ACGTUN])([+-])(\d+|[a-z]+|[ACGTUN])([.?]?)", head)
        if not m:
            raise ValueError(f"unreadable modification {head!r}")
        base, strand, said, _ = m.groups()
        codes = [said] if said.isdigit() else list(said)
        kind = "T" if base == "U" else base
        places = [k for k, c in enumerate(read) if kind == "N" or c == kind or (c == "U" and kind == "T")]
        at = -1
        for skip in skips:
            at += int(skip) + 1
            if at >= len(places):
                raise ValueError(f"{head!r} names more bases than there are")
            qpos = len(read) - 1 - places[at] if reverse else places[at]
            for code in codes:
                prob = (ml[used] + 0.5) / 256 if ml is not None and used < len(ml) else None
                used += 1
                out.append((qpos, base, strand, code, prob))
    return sorted(out, key=lambda x: x[0])


def base_modifications(seq: Column, mm: Column, ml: Column, flag: Column) -> Column:
    """``modifications`` of reads; ``ml`` is array<int>. Null without ``mm``."""

    @F.pandas_udf(MODIFICATION)
    def run(args: pd.DataFrame) -> pd.Series:
        out = []
        for s, m, l, f in args.itertuples(index=False, name=None):
            if not isinstance(m, str) or not isinstance(s, str):
                out.append(None)
                continue
            found = modifications(s, m, None if l is None else list(l), bool(int(f) & 16))
            out.append([dict(zip(("qpos", "base", "strand", "code", "prob"), x, strict=True)) for x in found])
        return pd.Series(out, dtype="object")

    return run(F.struct(seq.alias("s"), mm.alias("m"), ml.cast("array<int>").alias("l"), flag.alias("f")))


READS_AT_ONCE = 64


def _padded(rows: list, width: int, fill: float, kind) -> np.ndarray:
    out = np.full((len(rows), width), fill, kind)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def alignment_posteriors(reads: list[tuple[str, str, list[int], list[int]]], opening: float = 0.001, extension: float = 0.1, band: int = 7) -> list[np.ndarray]:
    """For each base of each read (reference, query, qualities, place of each base in the reference or -1), the
    probability that it is aligned to that place, by the forward and backward passes of a profile of match,
    insertion and deletion states in a band around the given alignment.

    All reads take each step together. A run of deletions within a row is a sum over its lengths, of which a
    band has no more than its width."""
    n = np.array([len(r[1]) for r in reads])
    m = np.array([len(r[0]) for r in reads])
    longest, widest = int(n.max()), int(m.max())
    code = lambda k: _padded([np.frombuffer(r[k].encode("latin-1", "replace"), np.uint8) for r in reads], (widest, longest)[k], 78, np.uint8)  # noqa: E731  78: N
    ref, query = code(0), code(1)
    error = 10 ** (-_padded([r[2] for r in reads], longest, 0, float) / 10)
    middle = _padded([r[3] for r in reads], longest, -1, np.int64)
    end = (1 / (2 * n))[:, None]
    mm, to_gap = (1 - 2 * opening) * (1 - end), opening * (1 - end)
    im, ii, dm, dd = (1 - extension) * (1 - end), extension * (1 - end), 1 - extension, extension
    # the band follows the given alignment
    first = np.array([next((x for x in r[3] if x >= 0), 0) for r in reads])
    seen = np.maximum.accumulate(np.where(middle >= 0, np.arange(longest), -1), axis=1)
    line = np.where(seen >= 0, np.take_along_axis(middle, np.maximum(seen, 0), axis=1), first[:, None])
    k = np.arange(widest)
    within = k < m[:, None]

    def banded(i: int) -> np.ndarray:
        return (k >= line[:, i, None] - band) & (k <= line[:, i, None] + band) & within & (i < n)[:, None]

    def emits(i: int) -> np.ndarray:
        q, e = query[:, i, None], error[:, i, None]
        return np.where((q == 78) | (ref == 78), 1.0, np.where(q == ref, 1 - e, e / 3))

    def shifted(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(x)
        if by > 0:
            out[:, by:] = x[:, :-by]
        else:
            out[:, :by] = x[:, -by:]
        return out

    def runs(x: np.ndarray, ahead: int) -> np.ndarray:
        """The sums of dd^t x, t places on in one direction."""
        out, weight, part = x.copy(), 1.0, x
        for _ in range(min(2 * band, widest - 1)):
            part, weight = shifted(part, ahead), weight * dd
            out += weight * part
        return out

    def total(*parts: np.ndarray) -> np.ndarray:
        found = sum(p.sum(axis=1) for p in parts)[:, None]
        return np.where(found > 0, found, 1.0)

    match, insert, scale = np.zeros((longest, len(reads), widest)), np.zeros((longest, len(reads), widest)), np.ones((longest, len(reads), 1))
    fm, fi, fd = (np.zeros((len(reads), widest)) for _ in range(3))
    for i in range(longest):
        here = banded(i)
        if not i:
            fm, fi, fd = emits(0) * (1 - opening) / m[:, None] * here, opening / m[:, None] / 4 * here, np.zeros_like(fd)
        else:
            fm, fi = emits(i) * (mm * shifted(fm, 1) + im * shifted(fi, 1) + dm * shifted(fd, 1)) * here, (to_gap * fm + ii * fi) / 4 * here
            fd = runs(shifted(to_gap * fm, 1), 1) * here
            scale[i] = total(fm, fi, fd)
            fm, fi, fd = fm / scale[i], fi / scale[i], fd / scale[i]
        if not i:
            scale[0] = total(fm, fi)
            fm, fi = fm / scale[0], fi / scale[0]
        match[i], insert[i] = fm, fi
    out = np.zeros((len(reads), longest))
    bm, bi = np.zeros((len(reads), widest)), np.zeros((len(reads), widest))
    for i in range(longest - 1, -1, -1):
        last = (i == n - 1)[:, None]
        if i < longest - 1:
            nxt, ins, here = shifted(emits(i + 1) * bm, -1), bi / 4, banded(i)
            bd = runs(dm * nxt * here, -1) * here if i else np.zeros_like(nxt)
            bm, bi = (mm * nxt + to_gap * ins + to_gap * shifted(bd, -1)) * here / scale[i + 1], (im * nxt + ii * ins) * here / scale[i + 1]
        bm, bi = np.where(last, end * within, bm), np.where(last, end * within, bi)
        both = match[i] * bm
        whole = total(both, insert[i] * bi)[:, 0]
        at = np.clip(middle[:, i], 0, widest - 1)
        out[:, i] = np.where((middle[:, i] >= 0) & (i < n), both[np.arange(len(reads)), at] / whole, 0.0)
    return [out[r, : n[r]] for r in range(len(reads))]


def alignment_qualities(reads: list[tuple[str, str, list[int], list[int]]]) -> list[list[int]]:
    """Qualities of reads (reference, query, qualities, places) capped by how surely each base is aligned where
    the alignment has it; bases that are not aligned to the reference keep theirs."""
    out = [list(r[2]) for r in reads]
    some = [k for k, r in enumerate(reads) if r[0] and r[1]]
    for at in range(0, len(some), READS_AT_ONCE):
        part = some[at : at + READS_AT_ONCE]
        for k, sure in zip(part, alignment_posteriors([(reads[k][0].upper(), reads[k][1].upper(), *reads[k][2:]) for k in part]), strict=True):
            caps = np.where(sure >= 1 - 1e-10, 99, np.floor(-10 * np.log10(np.maximum(1 - sure, 1e-10)) + 0.499))
            out[k] = [int(min(q, c)) if x >= 0 else q for q, c, x in zip(reads[k][2], caps.tolist(), reads[k][3], strict=True)]
    return out


def alignment_quality(ref: str, query: str, quals: list[int], middle: list[int]) -> list[int]:
    """``alignment_qualities`` of one read."""
    return alignment_qualities([(ref, query, quals, middle)])[0]


def _placed(cigar: str, pos: int, beg: int) -> list[int]:
    """Reference offsets (from ``beg``) of a read's bases; -1 where a base is on no reference base."""
    out, at = [], pos - beg
    for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar or ""):
        if op in "M=X":
            out += range(at, at + int(n))
        elif op in "IS":
            out += [-1] * int(n)
        if op in "MDN=X":
            at += int(n)
    return out


def base_alignment_quality(ref: Column, ref_beg: Column, seq: Column, qual: Column, cigar: Column, pos: Column) -> Column:
    """+33 qualities capped by ``alignment_quality``. ``ref`` is the reference from ``ref_beg`` on, some bases
    wider than the alignment; reads with a skip (N) or without qualities keep theirs."""

    @F.pandas_udf("string")
    def run(args: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for part in args:
            out, places, reads = [], [], []
            for r, rb, s, q, c, p in part.itertuples(index=False, name=None):
                out.append(q)
                if not all(isinstance(x, str) for x in (r, s, q, c)) or len(s) != len(q) or "N" in c or c == "*":
                    continue
                middle = _placed(c, int(p), int(rb))
                if len(middle) == len(s) and max(middle, default=-1) < len(r):
                    places.append(len(out) - 1)
                    reads.append((r, s, [ord(x) - 33 for x in q], middle))
            for k, found in zip(places, alignment_qualities(reads), strict=True):
                out[k] = "".join(chr(33 + x) for x in found)
            yield pd.Series(out, dtype="object")

    return run(F.struct(ref.alias("r"), ref_beg.alias("rb"), seq.alias("s"), qual.alias("q"), cigar.alias("c"), pos.alias("p")))


CAP_FLOOR, CAP_CEILING = 13, 33


def capped_mapping_quality(ref: str, ref_beg: int, seq: str, quals: list[int], cigar: str, pos: int, threshold: int = 40) -> int:
    """The most that a mapping quality should be, from what disagrees with the reference; -1 if too much does.

    Against it count the qualities of mismatches (at most 33 each, bases of quality 13 and more only), less
    the logarithm of the number of ways to choose as many among the bases compared, and a fifth of the
    clipped bases' qualities (13 each where hard clipping lost them). Where the reference ends, so does the count."""
    against = compared = wrong = clipped = read = 0
    at = pos - ref_beg
    for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar or ""):
        size = int(n)
        if op in "M=XD" and at + size > len(ref):
            size = max(len(ref) - at, 0)
        if op in "M=X":
            pairs = zip(seq[read : read + size].upper(), quals[read : read + size], ref[at : at + size].upper(), strict=True)
            sure = [(a != b, q) for a, q, b in pairs if q >= CAP_FLOOR and a in "ACGT" and b in "ACGT"]
            compared += len(sure) + (size if size == int(n) else 0)
            wrong += sum(x for x, _ in sure)
            against += sum(min(q, CAP_CEILING) for x, q in sure if x)
        elif op == "S":
            clipped += sum(quals[read : read + size])
        elif op == "H":
            clipped += CAP_FLOOR * size
        if op in "M=XD" and size < int(n):
            break
        at += size if op in "M=XDN" else 0
        read += size if op in "M=XIS" else 0
    ways = wrong * math.log(compared) - math.lgamma(wrong + 1) if wrong else 0.0
    doubt = against - 10 / math.log(10) * ways + clipped / 5
    if doubt > threshold:
        return -1
    return int(math.sqrt((threshold - max(doubt, 0)) / threshold) * threshold + 0.499)


def mapping_quality_cap(ref: Column, ref_beg: Column, seq: Column, qual: Column, cigar: Column, pos: Column, threshold: int = 40) -> Column:
    """``capped_mapping_quality`` of reads with +33 qualities; null where one of the inputs is."""

    @F.pandas_udf("int")
    def run(args: pd.DataFrame) -> pd.Series:
        out = []
        for r, rb, s, q, c, p in args.itertuples(index=False, name=None):
            whole = all(isinstance(x, str) for x in (r, s, q, c)) and len(s) == len(q)
            out.append(capped_mapping_quality(r, int(rb), s, [ord(x) - 33 for x in q], c, int(p), threshold) if whole else None)
        return pd.Series(out, dtype="Int32")

    return run(F.struct(ref.alias("r"), ref_beg.alias("rb"), seq.alias("s"), qual.alias("q"), cigar.alias("c"), pos.alias("p")))


def _more_errors(n: int, quality: int) -> np.ndarray:
    """For k = 0 to n - 1, how unlikely (Phred) it is that k errors among n bases of one quality are k + 1."""
    e = 10 ** (-quality / 10)
    k = np.arange(n + 1)
    fact = np.array([math.lgamma(i + 1) for i in range(n + 1)])
    log = fact[n] - fact - fact[::-1] + k * math.log(e) + (n - k) * math.log1p(-e)
    tail = np.logaddexp.accumulate(log[::-1])[::-1]  # log of the chance of k errors or more
    return 10 / math.log(10) * (tail[:-1] - tail[1:])


def genotype_likelihoods(alleles: list[int], quals: list[int], strands: list[int], n_alleles: int, dependency: float = 0.83, floor: float = 0.03) -> np.ndarray:
    """Phred-scaled likelihoods of all diploid genotypes (a symmetric matrix) from the bases over a position.

    Bases are taken from the best quality down. The k-th of equal bases on one strand counts with weight
    dependency^k down to ``floor``, because errors there are not independent; each costs what one more
    error than seen so far of its kind would. A heterozygous genotype adds the chance of its share."""
    out = np.zeros((n_alleles, n_alleles))
    n = len(alleles)
    if not n:
        return out
    cost, seen = np.zeros(n_alleles), np.zeros(n_alleles, int)
    same: dict[tuple[int, int], int] = {}
    tables: dict[int, np.ndarray] = {}
    for q, strand, a in sorted(zip(quals, strands, alleles, strict=True), reverse=True):
        q = min(max(q, 4), 63)
        if q not in tables:
            tables[q] = _more_errors(n, q)
        if a >= n_alleles:
            continue
        k = same.get((strand, a), 0)
        cost[a] += (dependency**k * (1 - floor) + floor if k else 1.0) * tables[q][seen[a]]
        seen[a] += 1
        same[strand, a] = k + 1
    for i in range(n_alleles):
        for j in range(i, n_alleles):
            rest = cost.sum() - cost[i] - (cost[j] if i != j else 0)
            if i != j:
                both = int(seen[i] + seen[j])
                rest -= 10 / math.log(10) * (math.lgamma(both + 1) - math.lgamma(seen[i] + 1) - math.lgamma(seen[j] + 1) - both * math.log(2))
            out[i, j] = out[j, i] = max(rest, 0.0)
    return out


def position_likelihoods(alleles: Column, quals: Column, strands: Column, n_alleles: int = 4, dependency: float = 0.83) -> Column:
    """``genotype_likelihoods`` of arrays, as an array over genotypes in the order of per-genotype fields."""

    @F.pandas_udf("array<double>")
    def run(args: pd.DataFrame) -> pd.Series:
        pairs = [(i, j) for j in range(n_alleles) for i in range(j + 1)]
        tables = (genotype_likelihoods(list(a), list(q), list(s), n_alleles, dependency) for a, q, s in args.itertuples(index=False, name=None))
        return pd.Series([[float(t[p]) for p in pairs] for t in tables], dtype="object")

    return run(F.struct(alleles.alias("a"), quals.alias("q"), strands.alias("s")))
