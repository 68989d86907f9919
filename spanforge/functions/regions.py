"""Region strings and numbers."""

from __future__ import annotations

import re
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

FAR = 1 << 35
_NUMBER = re.compile(r"\s*([+-]?)([\d,]*)(?:\.(\d*))?(?:[eE]([+-]?\d+))?([kKmMgG]?)")
_SUFFIX = {"": 0, "k": 3, "m": 6, "g": 9}


class RegionError(ValueError):
    """A region string that names no region."""


@dataclass(frozen=True)
class Region:
    """A half-open 0-based interval of a contig."""

    contig: str
    beg: int
    end: int


def parse_decimal(text: str, commas: bool = True) -> tuple[int, int]:
    """(value, characters read) of a number with thousands separators, exponent or suffix k, M, G.
    A fraction that is left over is cut off."""
    m = _NUMBER.match(text)
    if not m or not (m[2].replace(",", "") or m[3]):
        raise RegionError(f"no number in {text!r}")
    if "," in m[2] and not commas:
        digits = m[2].split(",")[0]
        return int(m[1] + digits), m.start(2) + len(digits)
    value = Fraction(int(m[2].replace(",", "") or 0)) + (Fraction(int(m[3]), 10 ** len(m[3])) if m[3] else 0)
    value *= Fraction(10) ** (int(m[4] or 0) + _SUFFIX[m[5].lower()])
    return (-1 if m[1] == "-" else 1) * int(value), m.end()


def _span(text: str, one_position: bool, commas: bool) -> tuple[int, int]:
    """0-based half-open span of ``beg-end``, ``beg``, ``beg-`` or ``-end``; end 0 is open."""
    beg, at = (1, 0) if text.startswith("-") else parse_decimal(text, commas)
    rest = text[at:]
    if not rest:
        return beg - 1, beg if one_position else 0
    if rest == "-":
        return beg - 1, 0
    if not rest.startswith("-"):
        raise RegionError(f"unreadable span {text!r}")
    end, used = parse_decimal(rest[1:], commas)
    if rest[1 + used :]:
        raise RegionError(f"unreadable span {text!r}")
    return beg - 1, end


def parse_region(text: str, contigs: dict[str, int], one_position: bool = False, commas: bool = True) -> Region:
    """The region of ``name``, ``name:span`` or ``{name}:span``, against contigs and their lengths.

    A name in braces is taken as it is. Otherwise the last colon parts name and span, unless the whole
    string is a contig; if both readings are possible, the string is an error.
    """
    if text.startswith("{"):
        close = text.find("}")
        if close < 0 or text[close + 1 : close + 2] not in ("", ":"):
            raise RegionError(f"unclosed name in {text!r}")
        name, span = text[1:close], text[close + 2 :]
    else:
        name, colon, span = text.rpartition(":")
        if not colon:
            name, span = text, ""
        elif text in contigs:
            if name in contigs:
                raise RegionError(f"{text!r} can be read in two ways; put the name in braces")
            name, span = text, ""
    if name not in contigs:
        raise RegionError(f"no contig {name!r}")
    beg, end = _span(span, one_position, commas) if span else (0, 0)
    end = end or contigs[name]
    if beg < 0 or beg >= end:
        raise RegionError(f"empty region {text!r}")
    return Region(name, beg, end)


def parse_regions(text: str, contigs: dict[str, int]) -> list[Region]:
    """Regions parted by commas; numbers then have no thousands separators."""
    return [parse_region(t, contigs, commas=False) for t in text.split(",") if t]


def region_parts(text: Column) -> Column:
    """struct<contig,beg,end> of simple region strings in a column: ``name`` reaches from 0 to ``FAR``,
    ``name:pos`` is one position, ``name:pos-`` is open. Null if a span is unreadable."""
    name = F.regexp_extract(text, r"^(.*?)(?::([\d,]+)(-?)([\d,]*))?$", 1)
    number = lambda k: F.regexp_replace(F.regexp_extract(text, r"^(.*?)(?::([\d,]+)(-?)([\d,]*))?$", k), ",", "").try_cast("long")
    dash = F.regexp_extract(text, r"^(.*?)(?::([\d,]+)(-?)([\d,]*))?$", 3)
    beg, end = number(2), number(4)
    return F.struct(
        name.alias("contig"),
        F.coalesce(beg - 1, F.lit(0).cast("long")).alias("beg"),
        F.when(beg.isNull(), F.lit(FAR)).when(dash == "", beg).otherwise(F.coalesce(end, F.lit(FAR))).cast("long").alias("end"),
    )


def fetch(seq: Column, beg: Column, end: Column) -> Column:
    """Bases [beg, end) of a sequence, both ends clipped to it; empty if nothing is left."""
    low = F.least(F.greatest(beg, F.lit(0)), F.length(seq))
    high = F.least(F.greatest(end, low), F.length(seq))
    return F.substring(seq, (low + 1).cast("int"), (high - low).cast("int"))


def text_interval(beg: Column, end: Column, zero_based: bool) -> tuple[Column, Column]:
    """Half-open 0-based interval of a text record's columns. A 1-based inclusive end is an exclusive
    0-based one; a begin under 0 is 0, an end under 1 is 1."""
    return F.greatest(beg if zero_based else beg - 1, F.lit(0)), F.greatest(end, F.lit(1))
