"""Functions of bases, qualities, CIGAR strings, flags and tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits of the FLAG field, in order.
FLAG_NAMES = ("PAIRED", "PROPER_PAIR", "UNMAP", "MUNMAP", "REVERSE", "MREVERSE", "READ1", "READ2", "SECONDARY", "QCFAIL", "DUP", "SUPPLEMENTARY")
# IUPAC bases and their complements.
BASES = "ACGTUMRWSYKVHDBN"
COMPLEMENTS = "TGCAAKYWSRMBDHVN"

NOT_PRIMARY = 256 | 512 | 2048


def reverse_complement(seq: Column) -> Column:
    """The opposite strand, case kept; other characters stay."""
    return F.reverse(F.translate(seq, BASES + BASES.lower(), COMPLEMENTS + COMPLEMENTS.lower()))


def is_primary(flag: Column) -> Column:
    """Neither secondary, nor supplementary, nor failed."""
    return flag.bitwiseAND(F.lit(NOT_PRIMARY)) == 0


def flag_names(flag: Column) -> Column:
    """The names of the bits set, joined by commas in order of the bits."""
    return F.concat_ws(",", *[F.when(flag.bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(FLAG_NAMES)])


def flag_value(names: Column) -> Column:
    """The FLAG of comma-joined names, or of a number as text; an unknown name is an error."""
    parts = F.filter(F.split(F.upper(names), ","), lambda n: n != "")
    known = F.create_map(*[F.lit(x) for i, n in enumerate(FLAG_NAMES) for x in (n, 1 << i)])
    bit = lambda n: F.coalesce(F.element_at(known, n), F.raise_error(F.concat(F.lit("unknown flag "), n)).cast("int"))
    number = F.try_to_number(names, F.lit("99999")).cast("int")
    return F.coalesce(number, F.aggregate(parts, F.lit(0), lambda a, n: a.bitwiseOR(bit(n))))


def oriented(flag: Column, seq: Column, qual: Column) -> tuple[Column, Column]:
    """Bases and qualities in the direction in which they were read."""
    back = flag.bitwiseAND(F.lit(16)) != 0
    return F.when(back, reverse_complement(seq)).otherwise(seq), F.when(back, F.reverse(qual)).otherwise(qual)


def parse_cigar(cigar: Column) -> Column:
    """A CIGAR string as array<struct<op,len>>; ``*`` and null have no operations."""
    ops = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit(r"(\d+)([MIDNSHP=XB])"), F.lit(0))
    return F.transform(ops, lambda o: F.struct(F.substring(o, -1, 1).alias("op"), F.regexp_extract(o, r"^(\d+)", 1).cast("int").alias("len")))


def cigar_length(cigar: Column, ops: str) -> Column:
    """The summed length of the operations named in ``ops`` of a parsed CIGAR."""
    return F.aggregate(F.filter(cigar, lambda o: F.lit(ops).contains(o["op"])), F.lit(0), lambda a, o: a + o["len"])


def query_length(cigar: Column) -> Column:
    """Bases of the read that the alignment consumes."""
    return cigar_length(cigar, "MIS=X")


def reference_length(cigar: Column) -> Column:
    """Positions of the reference that the alignment consumes."""
    return cigar_length(cigar, "MDN=X")


def end_position(pos: Column, cigar: Column, flag: Column) -> Column:
    """Exclusive end of an alignment (0-based pos); unmapped or empty ones take one position."""
    size = reference_length(cigar)
    return pos + F.when((flag.bitwiseAND(F.lit(4)) != 0) | (size == 0), F.lit(1)).otherwise(size)


def text_end_position(pos: Column, cigar: Column) -> Column:
    """Exclusive end by the rule of generic text indexes: only M, D and N count; at least one position."""
    return pos + F.greatest(cigar_length(cigar, "MDN"), F.lit(1))


def base_count(seq: Column, bases: str) -> Column:
    """How many characters of ``seq`` are among ``bases``, in either case."""
    return F.length(seq) - F.length(F.translate(seq, bases.upper() + bases.lower(), ""))


def quality_bytes(qual: Column) -> Column:
    """Phred values of a +33 string."""
    return F.transform(F.split(qual, ""), lambda c: F.ascii(c) - 33)


def _mapped(qual: Column, low: int, value) -> Column:
    """Each character through ``value`` (of its code); codes under ``low`` are an error."""
    one = lambda c: F.when(F.ascii(c) < low, F.raise_error(F.concat(F.lit("quality out of range: "), c)).cast("string")).otherwise(F.chr(value(F.ascii(c))))
    return F.array_join(F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), one), "")


def phred64_to_33(qual: Column) -> Column:
    """A +64 string as +33."""
    return _mapped(qual, 64, lambda a: (a - 31).cast("long"))


def solexa64_to_33(qual: Column) -> Column:
    """A Solexa +64 string as Phred +33: 33 + q + 10 log10(1 + 10^(-q/10)), truncated."""
    q = lambda a: (a - 64).cast("double")
    return _mapped(qual, 59, lambda a: F.floor(F.lit(33.0) + q(a) + F.lit(10.0) * F.log10(F.lit(1.0) + F.pow(F.lit(10.0), -q(a) / 10))).cast("long"))


def restored_quality(tags: Column, qual: Column, tag: str = "OQ") -> Column:
    """The quality kept in a tag if there is one, else the record's own."""
    return F.coalesce(F.element_at(tags, F.lit(tag)), qual)


def fastq_text(name: Column, seq: Column, qual: Column) -> Column:
    """One FASTQ record."""
    return F.concat(F.lit("@"), name, F.lit("\n"), seq, F.lit("\n+\n"), qual, F.lit("\n"))


def bare_name(name: Column) -> Column:
    """A read name without comment and without /1 or /2."""
    return F.regexp_replace(F.regexp_extract(name, r"^@?(\S*)", 1), r"/[12]$", "")


def parse_tags(fields: Column) -> Column:
    """Optional fields ``XX:t:value`` as map<tag, struct<type,value>>; the first of equal tags stays."""
    good = F.filter(fields, lambda f: f.rlike(r"^[A-Za-z][A-Za-z0-9]:[AifZHBcCsSId]:"))
    firsts = F.filter(good, lambda f, i: F.array_position(F.transform(good, lambda g: F.substring(g, 1, 2)), F.substring(f, 1, 2)) == i + 1)
    return F.map_from_entries(F.transform(firsts, lambda f: F.struct(F.substring(f, 1, 2).alias("tag"), F.struct(F.substring(f, 4, 1).alias("type"), F.substr(f, F.lit(6)).alias("value")))))


def tag_value(tags: Column, tag: str, kind: str = "string") -> Column:
    """A tag's value as ``kind``; null if absent or not of that kind."""
    return F.element_at(tags, F.lit(tag))["value"].try_cast(kind)


def with_tag(tags: Column, tag: str, kind: str, value: Column) -> Column:
    """Tags with one set or replaced."""
    rest = F.map_filter(tags, lambda k, _: k != tag)
    return F.map_concat(rest, F.create_map(F.lit(tag), F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value"))))


def without_tag(tags: Column, tag: str) -> Column:
    """Tags without one."""
    return F.map_filter(tags, lambda k, _: k != tag)


def tag_array(tags: Column, tag: str) -> Column:
    """The numbers of an array tag (type B): the part behind the element type."""
    return F.transform(F.slice(F.split(F.element_at(tags, F.lit(tag))["value"], ","), 2, 1 << 30), lambda x: x.cast("double"))


def insertion_text(seq: Column, at: Column, length: Column) -> Column:
    """Inserted bases behind the 0-based read position ``at``."""
    return F.substring(seq, at + 2, length)
