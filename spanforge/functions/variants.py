"""Functions of alleles, genotypes, filters and info fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Classes of a variant as bits, and of a genotype as numbers.
REF, SNP, MNP, INDEL, OTHER, BND, OVERLAP = 0, 1, 2, 4, 8, 16, 32
HOM_RR, HOM_AA, HET_RA, HET_AA, HAPL_R, HAPL_A, UNKNOWN = range(7)


def _common(a: Column, b: Column, longest: Column) -> Column:
    """How many leading characters two strings share, at most ``longest``."""
    differ = F.filter(F.sequence(F.lit(1), F.greatest(longest, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.when(longest < 1, F.lit(0)).otherwise(F.coalesce(F.get(differ, F.lit(0)) - 1, longest)).cast("int")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trimmed(ref: Column, alt: Column) -> Column:
    """struct<prefix,ref,alt>: what is left after a common prefix, then a common suffix that leaves
    at least one character of either."""

    def rests(k: Column) -> Column:
        return F.struct(k.alias("prefix"), F.substr(ref, k + 1).alias("ref"), F.substr(alt, k + 1).alias("alt"))

    def without_suffix(t: Column) -> Column:
        r, a = t["ref"], t["alt"]
        most = F.greatest(F.least(F.length(r), F.length(a)) - 1, F.lit(0))
        cut = lambda x, s: F.substring(x, F.lit(1), F.length(x) - s)
        same = _common(F.reverse(F.upper(r)), F.reverse(F.upper(a)), most)
        return _let(same, lambda s: F.struct(t["prefix"].alias("prefix"), cut(r, s).alias("ref"), cut(a, s).alias("alt")))

    k = _common(F.upper(ref), F.upper(alt), F.least(F.length(ref), F.length(alt)))
    return _let(_let(k, rests), without_suffix)


def allele_class(ref: Column, alt: Column) -> Column:
    """The class of one alternative allele."""
    lr, la = F.length(ref), F.length(alt)

    def of(t: Column) -> Column:
        r, a = t["ref"], t["alt"]
        left_r, left_a = lr - t["prefix"], la - t["prefix"]
        same_end = F.upper(F.substring(r, -1, 1)) == F.upper(F.substring(a, -1, 1))
        longer_alt = F.when(F.substr(alt, t["prefix"] + 1).rlike(r"^[\[\]]"), BND).otherwise(INDEL)
        one = lambda other: F.when(other == 1, SNP).when(same_end, INDEL).otherwise(OTHER)
        return (
            F.when((left_r == 0) & (left_a == 0), REF)
            .when(left_r == 0, longer_alt)
            .when(left_a == 0, INDEL)
            .when(F.length(a) == 1, one(F.length(r)))
            .when(F.length(r) == 1, one(F.length(a)))
            .when(F.length(r) == F.length(a), MNP)
            .otherwise(OTHER)
        )

    return (
        F.when(alt == "*", OVERLAP)
        .when((lr == 1) & (la == 1), F.when((alt == ".") | (F.upper(alt) == F.upper(ref)) | (F.upper(alt) == "X"), REF).otherwise(SNP))
        .when(alt.startswith("<"), F.when(alt.isin("<X>", "<*>", "<NON_REF>"), REF).otherwise(OTHER))
        .otherwise(_let(trimmed(ref, alt), of))
    )


def variant_class(ref: Column, alts: Column) -> Column:
    """The classes of all alternative alleles, as bits."""
    return F.aggregate(F.transform(alts, lambda a: allele_class(ref, a)), F.lit(REF), lambda x, c: x.bitwiseOR(c))


def is_snp(ref: Column, alts: Column) -> Column:
    """Whether every allele is one base long and no alternative is a placeholder."""
    return (F.length(ref) == 1) & F.forall(alts, lambda a: (F.length(a) == 1) & ~a.isin(".", "*"))


def variant_end(beg: Column, ref: Column, info: Column) -> Column:
    """Exclusive end (0-based beg): the reference allele's length, or INFO END if it lies beyond beg."""
    said = F.regexp_extract(F.coalesce(info, F.lit("")), r"(?:^|;)END=(\d+)", 1).try_cast("long")
    return F.when(said > beg, said).otherwise(beg + F.length(ref))


def trimmed_beg(beg: Column, ref: Column, alts: Column) -> Column:
    """Where a variant first differs from the reference: beg and the shortest common prefix."""
    return beg + F.coalesce(F.array_min(F.transform(alts, lambda a: F.when(a.startswith("<"), F.lit(0)).otherwise(trimmed(ref, a)["prefix"]))), F.lit(0))


def breakend_mate(alt: Column) -> Column:
    """struct<contig,pos> of a breakend's other side, null if the allele is none."""
    contig, pos = (F.regexp_extract(alt, r"[\[\]]\s*([^\[\]\s]+?)\s*:\s*(\d+)\s*[\[\]]", k) for k in (1, 2))
    return F.when(contig != "", F.struct(contig.alias("contig"), pos.cast("long").alias("pos")))


def parse_genotype(text: Column) -> Column:
    """struct<alleles array<int>, phased> of a genotype like 0/1, 1|2 or ./.; a missing allele is null."""
    parts = F.filter(F.split(text, r"[/|]"), lambda a: a != "")
    return F.struct(F.transform(parts, lambda a: a.try_cast("int")).alias("alleles"), text.contains("|").alias("phased"))


def decode_genotype(codes: Column) -> Column:
    """Allele numbers of codes (allele + 1) * 2 + phased; 0 and 1 are missing (null)."""
    return F.transform(codes, lambda c: F.when(F.shiftright(c, 1) > 0, F.shiftright(c, 1) - 1))


def encode_genotype(alleles: Column, phased: Column) -> Column:
    """The codes of allele numbers; the first allele carries no phase."""
    return F.transform(alleles, lambda a, i: F.coalesce(F.shiftleft(a + 1, 1), F.lit(0)) + F.when(phased & (i > 0), 1).otherwise(0))


def genotype_class(alleles: Column) -> Column:
    """The class of a genotype by its allele numbers."""
    alts = F.array_distinct(F.filter(alleles, lambda a: a > 0))
    has_ref = F.exists(alleles, lambda a: a == 0)
    return (
        F.when(alleles.isNull() | (F.size(alleles) == 0) | F.exists(alleles, lambda a: a.isNull()), UNKNOWN)
        .when(F.size(alleles) == 1, F.when(has_ref, HAPL_R).otherwise(HAPL_A))
        .when(F.size(alts) == 0, HOM_RR)
        .when(has_ref, HET_RA)
        .when(F.size(alts) == 1, HOM_AA)
        .otherwise(HET_AA)
    )


def allele_counts(genotypes: Column, n_alleles: Column) -> Column:
    """How often each allele number occurs in an array of allele arrays; missing ones count nowhere."""
    flat = F.flatten(genotypes)
    return F.transform(F.sequence(F.lit(0), n_alleles - 1), lambda k: F.size(F.filter(flat, lambda a: a == k)))


def counts_from_info(an: Column, ac: Column) -> Column:
    """Allele counts from INFO AN and AC: the reference has what is left."""
    return F.concat(F.array(an - F.aggregate(ac, F.lit(0), lambda a, x: a + x)), ac)


def genotype_index(low: Column, high: Column) -> Column:
    """The place of a diploid genotype in per-genotype fields."""
    return (high * (high + 1) / 2).cast("int") + low


def keep_alleles(keep: Column, values: Column, number: str) -> Column:
    """Per-allele values without the alleles that go. ``keep`` is an array of booleans, the reference
    first (it always stays). Number A has one value per alternative, R per allele, G per diploid
    genotype; other numbers and a lone missing value are left alone."""
    if number == "R":
        out = F.filter(values, lambda _, i: F.get(keep, i) | (i == 0))
    elif number == "A":
        out = F.filter(values, lambda _, i: F.get(keep, i + 1))
    elif number == "G":
        high = lambda i: F.floor((F.sqrt(F.lit(8.0) * i + 1) - 1) / 2).cast("int")
        low = lambda i: i - (high(i) * (high(i) + 1) / 2).cast("int")
        stays = lambda k: F.get(keep, k) | (k == 0)
        out = F.filter(values, lambda _, i: stays(high(i)) & stays(low(i)))
    else:
        return values
    return F.when((F.size(values) == 1) & F.get(values, F.lit(0)).isNull(), values).otherwise(out)


def parse_info(info: Column) -> Column:
    """INFO as map<key, value>; a flag has a null value, ``.`` is empty."""
    return F.when(info.isNull() | info.isin(".", ""), F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(info, F.lit(";"), F.lit("=")))


def info_numbers(info: Column, key: str, kind: str = "double") -> Column:
    """The values of a numeric INFO field; ``.`` is a null element, an absent key a null array."""
    return F.transform(F.split(F.element_at(info, F.lit(key)), ","), lambda x: x.try_cast(kind))


def parse_filters(text: Column) -> Column:
    """FILTER as an array; ``.`` is empty."""
    return F.when(text.isNull() | text.isin(".", ""), F.array().cast("array<string>")).otherwise(F.split(text, ";"))


def has_filter(filters: Column, wanted: list[str]) -> Column:
    """Whether any wanted filter is set; ``.`` stands for none set, and PASS for PASS or none."""
    named = F.arrays_overlap(filters, F.array(*[F.lit(w) for w in wanted])) if wanted else F.lit(False)
    return named | ((F.size(filters) == 0) & F.lit("." in wanted or "PASS" in wanted))


def add_filter(filters: Column, name: str) -> Column:
    """Filters with one more; PASS gives way to any other, and adding PASS removes the others."""
    if name == "PASS":
        return F.array(F.lit("PASS"))
    return F.array_union(F.array_remove(filters, "PASS"), F.array(F.lit(name)))


def remove_filter(filters: Column, name: str) -> Column:
    """Filters without one."""
    return F.array_remove(filters, name)


def set_info(info: Column, key: str, value: Column | None) -> Column:
    """An INFO map with a key set to text (null: a flag); its place is kept if it was there, else it is last."""
    new = F.lit(None).cast("string") if value is None else value.cast("string")
    changed = F.transform_values(info, lambda k, v: F.when(k == key, new).otherwise(v))
    return F.when(F.map_contains_key(info, key), changed).otherwise(F.map_concat(info, F.create_map(F.lit(key), new)))


def remove_info(info: Column, key: str) -> Column:
    """An INFO map without a key."""
    return F.map_filter(info, lambda k, _: k != key)


def info_text(info: Column) -> Column:
    """INFO as text; an empty map is ``.``."""
    said = F.array_join(F.transform(F.map_entries(info), lambda e: F.when(e["value"].isNull(), e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return F.when(said == "", F.lit(".")).otherwise(said)


def format_values(samples: Column, key: str, kind: str = "string") -> Column:
    """The values of a FORMAT field: one array per sample (null where the sample has no such field), in which
    ``.`` is null. samples: array<struct<sample, ..., fields map<string,string>>>."""

    def of(s: Column) -> Column:
        said = F.element_at(s["fields"], F.lit(key))
        return F.when(said.isNotNull(), F.transform(F.split(said, ","), lambda x: F.when(x != ".", x).try_cast(kind)))

    return F.transform(samples, of)


def set_format(samples: Column, key: str, values: Column) -> Column:
    """Samples with a FORMAT field set: ``values`` has one array of texts per sample; a null value is ``.``, a
    null or empty array a lone ``.``, and a null ``values`` removes the field."""

    def text(v: Column) -> Column:
        said = F.array_join(F.transform(v, lambda x: F.coalesce(x.cast("string"), F.lit("."))), ",")
        return F.when(v.isNull() | (F.size(v) < 1), F.lit(".")).otherwise(said)

    def of(s: Column, i: Column) -> Column:
        rest = F.map_filter(s["fields"], lambda k, _: k != key)
        there = F.transform_values(s["fields"], lambda k, v: F.when(k == key, text(F.get(values, i))).otherwise(v))
        new = F.when(F.map_contains_key(s["fields"], key), there).otherwise(F.map_concat(rest, F.create_map(F.lit(key), text(F.get(values, i)))))
        return s.withField("fields", F.when(values.isNull(), rest).otherwise(new))

    return F.transform(samples, of)


def format_keys(samples: Column) -> Column:
    """The FORMAT keys of a record: those of all samples, GT first."""
    keys = F.array_distinct(F.flatten(F.transform(samples, lambda s: F.map_keys(s["fields"]))))
    return F.concat(F.filter(keys, lambda k: k == "GT"), F.filter(keys, lambda k: k != "GT"))


def sample_text(samples: Column) -> Column:
    """FORMAT and sample columns as text, tab-separated; a field that a sample lacks is ``.``."""

    def whole(keys: Column) -> Column:
        one = lambda s: F.array_join(F.transform(keys, lambda k: F.coalesce(F.element_at(s["fields"], k), F.lit("."))), ":")
        return F.array_join(F.concat(F.array(F.array_join(keys, ":")), F.transform(samples, one)), "\t")

    return _let(format_keys(samples), whole)


def set_alleles(alleles: Column) -> tuple[Column, Column]:
    """(ref, alts) of an array of alleles, the reference first."""
    return F.get(alleles, F.lit(0)), F.slice(alleles, 2, F.greatest(F.size(alleles) - 1, F.lit(0)))


def add_id(old: Column, new: str) -> Column:
    """An ID with one more name, unless it is there; a missing one is replaced."""
    names = F.split(old, ";")
    return F.when(old.isNull() | old.isin(".", ""), F.lit(new)).when(F.array_contains(names, new), old).otherwise(F.concat(old, F.lit(f";{new}")))


def matches_target_alleles(target: Column, ref: Column, alts: Column) -> Column:
    """Whether a variant may stand for a target's alleles (an array, the reference first): targets with an
    allele of several bases take variants with an indel, all others those without. A simplified rule."""
    indel = variant_class(ref, alts).bitwiseAND(F.lit(INDEL)) != 0
    return F.when(F.exists(target, lambda a: F.length(a) > 1), indel).otherwise(~indel)
