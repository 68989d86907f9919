"""Header tables: lines (pos, type, tags map) of alignment headers and definitions of variant headers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DEFINITIONS = "pos int, kind string, id string, number string, type string, description string, line string"


def parse_header(spark: SparkSession, text: str) -> DataFrame:
    """An alignment header as a table; a comment line's text is under ``CO``. A header is one document."""
    rows = []
    for k, line in enumerate(t for t in text.splitlines() if t.startswith("@")):
        kind, *fields = line[1:].split("\t")
        tags = {"CO": "\t".join(fields)} if kind == "CO" else dict(f.split(":", 1) for f in fields if ":" in f)
        rows.append((k, kind, list(tags), list(tags.values())))
    arrays = spark.createDataFrame(rows, "pos int, type string, keys array<string>, vals array<string>")
    return arrays.select("pos", "type", F.map_from_arrays("keys", "vals").alias("tags"))  # tags keep their order


def header_text(lines: DataFrame) -> DataFrame:
    """(pos, value): header lines as text."""
    fields = F.array_join(F.transform(F.map_entries("tags"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), "\t")
    body = F.when(F.col("type") == "CO", F.element_at("tags", F.lit("CO"))).otherwise(fields)
    return lines.select("pos", F.concat(F.lit("@"), F.col("type"), F.lit("\t"), body).alias("value")).orderBy("pos")


def add_line(lines: DataFrame, kind: str, **tags: str) -> DataFrame:
    """Lines with one more at the end."""
    top = lines.agg((F.coalesce(F.max("pos"), F.lit(-1)) + 1).cast("int").alias("pos"))
    said = F.create_map(*[F.lit(x) for kv in tags.items() for x in kv]).cast("map<string,string>")
    return lines.unionByName(top.select("pos", F.lit(kind).alias("type"), said.alias("tags")))


def _is(kind: str, key: str | None, value: str | None) -> Column:
    out = F.col("type") == kind
    return out & (F.element_at("tags", F.lit(key)) == value) if key else out


def find_line(lines: DataFrame, kind: str, key: str | None = None, value: str | None = None) -> DataFrame:
    """Lines of a type, or those with a tag's value."""
    return lines.where(_is(kind, key, value))


def nth_line(lines: DataFrame, kind: str, n: int) -> DataFrame:
    """The n-th (from 0) line of a type."""
    return lines.where(F.col("type") == kind).withColumn("_n", F.row_number().over(W.orderBy("pos"))).where(F.col("_n") == n + 1).drop("_n")


def remove_lines(lines: DataFrame, kind: str, key: str | None = None, value: str | None = None) -> DataFrame:
    """Lines without those of a type, or without those with a tag's value."""
    return lines.where(~F.coalesce(_is(kind, key, value), F.lit(False)))


def remove_except(lines: DataFrame, kind: str, key: str, values: list[str]) -> DataFrame:
    """Lines without those of a type whose tag has none of the values."""
    return lines.where((F.col("type") != kind) | F.element_at("tags", F.lit(key)).isin(values))


def update_line(lines: DataFrame, kind: str, key: str, value: str, **tags: str) -> DataFrame:
    """Lines with tags set where a tag has a value."""
    new = F.create_map(*[F.lit(x) for kv in tags.items() for x in kv])
    merged = F.map_concat(F.map_filter("tags", lambda k, _: ~k.isin(list(tags))), new)
    return lines.withColumn("tags", F.when(F.coalesce(_is(kind, key, value), F.lit(False)), merged).otherwise(F.col("tags")))


def remove_tag(lines: DataFrame, kind: str, key: str, value: str, tag: str) -> DataFrame:
    """Lines without one tag where another has a value."""
    return lines.withColumn("tags", F.when(F.coalesce(_is(kind, key, value), F.lit(False)), F.map_filter("tags", lambda k, _: k != tag)).otherwise(F.col("tags")))


def count_lines(lines: DataFrame) -> DataFrame:
    """(type, n)."""
    return lines.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def add_program(lines: DataFrame, name: str, version: str) -> DataFrame:
    """Lines with a program added behind each end of a program chain; its id is made unique."""
    ids = [r[0] for r in lines.where("type = 'PG'").select(F.element_at("tags", F.lit("ID"))).collect()]  # a header's programs
    used = {r[0] for r in lines.where("type = 'PG'").select(F.element_at("tags", F.lit("PP"))).collect()}
    out = lines
    for last in [i for i in ids if i not in used] or [None]:
        n, new = 0, name
        while new in ids:
            n += 1
            new = f"{name}.{n}"
        ids.append(new)
        out = add_line(out, "PG", ID=new, PN=name, VN=version, **({"PP": last} if last else {}))
    return out


def contigs_of(lines: DataFrame) -> DataFrame:
    """(refid, contig, length) of the sequence lines, in order."""
    rows = lines.where("type = 'SQ'").select("pos", F.element_at("tags", F.lit("SN")).alias("contig"), F.element_at("tags", F.lit("LN")).cast("long").alias("length"))
    return rows.select((F.row_number().over(W.orderBy("pos")) - 1).cast("int").alias("refid"), "contig", "length")


def libraries(records: DataFrame, lines: DataFrame) -> DataFrame:
    """Records with ``library``: that of their read group, empty if there is none."""
    groups = lines.where("type = 'RG'").select(F.element_at("tags", F.lit("ID")).alias("rg"), F.element_at("tags", F.lit("LB")).alias("library"))
    return records.join(groups, "rg", "left").withColumn("library", F.coalesce("library", F.lit("")))


def _definition(k: int, line: str) -> list[tuple]:
    """Rows of ``DEFINITIONS`` of one line."""
    if line.startswith("#CHROM"):
        return [(k, "samples", s, None, None, None, line) for s in line.split("\t")[9:]]
    if m := re.match(r"##([^=]+)=<(.*)>\s*$", line):
        said = {a: b.strip('"') for a, b in re.findall(r'([A-Za-z0-9_.]+)=("(?:\\.|[^"\\])*"|[^,]*)', m[2])}
        return [(k, m[1], said.get("ID"), said.get("Number") or said.get("length"), said.get("Type"), said.get("Description"), line)]
    if m := re.match(r"##([^=]+)=(.*)$", line):
        return [(k, m[1], None, None, None, m[2], line)]
    return []


def parse_variant_header(spark: SparkSession, text: str) -> DataFrame:
    """Definitions of a variant header: ##KIND=<ID=...,Number=...,Type=...,Description=...> and plain
    ##key=value lines (id null). The sample line is under kind ``samples``."""
    return spark.createDataFrame([r for k, line in enumerate(text.splitlines()) for r in _definition(k, line)], DEFINITIONS)


def append_definition(definitions: DataFrame, line: str) -> DataFrame:
    """Definitions with one more line behind those of its kind's end, unless its kind has the id already (or,
    without an id, the line)."""
    spark = definitions.sparkSession
    new = spark.createDataFrame(_definition(0, line), DEFINITIONS)
    key = F.coalesce("id", "line")
    there = definitions.where("kind <> 'samples'").select(F.col("kind").alias("_kind"), key.alias("_key"))
    new = new.join(there, (F.col("kind") == F.col("_kind")) & (key == F.col("_key")), "left_anti")
    top = definitions.where("kind <> 'samples'").agg(F.coalesce(F.max("pos"), F.lit(-1)) + 1).first()[0]
    moved = definitions.withColumn("pos", F.when(F.col("kind") == "samples", F.greatest("pos", F.lit(top + 1))).otherwise(F.col("pos")).cast("int"))
    return moved.unionByName(new.withColumn("pos", F.lit(top).cast("int")))


def remove_definitions(definitions: DataFrame, kind: str, id_: str | None = None) -> DataFrame:
    """Definitions without one of a kind, or without all of it; the sample line is none of them."""
    gone = (F.col("kind") == kind) & (F.lit(True) if id_ is None else F.col("id").eqNullSafe(id_)) & (F.col("kind") != "samples")
    return definitions.where(~gone)


def find_definition(definitions: DataFrame, kind: str, id_: str) -> DataFrame:
    """The definition of an id."""
    return definitions.where((F.col("kind") == kind) & (F.col("id") == id_))


def version_of(definitions: DataFrame) -> str | None:
    """The format version that a header states."""
    found = definitions.where("kind = 'fileformat'").orderBy("pos").select("description").first()
    return found[0] if found else None


def set_version(definitions: DataFrame, version: str) -> DataFrame:
    """Definitions under another format version, which stands first."""
    line = f"##fileformat={version}"
    first = definitions.sparkSession.createDataFrame([(-1, "fileformat", None, None, None, version, line)], DEFINITIONS)
    return first.unionByName(definitions.where("kind <> 'fileformat'"))


def add_sample(definitions: DataFrame, name: str) -> DataFrame:
    """Definitions with one more sample at the end; a name that is there already is refused."""
    samples = [r[0] for r in definitions.where("kind = 'samples'").orderBy("pos", F.length("line")).select("id").collect()]  # a header's samples
    if name in samples:
        raise ValueError(f"sample {name} is there already")
    top = definitions.agg(F.coalesce(F.max("pos"), F.lit(-1))).first()[0]
    at = definitions.where("kind = 'samples'").agg(F.coalesce(F.max("pos"), F.lit(top + 1))).first()[0]
    line = definitions.where("kind = 'samples'").select("line").first()
    names = line[0].split("\t")[9:] if line else []
    rows = _definition(at, sample_line([*names, name]))
    return definitions.where("kind <> 'samples'").unionByName(definitions.sparkSession.createDataFrame(rows, DEFINITIONS))


def sample_line(names: list[str]) -> str:
    """The line of column names."""
    fixed = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"
    return "\t".join([fixed, "FORMAT", *names]) if names else fixed


def variant_header_text(definitions: DataFrame) -> str:
    """A variant header as text: its lines once each, in order, the sample line last."""
    rows = [tuple(r) for r in definitions.select("pos", "kind", "line").collect()]  # a header
    lines = list(dict.fromkeys(line for _, kind, line in sorted(rows, key=lambda r: r[0]) if kind != "samples"))
    last = next((line for _, kind, line in rows if kind == "samples"), sample_line([]))
    return "\n".join([*lines, last]) + "\n"


def merge_headers(first: DataFrame, second: DataFrame) -> DataFrame:
    """Definitions of both headers; of equal (kind, id) the first's stays. Lines without id stay once each."""
    both = first.withColumn("_o", F.lit(0)).unionByName(second.withColumn("_o", F.lit(1)))
    key = F.coalesce("id", "line")
    rank = F.row_number().over(W.partitionBy("kind", key).orderBy("_o", "pos"))
    return both.withColumn("_n", rank).where("_n = 1").drop("_n", "_o")


def _typed(kind: str):
    return lambda x: F.when(x != ".", x).try_cast(kind)


def typed_info(variants: DataFrame, definitions: DataFrame, column: str = "info") -> DataFrame:
    """Variants with one typed column ``info_<ID>`` per INFO definition. ``info`` is a map. Flags are
    booleans, Number 1 is a scalar, other numbers are arrays; ``.`` is null."""
    kinds = {"Integer": "int", "Float": "double", "String": "string", "Character": "string"}
    cols = {}
    for r in definitions.where("kind = 'INFO'").select("id", "number", "type").collect():  # a header's definitions
        raw = F.element_at(column, F.lit(r["id"]))
        kind = kinds.get(r["type"], "string")
        if r["type"] == "Flag":
            cols[f"info_{r['id']}"] = F.map_contains_key(column, r["id"])
        elif r["number"] == "1":
            cols[f"info_{r['id']}"] = F.when(raw != ".", raw).try_cast(kind)
        else:
            cols[f"info_{r['id']}"] = F.transform(F.split(raw, ","), _typed(kind))
    return variants.withColumns(cols)


def unique_lines(lines: DataFrame, columns: list[str]) -> DataFrame:
    """Lines that differ in the given columns, each once."""
    return lines.select(*columns).dropDuplicates()


def with_header(body: DataFrame, header: DataFrame) -> DataFrame:
    """Text lines (value) of a body under another header: header first, old header lines dropped."""
    own = header.select(F.lit(0).alias("part"), F.col("pos").cast("long").alias("pos"), "value")
    rest = body.where(~F.col("value").startswith("#") & ~F.col("value").rlike("^@[A-Z]{2}\t")).select(F.lit(1).alias("part"), F.monotonically_increasing_id().alias("pos"), "value")
    return own.unionByName(rest).orderBy("part", "pos").select("value")
