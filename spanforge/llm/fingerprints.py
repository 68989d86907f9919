"""Document fingerprints by one-permutation MinHash [native].

Every shingle (five words, lower case) is hashed once.  The hash's top bits name its bin and each of
the 256 bins keeps its smallest hash.  An empty bin borrows the value of a filled one by optimal
densification: a fixed pseudo-random sequence of bins, drawn for that bin, is followed to the first
filled bin.  The low-order 8 bits of each value are packed, and the share of equal positions is
corrected for chance equality: (share - 2^-8) / (1 - 2^-8), at least 0.

Defined results: a null text is empty; fewer than five words are one shingle; a text without words
has the empty fingerprint ``''``, alike (1.0) to another empty one and unlike (0.0) any other.  Equal
texts have equal fingerprints.  Documents are ordered by descending id, null ids last, rows of one id
by text (in a range of more than ``CROWD`` rows by a hash of the text first); a table of one document
follows itself.  Columns besides id and text are ignored.

Scale: shingles stay inside their row as arrays of longs, never exploded.  ``followed`` moves each
text once, by ranges of 64 ids; only the heads of those ranges are looked up across ranges.  A range
that repeated ids or null ids crowd is cut into cells of one id and some ``CROWD`` rows by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.shared import materialise
from spanforge.sources.tables import table

BIN_BITS = 8
N_BINS = 1 << BIN_BITS
LOW_BITS = 8
WORDS = 5
TRIES = 10
RANGE = 64
CROWD = 2048
NULL_RANGE = -(1 << 60)
MOST_BROADCAST = 100_000
WHITE = " \t\n\u000b\f\r"


def _candidates() -> list[list[int]]:
    """For every try, the bin that each bin looks at: a splitmix sequence."""
    out, state = [], 0x5EED
    for _ in range(TRIES):
        row = []
        for _ in range(N_BINS):
            state = (state + 0x9E3779B97F4A7C15) & (2**64 - 1)
            z = state
            z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
            z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
            row.append((z ^ (z >> 31)) >> (64 - BIN_BITS))
        out.append(row)
    return out


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds column ``out``: array of ``N_BINS`` tinyints (value - 128), or an empty array.

    The steps are separate projections; each step's column is read more than once by the next, so
    the optimizer keeps them apart and nothing is computed twice.
    """
    t, h, s, f, g = (f"_{out}_{x}" for x in "thsfg")
    bin_of = lambda x: F.shiftright(x, 64 - BIN_BITS)  # noqa: E731  -128 to 127, in the order of the signed hashes
    df = df.withColumn(t, F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WHITE)))
    df = df.withColumn(h, F.when(F.col(t) == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(F.col(t), r"[ \t\n\x0B\f\r]+"), lambda w: F.xxhash64(w))))
    at = lambda i: F.get(F.col(h), i)
    shingles = F.when(F.size(h) >= WORDS, F.transform(F.slice(h, F.lit(1), F.size(h) - (WORDS - 1)), lambda x, i: F.xxhash64(x, *[at(i + k) for k in range(1, WORDS)])))
    whole = F.when(F.size(h) > 0, F.array(F.aggregate(F.col(h), F.lit(0).cast("bigint"), lambda a, x: F.xxhash64(a, x))))
    df = df.withColumn(s, F.sort_array(F.coalesce(shingles, whole, F.array().cast("array<bigint>"))))
    df = df.withColumn(f, F.filter(F.col(s), lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(F.col(s), i - 1)))))
    low = lambda x: (x.bitwiseAND(F.lit((1 << LOW_BITS) - 1)) - 128).cast("tinyint")
    none = F.lit(None).cast("tinyint")
    gap = lambda x, i: bin_of(x) - F.when(i == 0, F.lit(-N_BINS // 2 - 1)).otherwise(bin_of(F.get(F.col(f), i - 1))) - 1
    filled = F.flatten(F.transform(F.col(f), lambda x, i: F.concat(F.array_repeat(none, gap(x, i).cast("int")), F.array(low(x)))))
    tail = F.array_repeat(none, (F.lit(N_BINS // 2 - 1) - bin_of(F.element_at(F.col(f), -1))).cast("int"))
    df = df.withColumn(g, F.when(F.size(f) > 0, F.concat(filled, tail)).otherwise(F.array().cast("array<tinyint>")))
    tries = [F.array(*[F.lit(b) for b in row]) for row in _candidates()]
    nearest = lambda j: F.array_min(F.transform(F.col(f), lambda x: F.struct(F.xxhash64(j, bin_of(x)).alias("r"), low(x).alias("v"))))["v"]
    dense = F.transform(F.col(g), lambda v, j: F.coalesce(v, *[F.get(F.col(g), F.get(c, j)) for c in tries], nearest(j)))
    return df.withColumn(out, F.when(F.size(f) > 0, dense).otherwise(F.col(g))).drop(t, h, s, f, g)


def likeness(a: Column, b: Column) -> Column:
    """The corrected share of equal positions, 0 to 1."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z)) / F.lit(float(N_BINS))
    chance = 2.0**-LOW_BITS
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))


def packed(fingerprint: Column) -> Column:
    """The fingerprint as lowercase hex, two digits a bin."""
    digits = F.array(*[F.lit(f"{i:02x}") for i in range(N_BINS)])
    return F.array_join(F.transform(fingerprint, lambda v: F.get(digits, v.cast("int") + 128)), "")


CELL = ["_r", "_ci", "_cs"]


def _following(cells: DataFrame) -> DataFrame:
    """For each cell (columns ``CELL``, distinct) the next lower one, and the highest after the lowest."""
    down = lambda part, by: W.partitionBy(*part).orderBy(F.desc(by))
    two = cells.select(F.struct(*CELL).alias("_c"), F.floor(F.col("_r") / 4096).alias("_s"))
    near = two.withColumn("_n", F.lead("_c").over(down(["_s"], "_c")))
    tops = two.groupBy("_s").agg(F.max("_c").alias("_top"))
    tops = tops.select("_s", F.lead("_top").over(down([], "_s")).alias("_below"), F.max("_top").over(W.partitionBy()).alias("_first"))
    return near.join(tops, "_s").select("_c.*", F.coalesce("_n", "_below", "_first").alias("_next"))


def _with_cells(rows: DataFrame) -> DataFrame:
    """Adds ``CELL``: the range number of ``_id`` and, in a crowded range, the id and a number by the text."""
    rows = rows.withColumn("_r", F.coalesce(F.floor(F.col("_id") / RANGE), F.lit(NULL_RANGE)))
    crowded = rows.groupBy("_r").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CROWD)
    crowded = materialise(crowded.select(F.col("_r").alias("_cr"), F.ceil(F.col("_n") / CROWD).alias("_cells")), "crowded")
    found = crowded.count()
    if not found:
        return rows.withColumns({"_ci": F.lit(0).cast("long"), "_cs": F.lit(0).cast("long")})
    if found <= MOST_BROADCAST:  # beyond, the join is a shuffle like any other
        crowded = F.broadcast(crowded)
    rows = rows.join(crowded, F.col("_r") == F.col("_cr"), "left")
    many = F.col("_cells").isNotNull()
    cells = {"_ci": F.when(many, F.coalesce("_id", F.lit(-(1 << 63)))).otherwise(0), "_cs": F.when(many, F.pmod(F.xxhash64("_text"), F.col("_cells"))).otherwise(0)}
    return rows.withColumns({k: v.cast("long") for k, v in cells.items()}).drop("_cr", "_cells")


def followed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _text and _fp of every document, and _next_text and _next_fp of the document after it in
    descending order of id (after the last: the first).  The window and the join with the heads deal
    rows out by the same cell, so that texts are shuffled once."""
    base = _with_cells(docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")))
    order = W.partitionBy(*CELL).orderBy(F.desc("_id"), F.desc("_text"))
    rows = with_fingerprint(base, "_text", "_fp")
    rows = rows.withColumns({"_next_text": F.lead("_text").over(order), "_next_fp": F.lead("_fp").over(order)})
    heads = base.groupBy(*CELL).agg(F.max_by("_text", F.struct("_id", "_text")).alias("_head")).select(F.struct(*CELL).alias("_next"), "_head")
    heads = _following(base.select(*CELL).distinct()).join(heads, "_next").select(*CELL, "_head")
    heads = with_fingerprint(heads, "_head", "_head_fp")
    rows = rows.join(heads, CELL)
    return rows.select("_id", "_text", "_fp", F.coalesce("_next_text", "_head").alias("_next_text"), F.coalesce("_next_fp", "_head_fp").alias("_next_fp"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, held against its edited text's and the next document's."""
    rows = followed(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("n_chars", F.length("_text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("_next_text", F.lit(1), cut))
    rows = rows.withColumn("_edited", edited)
    rows = with_fingerprint(rows.withColumn("edited_sha256", F.sha2(F.col("_edited").cast("binary"), 256)), "_edited", "_efp")
    return rows.select(
        F.col("_id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        packed(F.col("_fp")).alias("fingerprint"),
        packed(F.col("_efp")).alias("edited_fingerprint"),
        likeness(F.col("_fp"), F.col("_efp")).alias("near_edited"),
        likeness(F.col("_fp"), F.col("_next_fp")).alias("near_next"),
    )
