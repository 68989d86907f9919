"""N-way merges of variant tables, sample operations and allele statistics.

Tables are unions with a column ``source``.  Records are aligned at (contig, pos); for modes that
pair by equality a grouping key is enough, and the scored modes run per position in Python, where a
group is the records of one position in all files.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.functions.variants import variant_class

# What may pair, as bits.
SNPS, INDELS, ANY, SOME, SNP_REF, INDEL_REF = 1, 2, 4, 8, 16, 32
BOTH = SNPS | INDELS
BOTH_REF = BOTH | SNP_REF | INDEL_REF


def united(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables one below the other, with ``source``."""
    out = None
    for name, df in tables.items():
        one = df.withColumn("source", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def exact_key(ref: Column, alts: Column) -> Column:
    """What records must share to be one in exact mode: class, reference and the set of alternatives."""
    return F.concat_ws(">", variant_class(ref, alts).cast("string"), F.upper(ref), F.array_join(F.array_sort(F.transform(alts, lambda a: F.upper(a))), ","))


def merge_exact(rows: DataFrame, sources: list[str], payload: str, order: list[str]) -> DataFrame:
    """One row per variant, with one column of ``payload`` per source (null if absent) and n_sources.
    Equal variants of one source stay apart: the k-th pairs with the k-th of others."""
    keyed = rows.withColumn("_key", exact_key(F.col("ref"), F.col("alts")))
    nth = F.row_number().over(W.partitionBy("source", "contig", "pos", "_key").orderBy(*order))
    return keyed.withColumn("_nth", nth).groupBy("contig", "pos", "_key", "_nth").agg(
        *[F.max(F.when(F.col("source") == s, F.col(payload))).alias(s) for s in sources], F.count(F.lit(1)).alias("n_sources")
    ).withColumnsRenamed({"_key": "variant", "_nth": "copy"})


def merge_any(rows: DataFrame, sources: list[str], payload: str, order: list[str]) -> DataFrame:
    """One row per position and ordinal: whatever lies at a position pairs, the k-th with the k-th."""
    nth = F.row_number().over(W.partitionBy("source", "contig", "pos").orderBy(*order))
    return rows.withColumn("copy", nth).groupBy("contig", "pos", "copy").agg(
        *[F.max(F.when(F.col("source") == s, F.col(payload))).alias(s) for s in sources], F.count(F.lit(1)).alias("n_sources")
    )


def merge_by_class(rows: DataFrame, sources: list[str], payload: str, order: list[str], classes: int) -> DataFrame:
    """As ``merge_any`` among records of one class of ``classes`` (bits of variant classes); the others
    pair in exact mode."""
    kind = variant_class(F.col("ref"), F.col("alts"))
    key = F.when((kind != 0) & (kind.bitwiseAND(F.lit(classes)) == kind), F.concat(F.lit("class "), kind.cast("string"))).otherwise(exact_key(F.col("ref"), F.col("alts")))
    nth = F.row_number().over(W.partitionBy("source", "contig", "pos", "_key").orderBy(*order))
    return rows.withColumn("_key", key).withColumn("copy", nth).groupBy("contig", "pos", F.col("_key").alias("variant"), "copy").agg(
        *[F.max(F.when(F.col("source") == s, F.col(payload))).alias(s) for s in sources], F.count(F.lit(1)).alias("n_sources")
    )


def pair_score(a: int, b: int, mode: int) -> int:
    """How well variants of two classes pair: 3 for like with like, 2 with the reference, 1 for
    anything, 0 for never. Classes: 0 reference, 1 SNP or MNP, 4 indel, 8 other."""
    if mode & SNPS and a == b == 1 or mode & INDELS and a == b == 4:
        return 3
    if mode & SNP_REF and {a, b} == {0, 1} or mode & INDEL_REF and {a, b} == {0, 4}:
        return 2
    return int(bool(mode & ANY))


def paired(position: Iterable[tuple[str, str, str, int]], mode: int) -> list[list[tuple[str, str]]]:
    """Rows of one position from its records (source, key, alternatives joined by commas, class): each
    row has at most one (source, key) per source. Equal records always pair; beyond that the variant
    set present in most sources takes in the disjoint set that pairs best (the strictest pair counts;
    of equals the one in more sources), until none does."""
    sets: dict[str, tuple[set[int], set[str], list[tuple[str, str]]]] = {}
    seen: dict[tuple[str, str], int] = {}
    for source, key, alts, kind in position:
        nth = seen[source, key] = seen.get((source, key), -1) + 1
        label = f"{key}#{nth}" if nth else key
        classes, alleles, members = sets.setdefault(label, (set(), set(), []))
        classes.add(1 if kind in (1, 2) else kind if kind in (0, 4, 8) else 0)
        alleles |= set(alts.upper().split(","))
        members.append((source, key))
    # sets present in most sources first; only the one at hand changes, so the others keep this order
    names = {source: 1 << k for k, source in enumerate(dict.fromkeys(s for _, _, m in sets.values() for s, _ in m))}
    left = sorted(((sum(names[s] for s, _ in m), frozenset(c), frozenset(a), m) for c, a, m in sets.values()), key=lambda s: -len(s[3]))
    # sets of the same sources, classes and alleles are alike but for their order
    alike: dict[int, dict[tuple, deque[int]]] = {}
    for k, (mask, classes, alleles, _) in enumerate(left):
        alike.setdefault(mask, {}).setdefault((classes, alleles), deque()).append(k)
    scores: dict[tuple, int] = {}
    taken, out = [False] * len(left), []
    for k, (mask, classes, alleles, members) in enumerate(left):
        if taken[k]:
            continue
        same = alike[mask][classes, alleles]
        same.popleft()
        if not same:
            del alike[mask][classes, alleles]
        while True:
            best, found = (0, 0, 0), None
            for other, kinds in alike.items():
                if other & mask or (4, other.bit_count()) < best[:2]:
                    continue
                for (theirs, alts), places in kinds.items():
                    if mode & SOME and classes == theirs and alleles & alts:
                        score = 4
                    elif (score := scores.get((classes, theirs), -1)) < 0:
                        score = scores[classes, theirs] = min(pair_score(a, b, mode) for a in classes for b in theirs)
                    rank = (score, other.bit_count(), -places[0])
                    if score and (found is None or rank > best):
                        best, found = rank, (other, theirs, alts)
            if found is None:
                break
            other, theirs, alts = found
            at = alike[other][theirs, alts].popleft()
            if not alike[other][theirs, alts]:
                del alike[other][theirs, alts]
            taken[at] = True
            mask, classes, alleles, members = mask | other, classes | theirs, alleles | alts, members + left[at][3]
        out.append(sorted(members))
    return sorted(out)


def merge_scored(rows: DataFrame, mode: int) -> DataFrame:
    """(contig, pos, row, source, variant): the scored merge; rows of one number belong together.
    rows: source, contig, pos, ref, alts."""
    keyed = rows.select("contig", "pos", "source", F.concat("ref", F.lit(">"), F.when(F.size("alts") > 0, F.array_join("alts", ",")).otherwise(F.lit("."))).alias("key"), F.array_join("alts", ",").alias("alts"), variant_class(F.col("ref"), F.col("alts")).alias("kind"))

    def run(batches):
        held: list[tuple] = []

        def solve(groups):
            out = []
            for (contig, pos), records in groups:
                for n, row in enumerate(paired([r[2:] for r in records], mode)):
                    out += [(contig, pos, n, s, v) for s, v in row]
            return pd.DataFrame(out, columns=["contig", "pos", "row", "source", "variant"])

        for b in batches:
            held += list(b.itertuples(index=False, name=None))
            if held:
                last = held[-1][:2]
                done = [r for r in held if r[:2] != last]
                held = held[len(done) :]
                yield solve([(k, list(g)) for k, g in groupby(done, key=lambda r: r[:2])])
        yield solve([(k, list(g)) for k, g in groupby(held, key=lambda r: r[:2])])

    dealt = keyed.repartition("contig", "pos").sortWithinPartitions("contig", "pos", "source", "key")
    kinds = dict(keyed.dtypes)
    return dealt.mapInPandas(run, f"contig {kinds['contig']}, pos {kinds['pos']}, row int, source string, variant string")


def sample_intersection(tables: list[DataFrame], column: str = "sample") -> DataFrame:
    """Samples that every table has."""
    out = tables[0].select(column).distinct()
    for t in tables[1:]:
        out = out.intersect(t.select(column))
    return out


def subset_samples(variants: DataFrame, names: list[str], exclude: bool = False) -> DataFrame:
    """Variants with only (or without) the named samples; ``samples`` is array<struct<sample,...>>."""
    wanted = lambda s: s["sample"].isin(names)
    return variants.withColumn("samples", F.filter("samples", (lambda s: ~wanted(s)) if exclude else wanted))


def count_alleles(genotypes: DataFrame) -> DataFrame:
    """(contig, pos, allele, n) from rows (contig, pos, alleles array<int>); missing alleles count nowhere."""
    return genotypes.select("contig", "pos", F.explode("alleles").alias("allele")).where("allele IS NOT NULL").groupBy("contig", "pos", "allele").agg(F.count(F.lit(1)).alias("n"))


def unused_alleles(variants: DataFrame) -> DataFrame:
    """Variants with ``keep``, booleans per allele: the reference, and alternatives that some genotype has.
    variants: alts, genotypes array<array<int>>."""
    flat = F.flatten("genotypes")
    return variants.withColumn("keep", F.transform(F.sequence(F.lit(0), F.size("alts")), lambda k: (k == 0) | F.exists(flat, lambda a: a == k)))
