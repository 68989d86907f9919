"""SimHash near-duplicates over sharded BK-trees.

A text's fingerprint has bit i set if more than half of its shingles' hashes have it set.  Distinct
fingerprints are *members*; members are linked when they differ in at most ``radius`` bits.  Members
that share a shard key meet in one shard, where a BK-tree answers each member's search.  The trees are
built where their shard's rows are instead of being broadcast, because a tree of all rows has no size
bound.

*Shards without loss* (op1).  The fingerprint is cut into blocks of bits and a key is all blocks but
``radius`` of them: by the pigeonhole principle two fingerprints within the radius agree on some key.
There are as many blocks as make a key wide enough for the number of members (``blocks_for``), so that
unrelated members rarely meet at any size.

*Shards of a similarity* (``WIDE``).  512 bits are too many for blocks, and keys of bits would have to
multiply with the table.  A key is there the smallest values of ``MINIMA`` hash orders over the set of
shingles: sets alike to s share a key with probability s^MINIMA, whatever the size of the table, and
``KEYS`` keys find 0.997 of the pairs at 0.8.  Of a pair within the radius the sets themselves are
compared (64-bit hashes of the distinct shingles): a link has the spec's similarity, exactly.

Equal texts have equal fingerprints, so a group of copies of any size is one member.  A shard of more
than ``SHARD`` members (twice as many where sets are compared) is dealt to several trees.  Each tree first links its own members; then every
member that is not in its shard's most frequent component visits the shard's other trees.  Any two
members of different components include one such visitor, so no link between components is lost,
while a dense group of near copies, one component by then, travels once.  In a tree a pair is looked
at unless its ends are connected already: what leaves a tree is a spanning forest.

Defined results: words are runs without ASCII white space, A-Z in lower case; fewer words than a
shingle has are one shingle; no words (or a null text) give fingerprint zero, linked like any other.
A row with a null id has a fingerprint and links like others; the component of a group is its
smallest id, null if no row of it has one.  Repeated rows are kept.  An empty table gives an empty
result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.bktree import BKTree, Forest
from spanforge.llm.components import components
from spanforge.shared import drop_written, materialise
from spanforge.sources.tables import table

SHARD = 256
CHUNK = 1 << 15
KEYS, MINIMA = 11, 4
NO_ID = -(1 << 63)


@dataclass(frozen=True)
class Spec:
    """Fingerprint width in bits, words of a shingle and link radius.  With a similarity, links are pairs
    within the radius whose distinct shingles have it, and shards are keyed by smallest hashes."""

    bits: int
    words: int
    radius: int
    similarity: float | None = None


NARROW = Spec(64, 3, 2)
#: Pairs at 0.8 differ in 78 bits on average (standard deviation 8), five shingles and four of them in 96.
WIDE = Spec(512, 5, 124, similarity=0.8)


def blocks_for(spec: Spec, n: int) -> list[tuple[int, ...]]:
    """The keys of lossless shards as bit positions: all blocks but ``radius``, in every choice, of the
    smallest number of blocks (up to ten) whose keys are no narrower than log2(n) - 1 bits."""
    for k in range(spec.radius + 1, 11):
        edges = [spec.bits * i // k for i in range(k + 1)]
        blocks = [range(a, b) for a, b in zip(edges, edges[1:], strict=False)]
        keys = [tuple(x for b in kept for x in b) for kept in combinations(blocks, k - spec.radius)]
        if min(map(len, keys)) >= n.bit_length() - 1:
            break
    return keys


def shingle_hashes(text: bytes, words: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of every shingle of ``words`` words, in blocks of bounded size."""
    w = text.lower().split()
    if not w:
        return
    hash64 = xxhash.xxh64_intdigest
    if len(w) < words:
        yield np.array([hash64(b" ".join(w), 42)], np.uint64)
        return
    joined = b" ".join(w)
    begs = [0]
    at = 0
    for x in w:
        at += len(x) + 1
        begs.append(at)
    n = len(w) - words + 1
    for k in range(0, n, CHUNK):
        m = min(n, k + CHUNK)
        yield np.array([hash64(joined[a : b - 1], 42) for a, b in zip(begs[k:m], begs[k + words : m + words], strict=True)], np.uint64)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct hashes of ``shingle_hashes`` in order."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(text, words)]))


def simhash(blocks: Iterator[np.ndarray], bits: int) -> bytes:
    """The fingerprint of hashes, most significant bit first."""
    count = np.zeros(bits, np.int64)
    n = 0
    for h in blocks:
        n += len(h)
        for k in range(bits // 64):
            if k:
                h = (h + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
                h ^= h >> np.uint64(30)
                h *= np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(27)
                h *= np.uint64(0x94D049BB133111EB)
                h ^= h >> np.uint64(31)
            unpacked = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            count[64 * k : 64 * k + 64] += unpacked.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * count > n).tobytes()


def _orders() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    draw = lambda: rng.integers(0, 1 << 63, KEYS * MINIMA, np.uint64)
    return draw() * np.uint64(2) + np.uint64(1), draw()


def least_keys(hashes: np.ndarray) -> list[int]:
    """Shard keys of a set of shingle hashes: for each key the smallest values of its hash orders."""
    if not len(hashes):
        return []
    factor, offset = _ORDERS
    least = np.full(KEYS * MINIMA, np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), 4096):
        h = hashes[k : k + 4096]
        h = h ^ (h >> np.uint64(31))
        np.minimum(least, (h[:, None] * factor + offset).min(axis=0), out=least)
    least = least.reshape(KEYS, MINIMA)
    return [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(least)]


_ORDERS = _orders()


def row_key(id_col: str, text_col: str) -> list[Column]:
    """What names a row's id and text: the id (null: ``NO_ID``) and 128 bits of the text's hash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_k"), F.xxhash64(text).alias("_t1"), F.xxhash64(F.lit("second"), text).alias("_t2")]


KEY = ["_k", "_t1", "_t2"]


def fingerprints(docs: DataFrame, spec: Spec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _k, _t1, _t2, _fp binary, _keys) of every row; the keys are null without a similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, keys = [], []
            for t in b.column(4).to_pylist():
                if spec.similarity is None:
                    found.append(simhash(shingle_hashes(t or b"", spec.words), spec.bits))
                    keys.append(None)
                else:
                    once = shingle_set(t or b"", spec.words)
                    found.append(simhash((once[k : k + CHUNK] for k in range(0, len(once), CHUNK)), spec.bits))
                    keys.append(least_keys(once))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(found, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["_id", *KEY, "_fp", "_keys"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), *row_key(id_col, text_col), F.col(text_col).cast("binary").alias("_text"))
    return rows.mapInArrow(run, "_id long, _k long, _t1 long, _t2 long, _fp binary, _keys array<long>")


def _block_keys(spec: Spec, keys: list[tuple[int, ...]]):
    """Rows (_shard, _key, _m) of every fingerprint."""
    masks = np.zeros((len(keys), spec.bits), np.int64)
    for i, bits in enumerate(keys):
        masks[i, list(bits)] = 1 << np.arange(len(bits), dtype=np.int64)
    low, high = (masks & 0xFFFFFFFF).T.astype(np.float64), (masks >> 32).T.astype(np.float64)  # sums stay below 2^53

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            bits = np.unpackbits(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, -1), axis=1).astype(np.float64)
            key = ((bits @ high).astype(np.int64) << 32) | (bits @ low).astype(np.int64)
            shard = np.tile(np.arange(len(keys), dtype=np.int32), b.num_rows)
            at = pa.array(np.repeat(np.arange(b.num_rows), len(keys)))
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(key.reshape(-1)), b.column(1).take(at)], names=["_shard", "_key", "_m"])

    return run


def _alike(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of two sets of hashes; that of empty ones is 1."""
    if not len(a) and not len(b):
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


class _Tree:
    """One tree's members, the components they are in so far, and the links that made them."""

    def __init__(self, spec: Spec) -> None:
        self.spec, self.tree, self.forest, self.sets, self.parts = spec, BKTree(), Forest(), {}, set()
        self.out: list[tuple[int, int]] = []

    def meet(self, fp: int, m: int, label: int, own: bool, seek: bool, hashes: np.ndarray | None) -> None:
        """Link a member, if it is to ``seek``, to all of the tree's that are near and not connected to it
        yet; ``label``, a component's, connects from the start.  Its own members the tree keeps."""
        find, spec = self.forest.find, self.spec
        mine, here = ("m", m), ("c", label)
        self.forest.up.setdefault(here, here)
        self.forest.hang(mine, here)
        for other in self.tree.near(fp, spec.radius) if seek and self.parts - {find(mine)} else ():
            theirs = ("m", other)
            if find(theirs) == find(mine) or spec.similarity is not None and _alike(self.sets[other], hashes) < spec.similarity:
                continue
            self.forest.hang(find(mine), find(theirs))
            self.out.append((m, other))
            self.parts = {find(p) for p in self.parts}
            if not self.parts - {find(mine)}:
                break
        if own:
            self.tree.add(fp, m)
            self.sets[m] = hashes
            self.parts.add(find(mine))


def _tree_links(spec: Spec, within: bool):
    """Links (u, v) found in each tree: ``within`` its own members, or else between them and its visitors;
    rows come sorted by shard, key and tree, a tree's own members before its visitors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, out = None, _Tree(spec), []

        def close() -> pa.RecordBatch:
            e = out.copy()
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in e], pa.int64()), pa.array([x[1] for x in e], pa.int64())], names=["u", "v"])

        for b in batches:
            for shard, band, at, own, fp, m, label, hashes in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                if (shard, band, at) != key:
                    out += tree.out
                    key, tree = (shard, band, at), _Tree(spec)
                    if len(out) >= CHUNK:
                        yield close()
                tree.meet(int.from_bytes(fp, "big"), m, label, own, within or not own, None if hashes is None else np.frombuffer(hashes, np.uint64))
        out += tree.out
        if out:
            yield close()

    return run


def _dealt(met: DataFrame, members: DataFrame, sets: DataFrame | None) -> DataFrame:
    """The rows of ``_tree_links``, of (_shard, _key, _tree, _own, _m, _label)."""
    met = met.join(members.select("_m", "_fp"), "_m")  # fingerprints and sets travel only with keys that meet
    met = met.withColumn("_set", F.lit(None).cast("binary")) if sets is None else met.join(sets, "_m")
    met = met.select("_shard", "_key", "_tree", "_own", "_fp", "_m", "_label", "_set")
    return met.repartition("_shard", "_key", "_tree").sortWithinPartitions("_shard", "_key", "_tree", F.desc("_own"), "_m")


def _sets(docs: DataFrame, nodes: DataFrame, spec: Spec, id_col: str, text_col: str) -> DataFrame:
    """(_m, _set) of members, from one row of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(t or b"", spec.words).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["_m", "_set"])

    texts = docs.select(*row_key(id_col, text_col), F.col(text_col).cast("binary").alias("_text")).join(nodes, KEY).select("_m", "_text")
    return texts.mapInArrow(run, "_m long, _set binary").groupBy("_m").agg(F.max("_set").alias("_set"))


def links(docs: DataFrame, members: DataFrame, spec: Spec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Edges (u, v) between members whose components are those of all links. members: written."""
    spark = members.sparkSession
    if spec.similarity is None:
        keyed = members.select("_fp", "_m").mapInArrow(_block_keys(spec, blocks_for(spec, members.count())), "_shard int, _key long, _m long")
    else:
        keyed = members.select(F.posexplode("_keys").alias("_shard", "_key"), "_m")
    keyed = materialise(keyed, "keys")
    sizes = keyed.groupBy("_shard", "_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    met = keyed.join(sizes, ["_shard", "_key"])
    trees = F.ceil(F.col("_n") / (SHARD if spec.similarity is None else 2 * SHARD)).cast("int")
    met = materialise(met.select("_shard", "_key", "_m", trees.alias("_trees"), F.pmod(F.xxhash64("_m", "_shard"), trees).cast("int").alias("_tree")), "met")
    drop_written(spark, keyed)
    sets = None
    if spec.similarity is not None:
        nodes = members.join(met.select("_m").distinct(), "_m", "left_semi").select("_m", *KEY)
        sets = materialise(_sets(docs, nodes, spec, id_col, text_col), "sets")
    schema = "u long, v long"
    first = materialise(_dealt(met.withColumns({"_own": F.lit(True), "_label": F.col("_m")}), members, sets).mapInArrow(_tree_links(spec, True), schema), "links")
    dense = met.where("_trees > 1")
    made = [met] if sets is None else [met, sets]

    def done(out: DataFrame) -> DataFrame:
        for table_ in made:
            drop_written(spark, table_)
        return out

    if dense.isEmpty():
        return done(first)
    named = components(first)
    dense = dense.join(named, dense["_m"] == named["node"], "left").withColumn("_label", F.coalesce("component", "_m")).drop("node", "component")
    dense = materialise(dense, "dense")
    made.append(dense)
    most = dense.groupBy("_shard", "_key", "_label").agg(F.count(F.lit(1)).alias("_c"))
    most = materialise(most.groupBy("_shard", "_key").agg(F.max_by("_label", F.struct("_c", "_label")).alias("_most")), "most")
    made.append(most)
    dense = dense.join(most, ["_shard", "_key"])
    others = F.filter(F.sequence(F.lit(0), F.col("_trees") - 1), lambda t: t != F.col("_tree"))
    visits = dense.where("_label <> _most").withColumns({"_tree": F.explode(others), "_own": F.lit(False)})
    rest = _dealt(dense.withColumn("_own", F.lit(True)).unionByName(visits), members, sets).mapInArrow(_tree_links(spec, False), schema)
    return done(materialise(first.union(rest), "links"))


def near_duplicates(docs: DataFrame, spec: Spec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _k, _t1, _t2, _fp, _group, _component) of every row: its fingerprint, a number of its group,
    and the group's smallest id.  Equal fingerprints are one member (sets alike to 0.8 or less agree on 512
    bits with a probability below 10^-36)."""
    rows = materialise(fingerprints(docs, spec, id_col, text_col), "fingerprints")
    members = rows.groupBy("_fp").agg(F.min("_id").alias("_least"), F.min(F.struct(*KEY)).alias("_row"), F.first("_keys").alias("_keys"))
    # a member's number is fixed once it is written
    members = materialise(members.select("_fp", "_least", "_row.*", "_keys", F.monotonically_increasing_id().alias("_m")), "members")
    edges = links(docs, members, spec, id_col, text_col)
    found = components(edges)
    drop_written(edges.sparkSession, edges)
    named = members.join(found, members["_m"] == found["node"], "left").select("_fp", "_least", F.coalesce("component", "_m").alias("_group"))
    named = materialise(named, "named")
    drop_written(docs.sparkSession, members)
    least = materialise(named.groupBy("_group").agg(F.min("_least").alias("_component")), "least")
    named = named.join(least, "_group").select("_fp", "_group", "_component")
    return rows.join(named, "_fp").select("_id", *KEY, "_fp", "_group", "_component")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"), NARROW)
    return found.select(F.col("_id").alias("doc_id"), F.lower(F.hex("_fp")).alias("fingerprint"), F.col("_component").alias("component_id"))
