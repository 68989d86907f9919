"""SimHash, MinHash and repeated substrings against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spanforge.llm import fingerprints, simhash, suffixes
from spanforge.llm.bktree import BKTree, Forest
from spanforge.llm.components import components


def documents(spark, path):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]


def brute_simhash(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """Component of each fingerprint: the smallest id of those reachable over links of two bits."""
    least = {}
    for i, f in fps:
        if i is not None:
            least[f] = min(i, least.get(f, i))
    sets, nodes = Forest(), list(least.items())
    for a in range(len(nodes)):
        for b in range(a):
            if (nodes[a][0] ^ nodes[b][0]).bit_count() <= 2:
                sets.hang(*sorted((sets.find(nodes[a][1]), sets.find(nodes[b][1])), reverse=True))
    return {f: sets.find(i) for f, i in nodes}


@pytest.mark.parametrize("shard", [1024, 3])
def test_simhash(spark, sf, monkeypatch, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    docs = documents(spark, sf)
    fps = [(i, brute_simhash(t)) for i, t in docs]
    comp = brute_components(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op1_simhash(spark, sf).collect()}
    assert got == {i: (f"{f:016x}", comp[f]) for i, f in fps}


def test_simhash_chain_in_one_shard(spark, monkeypatch):
    """A chain of two-bit steps, all in one band, dealt to several trees, is one component."""
    monkeypatch.setattr(simhash, "SHARD", 4)
    r = random.Random(1)
    value, chain = 0, [0]
    for _ in range(40):
        value ^= 1 << r.randint(0, 21) | 1 << r.randint(0, 21)
        chain.append(value)
    rows = [(v.to_bytes(8, "big"), k) for k, v in enumerate(dict.fromkeys(chain))] + [((1 << 63 | 0xFFF << 30).to_bytes(8, "big"), 900)]
    members = spark.createDataFrame(rows, "_fp binary, _m long")
    found = {x["node"]: x["component"] for x in components(simhash.links(None, members, simhash.NARROW)).collect()}
    assert set(found.values()) == {0} and len(found) == len(rows) - 1


def test_simhash_edges(spark, edge_dir, empty_dir):
    rows = simhash.op1_simhash(spark, edge_dir)
    assert rows.columns == ["doc_id", "fingerprint", "component_id"]
    got = rows.collect()
    assert len(got) == 13
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add((r["fingerprint"], r["component_id"]))
    assert by[1] == {(by[1].copy().pop()[0], 1)} and {c for _, c in by[2]} == {1}
    assert by[3] == by[4] == by[5] == {("0" * 16, 3)}
    assert ("0" * 16, 3) in by[None]
    assert simhash.op1_simhash(spark, empty_dir).count() == 0


def test_wide_simhash(spark):
    r = random.Random(2)
    words = [f"w{k}" for k in range(5000)]
    base = [[r.choice(words) for _ in range(300)] for _ in range(40)]
    rows = []
    for k, w in enumerate(base):
        rows.append((3 * k, " ".join(w)))
        near = list(w)
        for at in r.sample(range(300), 4):
            near[at] = r.choice(words)
        rows.append((3 * k + 1, " ".join(near)))
        rows.append((3 * k + 2, " ".join(r.choice(words) for _ in range(300))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["_id"]: x["_component"] for x in simhash.near_duplicates(df, simhash.WIDE).collect()}
    assert all(got[3 * k + 2] == 3 * k + 2 and got[3 * k] == 3 * k for k in range(40))
    assert sum(got[3 * k + 1] == 3 * k for k in range(40)) >= 39


def test_blocks_lose_no_link():
    """Whatever the number of members: two flipped bits leave one key whole, and keys widen with the table."""
    width = {}
    for n in (10, 10**6, 10**8, 10**11):
        keys = simhash.blocks_for(simhash.NARROW, n)
        width[n] = min(map(len, keys))
        assert width[n] >= n.bit_length() - 1
        assert all(any(a not in k and b not in k for k in keys) for a in range(64) for b in range(a))
    assert width[10] == 21 and width[10**8] == 32


def test_repeated_ids_are_told_apart(spark):
    """Unrelated texts of one id, and of none, are different documents; groups may hold rows without an id."""
    r = random.Random(11)
    a, b, c, d = (" ".join(f"w{r.getrandbits(30)}" for _ in range(60)) for _ in range(4))
    df = spark.createDataFrame([(7, a), (7, b), (3, a), (None, c), (None, d), (None, b), (9, d)], "doc_id long, text string")
    for spec in (simhash.WIDE, simhash.NARROW):
        got = {(x["_id"], x["_t1"]): (x["_group"], x["_component"]) for x in simhash.near_duplicates(df, spec).collect()}
        assert len(got) == 7 and len({g for g, _ in got.values()}) == 4
        assert sorted(str(c) for _, c in got.values()) == ["3", "3", "7", "7", "9", "9", "None"]


@pytest.mark.parametrize("shard", [1024, 5])
def test_dense_group(spark, monkeypatch, shard):
    """Many near copies of one text, of which few are alike to each other, beside a second group in the same shards."""
    monkeypatch.setattr(simhash, "SHARD", shard)
    r = random.Random(12)
    words = [f"w{r.getrandbits(30)}" for _ in range(200)]
    rows, other = [(0, " ".join(words))], words[:170] + [f"x{k}" for k in range(60)]
    for k in range(1, 60):
        near = list(words if k % 3 else other)
        for at in r.sample(range(len(near)), 3):
            near[at] = f"y{k}.{at}"
        rows.append((k, " ".join(near)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["_id"]: x["_component"] for x in simhash.near_duplicates(df, simhash.WIDE).collect()}
    sets = {i: set(simhash.shingle_set(t.encode(), 5).tolist()) for i, t in rows}
    forest = Forest()
    for i in sets:
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                forest.hang(*sorted((forest.find(i), forest.find(j)), reverse=True))
    assert got == {i: forest.find(i) for i in sets}


def test_bktree():
    r = random.Random(3)
    values = [r.getrandbits(16) for _ in range(400)]
    tree = BKTree()
    for k, v in enumerate(values):
        tree.add(v, k)
    for q in values[:50] + [r.getrandbits(16) for _ in range(50)]:
        assert sorted(tree.near(q, 3)) == [k for k, v in enumerate(values) if (v ^ q).bit_count() <= 3]
    assert list(BKTree().near(5, 2)) == []


def test_components(spark):
    r = random.Random(4)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100 + r.randint(0, 40), 100 + r.randint(0, 40)) for _ in range(30)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    sets = Forest()
    for a, b in edges:
        sets.hang(*sorted((sets.find(a), sets.find(b)), reverse=True))
    want = {x: sets.find(x) for e in edges for x in e if any(x in f and f[0] != f[1] for f in edges)}
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_minhash(text):
    """The same fingerprint in plain Python."""
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    of_long = lambda v, seed: xxhash.xxh64_intdigest(v.to_bytes(8, "little"), seed)
    t = (text or "").lower().strip(fingerprints.WHITE)
    words = re.split(r"[ \t\n\x0B\f\r]+", t) if t else []
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]

    def chain(part, seed):
        for v in part:
            seed = of_long(v, seed)
        return seed

    if not h:
        return ""
    if len(h) >= 5:
        s = [chain(h[k : k + 5], 42) for k in range(len(h) - 4)]
    else:
        s = [0]
        for v in h:
            s = [of_long(v, of_long(s[0], 42))]
    bins = {}
    for v in sorted(map(signed, s)):
        bins.setdefault(v >> 56, v)
    low = lambda v: (v & 255) - 128
    out = []
    for j in range(256):
        if j - 128 in bins:
            out.append(low(bins[j - 128]))
            continue
        for row in fingerprints._candidates():
            if row[j] - 128 in bins:
                out.append(low(bins[row[j] - 128]))
                break
        else:
            of_int = lambda v, seed: xxhash.xxh64_intdigest((v & 0xFFFFFFFF).to_bytes(4, "little"), seed)
            best = min((signed(of_long(b & (1 << 64) - 1, of_int(j, 42))), low(v)) for b, v in bins.items())
            out.append(best[1])
    return "".join(f"{v + 128:02x}" for v in out)


def jaccard(a, b):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_minhash(spark, sf):
    docs = sorted(documents(spark, sf), reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.op2_minhash(spark, sf).collect()}
    off = []
    for k, (i, text) in enumerate(docs):
        follow = docs[(k + 1) % len(docs)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + follow[:cut]
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == brute_minhash(text) and r["edited_fingerprint"] == brute_minhash(edited)
        off += [r["near_edited"] - jaccard(text, edited), r["near_next"] - jaccard(text, follow)]
    assert np.sqrt(np.mean(np.square(off))) < 0.04 and abs(np.mean(off)) < 0.01


def test_minhash_edges(spark, edge_dir, empty_dir):
    got = fingerprints.op2_minhash(spark, edge_dir).collect()
    assert len(got) == 13
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["fingerprint"] == by[2][0]["fingerprint"] == by[2][1]["fingerprint"] == brute_minhash("one two three four five six seven eight nine ten")
    assert by[3][0]["fingerprint"] == by[4][0]["fingerprint"] == by[5][0]["fingerprint"] == "" and by[3][0]["n_chars"] == 0
    assert by[4][0]["near_next"] == 1.0 and by[6][0]["near_next"] == 0.0  # 4 is followed by 3 (both empty), 6 by 5
    assert fingerprints.op2_minhash(spark, empty_dir).count() == 0
    one = spark.createDataFrame([(5, "a b c d e f g h i")], "doc_id long, text string")
    row = fingerprints.followed(one, "doc_id", "text").first()
    assert row["_next_text"] == "a b c d e f g h i"


def test_followers_of_crowded_ids(spark, monkeypatch):
    """Ranges crowded by repeated and null ids, cut into cells, are followed in one order without gaps."""
    monkeypatch.setattr(fingerprints, "CROWD", 20)
    rows = [(k, f"plain {k}") for k in range(0, 400, 3)] + [(130, f"crowd {k}") for k in range(300)] + [(None, f"none {k}") for k in range(150)] + [(131, "same")] * 30
    got = [(r["_id"], r["_text"], r["_next_text"]) for r in fingerprints.followed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()]
    assert sorted((str(i), t) for i, t, _ in got) == sorted((str(i), t) for i, t in rows)
    assert sorted(t for _, t, _ in got) == sorted(n for _, _, n in got)  # each row follows one other
    by = {t: i for i, t in rows}
    down = [i if i is not None else -1 for i in (by[t] for _, t, _ in got)]
    after = [i if i is not None else -1 for i in (by[n] for _, _, n in got)]
    assert sum(a < b for a, b in zip(down, after, strict=True)) == 1  # only the last is followed by a higher one
    ids = sorted({i for i, _ in rows if i is not None}, reverse=True)
    steps = {(a, b) for a, b in zip(down, after, strict=True) if a > b}
    assert steps == set(zip(ids, [*ids[1:], -1], strict=True))


def brute_ranges(docs, length, first):
    count, least = {}, {}
    for key, b in sorted(docs):
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            count[w] = count.get(w, 0) + 1
            least.setdefault(w, (key, p))
    out = {}
    for key, b in docs:
        hit = [p for p in range(len(b) - length + 1) if count[b[p : p + length]] > 1 and not (first and least[b[p : p + length]] == (key, p))]
        out[key] = suffixes.merged([{"beg": p, "end": p + length} for p in hit])
    return out


def repetitive(seed, n):
    r = random.Random(seed)
    pieces = ["".join(r.choice("ab") for _ in range(r.randint(20, 90))) for _ in range(8)] + ["abab" * 20, "a" * 70]
    docs = []
    for k in range(n):
        body = "".join(r.choice(pieces) if r.random() < 0.5 else "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 60))) for _ in range(r.randint(0, 6)))
        docs.append((k, body))
    return docs


@pytest.mark.parametrize("group", [256, 2])
@pytest.mark.parametrize("first", [False, True])
def test_repeats_model(spark, monkeypatch, group, first):
    monkeypatch.setattr(suffixes, "GROUP", group)
    monkeypatch.setattr(suffixes, "GRIDS", (4, 1))
    docs = repetitive(5 + group, 60)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: suffixes.merged([x.asDict() for x in r["__ranges"] or ()]) for r in suffixes.with_ranges(df, 40, first, reach=16).collect()}
    assert got == brute_ranges([(i, t.encode()) for i, t in docs], 40, first)


def test_repeats_query(spark, sf):
    docs = [(i, t.encode()) for i, t in documents(spark, sf)]
    want = brute_ranges(docs, 400, False)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffixes.op3_suffix(spark, sf).collect()}
    for i, b in docs:
        kept = suffixes.cut(b, want[i])
        assert got[i] == (len(b), len(b) - len(kept), len(want[i]), hashlib.sha256(kept).hexdigest())


def test_repeats_edges(spark, edge_dir, empty_dir):
    got = {}
    for r in suffixes.op3_suffix(spark, edge_dir).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:4])
    assert got[9] == [(50_000, 50_000, 1)] and got[3] == [(0, 0, 0)] and got[4] == [(0, 0, 0)] and len(got[2]) == 2 and len(got[None]) == 2
    assert got[8][0][1] == got[8][0][0]
    assert suffixes.op3_suffix(spark, empty_dir).count() == 0


def test_long_text_in_segments(monkeypatch):
    """Units of a text cover every window once, and their names do not depend on segments."""
    r = random.Random(6)
    text = "".join(r.choice("abcd") for _ in range(4000)).encode()

    def cores(segment):
        monkeypatch.setattr(suffixes, "SEGMENT", segment)
        out, seen = {}, []
        for a, o1, o2, core, _ in suffixes.anchored_units(text, 400, 256):
            out.update(zip(a.tolist(), core.tolist(), strict=True))
            seen += [w for x, lo, hi in zip(a, o1, o2, strict=True) for w in range(x - hi, x - lo + 1)]
        assert sorted(seen) == list(range(len(text) - 399))
        return out

    assert cores(500) == cores(1 << 20)


def test_longest_previous_factors():
    """The array of the main path against brute force, positions in any order."""
    r = random.Random(7)
    assert suffixes.smaller_before(np.array([3, 1, 2, 5, 4, 0])).tolist() == [-1, -1, 1, 2, 2, -1]
    assert suffixes.smaller_before(np.arange(0)).tolist() == []
    for letters, size in ((b"ab", 90), (b"ab", 400), (b"a", 120), (b"abcdefgh", 200)):
        t = bytes(r.choice(letters) for _ in range(size))
        t += t[10:60]
        starts = np.arange(len(t) - 43)
        position = np.array(r.sample(range(1000), len(starts)))
        factor, source = suffixes.Suffixes(np.frombuffer(t + b"\0" * 8, np.uint8), starts, 44).previous_factors(position)

        def common(a, b, t=t):
            return next((k for k in range(44) if t[a + k] != t[b + k]), 44)

        for i in range(0, len(starts), 7):
            want = max([common(i, j) for j in starts if position[j] < position[i]], default=0)
            assert factor[i] == want
            assert source[i] == -1 if not want else position[source[i]] < position[i] and common(i, source[i]) == want


def test_texts_without_an_id_are_told_apart(spark):
    """Texts of one id or of none are named by themselves: what repeats nothing is left alone."""
    r = random.Random(9)
    texts = ["".join(r.choice("abcdef") for _ in range(900)) for _ in range(4)]
    rows = [(None, t) for t in texts] + [(1, texts[0]), (1, texts[1][:600]), (1, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x["doc_id"], x["text"]): suffixes.merged([y.asDict() for y in x["__ranges"] or ()]) for x in suffixes.with_ranges(df).collect()}
    assert got[None, texts[0]] == got[1, texts[0]] == [(0, 900)] and got[1, texts[1][:600]] == got[None, texts[1]] == [(0, 600)]
    assert got[None, texts[2]] == got[None, texts[3]] == got[1, "short"] == []


def test_equal_rows_cost_linear_work(spark):
    """Equal rows leave one list of ranges, however many they are."""
    r = random.Random(10)
    text = "".join(r.choice("abcdef") for _ in range(3000))
    other = text[:1500] + "".join(r.choice("abcdef") for _ in range(500))
    for k in (50, 400):
        df = spark.createDataFrame([(1, text)] * k + [(2, other)], "doc_id long, text string")
        found = suffixes.repeated_ranges(df).collect()
        assert sum(len(x["ranges"] or ()) for x in found) < 60 and {x["n"] for x in found} == {1, k}
        assert suffixes.with_ranges(df).where("__ranges is not null").count() == k + 1


def test_repeated_rows_are_cut_alike(spark):
    r = random.Random(8)
    text = "".join(r.choice("abcdef") for _ in range(900))
    df = spark.createDataFrame([(1, text), (1, text), (2, text[:500])], "doc_id long, text string")
    kept = [r["__ranges"] is None for r in suffixes.with_ranges(df, keep_first=True).orderBy("doc_id").collect()]  # noqa: E501
    assert kept == [True, True, False]
    assert df.select(F.count("*")).first()[0] == 3


def alike_pairs(seed, pairs, shared):
    """Pairs of texts of 90 shingles, ``shared`` of them in both: ids 2k and 2k + 1."""
    r = random.Random(seed)
    some = lambda n: [f"w{r.getrandbits(40)}" for _ in range(n)]
    rows = []
    for k in range(pairs):
        head = some(shared + 4)
        rows += [(2 * k + i, " ".join(head + some(90 - shared))) for i in (0, 1)]
    return rows


def test_wide_links_are_verified(spark):
    """No document loses to one that is less than 0.8 like it, however near their fingerprints."""
    rows = alike_pairs(5, 120, 77)  # 77 of 103: 0.748
    line = " ".join(f"line{k}" for k in range(12))
    r = random.Random(6)
    for k in range(1000, 1012):  # one line many times over, and twelve words of its own
        rows.append((k, " ".join([line] * 60 + [f"w{r.getrandbits(40)}" for _ in range(12)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["_id"]: x["_component"] for x in simhash.near_duplicates(df, simhash.WIDE).collect()}
    sets = {i: set(simhash.shingle_set(t.encode(), 5).tolist()) for i, t in rows}
    for i, c in got.items():
        assert c == i or any(len(sets[i] & sets[o]) / len(sets[i] | sets[o]) >= 0.8 for o in sets if o != i)
    assert sum(c != i for i, c in got.items() if i < 1000) == 0


def test_verified_links_beyond_a_forest(spark):
    """A forest that joins a group by pairs that fail still loses no pair that passes."""
    r = random.Random(8)
    words = lambda n: [f"w{r.getrandbits(40)}" for _ in range(n)]
    head, rows = words(81), []
    for k in range(12):  # twelve pairs; 0.748 or less between them, more within
        mine = words(13)
        rows += [(2 * k + i, " ".join(head + mine[: 13 - i] + words(i))) for i in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    wide = simhash.Spec(512, 5, 200, 0.8)
    got = {x["_id"]: x["_component"] for x in simhash.near_duplicates(df, wide).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_wide_simhash_at_the_threshold(spark):
    """Of pairs at exactly 0.8 no more than a few are missed."""
    df = spark.createDataFrame(alike_pairs(7, 300, 80), "doc_id long, text string")  # 80 of 100
    got = {x["_id"]: x["_component"] for x in simhash.near_duplicates(df, simhash.WIDE).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(300)) >= 296 and all(got[2 * k] == 2 * k for k in range(300))
