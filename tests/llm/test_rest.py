"""Sharding, neighbours, pages, chat and toxicity."""

import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import chat, neighbours, pages, sharding, toxicity
from spanforge.llm.registry import QUERIES


def by_shard(rows):
    out = {}
    for r in rows:
        out.setdefault(r["shard"], []).append(r)
    return out


def test_shards(spark, sf):
    import zlib

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = sharding.op4_virtual_slots(spark, sf).collect()
    assert len(rows) == len(docs) and {r["law"] for r in rows} == {"bytes"}
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and r["grown_shard"] is None
    sizes = []
    for rs in by_shard(rows).values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
        sizes.append(sum(r["size"] for r in rs))
    assert len(sizes) == 16 and max(sizes) <= sum(sizes) / 16 + max(r["size"] for r in rows)


def test_shards_are_near_equal_with_many_rows(spark):
    df = spark.range(60_000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(pow(rand(3), 4) * 900 as int))").alias("text"))
    rows, slot_map = sharding.shard(df)
    sizes = [r[0] for r in rows.groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert max(sizes) - min(sizes) < 0.01 * sum(sizes) / 16
    assert sorted(r[0] for r in slot_map.select("version").distinct().collect()) == [1, 2]
    assert rows.groupBy("vslot").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0


def test_grow_moves_only_into_the_new_shard(spark):
    old = sharding.initial_map(spark, 16)
    new = sharding.grow(old, 16)
    both = old.join(new.select("vslot", F.col("shard").alias("to")), "vslot").collect()
    moved = [r for r in both if r["shard"] != r["to"]]
    assert {r["to"] for r in moved} == {16} and abs(len(moved) - len(both) / 17) <= 1
    assert new.first()["version"] == 2


def test_shard_edges(spark, edge_dir, empty_dir):
    rows = sharding.op4_virtual_slots(spark, edge_dir).collect()
    assert len(rows) == 13 and {r["size"] for r in rows if r["doc_id"] in (3, 4)} == {1}
    for rs in by_shard(rows).values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
    assert len({r["slot"] for r in rows if r["doc_id"] == 2}) == 2
    assert sharding.op4_virtual_slots(spark, empty_dir).count() == 0


def test_crowded_records_are_dealt_out(spark, monkeypatch):
    """Rows of one id, of none, and one record many times over: shards stay near equal, places gapless."""
    monkeypatch.setattr(sharding, "REPEATS", 50)
    rows = [(7, f"text {k} " * (k % 9)) for k in range(4000)] + [(None, f"other {k}" * 3) for k in range(4000)] + [(8, "same text over and over")] * 4000
    rows_, _ = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"))
    by = by_shard(rows_.collect())
    assert sum(map(len, by.values())) == 12_000
    sizes = [sum(r["size"] for r in rs) for rs in by.values()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) < 0.02 * sum(sizes) / 16
    for rs in by.values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))


def brute_neighbours(x, ids, queries, k):
    out = {}
    for q in queries:
        score = x @ x[q]
        order = sorted((-s, i) for j, (s, i) in enumerate(zip(score.tolist(), ids, strict=True)) if j != q)
        out[ids[q]] = [i for _, i in order[:k]]
    return out


def test_neighbours(spark, sf):
    got = {}
    rows = neighbours.op7_cross_polytope(spark, sf).collect()
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r)
    data = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect())
    ids, x = [d[0] for d in data], np.array([d[1] for d in data], np.float64)
    want = brute_neighbours(x, ids, [k for k, i in enumerate(ids) if i % 20 == 0], 20)
    assert set(got) == set(want)
    hits = sum(len({r["vec_id"] for r in got[q]} & set(want[q])) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    for q, rs in got.items():
        assert [r["rank"] for r in rs] == list(range(1, 21))
        for r in rs:
            assert abs(r["score"] - float(x[ids.index(r["vec_id"])] @ x[ids.index(q)])) < 1e-12


def test_neighbour_edges(spark):
    one, two = [1.0, 0.0, 0.0], [0.0, 2.0, 0.0]
    rows = [(k, one) for k in range(100)] + [(200, two), (220, None), (240, [0.0, 0.0, 0.0]), (260, [float("nan"), 1.0, 0.0]), (280, [None, 1.0, 1.0]), (300, [float("inf"), 0.0, 0.0]), (None, one), (40, one), (320, [1.0, 1.0]), (340, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"rep": F.lit("clash"), "vec": F.lit(1), "ids": F.lit(2), "_q": F.lit(3)})
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == {0, 20, 40, 60, 80, 200}
    assert [i for i, _ in got[0]] == list(range(1, 21)) and [i for i, _ in got[60]] == list(range(20))
    assert got[200][0][1] == 0.0 and len(got[200]) <= 20
    assert neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_bucket_blocks(spark, monkeypatch):
    """Buckets dealt to several blocks lose nothing."""
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 16)) + 3
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(df, F.col("vec_id") < 10, 5).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute_neighbours(x, list(range(120)), range(10), 5)
    assert sum(len(got[q] & set(want[q])) for q in want) >= 45


def test_rotations_keep_lengths():
    x = np.random.default_rng(1).normal(size=(20, 64))
    y = neighbours.rotated(x, 7)
    assert np.allclose(x @ x.T, y @ y.T)
    assert neighbours.padded(np.ones((2, 65))).shape == (2, 128)
    assert neighbours.probes(x, 0, (64, 64), 9).shape == (20, 9) and neighbours.probes(x, 0, (2,), 9).shape == (20, 4)


@pytest.mark.parametrize("n", [500, 1500, 2000, 5000, 20_000, 100_000, 200_000])
def test_recall_of_the_shape(n):
    """The rule's tables, hashes and probes find 0.9 of the 20 nearest of random vectors, and more rows take fewer looks."""
    x = np.random.default_rng(n).normal(size=(n, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    score = x[:60] @ x.T
    score[np.arange(60), np.arange(60)] = -9
    near = np.argpartition(-score, 20, axis=1)[:, :20]
    axes, look = neighbours.shape_for(n, 64)
    hit = np.zeros(near.shape, bool)
    for t in range(neighbours.TABLES):
        seen = neighbours.probes(x[:60].astype(float), t, axes, look)
        own = neighbours.probes(x[near.ravel()].astype(float), t, axes, 1).reshape(near.shape)
        hit |= (own[:, :, None] == seen[:, None, :]).any(axis=2)
    assert hit.mean() >= 0.92
    assert n < 20_000 or neighbours.TABLES * look / np.prod([2 * m for m in axes]) < 0.6


def test_shapes_change_little_by_little():
    """No size is treated otherwise than its neighbours: buckets hold a few hundred vectors throughout."""
    for k in range(10, 40):
        axes, look = neighbours.shape_for(1 << k, 64)
        assert 64 <= (1 << k) / np.prod([2.0 * m for m in axes]) <= 256 or k > 39
        more = neighbours.shape_for(1 << k + 1, 64)
        assert sum(m.bit_length() for m in more[0]) - sum(m.bit_length() for m in axes) == 1 and 1 <= more[1] / look <= 2


def test_practice_pages_held_out():
    trees = pages.model()
    right = 0
    for k in range(20_000, 20_200):
        source = pages.practice(k)
        page = pages.Page(source, True)
        right += pages.extract([source], trees) == ["\n".join(page.text[v] for v in page.text if page.label[v])]
    assert right >= 190


def test_table_pages(spark, sf):
    import html
    import re

    source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = pages.op8_main_text(spark, sf).collect()
    assert len(rows) == len(source)
    right = 0
    for r in rows:
        h = source[r["page_id"]]
        inner = h[h.index("<article>") + 9 : h.index("</article>")]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        right += r["text"] == "\n".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"])
    assert right >= 0.98 * len(rows)


def test_odd_pages(spark):
    body = "<p>" + "This is the main text of the page, with a sentence or two. " * 8 + "</p>"
    odd = ["", None, "   ", "plain text only", "<p>unclosed <b>bold <i>both", "<div" * 50, "<!-- never closed", "<script>var x = '<p>", "<a href='x>y", "</p></div></b>", "&amp;&#65;&nosuch;&#x110000;", "<p a=\"1'>x</p>", f"<html><body><nav><a href=a>Home</a></nav><article>{body}</article><footer>&copy; x</footer>", "<table><tr><td>a<td>b<tr><td>c</table>", "<li>a<li>b", "x" * 200_000]
    df = spark.createDataFrame([(k, None, h) for k, h in enumerate(odd)], "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "_html": F.lit("clash"), "n_chars": F.lit(1)})
    rows = {r["page_id"]: r for r in pages.main_texts(df).collect()}
    assert len(rows) == len(odd) and rows[0]["text"] == rows[1]["text"] == "" and rows[12]["text"] == " ".join(pages.html.unescape(body[3:-4]).split())
    assert pages.main_texts(df.limit(0)).count() == 0
    deep = "<div>" * 3000 + body + "</div>" * 3000
    assert isinstance(pages.extract([deep], pages.model())[0], str)


def test_practice_labels_are_not_read_from_pages():
    body = "<p>" + "This is the main text of the page, with a sentence or two. " * 8 + "</p>"
    want = pages.extract([f"<article>{body}</article>"], pages.model())
    for value in ('"x"', "1", "'0'", '""', '"1"'):
        assert pages.extract([f"<article data-practice={value}>{body}</article>"], pages.model()) == want
        assert not any(pages.Page(f"<article data-practice={value}>{body}</article>").label.values())


@pytest.mark.parametrize("deep", ["<div><section>", "<p><x-a>", "<li><b>", "<table><tr><td>", "<select>", "<svg>", "<a b='", "<nosuch></div>"])
def test_deep_pages_cost_linear_time(deep):
    began = time.perf_counter()
    page = pages.Page(deep * 25_000 + "text")
    assert time.perf_counter() - began < 10
    assert len(pages.features([page])) == len(page.kind)
    wide = f"<div {'x' * 100_000} a=b>text</div>"
    assert list(pages.Page(wide).text.values()) == ["text"]
    assert time.perf_counter() - began < 20


def test_decoding_has_no_contradictions():
    r = random.Random(4)
    page = pages.Page(pages.practice(5))
    for _ in range(50):
        margin = np.array([r.uniform(-5, 5) for _ in page.kind])
        assert set(pages.decode(page, margin)) <= set(page.text.values())


def test_chat_oracle(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    df = chat.op9_preference(spark, sf)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({chat.OP9_SQL}) x").fetchall()
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(want)


def test_chat_edges(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", "bye"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, "user", "only"), (3, 0, "assistant", None), (4, 0, None, "x"), (4, 1, "assistant", "yes"), (None, 0, "user", "lost"), (6, None, "user", "q"), (6, None, "user", "q"), (6, 1, "assistant", "a"), (7, 0, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"chosen": F.lit(1), "_t": F.lit(2), "prompt": F.lit(3)})
    out = {r["conv_id"]: r for r in chat.preference_format(chat.conversation_pairs(df)).collect()}
    assert set(out) == {0, 1, 2, 3, 4, 6, 7}
    r = out[0]
    assert r["n_prefix_turns"] == 1 and r["prompt"] == "<|user|>\nhi<|end|>\n" and r["chosen_completion"] == "<|assistant|>\nyes<|end|>\n" and r["rejected_completion"] == "<|assistant|>\nno<|end|>\n"
    assert [(s["beg"], s["end"]) for s in r["chosen_spans"]] == [(14, 24)] and r["chosen_completion"][14:24] == "yes<|end|>"
    assert out[2]["n_prefix_turns"] == 1 and out[2]["chosen_completion"] == out[2]["rejected_completion"] == ""
    assert out[3]["chosen_completion"] == "<|assistant|>\n<|end|>\n" and out[3]["rejected_completion"] == ""
    assert out[4]["prompt"].startswith("<|user|>\nx") and out[6]["n_prefix_turns"] == 3 and out[6]["chosen_completion"] == ""
    assert chat.preference_format(chat.conversation_pairs(df.limit(0))).count() == 0


WORDS = "alpha beta gamma delta house garden window letter number paper water river stone cloud light music table chair".split()


def labelled(seed, n, insults=("idiot", "scumbag", "worthless")):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        words = [r.choice(WORDS) + r.choice(("", "s", "ing", "ed")) for _ in range(r.randint(5, 80))]
        bad = r.random() < 0.3
        if bad:
            for _ in range(r.randint(1, 3)):
                words[r.randrange(len(words))] = r.choice(insults)
        rows.append((" ".join(words), int(bad)))
    return rows


def test_toxicity_model():
    train, test = labelled(1, 600), labelled(2, 400)
    model = toxicity.fit(*map(list, zip(*train, strict=True)))
    score = model.score_texts([t for t, _ in test], {})
    y = np.array([t for _, t in test])
    assert ((score >= toxicity.THRESHOLD) == y).mean() >= 0.97
    spelt = ["table id1ot river", "stone w.o.r.t.h.l.e.s.s paper", "cloud i d i o t music", "garden SCUMBAG!!! light", "water worthlless chair"]
    clean = ["table river stone", "paper music light", "", None]
    assert (model.score_texts(spelt, {}) > 0.5).sum() >= 4 and (model.score_texts(clean, {}) < 0.5).all()
    again = toxicity.fit(*map(list, zip(*train, strict=True)))
    assert np.array_equal(again.score_texts([t for t, _ in test], {}), score)
    long = "river stone " * 100_000 + " worthless idiot"
    assert model.score_texts([long], {})[0] > model.score_texts(["river stone " * 100_000], {})[0]


@pytest.mark.parametrize("labels", [[], [0, 0], [1, 1]])
def test_toxicity_without_both_labels(labels):
    model = toxicity.fit(["some text"] * len(labels), labels)
    assert model.score_texts(["any", None], {}).tolist() == [float(bool(labels and labels[0]))] * 2


def test_kernel_weights_agree_with_features():
    spelling = toxicity.Spelling.of(["idiot", "idiom", "table"])
    k = toxicity._features(spelling, ["idiot", "idiom", "table"], ["idiot", "table"])
    assert np.allclose(np.diag(toxicity._features(spelling, ["abcde"], ["abcde"])), toxicity._features(spelling, ["abcde"], ["abcde"])[0, 0])
    assert k[0, 0] == pytest.approx(k[:, 0].max()) and k[0, 1] < k[1, 0]
    beta = np.array([0.5, -2.0])
    model = toxicity.Model(spelling, toxicity._weights(spelling, ["idiot", "table"], beta), 0.25, (0.0,) * 6)
    assert np.allclose(model.margins(["idiot", "idiom", "table"]), np.maximum(k @ beta + 0.25, 0.25))


def test_toxicity_query(spark, sf):
    import zlib

    rows = toxicity.op10_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)


def test_toxicity_of_held_out_labels():
    """Learnt from two thirds of the labels of sf0.1: of the toxic rest at least 0.85 is found, of the clean at most 0.01 flagged."""
    import zlib

    con = duckdb.connect()
    rows = con.execute("SELECT d.doc_id, d.text, l.toxic FROM '/root/testdata/sf0.1/labels.parquet' l JOIN '/root/testdata/sf0.1/documents.parquet' d USING (doc_id) WHERE toxic IS NOT NULL ORDER BY 1").fetchall()
    held = [zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in rows]
    train = [r for r, h in zip(rows, held, strict=True) if not h]
    test = [r for r, h in zip(rows, held, strict=True) if h]
    model = toxicity.fit([t or "" for _, t, _ in train], [y for _, _, y in train])
    flagged = model.score_texts([t for _, t, _ in test], {}) >= toxicity.THRESHOLD
    toxic = np.array([y for _, _, y in test], bool)
    assert toxic.sum() > 100 and flagged[toxic].mean() >= 0.85 and flagged[~toxic].mean() <= 0.01


def test_rare_letters_still_match():
    spelling = toxicity.Spelling.of(["".join(chr(0x4E00 + k) for k in range(200)), "ab"])
    word = "".join(chr(0x5E00 + k) for k in range(5))
    k = toxicity._features(spelling, [word, "xxxxx"], [word])
    assert k[0, 0] > 0 and len(set(spelling.codes.values())) == toxicity.ALPHABET - 1 - toxicity.SHARED


def test_toxicity_edges(spark, edge_dir, empty_dir):
    for folder, n in ((edge_dir, 13), (empty_dir, 0)):
        spark.createDataFrame([(1, 1, 1), (2, 0, 0), (2, None, 0), (None, 0, 1), (5, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        assert toxicity.op10_toxicity(spark, folder).count() == n


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_neighbours_of_unequal_norms(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 32))
    x *= (rng.lognormal(0, 0.5, 3000) / np.linalg.norm(x, axis=1))[:, None]
    x[7] *= 10 / np.linalg.norm(x[7])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute_neighbours(x, list(range(3000)), range(0, 3000, 50), 20)
    hits = sum(len(got.get(q, set()) & set(want[q])) for q in want)
    assert all(len(got.get(q, ())) == 20 for q in want) and hits >= 0.9 * 20 * len(want)


def test_raw_elements_end():
    """Custom, self-closed and unclosed elements take nothing of what follows with them."""
    for odd in ("<svg-icon name=x></svg-icon>", "<svg width=1/>", "<math/>", "<video-player>", "<select-box></select-box>", "<video src=x>", "<canvas>", "<object>"):
        page = pages.Page(f"<article>{odd}<p>Whole article text</p></article>")
        assert list(page.text.values()) == ["Whole article text"], odd
    assert not pages.Page("<svg><p>drawn</p></svg><script>var x").text
