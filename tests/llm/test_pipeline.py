"""The pipeline's stages, each on its own input, against brute force."""

import random

import corpus_pipeline as P
from pyspark.sql import functions as F

from spanforge.llm import packing, toxicity


def test_stages_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    clean = P.materialise(P.toxicity_stage(spark, docs, sf), "t")
    assert clean.columns == columns
    score = {r["doc_id"]: r["score"] for r in toxicity.op10_toxicity(spark, sf).collect()}
    assert {r[0] for r in clean.select("doc_id").collect()} == {i for i, s in score.items() if s < toxicity.THRESHOLD}
    single = P.materialise(P.simhash_stage(spark, clean, sf), "s")
    assert single.columns == columns
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    kept = {r["doc_id"]: r["text"] for r in single.collect()}
    assert len(kept) == single.count() and all(kept[i] == texts[i] for i in kept)
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} for i, w in ((i, t.lower().split()) for i, t in texts.items())}
    ids = sorted(texts)
    alike = {(a, b): len(shingles[a] & shingles[b]) / max(len(shingles[a] | shingles[b]), 1) for a in ids for b in ids if a < b and shingles[a] & shingles[b]}
    assert not [p for p, j in alike.items() if j >= 0.8 and p[0] in kept and p[1] in kept]
    for i in set(ids) - set(kept):
        assert max([j for p, j in alike.items() if i in p], default=0) >= 0.8
    cut = P.suffix_stage(spark, single, sf)
    assert cut.columns == columns and cut.count() == len(kept) and cut.where(F.length("text") != F.col("n_chars")).count() == 0
    packed = P.packing_stage(spark, cut, sf)
    assert packed.select("doc_id").distinct().count() == len(kept)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where(F.col("n") > packing.CAPACITY).count() == 0


def test_run(spark, sf):
    assert P.run(spark, sf).count() > 0 and P.ORACLE_SQL is None


def test_planted_cases(spark, tmp_path):
    r = random.Random(3)
    words = ["w" + "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = text(90)
    docs = {k: text(200) for k in range(60)}
    short = text(35)
    for k in (20, 21):
        docs[k] = text(80) + " " + short + " " + text(80)
    sixty = " ".join(w for w in text(200).split() if len(w) <= 6)
    sixty = " ".join(sixty.split()[:60])
    for k in (30, 31):
        docs[k] = text(80) + " " + sixty + " " + text(80)
    docs[60], docs[61] = docs[3], docs[3].replace(docs[3].split()[50], "changed")
    for k in (10, 11, 12):
        docs[k] = text(80) + " é " + passage + " ü " + text(80)
    rows = [(i, t, "en", "s", len(t)) for i, t in docs.items()] + [(None, "no id", None, None, None), (70, None, None, None, None), (71, "", "en", "s", 0), (5, docs[5], "en", "s", len(docs[5]))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    single = P.materialise(P.simhash_stage(spark, df, ""), "s")
    ids = sorted(x[0] for x in single.select("doc_id").where("doc_id IS NOT NULL").collect())
    assert ids == [*range(60), 70]  # 60 and 61 are copies of 3, 71 of 70, and 5 stays once
    assert single.where("doc_id IS NULL").count() == 1
    again = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in ((7, docs[1]), (7, docs[2]), (8, docs[4]), (3, docs[1]), (3, docs[1]), (None, docs[2]))], df.schema)
    told = sorted((x["doc_id"], x["text"]) for x in P.simhash_stage(spark, again, "").collect())
    assert told == sorted([(3, docs[1]), (7, docs[2]), (8, docs[4])])
    cut = {x["doc_id"]: x["text"] for x in P.suffix_stage(spark, single, "").collect()}
    assert passage in cut[10] and all(passage[60:-60] not in cut[k] and cut[k].startswith(docs[k][:300]) and cut[k].endswith(docs[k][-300:]) for k in (11, 12))
    assert all(cut[k] == docs[k] for k in range(60) if k not in (11, 12, 31)) and cut[70] is None
    assert sixty in cut[30] and sixty[20:-20] not in cut[31]  # sixty short words; thirty-five words stay
    empty = df.limit(0)
    assert P.simhash_stage(spark, empty, "").count() == P.suffix_stage(spark, empty, "").count() == P.packing_stage(spark, empty, "").count() == 0
