"""Byte BPE and packing against the tokenizer libraries, and exact round trips."""

import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spanforge.llm import packing, tokens

MULTI = "byte_bpe_multi_50k.tiktoken"
ALPHABET = " \n\t  　\x85\x1cab'sre1234!?éß漢😀ć'll"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=200), st.integers(1, 12))
def test_tree_is_the_whole(text, leaf):
    enc = tokens.encoding(MULTI)
    ids = tokens.encode(enc, text, leaf=leaf)
    assert ids == enc.encode_ordinary(text)
    assert tokens.decode(enc, ids, leaf=leaf) == text.encode()


def test_long_runs():
    enc = tokens.encoding(MULTI)
    began = time.time()
    for text in ("a" * 200_000, " " * 100_000 + "x", "漢字" * 20_000, "no spaces" * 5 + "\n" * 9000 + "end"):
        assert tokens.encode(enc, text) == enc.encode_ordinary(text)
    assert time.time() - began < 60


def test_white_is_unicode_white_space():
    import regex

    assert {chr(c) for c in range(0x3100) if regex.match(r"\p{White_Space}", chr(c))} == set(tokens.WHITE)


def test_json_vocabulary_equals_library(spark, sf):
    lib = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    r = random.Random(1)
    texts = [x[0] for x in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += ["".join(r.choice(ALPHABET) for _ in range(60)) for _ in range(500)] + ["".join(chr(r.choice((r.randint(1, 0xD7FF), r.randint(0xE000, 0x1FFFF)))) for _ in range(40)) for _ in range(500)] + ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|><|endoftext|> y<|endoftext", "<|endoftext|> " * 3000]
    for text, want in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert tokens.encode_as_library(packing.VOCABULARY, text) == want.ids


def test_round_trip_query(spark, sf):
    enc = tokens.encoding(MULTI)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in tokens.op5_byte_bpe(spark, sf).collect():
        ids = enc.encode_ordinary(docs[r["doc_id"]])
        assert tuple(r)[1:] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest())
    df = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    back = {r["_id"]: bytes(r["bytes"]).decode() for r in tokens.decode_table(tokens.encode_table(df, MULTI), MULTI).collect()}
    assert back == {r["doc_id"]: r["text"] for r in df.collect()}


def test_token_edges(spark, edge_dir, empty_dir):
    rows = tokens.op5_byte_bpe(spark, edge_dir).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 13 and by[3]["n_tokens"] == by[4]["n_tokens"] == 0 and by[4]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[9]["decoded_sha256"] == hashlib.sha256(b"x" * 50_000).hexdigest()
    assert tokens.op5_byte_bpe(spark, empty_dir).count() == 0 and packing.op6_packing(spark, empty_dir).count() == 0
    p = packing.op6_packing(spark, edge_dir).collect()
    assert {r["length"] for r in p if r["doc_id"] in (3, 4)} == {1}
    assert sum(1 for r in p if r["doc_id"] == 2) == 2
    check_places(p)


def check_places(rows):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return len(by)


def test_packing_query(spark, sf):
    lib = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = packing.op6_packing(spark, sf).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    total = 0
    for i, text in docs.items():
        ids = [*lib.encode(text, add_special_tokens=False).ids, packing.END]
        total += len(ids)
        parts = sorted(by[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts))) and all(r["length"] == 1024 for r in parts[1:]) and len(parts) == -(-len(ids) // 1024)
        at = 0
        for r in parts:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert check_places(rows) <= -(-total // 1024) * 1.08 + 1


def test_sequences(spark):
    df = spark.createDataFrame([(k, "word " * (k % 700)) for k in range(60)], "doc_id long, text string")
    pieces = packing.materialise(packing.token_pieces(df), "pieces")
    packed = packing.pack(pieces)
    seqs = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert seqs[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 30), max_size=20))
def test_plan_uses_every_piece(counts):
    layouts = packing.plan(counts, 64)
    used = {}
    for layout, n in layouts:
        assert n > 0 and sum(x * k for x, k in layout) <= 64
        for x, k in layout:
            used[x] = used.get(x, 0) + n * k
    assert used == {k: v for k, v in counts.items() if v}


@pytest.mark.parametrize("counts", [{1: 5 * 10**9}, {513: 10**9}, {k: 10**6 + k for k in range(1, 1025)}, {341: 10**7, 3: 7, 1024: 2}])
def test_plans_of_large_counts_are_short(counts):
    began = time.time()
    layouts = packing.plan(counts)
    assert len(layouts) < 3000 and time.time() - began < 20
    bound = -(-sum(k * v for k, v in counts.items()) // 1024)
    if 513 not in counts:
        assert sum(n for _, n in layouts) <= bound * 1.01 + 2


def test_exact_complements():
    assert packing.plan({1000: 3, 24: 3}) == [(((1000, 1), (24, 1)), 3)]
    assert packing.plan({1000: 2, 20: 2, 4: 2}) == [(((1000, 1), (20, 1), (4, 1)), 2)]
    assert packing.plan({1000: 2, 8: 6}) == [(((1000, 1), (8, 3)), 2)]
    assert packing.plan({}) == []
