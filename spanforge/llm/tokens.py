"""Byte-level BPE encoding and decoding by tree reduction.

Encoding is a monoid over pieces of a text: halves are encoded recursively, leaves directly, and
neighbours are joined by encoding a window around their border again.  The window grows until each
of its ends is a *seam*: a character that is not white space followed by one that is.  No match of
the pattern crosses a seam and no match before or after it depends on the other side (runs of white
space are looked at forwards only, and every other alternative ends at the white space), so the
encodings left and right of a seam are independent and tokens outside the window cannot change.
Without a seam the window becomes the whole piece, which is exact as well.

Decoding splits the ids in halves and concatenates bytes up the same tree.

Defined results: a null text is empty; an empty text has no ids.  One text is one record: a task
holds the text and its ids, and nothing else of the corpus.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.sources.tables import table

LEAF = 4096
WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0                　")


def _ranks_of_json(path: str) -> dict[bytes, int]:
    """Ranks from a tokenizer file whose vocabulary spells each byte as one printable character."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelt = {chr(b): b for b in plain}
    spelt |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"] for t in said["added_tokens"]}
    return {bytes(spelt[c] for c in t): i for t, i in said["model"]["vocab"].items() if t not in special}


@functools.cache
def encoding(name: str) -> tiktoken.Encoding:
    """The merge engine for a vocabulary file, by name: ranks (.tiktoken) or a tokenizer (.json).
    Merge order and id order are the same in both kinds, and special tokens are ordinary text here."""
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        ranks = _ranks_of_json(path)
    else:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def added_tokens(name: str) -> dict[str, int]:
    """The ids of a tokenizer file's added tokens, by their text; a file of ranks has none.  The library finds
    them in a text before anything else."""
    if not name.endswith(".json"):
        return {}
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{name}: only added tokens that stand for their exact text are read")
    return {t["content"]: t["id"] for t in added}


def encode_as_library(name: str, text: str) -> list[int]:
    """The ids that the tokenizers library gives a text with its default settings: added tokens are single
    ids, and what lies between them is encoded by itself."""
    enc, added = encoding(name), added_tokens(name)
    if not any(t in text for t in added):
        return encode(enc, text)
    out: list[int] = []
    for part in re.split("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")", text):
        out += [added[part]] if part in added else encode(enc, part)
    return out


def seam(text: str, at: int) -> bool:
    """Whether encodings left and right of ``at`` are independent."""
    return text[at - 1] not in WHITE and text[at] in WHITE


def _join(enc: tiktoken.Encoding, text: str, low: int, cut: int, high: int, left: list[int], right: list[int]) -> list[int]:
    """The ids of text[low:high] from those of text[low:cut] and text[cut:high]."""
    if seam(text, cut):
        return left + right
    width = 32
    while True:
        a = next((k for k in range(cut - 1, max(low, cut - width), -1) if seam(text, k)), None)
        b = next((k for k in range(cut + 1, min(high, cut + width)) if seam(text, k)), None)
        a = low if a is None and cut - width <= low else a
        b = high if b is None and cut + width >= high else b
        if a is not None and b is not None:
            break
        width *= 2
    head = left[: len(left) - len(enc.encode_ordinary(text[a:cut]))]
    tail = right[len(enc.encode_ordinary(text[cut:b])) :]
    return head + enc.encode_ordinary(text[a:b]) + tail


def encode(enc: tiktoken.Encoding, text: str, leaf: int = LEAF, low: int = 0, high: int | None = None) -> list[int]:
    """The ids of text[low:high], by tree reduction."""
    high = len(text) if high is None else high
    if high - low <= leaf:
        return enc.encode_ordinary(text[low:high])
    cut = (low + high) // 2
    return _join(enc, text, low, cut, high, encode(enc, text, leaf, low, cut), encode(enc, text, leaf, cut, high))


def decode(enc: tiktoken.Encoding, ids: list[int], leaf: int = LEAF) -> bytes:
    """The bytes of ids, concatenated up the tree."""
    if len(ids) <= leaf:
        return enc.decode_bytes(ids)
    half = len(ids) // 2
    return decode(enc, ids[:half], leaf) + decode(enc, ids[half:], leaf)


def encode_table(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, ids array<int>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                ids = [encode(enc, t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, "_id long, ids array<int>")


def decode_table(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(_id, bytes) from the columns of ``encode_table``; null ids are no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for b in batches:
            found = [decode(enc, ids or []) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["_id", "bytes"])

    return encoded.select("_id", "ids").mapInArrow(run, "_id long, bytes binary")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, n_tokens, ids_sha256, decoded_sha256): encoding and decoding in one pass, digests only,
    so that ids do not travel between two Python steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        decimal = [str(i).encode() for i in range(enc.n_vocab)]
        for b in batches:
            n, said, back = [], [], []
            for t in b.column(1).to_pylist():
                ids = encode(enc, t or "")
                n.append(len(ids))
                said.append(hashlib.sha256(b",".join([decimal[i] for i in ids])).hexdigest())
                back.append(hashlib.sha256(decode(enc, ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(said, pa.string()), pa.array(back, pa.string())], names=["_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, "_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """Ids and decoded bytes of every document, as digests."""
    return round_trip(table(spark, sf_dir, "documents"), vocabulary).withColumnRenamed("_id", "doc_id")
