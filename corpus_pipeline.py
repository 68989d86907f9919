"""A corpus pipeline of four stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs.  All but the last return the columns of documents.

1. toxicity: the machine of ``spanforge.llm.toxicity``, fitted on the labels of ``sf_dir``, drops
   documents that it scores at its threshold or above.
2. simhash_near_dedup: of documents linked by their SimHash (shingles of five words) and an exact
   similarity of 0.8 or more, the one with the smallest id stays.  A row without an id stays only if its
   group has none with an id; documents are told apart by id and text, so that different texts of one id
   are different documents, and of rows with equal id and text one stays.
3. suffix_array_dedup: later copies of passages go, the first stays.  A passage is a run of bytes all of
   whose strings of ``PASSAGE_BYTES`` have an earlier copy, and has at least ``PASSAGE_WORDS`` words;
   characters cut in half stay whole; documents stay even if nothing is left of them; n_chars is the
   new length.
4. best_fit_packing: the pieces of what is left, in sequences of 1024 tokens.

SQL cannot express the stages (trained scores, hashes, tokenizers), so ``ORACLE_SQL`` is None and
tests hold them against brute force.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import packing, simhash, suffixes, toxicity
from spanforge.shared import materialise
from spanforge.sources.tables import table


PASSAGE_BYTES = 160
PASSAGE_REACH = 96
PASSAGE_WORDS = 50


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not predicted toxic."""
    model = toxicity.fit(*toxicity.labelled_sample(docs, table(spark, sf_dir, "labels"), toxicity.in_training(F.col("doc_id"))))
    return docs.where(toxicity.scorer(spark, model)(F.col("text")) < toxicity.THRESHOLD)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    found = materialise(simhash.near_duplicates(docs, simhash.WIDE).select("_id", *simhash.KEY, "_group"), "groups")
    first = found.groupBy("_group").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), *simhash.KEY)).alias("row"))
    again = found.groupBy(*simhash.KEY).agg((F.count(F.lit(1)) > 1).alias("again"))
    stays = first.select(*(F.col(f"row.{k}").alias(k) for k in simhash.KEY)).join(again, simhash.KEY)
    own = [f"__row{k}" for k in simhash.KEY]
    stays = materialise(stays.toDF(*own, "__again"), "stays")
    rows = docs.withColumns(dict(zip(own, simhash.row_key("doc_id", "text"), strict=True))).join(stays, own)
    return rows.where(~F.col("__again")).union(rows.where("__again").dropDuplicates(own)).select(*docs.columns)


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans shrunk so that they cut no character in half."""
    out = []
    for beg, end in spans:
        while beg < end and raw[beg] & 0xC0 == 0x80:
            beg += 1
        while end > beg and end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        if beg < end:
            out.append((beg, end))
    return out


def _cut_text(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, begs, ends in parts:
        out = []
        for text, beg, end in zip(texts, begs, ends, strict=True):
            if isinstance(text, str) and beg is not None and len(beg):
                raw = text.encode()
                spans = suffixes.merged([{"beg": int(b), "end": int(e)} for b, e in zip(beg, end, strict=True)])
                spans = [(b, e) for b, e in spans if len(raw[b:e].split()) >= PASSAGE_WORDS]
                text = suffixes.cut(raw, whole_characters(raw, spans)).decode()
            out.append(text if isinstance(text, str) else None)
        yield pd.Series(out, dtype="object")


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without later copies of passages."""
    rows = suffixes.with_ranges(docs, PASSAGE_BYTES, keep_first=True, reach=PASSAGE_REACH)
    text = F.pandas_udf(_cut_text, "string")(F.col("text"), F.transform("__ranges", lambda r: r["beg"]), F.transform("__ranges", lambda r: r["end"]))
    rows = rows.withColumn("text", text)
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document in its sequence."""
    pieces = materialise(packing.token_pieces(docs, with_ids=False), "pieces")
    return packing.pack(pieces).withColumnRenamed("_id", "doc_id")


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", simhash_stage),
    ("suffix_array_dedup", suffix_stage),
    ("best_fit_packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from documents; each stage's result is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
