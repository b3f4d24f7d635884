"""A training corpus from raw documents, in five stages; each works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspan.llm.common import shared_dir, table, tokenizer_path
from quillspan.llm.langid import keep_identified
from quillspan.llm.packing import pack
from quillspan.llm.pii import replace_private
from quillspan.llm.simhash import keep_one
from quillspan.llm.suffixdedup import without_repeats

#: Bytes of memory for the chunks that a packing worker knows: beside executors whose heap earlier stages have filled, less
#: is left than the operator takes alone.  It bounds memory and never changes a result.
PACKING_BYTES = 24 << 20


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; the others have no letters.  A missing ``lang`` takes the prediction."""
    return keep_identified(docs)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of least id, of each group of near-duplicates."""
    return keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without byte strings and passages of 50 words that repeat; one of repeats alone stays with an empty text."""
    return without_repeats(docs, words=50)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data and secrets."""
    return replace_private(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its place in a training sequence."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"), chunk_bytes=PACKING_BYTES)


STAGES = [
    ("language_id", language_id),
    ("simhash", simhash),
    ("suffix_dedup", suffix_dedup),
    ("pii", pii),
    ("packing", packing),
]

#: SQL has no SimHash, Feistel network or tokenizer; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = shared_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
