"""Token counts through a digest cache.

A text's key is the SHA-256 of its normalised content (here: the text itself, a null as the empty text) beside the
digest of the tokenizer file.  Keys are joined to stored counts; texts whose key is not stored are encoded,
each distinct one once, and appended; then every document takes its count from the cache.

Defined results: a null text counts as the empty one; repeated rows and equal texts share one stored count and
each keep their row; columns besides ``doc_id`` and ``text`` are ignored; an empty table gives an empty result.
The append is atomic.  A run over the same ``cache`` folder finds what earlier runs appended and encodes only what is
new; ``op7_token_counts`` itself starts from an empty folder, so that it always does the whole work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, shared_dir, table, tokenizer_path, with_text
from .workers import begin, kept

CACHE = T.StructType([T.StructField("tokenizer", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType())])


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:16]


def word_counter(path: str):
    """A function from a text to its token count for a vocabulary that drops white space and never looks across it."""
    from .packing import word_encoder
    from .pieces import CACHE_BYTES, Known

    encoder = word_encoder(path, CACHE_BYTES // 2)
    counts = Known(lambda chunk: len(encoder.encode_chunk(chunk)) // 4)
    return lambda text: sum(map(counts.__getitem__, text.encode().split()))


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The stored counts; none if the folder holds no table yet."""
    try:
        return spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def token_counts(docs: DataFrame, path: str, cache: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text; ``cache`` is the folder of stored counts."""
    spark, version = docs.sparkSession, tokenizer_digest(path)
    texts = with_text(docs, "doc_id").withColumn("digest", F.unhex(F.sha2("text", 256)))
    stored = read_cache(spark, cache).where(F.col("tokenizer") == version)
    misses = texts.select("digest", "text").dropDuplicates(["digest"]).join(stored, "digest", "left_anti")

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        begin("token counts")
        count = kept(path, lambda: word_counter(path))
        for batch in batches:
            counts = [count(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    counted = misses.mapInArrow(encode, "digest binary, n_tokens long").select(F.lit(version).alias("tokenizer"), "digest", "n_tokens")
    counted.write.mode("append").parquet(cache)
    stored = read_cache(spark, cache).where(F.col("tokenizer") == version).select("digest", "n_tokens")
    # two runs at once may both append; written, so that the join can split a text that very many documents share
    counts = materialise(stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    sized = texts.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return sized.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), shared_dir(spark, "token-counts"))
