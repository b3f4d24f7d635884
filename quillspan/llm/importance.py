"""Importance resampling towards a target distribution of hashed words.

Identical texts are collapsed by grouping the full text; a text's words are cut and hashed once, its bucket counts are
multiplied by its number of copies, and its weight goes back to every document by the text's digest.  Only then does a
document's own noise come in, so that copies are drawn on their own.

The drawn documents are ranked without a global window: rows are sorted by ranges, and a row's rank is its place in
its range plus the sizes of the ranges before it (one number for each task of the sort).

Defined results: a null text holds no words; a document without words has weight 0.  A null doc_id takes the noise of
the empty id and stands behind equal scores.  Repeated rows are documents of their own, each with a rank.  Without
target texts, or without documents, the formulas hold with zero counts; an empty table gives an empty result.  Columns
besides ``doc_id`` and ``text`` are ignored.  What goes to the driver and to every task is one number for each bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import discard, materialise, table, with_text
from .workers import begin

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 2024, 20, 10


def hashed_texts(texts: DataFrame, buckets: int) -> DataFrame:
    """(digest, copies, n_features, buckets): each different text once, with the bucket of every word."""
    groups = texts.groupBy("text").agg(F.count("*").alias("copies"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        begin("importance")
        inside = words.letters_and_digits()
        for batch in batches:
            rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for places, pieces in words.split(batch.column("text"), inside):
                known = pieces.dictionary_encode()
                hashed = np.fromiter((crc32(w) % buckets for w in known.dictionary.to_pylist()), np.int32)
                rows.append(places)
                found.append(hashed[known.indices.to_numpy()])
            sizes = np.bincount(np.concatenate(rows), minlength=len(batch))
            lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(sizes)).astype(np.int32), np.concatenate(found))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("copies"), pa.array(sizes.astype(np.int64)), lists], ["digest", "copies", "n_features", "buckets"])

    keyed = groups.select(F.unhex(F.sha2("text", 256)).alias("digest"), "copies", "text")
    return keyed.mapInArrow(run, "digest binary, copies long, n_features long, buckets array<int>")


def bucket_counts(hashed: DataFrame) -> dict[int, int]:
    """Occurrences by bucket over all documents, copies included; at most a row for each bucket comes to the driver."""
    each = hashed.select("copies", F.explode("buckets").alias("bucket"))
    return {r["bucket"]: r["n"] for r in each.groupBy("bucket").agg(F.sum("copies").alias("n")).collect()}


def bucket_gains(corpus: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """By bucket, a thousand times the log of how much likelier the target is to hold it, both smoothed by one."""
    held, wanted = sum(corpus.values()), sum(target.values())
    ratio = lambda b: ((target.get(b, 0) + 1) * (held + buckets)) / ((corpus.get(b, 0) + 1) * (wanted + buckets))
    return [math.floor(1000 * math.log(ratio(b))) for b in range(buckets)]


def text_weights(hashed: DataFrame, gains: list[int]) -> DataFrame:
    """(digest, n_features, weight) of each different text."""
    sent = hashed.sparkSession.sparkContext.broadcast(gains)  # one number for each bucket

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        begin("importance")
        gain = np.array(sent.value, np.int64)
        for batch in batches:
            lists = batch.column("buckets")
            sums = np.append(0, np.cumsum(gain[lists.flatten().to_numpy()]))
            ends = np.append(0, np.cumsum(batch.column("n_features").to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("n_features"), pa.array(np.diff(sums[ends]))], ["digest", "n_features", "weight"])

    return hashed.select("digest", "n_features", "buckets").mapInArrow(run, "digest binary, n_features long, weight long")


def ranked(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """``scored`` (doc_id, n_features, weight, score) with ``rank`` for the best ``percent`` of the long enough rows."""
    able = F.col("n_features") >= least_words
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    dealt = scored.withColumn("able", able).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(dealt.withColumn("_place", F.monotonically_increasing_id()), "ranges")
    part, within = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("able").alias("n_able")).sort("part").collect()
    before, starts = 0, []
    for r in sizes:  # a row for each task that sorted
        starts.append((r["part"], before))
        before += r["n"]
    drawn = percent * sum(r["n_able"] for r in sizes) // 100
    starts = scored.sparkSession.createDataFrame(starts, "part int, before long")
    rank = F.col("before") + within + 1
    found = placed.withColumn("part", part.cast("int")).join(F.broadcast(starts), "part")
    return found.select("doc_id", "n_features", "weight", "score", F.when(F.col("able") & (rank <= drawn), rank).alias("rank"))


def importance_ranks(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; ``rank`` is null where it isn't drawn."""
    texts = with_text(docs, "doc_id")
    hashed = materialise(hashed_texts(texts, buckets), "hashed-texts")
    gains = bucket_gains(bucket_counts(hashed), bucket_counts(hashed_texts(with_text(target), buckets)), buckets)
    keyed = texts.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0)))
    scored = keyed.join(text_weights(hashed, gains), "digest").select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"))
    scored = materialise(scored, "scored")  # the ranges' bounds are found by a pass of their own
    discard(hashed)
    return ranked(scored, percent, least_words)


def resample(docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """The drawn documents, with all their columns; rows of an id that was drawn stay together."""
    drawn = importance_ranks(docs, target, **parameters).where("rank IS NOT NULL").select("doc_id").distinct()
    return docs.join(drawn, docs["doc_id"].eqNullSafe(drawn["doc_id"]), "left_semi")


#: CRC-32 byte by byte with a table that the query makes; everything else follows the definition.
SQL = r"""WITH RECURSIVE bits AS (SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) r(i) UNION ALL SELECT i, k + 1, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) FROM bits WHERE k < 8),
entry AS MATERIALIZED (SELECT i, c FROM bits WHERE k = 8),
bench AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
held AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents),
perdoc AS MATERIALIZED (SELECT doc_id, w, count(*) AS n FROM held GROUP BY ALL),
target AS MATERIALIZED (SELECT w, count(*) AS n FROM bench GROUP BY w),
crc AS (SELECT w, hex(encode(w)) AS h, 0 AS k, 4294967295::BIGINT AS c FROM (SELECT w FROM perdoc UNION SELECT w FROM target)
  UNION ALL SELECT w, h, k + 1, xor(entry.c, crc.c >> 8) FROM crc JOIN entry ON entry.i = xor(crc.c & 255, (strpos('0123456789ABCDEF', substr(h, 2 * k + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(h, 2 * k + 2, 1)) - 1) WHERE k < length(h) // 2),
bucket AS MATERIALIZED (SELECT w, xor(c, 4294967295) % 10000 AS b FROM crc WHERE k = length(h) // 2),
s AS (SELECT b, sum(n)::BIGINT AS n FROM perdoc JOIN bucket USING (w) GROUP BY b), t AS (SELECT b, sum(n)::BIGINT AS n FROM target JOIN bucket USING (w) GROUP BY b),
total AS (SELECT coalesce((SELECT sum(n) FROM s), 0)::DOUBLE AS s, coalesce((SELECT sum(n) FROM t), 0)::DOUBLE AS t),
gain AS MATERIALIZED (SELECT b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (total.s + 10000) / ((s.n + 1)::DOUBLE * (total.t + 10000))))::BIGINT AS g FROM s LEFT JOIN t USING (b) CROSS JOIN total),
weighed AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight FROM perdoc JOIN bucket USING (w) JOIN gain USING (b) GROUP BY doc_id),
scored AS (SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score FROM documents d LEFT JOIN weighed USING (doc_id)),
able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM scored LEFT JOIN able USING (doc_id)"""


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_ranks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
