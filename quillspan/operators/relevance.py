"""Lexical scores over a candidate set (BM25) without a shuffle of the candidates.

Query terms are few.  Each row counts only them, so the corpus statistics are one row of sums over the rows, which
meets every row again as a broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import text as X
from quillspan.storage import materialise, spread

K1, B = 1.2, 0.75


def term_list(spark, query: str) -> list[str]:
    return spark.range(1).select(X.query_terms(F.lit(query)).alias("t")).first()["t"]


def frequencies(rows: DataFrame, fields: list[tuple[str, float]], terms: list[str], keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``rows`` with ``_dl``, the weighted length, and ``_f0``, ``_f1``, ...: how often each term occurs."""
    made = rows
    for i, (field, _) in enumerate(fields):
        made = made.withColumn(f"_t{i}", X.tokens(F.col(field)))
    total = lambda f: reduce(Column.__add__, (f(F.col(f"_t{i}")) * float(w) for i, (_, w) in enumerate(fields)))
    return made.select(*keep, total(F.size).alias("_dl"), *(total(lambda t, w=w: F.size(t) - F.size(F.array_remove(t, w))).alias(f"_f{k}") for k, w in enumerate(terms)))


def scored(counted: DataFrame, terms: list[str], score: str = "score") -> DataFrame:
    """What ``frequencies`` gives for a candidate set, with its BM25 score in place of the counts; it is read twice."""
    counts = ["_dl", *(f"_f{k}" for k in range(len(terms)))]
    stats = counted.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avg"), *(F.count_if(F.col(f"_f{k}") > 0).alias(f"_d{k}") for k in range(len(terms))))
    both = counted.crossJoin(F.broadcast(stats))  # one row
    norm = 1 - B + B * F.col("_dl") / F.when(F.col("_avg") > 0, F.col("_avg")).otherwise(1.0)
    parts = []
    for k in range(len(terms)):
        f, d = F.col(f"_f{k}"), F.col(f"_d{k}")
        idf = F.log(1 + (F.col("_n") - d + 0.5) / (d + 0.5))
        parts.append(F.when(f > 0, idf * (f * (K1 + 1)) / (f + K1 * norm)).otherwise(0.0))
    return both.select(*(c for c in counted.columns if c not in counts), reduce(Column.__add__, parts, F.lit(0.0)).alias(score))


def bm25(rows: DataFrame, fields: list[tuple[str, float]], terms: list[str], score: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``rows`` with a BM25 score over weighted text ``fields``; 0 where no term occurs, and for no terms.

    With ``keep``, only those columns stay, and texts are read once: their counts are written, and both the statistics and
    the scores come from what was written.
    """
    if not terms:
        return rows.select(*(keep or rows.columns), F.lit(0.0).alias(score))
    counted = frequencies(spread(rows), fields, terms, keep or rows.columns)
    return scored(materialise(counted, "term-counts") if keep else counted, terms, score)


def filter_rank(rows: DataFrame, fields: list[tuple[str, float]], query: str, order: str) -> DataFrame:
    """Rows that hold a query term, with ``score``, best first; all rows unscored for a query without terms."""
    terms = term_list(rows.sparkSession, query)
    if not terms:
        return rows
    return bm25(rows, fields, terms).where("score > 0").orderBy(F.desc("score"), order)


def term_counts(rows: DataFrame, title: str, blob: str, terms: list[str]) -> DataFrame:
    """The plain scorer of some sources: occurrences of the terms in the text, and three times those in the title."""
    count = lambda c, t: (F.length(c) - F.length(F.replace(c, F.lit(t), F.lit("")))) / len(t)
    parts = [count(F.lower(blob), t) + 3 * count(F.lower(title), t) for t in terms]
    return rows.withColumn("score", reduce(Column.__add__, parts, F.lit(0.0)).cast("long"))
