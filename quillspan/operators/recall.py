"""Vector recall, rank fusion and nearest neighbours over stored vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK_CONSTANT = 60


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector and for vectors of different lengths."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms)


def vector_search(vectors: DataFrame, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """(key, cos): the k keys whose best vector is nearest; ``vectors`` are (key, vector) with several rows a key.

    The mask comes before the cut and rows are pooled before it, so that the k best keys in scope are found exactly.
    """
    scoped = vectors if where is None else vectors.where(where)
    asked = F.array(*(F.lit(float(x)) for x in query))
    scored = scoped.select("key", cosine(F.col("vector"), asked).alias("cos")).where("cos IS NOT NULL")
    return scored.groupBy("key").agg(F.max("cos").alias("cos")).orderBy(F.desc("cos"), "key").limit(k)


def ranked(rows: DataFrame, *order: Column, k: int) -> DataFrame:
    """The first k rows with their ``rank`` from 1."""
    top = rows.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def fuse(lexical: DataFrame, vector: DataFrame) -> DataFrame:
    """(key, rrf, via) of two ranked lists (key, rank): the sum of 1 / (60 + rank)."""
    both = lexical.select("key", "rank", F.lit("lexical").alias("arm")).unionByName(vector.select("key", "rank", F.lit("vector").alias("arm")))
    via = F.when(F.count_distinct("arm") > 1, "both").otherwise(F.min("arm"))
    return both.groupBy("key").agg(F.sum(1.0 / (RANK_CONSTANT + F.col("rank"))).cast("double").alias("rrf"), via.alias("via"))
