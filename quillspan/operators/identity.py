"""Who a name stands for: ranked candidates, known papers, ambiguity; nobody is ever picked in silence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import text as X

#: How many candidates are told at least, and the works from which one counts as strong.
LEAST_TOLD, STRONG_WORKS = 5, 2


def id_backend(token: Column) -> Column:
    """The backend whose author id a token is; null for a name."""
    t = F.trim(token)
    return F.when(t.rlike(r"^A\d+$"), "openalex").when(t.rlike(r"^\d{6,}$"), "s2")


def split_ids(token: Column) -> Column:
    """STRUCT<ids, source> of a token that is an id, or ids joined by ``+`` of one person split over them; null for a name."""
    ids = F.transform(F.split(F.trim(token), r"\+"), lambda i: F.trim(i))
    return F.when(F.forall(ids, lambda i: id_backend(i).isNotNull()), F.struct(ids.alias("ids"), id_backend(ids[0]).alias("source")))


def candidates(asked: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with ``name_match`` and ``hint_match``, and ``nth`` in the order of both and of works, equal ones by ``pos``.

    ``asked`` are (query, hint), each query once; ``found`` are (query, pos, id, source, name, works, institution).
    """
    hint = F.lower(F.trim(F.coalesce("hint", F.lit(""))))
    rows = found.join(asked, "query")
    rows = rows.withColumns({"works": F.coalesce("works", F.lit(0)), "name_match": X.name_matches(F.col("query"), F.col("name")), "hint_match": (hint != "") & F.contains(F.lower(F.coalesce("institution", F.lit(""))), hint)})
    order = [F.desc("name_match"), F.desc("hint_match"), F.desc("works"), F.asc("pos")]
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(*order))).drop("hint")


def by_paper(asked: DataFrame, authors: DataFrame) -> DataFrame:
    """(query, pos, id, source, name): the authors of each query's known paper who bear its name.

    ``asked`` are (query, paper), ``authors`` are (paper, pos, id, source, name).
    """
    met = asked.where("paper <> ''").join(authors.where("id IS NOT NULL"), "paper")
    return met.where(X.name_matches(F.col("query"), F.col("name"))).select("query", "pos", "id", "source", "name")


def resolved(asked: DataFrame, found: DataFrame, authors: DataFrame | None = None, limit: int = 5) -> DataFrame:
    """(query, nth, id, source, name, name_match, anchored, ambiguous): at most ``limit`` candidates, those of a known paper before them.

    A query is ambiguous if its two first matching candidates of ``STRONG_WORKS`` works have works within a factor of two,
    or, with a known paper, if that has several authors of the name.  Only the first rows of a query are kept by a task.
    """
    ranked = candidates(asked.select("query", "hint"), found)
    strong = ranked.where(F.col("name_match") & (F.col("works") >= STRONG_WORKS))
    two = strong.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy("nth"))).where("k <= 2").groupBy("query").agg(F.max(F.when(F.col("k") == 1, F.col("works"))).alias("first"), F.max(F.when(F.col("k") == 2, F.col("works"))).alias("second"))
    close = two.select("query", F.coalesce(F.col("second") * 2 >= F.col("first"), F.lit(False)).alias("close"))
    anchored = by_paper(asked.select("query", "paper"), authors) if authors is not None else found.limit(0).select("query", "pos", "id", "source", "name")
    pinned = anchored.groupBy("query").agg(F.count("*").alias("pinned"))
    rest = ranked.join(anchored.select("query", "id").distinct(), ["query", "id"], "left_anti")
    told = F.lit(max(limit, LEAST_TOLD))
    rest = rest.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("name_match"), "nth"))).where(F.col("k") <= told)
    first = anchored.select("query", F.row_number().over(Window.partitionBy("query").orderBy("pos", "id")).alias("k"), "id", "source", "name", F.lit(True).alias("name_match"), F.lit(True).alias("anchored"))
    rows = first.unionByName(rest.select("query", "k", "id", "source", "name", "name_match", F.lit(False).alias("anchored")))
    rows = rows.join(pinned, "query", "left").join(close, "query", "left")
    nth = F.when(F.col("anchored"), F.col("k")).otherwise(F.col("k") + F.coalesce("pinned", F.lit(0))).cast("int")
    ambiguous = F.when(F.col("pinned") > 0, F.col("pinned") > 1).otherwise(F.coalesce("close", F.lit(False)))
    return rows.select("query", nth.alias("nth"), "id", "source", "name", "name_match", "anchored", ambiguous.alias("ambiguous"))


def picked(tokens: DataFrame, told: DataFrame, source: str = "openalex") -> DataFrame:
    """(token, ids, source, alternatives): ids as they are; for a name its first matching candidate of ``source`` and three others.

    ``tokens`` are (token), ``told`` comes from ``resolved`` with tokens as queries.  A name that nobody bears has null ids.
    """
    named = tokens.select("token", split_ids(F.col("token")).alias("own"))
    match = told.where(F.col("name_match") & (F.col("source") == source))
    few = match.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy("nth"))).where("k <= 4")
    best = few.groupBy(F.col("query").alias("token")).agg(F.array_sort(F.collect_list(F.struct("k", "id"))).alias("m"))
    joined = named.join(best, "token", "left")
    ids = F.when(F.col("own").isNotNull(), F.col("own.ids")).when(F.size("m") > 0, F.array(F.col("m")[0]["id"]))
    others = F.when(F.col("own").isNull() & (F.size("m") > 1), F.transform(F.slice("m", 2, 3), lambda x: x["id"])).otherwise(F.array().cast("array<string>"))
    return joined.select("token", ids.alias("ids"), F.when(F.col("own").isNotNull(), F.col("own.source")).when(ids.isNotNull(), F.lit(source)).alias("source"), others.alias("alternatives"))
