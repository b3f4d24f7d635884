"""Citation and collaboration analytics over works, references and authors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def citation_degrees(works: DataFrame, seeds: DataFrame) -> DataFrame:
    """(work, in_degree, edges, seed_refs, seed_cites): counts over references that are works of the corpus.

    ``in_degree`` counts repeated references and self-citations; ``edges`` counts distinct citing works without loops.
    A seed is never missing, so its own ``seed_refs`` and ``seed_cites`` are null.  ``works`` are (work, refs), ``seeds`` are (work).
    """
    flagged = works.join(seeds.withColumn("is_seed", F.lit(True)), "work", "left")
    refs = flagged.select(F.col("work").alias("citing"), "is_seed", F.explode("refs").alias("work"))
    seeded = seeds.select(F.col("work"), F.lit(True).alias("to_seed"))
    cites = refs.join(seeded, "work").groupBy(F.col("citing").alias("work")).agg(F.count_distinct("work").alias("seed_cites"))
    degrees = refs.groupBy("work").agg(
        F.count("*").alias("in_degree"), F.count_distinct(F.when(F.col("citing") != F.col("work"), F.col("citing"))).alias("edges"),
        F.count_distinct(F.when(F.col("is_seed"), F.col("citing"))).alias("seed_refs"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rows = flagged.select("work", "is_seed").join(degrees, "work", "left").join(cites, "work", "left")
    return rows.select("work", zero("in_degree"), zero("edges"), *(F.when(F.col("is_seed").isNull(), zero(c)).alias(c) for c in ("seed_refs", "seed_cites")))


def coauthor_credit(authorship: DataFrame, egos: DataFrame, most: int = 12) -> DataFrame:
    """(ego, author, credit, papers, nth): shared works, each worth one over its number of authors.

    ``authorship`` is (work, author), ``egos`` is (author).
    """
    mine = egos.join(authorship.distinct(), "author").select(F.col("author").alias("ego"), "work")
    sizes = authorship.groupBy("work").agg(F.count_distinct("author").alias("n"))
    met = mine.join(sizes, "work").join(authorship.distinct(), "work").where("author <> ego")
    credit = met.groupBy("ego", "author").agg(F.sum(1.0 / F.col("n")).cast("double").alias("credit"), F.count("*").alias("papers"))
    order = Window.partitionBy("ego").orderBy(F.desc(F.round("credit", 9)), "author")
    return credit.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)


def bridges(credit: DataFrame, most: int = 15) -> DataFrame:
    """(author, egos, credit): coauthors of at least two egos, by their credit with all of them."""
    found = credit.groupBy("author").agg(F.count_distinct("ego").alias("egos"), F.sum("credit").alias("credit")).where("egos >= 2")
    return found.orderBy(F.desc(F.round("credit", 9)), "author").limit(most)


def cooccurrence(authorship: DataFrame, among: DataFrame) -> DataFrame:
    """(a, b, works): how many works two of the given authors (author) share; the given set is small."""
    few = authorship.distinct().join(among, "author")
    a, b = few.select("work", F.col("author").alias("a")), few.select("work", F.col("author").alias("b"))
    return a.join(b, "work").where("a < b").groupBy("a", "b").agg(F.count("*").alias("works"))


def cohort(authorship: DataFrame, institutions: DataFrame, institution, limit: int = 40) -> DataFrame:
    """Authors of an institution by their works: (author, works)."""
    mine = institutions.where(F.col("institution") == institution).select("author")
    return authorship.join(mine, "author").groupBy("author").agg(F.count_distinct("work").alias("works")).orderBy(F.desc("works"), "author").limit(limit)


def likely_same(people: DataFrame, key) -> DataFrame:
    """Groups of ids of one source whose names have the same words: (key, source, n, merged)."""
    keyed = people.withColumn("key", key).where("key <> ''")
    found = keyed.groupBy("key", "source").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("id")), "+").alias("merged"))
    return found.where("n >= 2")


def abstract_text(inverted):
    """The text of an inverted index (word to places); the last word wins a place."""
    pairs = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")
