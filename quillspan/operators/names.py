"""Names that nearly agree, and hosts that candidates share with sources that are already there.

Two names agree by the share of characters in matching blocks, twice over both lengths (Ratcliff and Obershelp).  A pair that
reaches ``least`` shares at least so many bigrams, counted with repeats: the matched characters are M >= least * T / 2 of the T
of both; unmatched ones cut the matches into at most T - 2M + 1 blocks, and a block of b characters holds b - 1 bigrams; so
3M - T - 1 bigrams are common.  Of two bigram sets that share o, each ordered from rare to common, the first size - o + 1
have one in common: only those meet in the join.  The shares of what meets are then computed exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.storage import materialise

LEAST = 0.85


def needed(length: Column, least: float) -> Column:
    """A lower bound of the bigrams that a name of ``length`` shares with any name that it agrees with."""
    shortest = F.ceil(length * (least / (2 - least)) - 1e-9)  # matches fit into the shorter name
    return F.ceil((1.5 * least - 1) * (length + shortest) - 1 - 1e-9)


def bigrams(name: Column) -> Column:
    """The bigrams of a name, each with how many of its kind came before; a name of one character is its own."""
    pairs = F.when(F.length(name) < 2, F.array(name)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - 1, F.lit(1))), lambda i: F.substring(name, i, F.lit(2))))
    return F.transform(pairs, lambda g, i: F.concat(g, F.lit("\x00"), F.size(F.filter(F.slice(pairs, 1, i), lambda h: h == g)).cast("string")))


def rarest(names: DataFrame, counts: DataFrame, least: float) -> DataFrame:
    """(name, token) of the tokens of which two agreeing names share one."""
    tokens = names.select("name", F.explode("tokens").alias("token")).join(counts, "token")
    ordered = tokens.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("t"))  # as many as the name has letters
    keep = F.size("t") - F.greatest(needed(F.length("name"), least), F.lit(1)) + 1
    return ordered.select("name", F.explode(F.slice("t", 1, F.greatest(keep, F.lit(1)).cast("int"))).alias("t")).select("name", "t.token")


def similar_names(candidates: DataFrame, existing: DataFrame, least: float = LEAST) -> DataFrame:
    """(name, existing, ratio): the existing names that a candidate nearly bears, itself left out.

    Case doesn't count.  The ratio is that of the candidate against the existing name, rounded to three places; the bound
    is held against the exact one.  Empty names and nulls agree with nothing.  Equal lower-case names meet once, whatever
    number of rows bears them.  ``least`` is above 2/3, below which bigrams bound nothing.
    """
    if not 2 / 3 < least <= 1:
        raise ValueError("least lies above 2/3 and at most at 1")
    sides = [df.select("name").where("name <> ''").distinct() for df in (candidates, existing)]
    lowered = [s.select(F.lower("name").alias("name")).distinct().withColumn("tokens", bigrams(F.col("name"))) for s in sides]
    counts = materialise(lowered[0].unionByName(lowered[1]).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")), "tokens")
    left, right = (rarest(s, counts, least) for s in lowered)
    met = left.join(right.withColumnRenamed("name", "other"), "token")
    ratio = least / (2 - least)
    fits = (F.length("other") >= F.length("name") * ratio - 1e-9) & (F.length("name") >= F.length("other") * ratio - 1e-9)
    pairs = met.where(fits).select("name", "other").distinct().unionByName(short_pairs(lowered, least)).distinct()

    def exact(batches: Iterator) -> Iterator:
        import difflib

        import pyarrow as pa

        for batch in batches:
            rows, matcher, was = [], difflib.SequenceMatcher(None), None
            for a, b in zip(batch.column("name").to_pylist(), batch.column("other").to_pylist()):
                if b != was:
                    matcher.set_seq2(was := b)
                matcher.set_seq1(a)
                if matcher.real_quick_ratio() >= least and matcher.quick_ratio() >= least and (r := matcher.ratio()) >= least:
                    rows.append((a, b, r))
            yield pa.RecordBatch.from_pydict({"name": [r[0] for r in rows], "other": [r[1] for r in rows], "ratio": pa.array([r[2] for r in rows], pa.float64())}, pa.schema([("name", pa.string()), ("other", pa.string()), ("ratio", pa.float64())]))

    agreed = pairs.mapInArrow(exact, "name string, other string, ratio double")
    spelled = [s.select(F.col("name").alias(c), F.lower("name").alias(low)) for s, c, low in zip(sides, ("called", "existing"), ("name", "other"))]
    found = agreed.join(spelled[0], "name").join(spelled[1], "other").where("called <> existing")
    return found.select(F.col("called").alias("name"), "existing", F.round("ratio", 3).alias("ratio"))


def short_pairs(lowered: list[DataFrame], least: float) -> DataFrame:
    """Pairs of names so short that agreeing ones may share no bigram: by characters, of names of a few letters alone."""
    longest = math.floor(2 / (1.5 * least - 1))  # 3M - T - 1 < 1 needs (1.5 least - 1) T < 2
    few = [s.where(F.length("name") < longest).select("name", F.explode(F.array_distinct(F.split("name", ""))).alias("c")) for s in lowered]
    near = few[0].join(few[1].withColumnRenamed("name", "other"), "c").where(F.length("name") + F.length("other") <= longest)
    return near.select("name", "other").distinct()


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))


def node_host(doi: Column, url: Column) -> tuple[Column, Column]:
    """(host, edge) of a citation node: its DOI's host, else that of its own page; never that of a link in its text."""
    by_doi, by_url = host(doi), host(url)
    return F.coalesce(F.nullif(by_doi, F.lit("")), F.nullif(by_url, F.lit(""))), F.when(by_doi != "", "venue_doi").when(by_url != "", "venue_url")


def host_overlap(candidates: DataFrame, roster: DataFrame) -> DataFrame:
    """(name, existing, shared_host) of candidates (name, url) whose host a source of the roster (name, url) serves."""
    sides = [df.select(F.col("name").alias(c), host(F.col("url")).alias("shared_host")).where("shared_host <> ''").distinct() for df, c in ((candidates, "name"), (roster, "existing"))]
    return sides[0].join(sides[1], "shared_host").select("name", "existing", "shared_host")
