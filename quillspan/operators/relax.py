"""Queries that loosen step by step, and qualifiers in their text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.storage import materialise

# Words that say nothing of what is asked for, and how many others are looked for together.
STOPWORDS = """
a an the to of in on at for and or but with without within into onto from by as is are was were be been
being do does did how what when where why who whom which that this these those i you he she it we they
my your his her its our their me him us them not no yes can could should would may might will shall must
about over under via per vs than then so if else any all some each more most less few many much get got
getting need needs want wants like out up down off no
""".split()
MOST_TERMS = 4


def content_terms(query: str) -> list[str]:
    """The words of a query that say something, as they are written."""
    return [w for w in query.split() if w.lower() not in STOPWORDS]


def specificity(term: str) -> tuple[bool, bool, int]:
    """What makes a term specific: an acronym or a digit, then a capital letter, then length."""
    short = term.isupper() and 2 <= len(term) <= 6
    return short or any(map(str.isdigit, term)), term[:1].isupper() and not term.isupper(), len(term)


def ladder(query: str, most: int = MOST_TERMS) -> list[list[str]]:
    """The sets of terms to look for, the tightest first: the ``most`` most specific ones, two of them, one."""
    terms = content_terms(query) or query.split()
    by_rank = sorted(terms, key=specificity, reverse=True)  # equal ones in the order of the query
    steps = [[t for t in terms if t in by_rank[:most]]]
    if len(terms) > 2:
        steps.append(by_rank[:2])
    if len(terms) > 1:
        steps.append(by_rank[:1])
    return [s for i, s in enumerate(steps) if s and s != (steps[i - 1] if i else None)]


def holds_term(text: Column, term: str) -> Column:
    """Whether a text holds a term as words of its own, whatever the case."""
    return text.rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}])\Q{term}\E(?![\p{{L}}\p{{N}}])")


def relaxed(docs: DataFrame, text: str, query: str, least: int = 1, most: int = MOST_TERMS) -> DataFrame:
    """The rows of ``docs`` that hold all terms of the tightest step with at least ``least`` rows, with that ``tier``.

    A step's terms are among those of the step before it, so one scan finds the tightest step that each row meets; the
    rows that meet any are written, and the counts of the steps come from them.  A row's ``terms_met`` is a bit for each
    term of the first step.  No terms, or no step with enough rows, give no rows.
    """
    steps = ladder(query, most)
    if not steps:
        return docs.limit(0).select("*", F.lit(0).alias("terms_met"), F.lit(0).alias("tier"))
    terms = list(dict.fromkeys(t.lower() for t in steps[0]))
    bit = {t: 1 << i for i, t in enumerate(terms)}
    mask = reduce(Column.bitwiseOR, (F.when(holds_term(F.col(text), t), bit[t]).otherwise(0) for t in terms))
    needed = [sum({bit[t.lower()] for t in s}) for s in steps]
    own = F.coalesce(*(F.when(F.col("terms_met").bitwiseAND(n) == n, i) for i, n in enumerate(needed)))
    met = materialise(docs.withColumn("terms_met", mask).withColumn("_own", own).where("_own IS NOT NULL"), "relaxed")
    counts = met.agg(*(F.count_if(F.col("_own") <= i).alias(f"n{i}") for i in range(len(steps))))
    winner = counts.select(F.coalesce(*(F.when(F.col(f"n{i}") >= least, i) for i in range(len(steps)))).alias("tier"))
    return met.crossJoin(F.broadcast(winner)).where(F.col("_own") <= F.col("tier")).drop("_own")  # one row


NAMES, REPLIES = r"(?i)(?:^|\s)(?:subreddit|sub)\s*:\s*([A-Za-z0-9_,]+)", r"(?i)(?:^|\s)comments?\s*:"


def qualified(query: Column) -> Column:
    """STRUCT<text, names, replies> of a query: names after ``sub:``, each once whatever its case, and whether ``comments:`` stands in it.

    ``names`` is null and the text stays where no name is given.
    """
    q = F.coalesce(query, F.lit(""))
    given = F.filter(F.transform(F.flatten(F.transform(F.regexp_extract_all(q, F.lit(NAMES), 1), lambda g: F.split(g, ","))), lambda n: F.trim(n)), lambda n: n != "")
    lowered = F.transform(given, F.lower)
    names = F.filter(given, lambda n, i: F.array_position(lowered, F.lower(n)) == i + 1)
    text = F.when(F.size(given) > 0, F.trim(F.regexp_replace(q, NAMES, " "))).otherwise(F.trim(q))
    return F.struct(F.trim(F.regexp_replace(text, REPLIES, " ")).alias("text"), F.when(F.size(given) > 0, names).alias("names"), q.rlike(REPLIES).alias("replies"))
