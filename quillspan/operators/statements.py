"""Directed statements as keyed state: a triple (src, dst, type) holds the last thing said about it.

Statements are judgments that somebody made; nothing here makes one.  Direction counts, so (a, b, t) and (b, a, t) are two
statements, and identity has no place among them: those types are refused and belong to rulings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The longest type, and the types that belong to rulings.
LONGEST_TYPE = 40
IDENTITY_TYPES = ["same_as", "not_same_as"]


def trimmed(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def type_slug(kind: Column) -> Column:
    """Lower-case ASCII letters, digits and single underscores; empty where nothing is left."""
    folded = F.replace(F.lower(F.trim(F.coalesce(kind, F.lit("")))), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", "_"), F.lit("_"))


def checked(requests: DataFrame) -> DataFrame:
    """``requests`` (seq, op, src, dst, type, note, doc, stated_at) trimmed, with the slug as ``type`` and ``refused``: why, or null.

    ``op`` is save or delete; only a save needs a note.
    """
    clean = requests.select("seq", "op", *(trimmed(c).alias(c) for c in ("src", "dst", "note", "doc")), type_slug(F.col("type")).alias("type"), "stated_at")
    why = (
        F.when((F.col("src") == "") | (F.col("dst") == ""), "no ends").when(F.col("type") == "", "no type")
        .when(F.length("type") > LONGEST_TYPE, "long type").when(F.col("type").isin(IDENTITY_TYPES), "identity")
        .when((F.col("op") == "save") & (F.col("note") == ""), "no note")
    )
    return clean.withColumn("refused", why)


def settled(statements: DataFrame | None, requests: DataFrame) -> DataFrame:
    """(src, dst, type, note, doc, stated_at) after ``requests``: a save replaces its triple, a delete empties it.

    ``seq`` orders the requests.  The last one of each triple is a mergeable maximum, so a triple that is rewritten all
    the time is combined before it is shuffled; refused requests change nothing.
    """
    said = F.struct("seq", "op", "note", "doc", "stated_at")
    events = checked(requests).where("refused IS NULL").select("src", "dst", "type", said.alias("said"))
    if statements is not None:
        held = F.struct(F.lit(None).cast("long").alias("seq"), F.lit("save").alias("op"), "note", "doc", "stated_at")  # a null is before any number
        events = events.unionByName(statements.select("src", "dst", "type", held.alias("said")))
    last = events.groupBy("src", "dst", "type").agg(F.max("said").alias("said")).where("said.op = 'save'")
    return last.select("src", "dst", "type", "said.note", "said.doc", "said.stated_at")


def as_edges(statements: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Statements in the shape of edges: tier J, method statement; those without ends or type are none."""
    kept = statements.select(*(trimmed(c).alias(c) for c in ("src", "dst", "type")), F.nullif("note", F.lit("")).alias("note"), F.nullif("doc", F.lit("")).alias("doc"), "stated_at")
    kept = kept.where("src <> '' AND dst <> '' AND type <> ''")
    if types:
        kept = kept.where(F.col("type").isin(types))
    return kept.withColumns({"method": F.lit("statement"), "tier": F.lit("J")})
