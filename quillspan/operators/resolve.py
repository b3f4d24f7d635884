"""Deduplication across sources: fingerprint groups, identity unions, survivors and what they carry over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import text as X
from quillspan.operators.components import connected_components


def grouped(docs: DataFrame) -> DataFrame:
    """``docs`` with ``fp``, and ``grp``: the earliest fingerprint of those that strong ids unite, and ``united``.

    ``docs`` have pos, source, source_id, url, title, doi, arxiv, or ``fp`` in place of the title.  Fingerprints that share a strong id are joined by
    their components; rows without a shared id take no part in that.
    """
    keyed = docs if "fp" in docs.columns else docs.withColumn("fp", X.fingerprint(*(F.col(c) for c in ("title", "doi", "url", "source", "source_id"))))
    ids = keyed.select("fp", "pos", F.explode(X.strong_ids(F.col("doi"), F.col("arxiv"), F.col("url"))).alias("strong"))
    firsts = keyed.groupBy("fp").agg(F.min("pos").alias("fp_pos"))
    holders = ids.groupBy("strong", "fp").agg(F.lit(1)).select("strong", "fp").join(firsts, "fp")
    least = holders.groupBy("strong").agg(F.min("fp_pos").alias("least"), F.count("*").alias("n")).where("n > 1")
    edges = holders.join(least, "strong").select(F.col("fp_pos").alias("src"), F.col("least").alias("dst"))
    roots = connected_components(edges).select(F.col("node").alias("fp_pos"), F.col("component").alias("grp"))
    placed = firsts.join(roots, "fp_pos", "left").select("fp", F.coalesce("grp", "fp_pos").alias("grp"), F.col("grp").isNotNull().alias("united"))
    return keyed.join(placed, "fp")


def narrow_columns() -> list[Column]:
    """What ``grouped`` and ``survivors`` need of a document, without its text; a long fingerprint as its digest.

    Equal fingerprints have equal digests and a digest keeps its kind, so the groups and what they rest on are the same.
    """
    fp = X.fingerprint(*(F.col(c) for c in ("title", "doi", "url", "source", "source_id")))
    short = F.when(F.length(fp) > 96, F.concat(F.substring_index(fp, ":", 1), F.lit(":"), F.sha2(fp, 256))).otherwise(fp)
    kept = [F.col(c) for c in ("pos", "source", "source_id", "url", "doi", "arxiv", "backend", "date", "attention")]
    return [*kept, F.length(F.coalesce("content", F.lit(""))).alias("chars"), short.alias("fp")]


def survivors(members: DataFrame) -> DataFrame:
    """A row for each group: its richest member and the facts that the group agrees on.

    ``members`` are from ``grouped`` with content (or ``chars``, its length), attention, backend, date.  Everything is one aggregation over mergeable
    extremes and sets, so a group of any size is combined before it is shuffled.
    """
    chars = F.col("chars") if "chars" in members.columns else F.length(F.coalesce("content", F.lit("")))
    best = F.max_by(F.struct("pos", "source", "source_id", "date"), F.struct(chars, F.coalesce("attention", F.lit(0.0)), -F.col("pos")))
    dated = F.min_by(F.struct("date", "source"), F.when(F.col("date").isNotNull(), F.col("pos")))
    rows = members.groupBy("grp").agg(
        best.alias("best"), F.collect_set("source").alias("sources"), F.count_distinct("backend").alias("backends"),
        F.count("*").alias("members"), dated.alias("dated"), F.bool_or("united").alias("united"), F.min_by("fp", "pos").alias("fp"),
    )
    own = F.col("best.date")
    return rows.select(
        "grp", F.col("best.pos").alias("pos"), F.col("best.source").alias("source"), "members",
        F.array_sort(F.array_remove("sources", F.col("best.source"))).alias("also_in"), F.array_sort("sources").alias("live_sources"),
        F.greatest("backends", F.lit(1)).alias("corroboration"), F.coalesce(own, F.col("dated.date")).alias("date"),
        F.when(own.isNull(), F.col("dated.source")).alias("date_from"),
        F.when(F.col("united") | ~F.startswith("fp", F.lit("title:")), "id").otherwise("title").alias("merge_basis"),
    )


def carried(members: DataFrame) -> DataFrame:
    """(grp, pos, doi, arxiv, ids_from, openalex, authorships): what a group's survivor takes from its other members.

    A survivor without any id takes those of the first member that has one; one without authorships takes those of the
    first member with some, and that member's openalex id if it lacks its own.  Everything else is null: nothing native is
    told again.  ``members`` are from ``grouped`` with content, attention, openalex, authorships (array).  "The first
    member with" is a mergeable minimum for each fact, so no group is sorted.
    """
    some = lambda c: F.nullif(c, F.lit(""))
    handle = F.coalesce(some("doi"), some("arxiv"))
    named = F.coalesce(F.size("authorships"), F.lit(0)) > 0
    seen = F.struct("pos", handle.isNotNull().alias("handled"), named.alias("named"), some("openalex").alias("openalex"))
    best = F.max_by(seen, F.struct(F.length(F.coalesce("content", F.lit(""))), F.coalesce("attention", F.lit(0.0)), -F.col("pos")))
    rows = members.groupBy("grp").agg(
        best.alias("best"), F.min_by(F.struct(some("doi").alias("doi"), some("arxiv").alias("arxiv"), "source"), F.when(handle.isNotNull(), F.col("pos"))).alias("ids"),
        F.min_by(F.struct("authorships", some("openalex").alias("openalex")), F.when(named, F.col("pos"))).alias("who"),
    )
    lent = lambda c: F.when(~F.col("best.handled"), F.col(f"ids.{c}"))
    told = F.when(~F.col("best.named"), F.col("who.authorships"))
    return rows.select("grp", F.col("best.pos").alias("pos"), lent("doi").alias("doi"), lent("arxiv").alias("arxiv"), lent("source").alias("ids_from"), F.when(told.isNotNull() & F.col("best.openalex").isNull(), F.col("who.openalex")).alias("openalex"), told.alias("authorships"))


def divergence_ratio(a: Column, b: Column) -> Column:
    """max|v| / min|v|; infinite for opposite signs or one zero; null for equal values."""
    high, low = F.greatest(F.abs(a), F.abs(b)), F.least(F.abs(a), F.abs(b))
    return F.when(a == b, F.lit(None)).when((a * b < 0) | (low == 0), F.lit(float("inf"))).otherwise(high / low)


def significant(x: Column, digits: int = 3) -> Column:
    """``x`` rounded to significant digits; zero and infinity stay."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when((x == 0) | (F.abs(x) == float("inf")), x).otherwise(F.round(x * scale) / scale)


def divergences(signals: DataFrame, most: int = 3) -> DataFrame:
    """The ``most`` strongest disagreements of each group: (grp, signal, source_a, source_b, ratio, nth).

    ``signals`` are (grp, pos, source, signal, value).  A group's members of one signal are what sources say of one work.
    """
    a, b = signals.alias("a"), signals.alias("b")
    met = a.join(b, (F.col("a.grp") == F.col("b.grp")) & (F.col("a.signal") == F.col("b.signal")) & (F.col("a.pos") < F.col("b.pos")) & (F.col("a.source") != F.col("b.source")))
    rated = met.select(F.col("a.grp").alias("grp"), F.col("a.signal").alias("signal"), F.col("a.source").alias("source_a"), F.col("b.source").alias("source_b"), F.col("a.pos").alias("pos_a"), F.col("b.pos").alias("pos_b"), divergence_ratio(F.col("a.value"), F.col("b.value")).alias("ratio")).where("ratio IS NOT NULL")
    order = Window.partitionBy("grp").orderBy(F.desc("ratio"), "pos_a", "pos_b", "signal")
    return rated.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).withColumn("ratio", significant(F.col("ratio")))
