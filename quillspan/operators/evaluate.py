"""Evaluation statistics: intervals, percentiles, majorities and mechanical judges."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wilson(successes: Column, total: Column, z: float = 1.96) -> Column:
    """STRUCT<low, high>; null for no trials."""
    p, z2 = successes / total, z * z
    middle, spread = p + z2 / (2 * total), z * F.sqrt((p * (1 - p) + z2 / (4 * total)) / total)
    return F.when(total > 0, F.struct(F.greatest(F.lit(0.0), (middle - spread) / (1 + z2 / total)).alias("low"), F.least(F.lit(1.0), (middle + spread) / (1 + z2 / total)).alias("high")))


def majority(reps: DataFrame) -> DataFrame:
    """(task, status): dormant where all repetitions are, pass where more than half of all pass, skipped where some are and none fails, else fail."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    n, passed = F.count("*"), is_("pass")
    return reps.groupBy("task").agg(F.when(is_("dormant") == n, "dormant").when(2 * passed > n, "pass").when((is_("skipped") > 0) & (is_("fail") == 0), "skipped").otherwise("fail").alias("status"))


def suite_rates(tasks: DataFrame, dead: DataFrame) -> DataFrame:
    """(suite, passed, total, low, high) over tasks (task, suite, status) that are neither skipped nor observed dead."""
    kept = tasks.where("status <> 'skipped'").join(dead, "task", "left_anti")
    counted = kept.groupBy("suite").agg(F.count_if(F.col("status") == "pass").alias("passed"), F.count("*").alias("total"))
    return counted.withColumn("w", wilson(F.col("passed"), F.col("total"))).select("suite", "passed", "total", F.round("w.low", 9).alias("low"), F.round("w.high", 9).alias("high"))


def latency(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Percentiles by linear interpolation, and the mean of positive values."""
    p = [F.percentile(value, q).alias(f"p{int(q * 100)}") for q in (0.5, 0.9, 0.99)]
    return rows.groupBy(group).agg(*p, F.avg(F.when(F.col(value) > 0, F.col(value))).alias("mean_positive"))


def conflicts(claims: DataFrame, floor: float) -> DataFrame:
    """(item, ratio): the first value of each provenance disagrees by max / min of at least ``floor``.

    Values that are not positive are provenances all the same, but stay out of the ratio.
    """
    first = claims.groupBy("item", "provenance").agg(F.min_by("value", "pos").alias("value"))
    positive = F.when(F.col("value") > 0, F.col("value"))
    spread = first.groupBy("item").agg(F.count("*").alias("n"), F.count(positive).alias("p"), (F.max(positive) / F.min(positive)).alias("ratio"))
    return spread.where((F.col("n") >= 2) & (F.col("p") >= 2) & (F.col("ratio") >= floor)).select("item", "ratio")


#: The punctuation that judges leave out, and those of it that count between digits.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~，。、：；！？（）「」『』【】《》〈〉“”‘’＂＇﹁﹂﹃﹄"
SEPARATORS = ",._:/-−"
_LISTED = lambda chars: "".join(f"\\{c}" if c in "\\]^[-&" else c for c in chars)
_KEPT = _LISTED(c for c in SEPARATORS if c in PUNCTUATION)
#: What goes: punctuation that never counts, and blanks and separators without a digit on either side.
_DROPPED = f"[{_LISTED(c for c in PUNCTUATION if c not in SEPARATORS)}]|(?<!\\d)[ {_KEPT}]|[ {_KEPT}](?!\\d)"


def ascii_form(text: Column) -> Column:
    """``plain_form`` of ASCII texts, in the JVM."""
    low = F.trim(F.regexp_replace(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\\%"), F.lit("%"))), r"[\s\x1c-\x1f]+", " "))
    return F.regexp_replace(low, _DROPPED, "")


def plain_form(text: str | None) -> str:
    """Normal form for judges: NFKC, case folded; the listed punctuation and white space go, but separators between digits stay."""
    s = unicodedata.normalize("NFKC", (text or "").replace("\\%", "%")).casefold()
    s = " ".join(s.split())
    digit = lambda i: 0 <= i < len(s) and s[i].isdecimal()
    keep = lambda i, c: digit(i - 1) and digit(i + 1) if c == " " or c in SEPARATORS and c in PUNCTUATION else c not in PUNCTUATION
    return "".join(c for i, c in enumerate(s) if keep(i, c))


def contained(rows: DataFrame, needle: str, haystack: str, out: str = "contained") -> DataFrame:
    """``rows`` with whether the normal form of a needle (not empty) is in that of a text; only Unicode forms need Python."""

    @F.pandas_udf("boolean")
    def check(needles, texts):
        import pandas as pd

        return pd.Series([bool(n) and n in plain_form(t) for n, t in zip(map(plain_form, needles), texts)])

    plain = F.coalesce(F.col(needle), F.lit("")).rlike(r"\A[\x00-\x7f]*\z") & F.coalesce(F.col(haystack), F.lit("")).rlike(r"\A[\x00-\x7f]*\z")
    form = ascii_form(F.col(needle))
    in_jvm = rows.where(plain).withColumn(out, (form != "") & F.contains(ascii_form(F.col(haystack)), form))
    return in_jvm.unionByName(rows.where(~plain).withColumn(out, check(needle, haystack)))


def similar(needle: str, text: str) -> float:
    """The best ratio of matching blocks between a needle and the windows of its length in a text."""
    from difflib import SequenceMatcher

    n, t = plain_form(needle), plain_form(text)
    if not n or not t:
        return 0.0
    if n in t:
        return 1.0
    best, match = 0.0, SequenceMatcher(None, n, autojunk=False)
    for i in range(max(1, len(t) - len(n) + 1)):
        match.set_seq2(t[i : i + len(n)])
        if match.quick_ratio() > best:  # never below the ratio
            best = max(best, match.ratio())
    return best


def identifier(value: Column) -> Column:
    """STRUCT<kind, value> of an identifier: an arXiv id without its version, a DOI, a link without its scheme, or text."""
    v = F.regexp_replace(F.lower(F.trim(value)), r"[.,;]+$", "")
    v = F.regexp_replace(F.regexp_extract(v, r"^[^?#]*", 0), r"^https?://doi\.org/", "")
    v = F.regexp_replace(F.regexp_replace(v, r"^doi:\s*", ""), r"^(https?://)?arxiv\.org/(abs|pdf)/", "")
    v = F.regexp_replace(F.regexp_replace(v, r"\.pdf$", ""), "/+$", "")
    arxiv, link = r"^(?:arxiv:)?(\d{4}\.\d{4,5}|[a-z-]+/\d{7})(?:v\d+)?$", r"^[a-z][a-z0-9+.-]*://"
    made = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("value"))
    return (
        F.when(v.rlike(arxiv), made("arxiv", F.regexp_extract(v, arxiv, 1))).when(F.startswith(v, F.lit("10.")) & F.contains(v, F.lit("/")), made("doi", v))
        .when(v.rlike(link), made("url", F.regexp_replace(v, link, ""))).otherwise(made("text", v))
    )


def in_top(results: Column, wanted: Column, k: int) -> Column:
    """Whether one of the first k identifiers is the wanted one, in kind and value."""
    return F.exists(F.slice(results, 1, max(0, k)), lambda r: identifier(r) == identifier(wanted)) if k > 0 else F.lit(False)
