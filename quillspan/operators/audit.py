"""Planning and auditing of sources: which run, what they cover, which rules they break, and what is missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enabled(catalog: DataFrame) -> Column:
    """Explicit enable, explicit disable, walled sources off, group disables, else on; columns of ``catalog`` by name."""
    return F.when(F.col("enable"), True).when(F.col("disable"), False).when(F.col("walled"), False).when(F.col("group_off"), False).otherwise(F.lit(True))


def excluded_reason(catalog: DataFrame, policies: list[tuple[str, DataFrame]]) -> DataFrame:
    """``catalog`` with ``reason``: the first of the named policies (each a table of names) that has the source."""
    rows = catalog
    for name, table in policies:
        rows = rows.join(table.select("name", F.lit(name).alias(f"_{name}")).distinct(), "name", "left")
    return rows.withColumn("reason", F.coalesce(*(F.col(f"_{name}") for name, _ in policies))).drop(*(f"_{name}" for name, _ in policies))


def plan(catalog: DataFrame, down: DataFrame, terms: list[str], hints: int = 6) -> DataFrame:
    """(name, role): live sources, those that are down, and the excluded ones that fit the query best.

    ``catalog`` has name, enabled, reason, tokens.  A query token counts by its rarity over the whole catalog.
    """
    flags = [F.array_contains("tokens", t) for t in terms]
    stats = catalog.agg(F.count("*").alias("_n"), *(F.count_if(f).alias(f"_d{i}") for i, f in enumerate(flags)))
    rated = catalog.crossJoin(F.broadcast(stats))  # one row
    idf = [F.when(f, F.log(1 + (F.col("_n") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5))).otherwise(0.0) for i, f in enumerate(flags)]
    rated = rated.withColumn("fit", reduce(Column.__add__, idf, F.lit(0.0))).join(down.select("name", F.lit(True).alias("_down")).distinct(), "name", "left")
    out = F.col("reason").isNotNull() | ~F.col("enabled")
    running = rated.where(~out).select("name", F.when(F.col("_down"), "down").otherwise("live").alias("role"))
    hinted = rated.where(out & (F.col("fit") > 0) & ~F.coalesce(F.startswith("reason", F.lit("org_watch")), F.lit(False)))
    return running.unionByName(hinted.orderBy(F.desc(F.round("fit", 9)), "name").limit(hints).select("name", F.lit("hint").alias("role")))


def overlap(query_terms: list[str], surface: Column) -> Column:
    return F.size(F.array_intersect(F.array(*map(F.lit, query_terms)), surface))


def coverage(roster: DataFrame, domains: DataFrame, modes: DataFrame) -> DataFrame:
    """(domain, mode, sources, state) of every declared cell; ``roster`` is (name, domains, modes, healthy).

    Where the roster has ``presumed_dark``, such a source holds no cell either: it is as good as down.
    """
    if "presumed_dark" in roster.columns:
        roster = roster.withColumn("healthy", F.col("healthy") & ~F.coalesce("presumed_dark", F.lit(False)))
    placed = roster.select("name", "healthy", F.explode("domains").alias("domain"), "modes").select("name", "healthy", "domain", F.explode("modes").alias("mode"))
    cells = placed.groupBy("domain", "mode").agg(F.count_distinct("name").alias("sources"), F.count_distinct(F.when(F.col("healthy"), F.col("name"))).alias("healthy"))
    declared = domains.crossJoin(F.broadcast(modes))  # the declared grid, not rows
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    state = F.when(count("sources") == 0, "empty").when(count("healthy") == 0, "dark").when(count("healthy") == 1, "single").otherwise("covered")
    return declared.join(cells, ["domain", "mode"], "left").select("domain", "mode", count("sources").alias("sources"), state.alias("state"))


def gap_cells(grid: DataFrame, out_of_scope: DataFrame) -> DataFrame:
    """Empty cells, and single ones that are not out of scope."""
    empty = grid.where("state = 'empty'").select("domain", "mode")
    single = grid.where("state IN ('single', 'dark')").select("domain", "mode").join(out_of_scope, ["domain", "mode"], "left_anti")
    return empty.unionByName(single).distinct()


def impact(roster: DataFrame, name: str) -> DataFrame:
    """What each cell of a source keeps without it: (domain, mode, left, turns)."""
    placed = roster.select("name", F.explode("domains").alias("domain"), "modes").select("name", "domain", F.explode("modes").alias("mode")).distinct()
    cells = placed.where(F.col("name") == name).select("domain", "mode")
    left = placed.join(cells, ["domain", "mode"]).groupBy("domain", "mode").agg(F.count_if(F.col("name") != name).alias("left"))
    return left.withColumn("turns", F.when(F.col("left") == 0, "empty").when(F.col("left") == 1, "single").otherwise("covered"))


def dossier(roster: DataFrame, yields: DataFrame, watermarks: DataFrame, streaks: DataFrame) -> DataFrame:
    """A row for each source with its facts and safety flags; what is unknown stays null."""
    rows = roster.join(yields, "name", "left").join(watermarks, "name", "left").join(streaks, "name", "left")
    rate = lambda a, b: F.coalesce(F.round(F.try_divide(F.col(a), F.col(b)), 3), F.lit(0.0))
    rows = rows.withColumns({"sole_share": rate("sole", "top"), "presence_rate": rate("top", "offered")})
    evidence = F.coalesce(F.col("offered") >= 30, F.lit(False))
    dark = F.coalesce(F.col("silent_days") > F.col("cadence_days"), F.lit(False))
    return rows.withColumns({
        "evidence_met": evidence, "presumed_dark": dark, "blind": F.col("offered").isNull(), "starved": evidence & (F.coalesce(F.col("top"), F.lit(0)) == 0),
        "redundant": evidence & ~F.col("protected") & (F.col("sole_share") == 0) & (F.coalesce(F.col("top"), F.lit(0)) > 0),
        "dead": F.coalesce(F.col("fails") >= 2, F.lit(False)) & ~F.col("credentialed"), "silent": F.coalesce(F.col("silent_days") >= 30, F.lit(False)) & dark,
    })


#: Fixed value: the soft rules that are hard for candidates that nobody submitted.
HARD_IF_DISCOVERED = ["pii_employment_tracker"]


def red_lines(candidates: DataFrame, rules: DataFrame, promoted: list[str] = HARD_IF_DISCOVERED) -> DataFrame:
    """(id, rule, severity) of every rule that a candidate (id, url, query, discovered) breaks.

    ``rules`` are (rule, kind, value, severity), a policy file of bounded size.  Hosts meet by equality; suffixes by every
    suffix of a host; only path and query rules are tried one by one, in one expression.  The ``promoted``
    rules are hard for discovered candidates, even where they are soft.
    """
    host = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))), r"^(www|m)\.", "")
    rows = candidates.withColumn("host", host)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    by_host = rows.join(F.broadcast(rules.where("kind = 'host'")), F.col("host") == F.col("value"))
    ends = rows.select("*", F.explode(suffixes).alias("_suffix"))
    by_suffix = ends.join(F.broadcast(rules.where("kind = 'host_suffix'")), F.col("_suffix") == F.col("value")).drop("_suffix")
    tried = rules.where("kind IN ('path_regex', 'query_term')").collect()  # a policy file
    path = F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit(""))
    checks = [F.when(path.rlike(r["value"]) if r["kind"] == "path_regex" else F.contains(F.lower("query"), F.lit(r["value"])), F.struct(F.lit(r["rule"]).alias("rule"), F.lit(r["severity"]).alias("severity"))) for r in tried]
    broken = [d.select("id", "discovered", "rule", "severity") for d in (by_host, by_suffix)]
    if checks:
        broken.append(rows.select("id", "discovered", F.explode(F.array_compact(F.array(*checks))).alias("r")).select("id", "discovered", "r.rule", "r.severity"))
    found = reduce(DataFrame.unionByName, broken)
    return found.select("id", "rule", F.when(F.col("discovered") & F.col("rule").isin(promoted), "hard").otherwise(F.col("severity")).alias("severity")).distinct()


def allowed_moves(history: DataFrame, edges: DataFrame) -> DataFrame:
    """``history`` (id, step, state) with ``allowed``: a first state, the same state, or one along an edge (a, b)."""
    before = F.lag("state").over(Window.partitionBy("id").orderBy("step"))
    moves = history.withColumn("before", before)
    joined = moves.join(F.broadcast(edges.select(F.col("a").alias("before"), F.col("b").alias("state"), F.lit(True).alias("_edge"))), ["before", "state"], "left")
    return joined.select("id", "step", "state", (F.col("before").isNull() | (F.col("before") == F.col("state")) | F.coalesce("_edge", F.lit(False))).alias("allowed"))


# The words of a refusal and of throttling.
REFUSED, THROTTLED = r"\b(401|403)\b", r"\b429\b|rate[\s_-]*limit(ed|ing)?|throttl(e|ed|ing)|too many requests"


def probe_class(ok: Column, message: Column) -> Column:
    """skipped, blocked, rate_limited, degraded, up or down, by a probe's result and words.

    A probe without a result was skipped.  Only a failed one can be blocked, but a source that answers may throttle too.
    """
    low = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(ok.isNull(), "skipped").when(~ok & low.rlike(REFUSED), "blocked").when(low.rlike(THROTTLED), "rate_limited")
        .when(ok & F.contains(low, F.lit("degraded")), "degraded").when(ok, "up").otherwise("down")
    )


def summary(rows: DataFrame, statuses: list[str]) -> DataFrame:
    """(status, n) over a fixed domain; zeros stay."""
    domain = rows.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    return domain.join(rows.groupBy("status").count(), "status", "left").select("status", F.coalesce("count", F.lit(0)).cast("long").alias("n"))
