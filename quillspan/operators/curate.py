"""Records that people and agents curate: candidates, verdicts, overlays, and reference facts about works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Notices that say something about a work's integrity, and those that withdraw it.
NOTICES = ["correction", "erratum", "expression_of_concern", "removal", "retraction", "withdrawal"]
WITHDRAWN = ["removal", "retraction", "withdrawal"]
# Flags that forbid each class of removal.
FORBIDDING = {
    "DEAD": ["coverage_critical", "coverage_unknown", "is_cdp_or_credentialed", "watchdog_untracked"],
    "low-yield": ["coverage_critical", "coverage_unknown", "protected_sole_contributor", "tap_blind", "deadline_starved", "below_cadence_floor", "min_evidence_unmet"],
    "redundant": ["coverage_critical", "coverage_unknown", "protected_sole_contributor", "tap_blind", "deadline_starved", "min_evidence_unmet"],
}


def canonical_host(url: Column) -> Column:
    """A link's or bare host's lower-case host without user, port and ``www.``; empty if there is none."""
    rest = F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"^([a-z][a-z0-9+.-]*:)?//", "")
    head = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"[/?#].*$", ""), r"^.*@", ""), r":\d*$", "")
    return F.regexp_replace(F.trim(head, F.lit(".")), r"^www\.", "")


def candidate_id(name: Column, urls: Column) -> Column:
    """A slug of the name and the beginning of a digest of name and links."""
    slug = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.concat(slug, F.lit("-"), F.substring(F.sha2(F.concat(name, F.lit("|"), F.array_join(F.array_sort(urls), "|")), 256), 1, 8))


def gated_verdicts(verdicts: DataFrame, flags: DataFrame) -> DataFrame:
    """``verdicts`` (name, verdict, prune_class) with ``forbidden_by`` and ``recorded``.

    ``flags`` are (name, flag) of those that hold now; a source without any row in it is unknown, so never removable.
    Keeping and watching always succeed.
    """
    rules = verdicts.sparkSession.createDataFrame([(c, f) for c, fs in FORBIDDING.items() for f in fs], "prune_class string, flag string")
    held = flags.groupBy("name").agg(F.collect_set("flag").alias("held"))
    matrix = rules.groupBy("prune_class").agg(F.collect_set("flag").alias("forbidding"))
    rows = verdicts.join(held, "name", "left").join(F.broadcast(matrix), "prune_class", "left")
    active = F.coalesce("held", F.array(F.lit("coverage_unknown"), F.lit("min_evidence_unmet")))
    prune = F.col("verdict") == "prune"
    against = F.when(prune, F.array_sort(F.array_intersect(active, F.coalesce("forbidding", F.array().cast("array<string>"))))).otherwise(F.array().cast("array<string>"))
    known = F.col("verdict").isin("keep", "watch") | (prune & F.col("forbidding").isNotNull())
    return rows.select("name", "verdict", "prune_class", against.alias("forbidden_by"), (known & (F.size(against) == 0)).alias("recorded"))


def submitted(current: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Candidates (id, name, state, created) after submissions (id, name): a known one refreshes its name, keeps state and age."""
    latest = new.groupBy("id").agg(F.max_by("name", "pos").alias("new_name"))
    return current.join(latest, "id", "full_outer").select("id", F.coalesce("new_name", "name").alias("name"), F.coalesce("state", F.lit("new")).alias("state"), F.coalesce("created", now).alias("created"))


def moved_on(current: DataFrame, moves: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates (id, state, history) after at most one move each (id, to): along an edge (a, b) or to the same state."""
    rows = current.join(moves, "id", "left").join(F.broadcast(edges.select(F.col("a").alias("state"), F.col("b").alias("to"), F.lit(True).alias("_edge"))), ["state", "to"], "left")
    goes = F.col("to").isNotNull() & ((F.col("state") == F.col("to")) | F.coalesce("_edge", F.lit(False)))
    return rows.select("id", F.when(goes, F.col("to")).otherwise(F.col("state")).alias("state"), F.when(goes, F.array_append("history", F.col("to"))).otherwise(F.col("history")).alias("history"), (F.col("to").isNotNull() & ~goes).alias("refused"))


def with_overlay(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """Base rows and those overlay rows whose name the base lacks."""
    return base.unionByName(overlay.join(base.select("name"), "name", "left_anti").dropDuplicates(["name"]), allowMissingColumns=True)


def untried(candidates: DataFrame, tried: DataFrame) -> DataFrame:
    """Candidates (url) whose host no ledger row (url) has."""
    hosts = tried.select(canonical_host(F.col("url")).alias("_host")).distinct()
    return candidates.withColumn("_host", canonical_host(F.col("url"))).join(hosts, "_host", "left_anti").drop("_host")


def watch_expired(candidates: DataFrame, now: Column, most_probes: int = 3, days: int = 120) -> Column:
    """Whether a watched candidate (history, verdict_at) has used up its probes or its time."""
    probes = F.size(F.filter("history", lambda s: s == "probed"))
    return (probes >= most_probes) | F.coalesce(F.unix_timestamp(now) - F.unix_timestamp("verdict_at") >= days * 86400, F.lit(False))


def problems(required: list[str], whole: list[str] = (), flags: list[str] = ()) -> Column:
    """What is wrong with a row of strings: missing values, and values that are no numbers or truth values."""
    missing = [F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", F.lit(f"{c} is missing")) for c in required]
    numbers = [F.when(F.col(c).isNotNull() & F.col(c).try_cast("long").isNull(), F.lit(f"{c} is no number")) for c in whole]
    truths = [F.when(F.col(c).isNotNull() & ~F.lower(c).isin("true", "false", "yes", "no", "1", "0"), F.lit(f"{c} is no truth value")) for c in flags]
    return F.array_compact(F.array(*missing, *numbers, *truths))


def partial_update(current: DataFrame, probed: DataFrame, key: str, registered: DataFrame) -> DataFrame:
    """State (key, value) after a run that saw only some keys; rows of keys that are registered no more go.

    An empty registry means that it didn't load, so nothing goes.
    """
    rows = current.withColumnRenamed("value", "_old").join(probed.withColumnRenamed("value", "_new"), key, "full_outer").select(key, F.coalesce("_new", "_old").alias("value"))
    return rows if registered.isEmpty() else rows.join(registered.select(key).distinct(), key, "left_semi")


def down_set(health: DataFrame, now: Column, least: int = 2, hours: int = 6) -> DataFrame:
    """Names with enough failures in a row, as long as the watchdog's last run is fresh; ``health`` is (name, fails, as_of)."""
    age = F.unix_timestamp(now) - F.unix_timestamp("as_of")
    return health.where((F.col("fails") >= least) & age.between(0, hours * 3600)).select("name")


def reader_order(readers: DataFrame, depths: dict[str, int], other: int = 10) -> DataFrame:
    """Readers (name, depth_class, pos) in the order in which they try a link."""
    depth = F.coalesce(*(F.when(F.col("depth_class") == k, v) for k, v in depths.items()), F.lit(other))
    return readers.withColumn("nth", F.row_number().over(Window.orderBy(depth, "pos")))


def paper_key(raw: Column) -> Column:
    """One key for every form in which a paper is named: arXiv before DOI before the text itself."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    arxiv = F.nullif(F.regexp_extract(text, r"(?i)(?:^|arxiv[.:/]|arxiv\.org/(?:abs|pdf)/)(\d{4}\.\d{4,5})(?:v\d+)?", 1), F.lit(""))
    doi = F.lower(F.regexp_replace(text, r"(?i)^https?://(?:dx\.)?doi\.org/", ""))
    return F.coalesce(F.concat(F.lit("arxiv:"), arxiv), F.when(F.startswith(doi, F.lit("10.")), F.concat(F.lit("doi:"), doi)), F.concat(F.lit("raw:"), F.lower(text)))


def seed_id(raw: Column) -> Column:
    """A seed with the prefix that a citation backend needs."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    doi = F.trim(F.regexp_replace(text, r"^.*doi\.org/", ""), F.lit("/"))
    return F.when(text.rlike(r"^\d{4}\.\d{4,5}(v\d+)?$"), F.concat(F.lit("ArXiv:"), text)).when(text.rlike(r"(?i)^10\.|doi\.org/"), F.concat(F.lit("DOI:"), doi)).otherwise(text)


def enriched(asked: DataFrame, notices: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, retracted, notices, citations) of papers (id): by reference tables (key, notice) and (key, citations).

    ``retracted`` is null for a paper that the tables don't know.
    """
    keys = asked.select(paper_key(F.col("id")).alias("key")).distinct()
    found = notices.where(F.col("notice").isin(NOTICES)).groupBy("key").agg(F.array_sort(F.collect_set("notice")).alias("notices"))
    rows = keys.join(found, "key", "left").join(counts, "key", "left")
    known = F.col("notices").isNotNull() | F.col("citations").isNotNull()
    held = F.coalesce("notices", F.array().cast("array<string>"))
    return rows.select("key", F.when(known, F.arrays_overlap(held, F.array(*map(F.lit, WITHDRAWN)))).alias("retracted"), held.alias("notices"), "citations")


def similar_anchors(target: str, statements: DataFrame, limit: int = 5) -> DataFrame:
    """(id, shared): ends of statements (src, dst) of the target's kind whose words hold the target's or are held by them."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.element_at(F.split(c, ":"), -1)), r"[\s_\-/]+"), lambda w: F.length(w) >= 3))
    kind = target.split(":", 1)[0]
    ends = statements.select(F.explode(F.array("src", "dst")).alias("id")).where(F.col("id").isNotNull()).distinct()
    wanted = words(F.lit(target))
    shared = F.size(F.array_intersect(wanted, words(F.col("id"))))
    rows = ends.where((F.split("id", ":")[0] == kind) & (F.col("id") != target)).select("id", shared.alias("shared"), F.least(F.size(wanted), F.size(words(F.col("id")))).alias("_least"))
    return rows.where("shared > 0 AND shared >= _least").orderBy(F.desc("shared"), "id").limit(limit).select("id", "shared")


def timed_segments(spans: Column, texts: Column) -> Column:
    """Spans in milliseconds with their texts, as seconds; the shorter list ends both and empty texts go."""
    n = F.least(F.size(spans), F.size(texts))
    pairs = F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.round(F.element_at(spans, i)[0] / 1000, 2).alias("start"), F.round(F.element_at(spans, i)[1] / 1000, 2).alias("end"), F.trim(F.element_at(texts, i)).alias("text")))
    return F.filter(pairs, lambda p: p["text"] != "")
