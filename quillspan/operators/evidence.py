"""Bounded views over an evidence graph, under one policy of which identities count.

A hop unites four kinds of edges that touch its frontier: stored ones, identities derived from titles and from ids that
documents carry, statements, and rulings.  All are found by equality joins with the frontier, each end by its own, so a
node with very many edges is split as a skewed join.  A hop is written once and read by whatever follows.

Statements and rulings count in the policies that heed judgments.  A ruling joins where it touches the frontier.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.operators.components import connected_components
from quillspan.operators.graph import BY_ID, POLICIES, RULED, node_kind
from quillspan.operators.statements import as_edges
from quillspan.storage import materialise

EDGE = ["src", "dst", "type", "method", "tier", "note", "doc"]
MOST_VOICES = 64


class Evidence(NamedTuple):
    """The tables that the views read.

    nodes: id, kind, label, last_seen; edges: src, dst, type, tier, method, first_seen; documents: id, title, fp, openalex,
    doi, arxiv, last_seen (see ``known_documents``); rulings: a, b, verdict; statements: src, dst, type, note, doc, stated_at.
    last_seen and first_seen are timestamps.
    """

    nodes: DataFrame
    edges: DataFrame
    documents: DataFrame
    rulings: DataFrame
    statements: DataFrame


class Subgraph(NamedTuple):
    """nodes: id, kind, label, capped (whether nodes were left out); edges: EDGE and ``added`` where the view has times."""

    nodes: DataFrame
    edges: DataFrame

    def rows(self) -> DataFrame:
        """Both as one table: ``part`` is node or edge, a node's id stands in ``src``."""
        nodes = self.nodes.select(F.lit("node").alias("part"), F.col("id").alias("src"), "kind", "label", "capped")
        return nodes.unionByName(self.edges.drop("note", "doc").withColumn("part", F.lit("edge")), allowMissingColumns=True)


def instant(text: Column) -> Column:
    """The time of an ISO date or stamp; without a zone it is UTC, and what is neither gives null."""
    zoned = F.when(F.length(text) == 10, F.concat(text, F.lit("T00:00:00Z"))).when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\d"), zoned.try_cast("timestamp"))


def known_documents(docs: DataFrame, thin: DataFrame) -> DataFrame:
    """Documents of both stores; one that is indexed in ``docs`` hides its thin row."""
    return docs.unionByName(thin.join(docs.select("id"), "id", "left_anti"))


def self_label(node: Column) -> Column:
    """The label that an id of the form kind:label:x carries itself."""
    parts = F.split(node, ":", 3)
    return F.when(F.get(parts, F.lit(1)) == "label", F.nullif(F.get(parts, F.lit(2)), F.lit("")))


def touching(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """The edges with an end in the frontier (node), each once."""
    ends = [edges.join(frontier.withColumnRenamed("node", end), end, "left_semi").select(*edges.columns) for end in ("src", "dst")]
    return ends[0].unionByName(ends[1]).distinct()


def shaped(edges: DataFrame, *more: Column) -> DataFrame:
    """``edges`` with the columns of EDGE, null where they lack one, and ``more``."""
    return edges.select(*(F.col(c) if c in edges.columns else F.lit(None).cast("string").alias(c) for c in EDGE), *more)


def title_edges(documents: DataFrame, frontier: DataFrame) -> DataFrame:
    """Identities between documents of one title fingerprint, of which one is in the frontier."""
    titled = documents.where(F.startswith("fp", F.lit("title:"))).select("id", "fp")
    mine = titled.join(frontier.withColumnRenamed("node", "id"), "id", "left_semi").withColumnRenamed("id", "one")
    pairs = mine.join(titled, "fp").where("id <> one")
    return pairs.select(F.least("one", "id").alias("src"), F.greatest("one", "id").alias("dst"), F.lit("same_as").alias("type"), F.lit("align:title_fp").alias("method")).distinct()


def id_edges(documents: DataFrame, frontier: DataFrame) -> DataFrame:
    """Identities of the frontier's documents with the works whose ids they carry."""
    mine = documents.join(frontier.withColumnRenamed("node", "id"), "id", "left_semi")
    carried = [(name, F.trim(F.lower(name)) if name == "doi" else F.col(name)) for name in ("openalex", "doi", "arxiv")]
    works = [F.struct(F.concat(F.lit(f"work:{name}:"), value).alias("dst"), F.lit(f"id_eq:{name}").alias("method"), (F.col(name) != "").alias("held")) for name, value in carried]
    found = mine.select(F.col("id").alias("src"), F.explode(F.array(*works)).alias("w")).where("w.held")
    return found.select("src", "w.dst", F.lit("same_as").alias("type"), "w.method")


def hop(evidence: Evidence, frontier: DataFrame, policy: str, types: list[str] | None = None, stated: bool = True) -> DataFrame:
    """Every edge (EDGE) that touches the frontier (node) and that the policy lets count.

    ``types`` bounds stored edges and statements.  Facts always pass, identities by the policy's methods; refused pairs go
    last, so a refusal wins over whatever says the same.
    """
    name = policy.strip().lower()
    methods = POLICIES.get(name, BY_ID)
    stored = evidence.edges if not types else evidence.edges.where(F.col("type").isin(types))
    stored = stored.where((F.col("type") != "same_as") | F.col("method").isin(methods)).select("src", "dst", "type", "method")
    found = [touching(stored, frontier)]
    if "align:title_fp" in methods:
        found.append(title_edges(evidence.documents, frontier))
    found.append(id_edges(evidence.documents, frontier).where(F.col("method").isin(methods)))
    if name in RULED:
        if stated:
            found.append(touching(shaped(as_edges(evidence.statements, types)), frontier))
        ends = evidence.rulings.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "verdict").where("src <> dst")
        final = ends.groupBy("src", "dst").agg(F.min("verdict").alias("verdict"))  # not_same before same
        same = final.where("verdict = 'same'").select("src", "dst", F.lit("same_as").alias("type"), F.lit("ruling").alias("method"), F.lit("J-ruling").alias("tier"))
        found.append(touching(same, frontier))
        refused = final.where("verdict = 'not_same'").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    united = reduce(DataFrame.unionByName, map(shaped, found)).dropDuplicates(["src", "dst", "type", "method"])
    if name in RULED:
        pair = (F.col("type") == "same_as") & (F.least("src", "dst") == F.col("a")) & (F.greatest("src", "dst") == F.col("b"))
        united = united.join(refused, pair, "left_anti")
    return united


def ends_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def described(evidence: Evidence, ids: DataFrame) -> DataFrame:
    """(id, kind, label, last_seen) of ``ids`` (node): from the nodes, the documents, or the id itself."""
    named = evidence.nodes.select("id", F.lit(True).alias("_named"), F.col("kind").alias("_kind"), F.col("label").alias("_label"), F.col("last_seen").alias("_seen"))
    papers = evidence.documents.select("id", F.lit(True).alias("_paper"), F.col("title").alias("_title"), F.col("last_seen").alias("_read"))
    joined = ids.withColumnRenamed("node", "id").join(named, "id", "left").join(papers, "id", "left")
    label = F.coalesce(F.when(F.col("_named"), F.col("_label")).otherwise(F.col("_title")), self_label(F.col("id")))
    return joined.select("id", F.coalesce("_kind", node_kind(F.col("id"))).alias("kind"), label.alias("label"), F.when(F.col("_paper"), F.col("_read")).otherwise(F.col("_seen")).alias("last_seen"))


def bounded(evidence: Evidence, edges: DataFrame, anchors: DataFrame, most: int) -> Subgraph:
    """The subgraph of the ``most`` nodes that were seen last, then touch most edges, then come first by id; anchors stay."""
    degree = edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    nodes = described(evidence, ends_of(edges).unionByName(anchors).distinct())
    ranked = nodes.join(degree.withColumnRenamed("node", "id"), "id", "left").join(anchors.select(F.col("node").alias("id"), F.lit(True).alias("_anchor")), "id", "left")
    order = [F.coalesce("_anchor", F.lit(False)).desc(), F.desc_nulls_last("last_seen"), F.desc_nulls_last("degree"), F.asc("id")]
    top = ranked.orderBy(*order).limit(most + 1)
    numbered = top.select("*", F.row_number().over(Window.orderBy(*order)).alias("_nth"), F.count("*").over(Window.partitionBy()).alias("_n"))  # most + 1 rows
    kept = materialise(numbered.where(F.col("_nth") <= most).select("id", "kind", "label", (F.col("_n") > most).alias("capped")), "kept-nodes")
    for end in ("src", "dst"):
        edges = edges.join(kept.select(F.col("id").alias(end)), end, "left_semi").select(*edges.columns)
    return Subgraph(kept, edges)


def node_table(spark: SparkSession, ids: list[str]) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "node string")


def neighborhood(evidence: Evidence, anchor: str, depth: int = 1, types: list[str] | None = None, policy: str = "conservative", most: int = 40) -> Subgraph:
    """What lies within ``depth`` hops (2 at most) of the anchor, cut to ``most`` nodes."""
    anchors = node_table(evidence.nodes.sparkSession, [anchor])
    reached, frontier, found = anchors, anchors, []
    for _ in range(max(0, min(depth, 2))):
        found.append(materialise(hop(evidence, frontier, policy, types), "hop"))
        frontier = materialise(ends_of(found[-1]).join(reached, "node", "left_anti"), "frontier")
        reached = reached.unionByName(frontier)
    if not found:
        return bounded(evidence, shaped(evidence.edges.limit(0)), anchors, max(1, most))
    edges = reduce(DataFrame.unionByName, found).dropDuplicates(["src", "dst", "type", "method"])
    return bounded(evidence, edges, anchors, max(1, most))


def since(evidence: Evidence, anchor: str, cutoff: str, types: list[str] | None = None, most: int = 40) -> Subgraph:
    """Stored edges and statements at the anchor from ``cutoff`` on; identities don't collapse, and derived ones have no time.

    The edges have ``added``: when they were first seen or stated.  A cutoff that is no date is an error.
    """
    spark = evidence.nodes.sparkSession
    start = spark.range(1).select(instant(F.lit(cutoff.strip())).alias("t")).first()["t"]
    if start is None:
        raise ValueError("cutoff must be YYYY-MM-DD or an ISO stamp")
    anchors = node_table(spark, [anchor])
    stored = evidence.edges if not types else evidence.edges.where(F.col("type").isin(types))
    seen = shaped(stored, F.col("first_seen").cast("timestamp").alias("added"))
    said = shaped(as_edges(evidence.statements, types), instant(F.col("stated_at")).alias("added"))
    edges = materialise(touching(seen.unionByName(said).where(F.col("added") >= F.lit(start)), anchors), "since")
    return bounded(evidence, edges, anchors, max(1, most))


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b) of every edge in either direction, loops left out."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct().toDF("a", "b")


def between(evidence: Evidence, a: str, b: str, types: list[str] | None = None, policy: str = "conservative", most_nodes: int = 40, most: int = 8) -> DataFrame:
    """(nth, path, edges, capped): the ``most`` shortest simple paths of at most four edges, in order of length and nodes.

    Paths of four edges meet in the middle.  The first ``most`` + 1 of them use, for a middle node, only its least
    neighbours on either side, ``most`` + 1 and two that the path may already hold; so a hub gives no more than that many
    pairs, and no path that counts is lost.  A path that would bring the nodes over ``most_nodes`` ends the list.
    """
    if not a.strip() or not b.strip() or a == b:
        raise ValueError("between takes two different nodes")
    spark = evidence.nodes.sparkSession

    found = []
    for start in (a, b):
        found.append(materialise(hop(evidence, node_table(spark, [start]), policy, types), "ring"))
        found.append(materialise(hop(evidence, ends_of(found[-1]).where(F.col("node") != start), policy, types), "ring"))
    ways = materialise(both_ways(reduce(DataFrame.unionByName, found)), "ways")

    def reached(start: str) -> tuple[DataFrame, DataFrame]:
        """(next): the start's neighbours; (next, far): where they lead."""
        first = ways.where(F.col("a") == start).select(F.col("b").alias("next"))
        return first, ways.toDF("next", "far").join(first, "next", "left_semi").where(F.col("far") != start)

    (near_a, far_a), (near_b, far_b) = reached(a), reached(b)
    least = Window.partitionBy("far").orderBy("next")
    few = lambda far, other: far.where((F.col("next") != other) & (F.col("far") != other)).withColumn("_nth", F.row_number().over(least)).where(F.col("_nth") <= most + 3).drop("_nth")
    path = lambda *nodes: F.array(*nodes).alias("path")
    one, other = F.lit(a), F.lit(b)
    meeting = few(far_a, b).join(few(far_b, a).withColumnRenamed("next", "last"), "far").where("next <> last")
    paths = [
        near_a.where(F.col("next") == b).select(path(one, other)),
        near_a.join(near_b, "next").where(~F.col("next").isin(a, b)).select(path(one, "next", other)),
        far_a.where((F.col("next") != b) & (F.col("far") != b)).join(near_b.select(F.col("next").alias("far")), "far", "left_semi").select(path(one, "next", "far", other)),
        meeting.select(path(one, "next", "far", "last", other)),
    ]
    shortest = reduce(DataFrame.unionByName, paths).select(F.size("path").alias("n"), "path").orderBy("n", "path").limit(most + 1)
    rows = F.array_sort(F.collect_list(F.struct("n", "path")))  # most + 1 of them
    start = F.struct(F.array().cast("array<array<string>>").alias("kept"), F.array().cast("array<string>").alias("seen"), F.lit(False).alias("full"))

    def take(state: Column, row: Column) -> Column:
        seen = F.array_union(state["seen"], row["path"])
        full = state["full"] | ((F.size(seen) > most_nodes) & (F.size(state["kept"]) > 0))
        return F.struct(F.when(full, state["kept"]).otherwise(F.array_append(state["kept"], row["path"])).alias("kept"), F.when(full, state["seen"]).otherwise(seen).alias("seen"), full.alias("full"))

    folded = shortest.agg(rows.alias("rows")).select(F.size("rows").alias("n"), F.aggregate(F.slice("rows", 1, most), start, take).alias("s"))
    return folded.select(F.posexplode("s.kept").alias("nth", "path"), ((F.col("n") > most) | F.col("s.full")).alias("capped")).select((F.col("nth") + 1).alias("nth"), "path", (F.size("path") - 1).alias("edges"), "capped")


def path_edges(evidence: Evidence, paths: DataFrame, policy: str = "conservative", types: list[str] | None = None) -> DataFrame:
    """For each step of ``paths``, the edge that it takes, in the direction in which it was stated; the first of several."""
    steps = paths.select(F.explode(F.expr("transform(sequence(1, size(path) - 1), i -> struct(least(path[i - 1], path[i]) AS lo, greatest(path[i - 1], path[i]) AS hi))")).alias("s")).select("s.lo", "s.hi").distinct()
    edges = hop(evidence, steps.select(F.explode(F.array("lo", "hi")).alias("node")).distinct(), policy, types)
    keyed = edges.withColumns({"lo": F.least("src", "dst"), "hi": F.greatest("src", "dst")}).join(steps, ["lo", "hi"], "left_semi")
    first = keyed.groupBy("lo", "hi").agg(F.min(F.struct("method", "type", "src", "dst", "tier", "note", "doc")).alias("e"))
    return first.select(*(f"e.{c}" for c in EDGE))


def voices(evidence: Evidence, ids: list[str], policy: str = "conservative") -> DataFrame:
    """(voice, verdict, docs, works, persons, speaker_known): which of the given documents speak with one voice.

    Documents that share a work, a title, a ruling or an author are one voice.  A document without any evidence is
    ``unresolved``, never a voice; an id that is no document is ``skipped``.  Statements are no evidence of identity, and a
    ruling counts between given documents alone.  More than ``MOST_VOICES`` ids are an error, not cut.
    """
    if len(ids) > MOST_VOICES:
        raise ValueError(f"voices takes at most {MOST_VOICES} ids; split the set")
    spark = evidence.nodes.sparkSession
    docs = node_table(spark, sorted({i for i in ids if i.startswith("doc:")}))
    same = hop(evidence, docs, policy, ["same_as"], stated=False)
    inside = same.join(docs.withColumnRenamed("node", "src"), "src", "left_semi").join(docs.withColumnRenamed("node", "dst"), "dst", "left_semi").where("method = 'ruling'").select("src", "dst")
    same = materialise(same.where("method <> 'ruling'").select("src", "dst").unionByName(inside), "same")
    works = ends_of(same).where(F.startswith("node", F.lit("work:")))
    authored = touching(evidence.edges.where("type = 'authored'").select("src", "dst"), works)
    links = materialise(same.unionByName(authored).distinct(), "links")
    nodes = materialise(ends_of(links).unionByName(docs).distinct().withColumn("n", F.monotonically_increasing_id()), "voice-nodes")
    number = lambda end: nodes.select(F.col("node").alias(end), F.col("n").alias(f"{end}_n"))
    numbered = links.join(number("src"), "src").join(number("dst"), "dst").select(F.col("src_n").alias("src"), F.col("dst_n").alias("dst"))
    roots = connected_components(numbered).withColumnRenamed("node", "n")
    placed = nodes.join(roots, "n", "left").withColumn("component", F.coalesce("component", "n")).join(docs.withColumn("given", F.lit(True)), "node", "left")
    of = lambda what: F.array_sort(F.collect_set(F.when(what, F.col("node"))))
    groups = placed.groupBy("component").agg(of(F.col("given")).alias("docs"), of(F.startswith("node", F.lit("work:"))).alias("works"), of(F.startswith("node", F.lit("person:"))).alias("persons")).where(F.size("docs") > 0)
    verdict = F.when((F.size("works") > 0) | (F.size("docs") > 1), "voice").otherwise("unresolved")
    found = groups.select(F.col("docs")[0].alias("voice"), verdict.alias("verdict"), "docs", "works", "persons", (F.size("persons") > 0).alias("speaker_known"))
    none = F.array().cast("array<string>")
    skipped = node_table(spark, [i for i in ids if not i.startswith("doc:")]).select(F.col("node").alias("voice"), F.lit("skipped").alias("verdict"), none.alias("docs"), none.alias("works"), none.alias("persons"), F.lit(False).alias("speaker_known"))
    return found.unionByName(skipped)
