"""A typed evidence graph: edges (src, dst, type, tier, method, first_seen) and bounded queries over it.

Every hop joins the frontier with the edges by two plain equalities, one for each end, so neither becomes a nested
loop and a node with very many edges is split as a skewed join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators.components import connected_components

SYMMETRIC = ["same_as", "not_same_as", "coauthored", "conflicts"]
# The methods by which each policy accepts an identity edge, and the policies that heed rulings.
BY_ID = ["id_eq:doi", "id_eq:arxiv", "id_eq:openalex", "id_eq:orcid"]
POLICIES = {"conservative": BY_ID, "working": [*BY_ID, "ruling"], "exploratory": [*BY_ID, "ruling", "align:title_fp", "align:name_match"]}
RULED = ["working", "exploratory"]


def node_kind(node: Column) -> Column:
    """A node's kind from its id's prefix."""
    prefix = F.split(node, ":")[0]
    return F.when(~F.contains(node, F.lit(":")), "unknown").when(prefix == "doc", "document").when(prefix == "inst", "institution").when(prefix == "inv", "investigation").otherwise(prefix)


def normal_edges(edges: DataFrame) -> DataFrame:
    """Edges of tier M or A, undirected types with the lesser end first, one row for each (src, dst, type, method).

    The first sight of an edge never changes and its last one moves on.
    """
    turned = F.col("type").isin(SYMMETRIC) & (F.col("src") > F.col("dst"))
    ends = edges.where(F.col("tier").isin("M", "A")).withColumns({"src": F.when(turned, F.col("dst")).otherwise(F.col("src")), "dst": F.when(turned, F.col("src")).otherwise(F.col("dst"))})
    return ends.groupBy("src", "dst", "type", "method").agg(F.min("tier").alias("tier"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(facet, name, n): nodes by kind, edges by type and by tier."""
    kinds = nodes.groupBy("kind").count().select(F.lit("kind").alias("facet"), F.col("kind").alias("name"), F.col("count").alias("n"))
    both = edges.groupingSets([["type"], ["tier"]], "type", "tier").agg(F.count("*").alias("n"))
    return kinds.unionByName(both.select(F.when(F.col("type").isNotNull(), "type").otherwise("tier").alias("facet"), F.coalesce("type", "tier").alias("name"), "n"))


def accepted(edges: DataFrame, policy: str, rulings: DataFrame | None = None) -> DataFrame:
    """``edges`` under a policy: facts pass, identities by its methods; an unknown policy is the conservative one.

    Rulings (a, b, verdict) overrule in the policies of ``RULED`` and refusals win; the conservative one knows none.
    """
    name = policy.strip().lower()
    kept = edges.where((F.col("type") != "same_as") | F.col("method").isin(POLICIES.get(name, BY_ID)))
    if rulings is None or name not in RULED:
        return kept
    ends = rulings.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "verdict")
    final = ends.groupBy("a", "b").agg(F.min("verdict").alias("verdict"))  # not_same before same
    refused = final.where("verdict = 'not_same'")
    same = (F.col("type") == "same_as") & (F.least("src", "dst") == F.col("a")) & (F.greatest("src", "dst") == F.col("b"))
    kept = kept.join(refused, same, "left_anti")
    ruled = final.where("verdict = 'same'").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("same_as").alias("type"), F.lit("ruling").alias("method"))
    return kept.select("src", "dst", "type", "method").unionByName(ruled)


def step(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, via): the distinct neighbours of a frontier (node) on either end."""
    ahead = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"))
    back = frontier.join(edges, F.col("node") == F.col("dst")).select(F.col("src").alias("node"))
    return ahead.unionByName(back).distinct()


def neighborhood(edges: DataFrame, anchors: DataFrame, depth: int = 1) -> DataFrame:
    """(node, hops) within ``depth`` (2 at most) of the anchors (node)."""
    reached = anchors.select("node", F.lit(0).alias("hops"))
    frontier = anchors.select("node")
    for hop in range(1, min(depth, 2) + 1):
        frontier = step(frontier, edges).join(reached, "node", "left_anti")
        reached = reached.unionByName(frontier.withColumn("hops", F.lit(hop)))
    return reached


def between(edges: DataFrame, a: str, b: str, most: int = 8) -> DataFrame:
    """The ``most`` shortest simple paths of at most four edges, ties in the order of their nodes.

    Two steps from each side meet in the middle.
    """
    spark = edges.sparkSession
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()

    def walks(start: str) -> DataFrame:
        found = spark.createDataFrame([(start, [start])], "node string, path array<string>")
        out = found
        for _ in range(2):
            found = found.join(both, F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"))
            out = out.unionByName(found)
        return out

    left, right = walks(a), walks(b).withColumnRenamed("path", "back")
    met = left.join(right, "node").select(F.concat("path", F.slice(F.reverse("back"), 2, 4)).alias("path"))
    simple = met.where((F.size("path") == F.size(F.array_distinct("path"))) & (F.size("path") >= 2)).distinct()
    order = [F.size("path"), F.array_join("path", "|")]
    return simple.orderBy(*order).limit(most).select((F.size("path") - 1).alias("edges"), F.array_join("path", "|").alias("path"))


def since(edges: DataFrame, anchor: str, cutoff: Column) -> DataFrame:
    return edges.where(((F.col("src") == anchor) | (F.col("dst") == anchor)) & (F.col("first_seen") >= cutoff)).orderBy(F.desc("first_seen"), "src", "dst", "type")


def find(nodes: DataFrame, label: str, kind: str = "", limit: int = 20) -> DataFrame:
    """Nodes whose label holds every word, with ``capped`` where more exist."""
    found = nodes
    for word in label.lower().split():
        found = found.where(F.contains(F.lower("label"), F.lit(word)))
    if kind:
        found = found.where(F.col("kind") == kind)
    top = found.orderBy("id").limit(limit + 1)
    ranked = top.select("*", F.row_number().over(Window.orderBy("id")).alias("_nth"), F.count("*").over(Window.partitionBy()).alias("_n"))
    return ranked.where(F.col("_nth") <= limit).withColumn("capped", F.col("_n") > limit).drop("_nth", "_n")


def voices(edges: DataFrame, policy: str = "conservative", rulings: DataFrame | None = None) -> DataFrame:
    """(voice, documents, works, verdict): components over identities; a voice holds a work or two documents at least.

    ``edges`` join documents, works and persons by strings; nodes get numbers by their order for the components.
    """
    kept = accepted(edges, policy, rulings)
    hashed = kept.select(F.xxhash64("src").alias("src"), F.xxhash64("dst").alias("dst"))
    nodes = kept.select(F.col("src").alias("id")).unionByName(kept.select(F.col("dst").alias("id"))).distinct().withColumn("node", F.xxhash64("id"))
    roots = connected_components(hashed)
    joined = nodes.join(roots, "node", "left").withColumn("component", F.coalesce("component", "node"))
    counted = joined.groupBy("component").agg(F.min("id").alias("voice"), F.count_if(F.startswith("id", F.lit("doc:"))).alias("documents"), F.count_if(F.startswith("id", F.lit("work:"))).alias("works"))
    return counted.select("voice", "documents", "works", F.when((F.col("works") >= 1) | (F.col("documents") >= 2), "voice").otherwise("unresolved").alias("verdict"))
