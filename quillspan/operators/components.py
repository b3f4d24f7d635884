"""Connected components of an undirected graph given as an edge table.

Each partition first replaces its edges by a spanning forest of stars.  Then large-star and small-star rounds
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014) join edges with the least neighbour of each
node until nothing changes, a number of rounds that grows with the logarithm of the graph's size.  A round
aggregates before it shuffles; the result is written, so that the join has plain inputs and a node with very many
neighbours is split as a skewed one.  Each round's edges are written to the shared folder.  A forest that one task's memory surely holds, at most
``ONE_TASK`` rows, is finished there instead.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.storage import materialise

ONE_TASK = 100_000


class UnionFind:
    """Disjoint sets whose root is the least member."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            x, parent[x] = parent.get(x, x), root
        return root

    def union(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def stars(self) -> Iterable[tuple]:
        """(node, root) of every node that isn't its set's root."""
        for x in list(self.parent):
            if (root := self.find(x)) != x:
                yield x, root


def _contract(batches: Iterator) -> Iterator:
    import pyarrow as pa

    sets = UnionFind()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sets.union(a, b)
    stars = list(sets.stars())
    for k in range(0, len(stars), 50_000):
        part = stars[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([r for _, r in part], pa.int64())], ["u", "v"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = materialise(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge to another node; ``edges`` are (src, dst) longs.

    ``component`` is the least node of the component.  Edges with a null end and loops are left out.
    """
    pairs = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    state = materialise(pairs.mapInArrow(_contract, "u long, v long").distinct(), "components")
    small, seen = state.count() <= ONE_TASK, None
    if small:
        state = materialise(state.coalesce(1).mapInArrow(_contract, "u long, v long"), "components")
    while not small:
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).collect()[0]
        if mark[0] == 0 or mark == seen:
            break
        seen = mark
        state = materialise(_small_star(_large_star(state)), "components")
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
