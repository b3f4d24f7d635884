"""Exact top-k inner-product search with a KD-tree for each shard.

Vectors are dealt to shards by a hash of their id.  A shard's tree splits at the median of its widest dimension
down to leaves, and every node keeps the tight box of its vectors.  A query enters nodes in order of the
greatest inner product that their boxes allow; it ends where no box can beat its k-th best score so far.  A task
takes a block of queries through several shards, and the k-th scores found in one bound the search of the next.

Components are turned into whole numbers first, and products are exact: in double precision below 2 ** 53, else in
64-bit whole numbers.

Defined results: vectors that are null or hold null or non-finite components, and rows without an id, take no part;
repeated rows count each time, as candidates and as queries; a query's own id is not among its results; vectors of another length than a query's are no
candidates; ties go to smaller ids; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

SHARD_ROWS, LEAF_ROWS, QUERY_ROWS = 8192, 256, 1024
#: Shards that one task takes a block of queries through.
SHARDS_A_TASK = 4


def whole_vector(vector: Column) -> Column:
    """floor(256 x) of every component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long"))


def is_sound(vector: Column) -> Column:
    """Not null, and neither null nor non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


class Tree:
    """Median splits with tight boxes; children of node i are 2 i + 1 and 2 i + 2 where it is no leaf."""

    def __init__(self, ids, vectors, leaf_rows: int = LEAF_ROWS):
        import numpy as np

        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.low, self.high, self.least, self.leaves = {}, {}, {}, {}
        stack = [(0, np.arange(len(ids)))]
        while stack:
            node, rows = stack.pop()
            part = self.vectors[rows]
            low, high = part.min(axis=0), part.max(axis=0)
            self.low[node], self.high[node], self.least[node] = low, high, int(self.ids[rows[0]])
            width = high - low
            if len(rows) <= leaf_rows or not width.size or not width.max():
                self.leaves[node] = rows  # ascending ids
                continue
            at = int(width.argmax())
            split = np.argpartition(part[:, at], len(rows) // 2)
            halves = np.sort(split[: len(rows) // 2]), np.sort(split[len(rows) // 2 :])
            stack += (2 * node + 1, rows[halves[0]]), (2 * node + 2, rows[halves[1]])

    def bounds(self, queries):
        """{node: greatest product that its box allows, by query}."""
        import numpy as np

        nodes = list(self.low)
        low, high = np.stack([self.low[n] for n in nodes]), np.stack([self.high[n] for n in nodes])
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        return dict(zip(nodes, (high @ up.T + low @ down.T).tolist()))

    def search(self, query_ids, queries, best: list[list[tuple[int, int]]], k: int) -> None:
        """Improve ``best``, each query's up to k (score, -id) as a heap with the worst first."""
        bounds = self.bounds(queries)
        for q, (own, query, top) in enumerate(zip(query_ids.tolist(), queries, best)):
            heap = [(-bounds[0][q], 0)]
            while heap:
                bound, node = heapq.heappop(heap)
                if len(top) == k and -bound < top[0][0]:
                    break
                if len(top) == k and (-bound, -self.least[node]) <= top[0]:
                    continue
                if node not in self.leaves:
                    for child in (2 * node + 1, 2 * node + 2):
                        heapq.heappush(heap, (-bounds[child][q], child))
                    continue
                self._leaf(self.leaves[node], own, query, top, k)

    def _leaf(self, rows, own: int, query, top: list, k: int) -> None:
        import numpy as np

        scores = self.vectors[rows] @ query
        if len(top) == k:
            near = np.flatnonzero(scores >= top[0][0])
        elif len(rows) > k + 1:
            near = np.flatnonzero(scores >= np.partition(scores, -k - 1)[-k - 1])
        else:
            near = np.arange(len(rows))
        if len(near) > k + 1:  # the query's own row may be among them
            near = near[np.argsort(-scores[near], kind="stable")[: k + 1]]
        for i in near.tolist():
            found = (int(scores[i]), -int(self.ids[rows[i]]))
            if -found[1] == own:
                continue
            if len(top) < k:
                heapq.heappush(top, found)
            elif found > top[0]:
                heapq.heapreplace(top, found)


def _blocks(rows: DataFrame, group: str, kind: str) -> DataFrame:
    """(group, dim, ids, vectors): the rows of each group as two arrays of bytes."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held: dict = {}
        for batch in batches:
            lists, groups = batch.column("vector"), batch.column(group).to_numpy()
            dims, ids = batch.column("dim").to_numpy(), batch.column("vec_id").to_numpy()
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for dim in np.unique(dims).tolist():
                of_dim = np.flatnonzero(dims == dim)
                for g in np.unique(groups[of_dim]).tolist():
                    at = of_dim[groups[of_dim] == g]
                    held.setdefault((g, dim), []).append((ids[at], values[offsets[at][:, None] + np.arange(dim)]))
        for (g, dim), found in held.items():
            ids, vectors = np.concatenate([i for i, _ in found]), np.concatenate([v for _, v in found])
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([dim], pa.int32()), pa.array([ids.astype("<i8").tobytes()]), pa.array([vectors.astype("<i8").tobytes()])], [group, "dim", f"{kind}_ids", f"{kind}_vectors"])

    return rows.repartition(group).mapInArrow(run, f"{group} long, dim int, {kind}_ids binary, {kind}_vectors binary")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score); both inputs are (vec_id, vector) with whole-number components."""
    sized = [d.select("vec_id", "vector", F.size("vector").alias("dim")).where("vec_id IS NOT NULL") for d in (vectors, queries)]
    rows, asked = (materialise(d, what) for d, what in zip(sized, ("candidates", "queries")))
    shards, blocks = (max(1, -(-d.count() // n)) for d, n in ((rows, SHARD_ROWS), (asked, QUERY_ROWS)))
    dealt = lambda n, what: F.pmod(F.xxhash64(F.col("vec_id"), F.lit(what)), F.lit(n)).cast("long")
    trees = materialise(_blocks(rows.withColumn("shard", dealt(shards, "shard")), "shard", "row"), "shards")
    asking = materialise(_blocks(asked.withColumn("block", dealt(blocks, "block")), "block", "query"), "query-blocks")
    met = trees.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(asking, ["block", "dim"])
    met = met.withColumn("turn", F.floor(F.col("shard") / SHARDS_A_TASK))
    tasks = blocks * -(-shards // SHARDS_A_TASK)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def results(ids, best):
            out = [(q, -i, s) for q, top in zip(ids.tolist(), best) for s, i in top]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 3)], ["query_id", "vec_id", "score"])

        now = query_ids = best = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                group = row["block"], row["turn"], row["dim"]
                ids, found = (np.frombuffer(row[f"{kind}_ids"], "<i8") for kind in ("query", "row"))
                q, v = (np.frombuffer(row[f"{kind}_vectors"], "<i8").reshape(len(x), row["dim"]) for kind, x in (("query", ids), ("row", found)))
                if float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, row["dim"]) < 1 << 53:
                    q, v = q.astype(np.float64), v.astype(np.float64)
                if group != now:
                    if now:
                        yield results(query_ids, best)
                    now, query_ids, best = group, ids, [[] for _ in ids]
                Tree(found, v).search(ids, q, best, k)
        if now:
            yield results(query_ids, best)

    placed = met.repartition(min(tasks, 20_000), "block", "turn").sortWithinPartitions("block", "turn", "dim")
    found = placed.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    sound = table(spark, sf_dir, "embeddings").where(is_sound(F.col("embedding")))
    vectors = sound.select("vec_id", whole_vector(F.col("embedding")).alias("vector"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


SQL = """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM sound q JOIN sound c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
