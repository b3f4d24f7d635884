"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with a cosine of at least c lie within epsilon = sqrt(2 - 2 c) of one another.  Vectors are rotated to
principal dimensions, which are dealt to up to ``GROUPS`` groups.  Of a linked pair, the squared distance in some group is at
most that group's share of epsilon squared, so each group is joined by itself, with its own small radius.

A group's leading dimensions carry a grid whose cells are at least twice as wide as the radius.  Vectors are put in the
lexicographic order of their cells; intervals of that order, those of equal leading cells, are the tasks.  A task holds
the vectors of its interval and meets each vector of the table with the cells near it, found dimension by dimension: the squared
distances to the borders crossed add up, and what exceeds half the group's share is skipped.  Half is enough, as of two
vectors on two sides of some borders one is that near to them.  What remains is compared by matrix products in the
group's dimensions, and pairs found there by their whole vectors in double precision.

Every task reads the one table of blocks from the shared folder, so vectors are shuffled once, when equal ones are brought
together, and disk grows in proportion to the input.  The time of reading grows with the number of intervals.

A pair may be found in several groups, and from either side.  It counts where its distance has the least part of the
group's share, from the side that is nearer to the borders.  These are functions of the two vectors alone: coordinates
are sums of whole numbers that double precision holds exactly, in whatever order a product adds them.

Equal vectors are one class with a count, so a very common vector costs what one does.  A task adds up the links of
each class and gives a spanning forest of them; no list of all pairs is made.  Links between classes make components.

The rotation, the cuts of the grid and the sizes of intervals come from a random sample of about ``SAMPLE`` classes; any of
them gives the same result.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, and
so do vectors of different lengths; equal rows count as several vectors; rows without an id have a null
``component_id`` unless they reach one with an id, and are kept only in place of none; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from quillspan.operators.components import connected_components

from .common import discard, materialise, table
from .topk import is_sound
from .workers import begin, give_back

SAMPLE = 4096
#: Principal dimensions that are used, groups of them, and the rows up to which one group does.
DIMS, GROUPS, ONE_GROUP = 128, 4, 1 << 14
#: Most classes of a stored row, of at most ROW_BYTES; classes in a cell, about; bytes of an interval's vectors, about.
BLOCK_ROWS, ROW_BYTES, SMALL_ROWS, INTERVAL_BYTES = 16, 1 << 14, 160, 40 << 20
#: Bits of a coordinate; products of two and their sums stay whole below 2 ** 53.
BITS = 25
SLACK = 1e-5
#: Queries that wait for one another, their visits to cells at once, and pairs that are looked at together.
WAITING, VISITS, PAIRS = 1 << 14, 1 << 18, 1 << 16


def digests(vector: Column, salt: int) -> list[Column]:
    """128 bits that stand for a vector as a key; ``classes_of`` makes sure that no two classes share them."""
    return [F.xxhash64(F.lit(salt), vector), F.xxhash64(vector, F.lit(-1 - salt))]


def with_digests(rows: DataFrame, salt: int) -> DataFrame:
    return rows.withColumns({f"h{i}": h for i, h in enumerate(digests(F.col("embedding"), salt))})


def packed(classes: DataFrame) -> DataFrame:
    """(block, dim, vectors, h0, h1, n, first): classes of one length in rows of up to ``BLOCK_ROWS``; a class is block * BLOCK_ROWS + its place."""
    most, size, carried = BLOCK_ROWS, ROW_BYTES, ["h0", "h1", "n", "first"]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            lists = batch.column("embedding")
            dims, starts, values = pc.list_value_length(lists).to_numpy(), lists.offsets.to_numpy()[:-1], lists.values.to_numpy()
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                vectors = values[starts[rows][:, None] + np.arange(dim)]
                step = max(1, min(most, size // (dim * vectors.itemsize)))
                cuts = np.append(np.arange(0, len(rows), step), len(rows)).astype(np.int32)
                blobs = pa.array([vectors[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])], pa.binary())
                lists_of = [pa.ListArray.from_arrays(pa.array(cuts), batch.column(c).take(pa.array(rows))) for c in carried]
                ids = pa.array(np.arange(block, block + len(blobs)), pa.int64())
                block += len(blobs)
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(blobs), dim, np.int32)), blobs, *lists_of], ["block", "dim", "vectors", *carried])

    kinds = ", ".join(f"{c} array<{classes.schema[c].dataType.simpleString()}>" for c in carried)
    return classes.mapInArrow(run, f"block long, dim int, vectors binary, {kinds}")


def classes_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks of the distinct vectors, the rows with digests that tell these apart)."""
    salt = 0
    while True:
        keyed = with_digests(rows, salt)
        blocks = materialise(packed(keyed.groupBy("h0", "h1", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))), "blocks")
        keys = blocks.select(F.explode(F.arrays_zip("h0", "h1")).alias("h")).select("h.*")
        if not keys.groupBy("h0", "h1").count().where("count > 1").head(1):
            return blocks, keyed
        discard(blocks)
        salt += 1


def sampled(blocks: DataFrame, share: float, kind: str) -> dict:
    """{dimension: about that share of its vectors}"""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rng, found = np.random.default_rng(batch.column("block")[0].as_py()), ([], [])
            for dim, blob in zip(batch.column("dim").to_pylist(), batch.column("vectors").to_pylist()):
                x = np.frombuffer(blob, kind).reshape(-1, dim)
                for v in x[rng.random(len(x)) < share]:
                    found[0].append(dim)
                    found[1].append(v.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int32()), pa.array(found[1], pa.binary())], ["dim", "vector"])

    import numpy as np

    out: dict = {}
    for dim, blob in blocks.select("block", "dim", "vectors").mapInArrow(run, "dim int, vector binary").collect():
        out.setdefault(dim, []).append(np.frombuffer(blob, kind))
    return {dim: np.stack(found) for dim, found in out.items()}


def scaled(vectors):
    """Vectors in double precision, scaled by powers of two so that no square overflows or vanishes, and their norms; directions are exact."""
    import numpy as np

    x = vectors.astype(np.float64)
    if vectors.dtype.itemsize > 4:  # squares of single precision fit
        x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x, np.sqrt((x * x).sum(axis=1))


def rough(vectors):
    """Vectors and norms in single precision, of about the same directions."""
    import numpy as np

    if vectors.dtype.itemsize > 4:
        x, norms = scaled(vectors)
        return (x / norms[:, None]).astype(np.float32), np.ones(len(x), np.float32)
    with np.errstate(over="ignore"):
        norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    odd = np.flatnonzero(~((norms > 1e-15) & (norms < 1e15)))
    if len(odd):
        x, exact = scaled(vectors[odd])
        vectors = vectors.copy()
        vectors[odd], norms[odd] = x / exact[:, None], 1
    return vectors, norms


class Grid:
    """The groups of the principal dimensions of vectors of one length, and a grid in each."""

    def __init__(self, dim: int, count: int, sample, least: float, cells: float, groups: int):
        import numpy as np

        self.dim, self.least = dim, least
        epsilon = (max(0.0, 2 - 2 * least)) ** 0.5 + SLACK
        spread, base = np.zeros(dim), np.eye(dim)
        if len(sample):
            x, norms = scaled(sample)
            x /= norms[:, None]
            spread, base = np.linalg.eigh(x.T @ x / len(x) - np.outer(x.mean(0), x.mean(0)))
            spread, base = np.maximum(spread[::-1], 0), base[:, ::-1]
        spread, base = spread[:DIMS], base[:, :DIMS]
        effective = spread.sum() ** 2 / max((spread**2).sum(), 1e-300)
        n = int(np.clip(round(effective / 16), 1, groups)) if count > ONE_GROUP else 1
        turns = np.arange(len(spread)) % (2 * n)
        dealt = [np.flatnonzero(np.minimum(turns, 2 * n - 1 - turns) == g) for g in range(n)]
        self.rotation = np.rint(base[:, np.concatenate(dealt)] * 2.0**BITS)
        ends = np.cumsum([0, *map(len, dealt)]).tolist()
        self.columns = list(zip(ends[:-1], ends[1:]))
        self.single = [(self.rotation[:, a:b] * 2.0**-BITS).astype(np.float32) for a, b in self.columns]
        #: What single precision may lose in a coordinate.
        self.tolerance = 1e-6 + 2e-8 * dim
        shares = np.array([spread[d].sum() for d in dealt])
        shares = shares / shares.sum() if shares.min() > 0 else np.full(n, 1 / n)
        self.budgets = (shares * epsilon**2).tolist()
        self.sample = self.coordinates(*scaled(sample)) if len(sample) else np.zeros((0, len(spread)))
        self.cuts = [self.cut(self.sample[:, a:b], budget**0.5, count / cells) for (a, b), budget in zip(self.columns, self.budgets)]

    @staticmethod
    def cut(y, radius: float, cells: float) -> list:
        """The cuts of the leading dimensions, those that make ``cells`` cells; as many in each as leave cells two radii wide."""
        import numpy as np

        out, made = [], 1
        for x in y.T:
            if made >= min(cells, 1 << 22) or len(x) < 2 or x.std() < 0.3 * radius:
                break
            for n in range(16, 1, -1):
                cuts = np.quantile(x, np.arange(1, n) / n)
                if n == 2 or np.diff(cuts).min() >= 2 * radius:
                    break
            out.append(cuts)
            made *= n
        return out

    def coordinates(self, x, norms, group: int | None = None):
        """Principal coordinates, of one group or all, the same for a vector whatever rows stand beside it."""
        import numpy as np

        a, b = self.columns[group] if group is not None else (0, self.rotation.shape[1])
        x = x * (2.0**BITS / norms)[:, None]
        return (np.rint(x, out=x) @ self.rotation[:, a:b]) * 2.0 ** (-2 * BITS)

    def about(self, vectors, norms, group: int):
        """Coordinates of one group in single precision."""
        return (vectors @ self.single[group]) / norms[:, None]

    def place(self, group: int, y, first: int = 0, last: int | None = None):
        """(cell, squared distance to its lower border, to its upper one) of each vector, by dimension of the grid; with one cut, both are the distance to that."""
        import numpy as np

        cuts = self.cuts[group][first:last]
        cells, down, up = np.empty((len(cuts), len(y)), np.int32), np.empty((len(cuts), len(y)), y.dtype), np.empty((len(cuts), len(y)), y.dtype)
        for j, c in enumerate(cuts):
            x = y[:, first + j]
            if len(c) == 1:
                cells[j] = x >= c[0]
                down[j] = (x - c[0]) ** 2
                up[j] = down[j]
            else:
                borders = np.concatenate(([-np.inf], c, [np.inf]))
                cells[j] = np.searchsorted(c, x, "right")
                down[j], up[j] = (x - borders[cells[j]]) ** 2, (borders[cells[j] + 1] - x) ** 2
        return cells, down, up

    def intervals(self, count: int, width: int, least: int) -> list[tuple]:
        """(group, leading cells, part, parts, classes in it, about): intervals of every group's order, at least ``least`` in all if the grid has them."""
        import itertools

        out, most = [], max(1, INTERVAL_BYTES // (self.dim * width))
        for g, (a, b) in enumerate(self.columns):
            lead, made = 0, 1
            while lead < len(self.cuts[g]) and made < max(count / most, min(least / len(self.columns), count / 1024)):
                made *= len(self.cuts[g][lead]) + 1
                lead += 1
            cells = self.place(g, self.sample[:, a:b], 0, lead)[0]
            for prefix in itertools.product(*(range(len(c) + 1) for c in self.cuts[g][:lead])):
                held = count * (1 + int((cells.T == prefix).all(axis=1).sum())) / (1 + len(self.sample))
                parts = -(-int(held) // most) or 1
                out += ((g, prefix, i, parts, held / parts) for i in range(parts))
        return out


class Interval:
    """The vectors of an interval in grid order, which the vectors of the whole table meet."""

    def __init__(self, grid: Grid, group: int, prefix: tuple, part: int, parts: int):
        import numpy as np

        self.grid, self.group, self.prefix, self.part, self.parts = grid, group, prefix, part, parts
        budget, lost = grid.budgets[group], grid.tolerance
        #: More than half the share and the share, by what single precision may lose.
        self.half = ((budget / 2) ** 0.5 + 5 * lost) ** 2 + 1e-6
        self.limit = np.float32((budget**0.5 + 2 * grid.single[group].shape[1] ** 0.5 * lost) ** 2 + 4e-6)
        self.held: list = []
        self.ready, self.waiting, self.waits, self.step = False, [], 0, 1024
        self.pairs: list = []
        self.paired, self.enough = 0, 4 * PAIRS

    def hold(self, ids, weights, vectors, y) -> None:
        """Keep what lies in the interval; ``y`` are coordinates in single precision, the exact ones decide."""
        import numpy as np

        inside = ids // 7 % self.parts == self.part if self.parts > 1 else np.ones(len(ids), bool)
        for j, want in enumerate(self.prefix):
            borders = [-np.inf, *self.grid.cuts[self.group][j], np.inf]
            inside &= (y[:, j] >= borders[want] - self.grid.tolerance) & (y[:, j] <= borders[want + 1] + self.grid.tolerance)
        at = np.flatnonzero(inside)
        y = self.grid.coordinates(*scaled(vectors[at]), self.group)
        cells = self.grid.place(self.group, y)[0]
        inside = (cells[: len(self.prefix)] == np.array(self.prefix, np.int32)[:, None]).all(axis=0)
        if inside.any():
            at = at[inside]
            self.held.append((ids[at], weights[at], vectors[at], y[inside].astype(np.float32), cells[len(self.prefix) :, inside]))

    def order(self) -> None:
        import numpy as np

        self.ready, lead = True, len(self.prefix)
        sizes = [len(c) + 1 for c in self.grid.cuts[self.group]]
        self.strides = [int(np.prod(sizes[j + 1 :], dtype=np.int64)) for j in range(len(sizes))]
        if not self.held:
            return
        keys = np.concatenate([(h[4].T * np.array(self.strides[lead:], np.int64)).sum(axis=1) for h in self.held])
        order = np.argsort(keys, kind="stable")
        place, start = np.empty(len(order), np.int64), 0
        place[order] = np.arange(len(order))
        self.ids, self.weights, self.vectors, y = (np.empty((len(order), *x.shape[1:]), x.dtype) for x in self.held[0][:4])
        for k, found in enumerate(self.held):  # one by one, so that little stands twice in memory
            at = place[start : start + len(found[0])]
            self.ids[at], self.weights[at], self.vectors[at], y[at] = found[:4]
            self.held[k], start = True, start + len(at)
        found, first = np.unique(keys[order], return_index=True)
        self.rank = np.full(int(np.prod(sizes[lead:], dtype=np.int64)), -1, np.int32)
        self.rank[found] = np.arange(len(found))
        self.bounds = np.append(first, len(order)).tolist()
        self.points = np.concatenate((-2 * y, np.ones((len(y), 1), np.float32), (y * y).sum(axis=1, keepdims=True)), axis=1)
        self.links = np.zeros(len(self.ids), np.int64)

    def ask(self, ids, weights, vectors, y) -> Iterator:
        """Meet more vectors; gives (class, links) of those asked."""
        import numpy as np

        if not self.held:
            return
        lead, left = len(self.prefix), np.full(len(ids), self.half, np.float32)
        cells, down, up = self.grid.place(self.group, y, 0, lead)
        for j, want in enumerate(self.prefix):
            d = want - cells[j]
            left -= np.where(d == 0, 0.0, np.where(d == 1, up[j], np.where(d == -1, down[j], np.inf)))
        at = np.flatnonzero(left >= 0)
        if not len(at):
            return
        y = y[at]
        points = np.concatenate((y, (y * y).sum(axis=1, keepdims=True), np.ones((len(y), 1), np.float32)), axis=1)
        self.waiting.append((ids[at], weights[at], vectors[at], points, left[at], *self.grid.place(self.group, y, lead)))
        self.waits += len(at)
        if self.waits >= WAITING:
            yield from self.meet()

    def meet(self) -> Iterator:
        import numpy as np

        if not self.waits:
            return
        columns = list(zip(*self.waiting))
        self.waiting, self.waits = [], 0
        ids, weights, vectors, points, left = (np.concatenate(c) for c in columns[:5])
        grid_of = [np.concatenate(c, axis=1) for c in columns[5:]]
        links, start = np.zeros(len(ids), np.int64), 0
        while start < len(ids):
            stop = min(len(ids), start + self.step)
            at, rank = self.visits(start, stop, left, *grid_of)
            self.step = int(np.clip((stop - start) * VISITS / max(1, len(at)), 64, 4 * self.step))
            self.compare(at, rank, ids, weights, vectors, points, links)
            start = stop
        at = np.flatnonzero(links)
        if len(at):
            yield ids[at], links[at]

    def visits(self, start: int, stop: int, left, cells, down, up):
        """(query, cell) wherever the borders between them are near enough, by cell."""
        import numpy as np

        at, key, left = np.arange(start, stop, dtype=np.int32), np.zeros(stop - start, np.int32), left[start:stop]
        for j, stride in enumerate(self.strides[len(self.prefix) :]):
            here = cells[j].take(at)
            if len(self.grid.cuts[self.group][len(self.prefix) + j]) == 1:
                steps = [(down[j], None)]
            else:
                steps = [(down[j], -stride), (up[j], stride)]
            found = [(at, key + here * np.int32(stride), left)]
            for cost, by in steps:
                rest = left - cost.take(at)
                ok = np.flatnonzero(rest >= 0)
                to = found[0][1].take(ok) + np.int32(by) if by else key.take(ok) + (1 - here.take(ok)) * np.int32(stride)
                found.append((at.take(ok), to, rest.take(ok)))
            at, key, left = (np.concatenate(c) for c in zip(*found))
        rank = self.rank.take(key)
        if len(self.bounds) <= len(self.rank):
            some = np.flatnonzero(rank >= 0)
            at, rank = at.take(some), rank.take(some)
        order = np.argsort(rank.astype(np.uint16) if len(self.bounds) <= 1 << 16 else rank, kind="stable")
        return at.take(order), rank.take(order)

    def compare(self, at, rank, ids, weights, vectors, points, links) -> None:
        import numpy as np

        found, n = [], 0
        counts = np.bincount(rank, minlength=len(self.bounds) - 1)
        ends = np.cumsum(counts).tolist()
        for c in np.flatnonzero(counts).tolist():
            queries = at[ends[c] - counts[c] : ends[c]]
            for low in range(self.bounds[c], self.bounds[c + 1], 4096):
                there = self.points[low : min(low + 4096, self.bounds[c + 1])]
                width = len(there)
                for k in range(0, len(queries), max(64, (1 << 19) // width)):
                    some = queries[k : k + max(64, (1 << 19) // width)]
                    near = np.flatnonzero((points.take(some, axis=0) @ there.T).ravel() <= self.limit)
                    if len(near):
                        found.append((some[near // width], low + near % width))
                        n += len(near)
                        if n >= PAIRS:
                            self.settle(found, ids, weights, vectors, links)
                            found, n = [], 0
        if n:
            self.settle(found, ids, weights, vectors, links)

    def settle(self, found, ids, weights, vectors, links) -> None:
        """Count the pairs that are linked and whose place is here."""
        import numpy as np

        asked, held = (np.concatenate(c) for c in zip(*found))
        other = ids[asked] != self.ids[held]
        asked, held = asked[other], held[other]
        grid, step = self.grid, max(256, (1 << 22) // (self.grid.dim * 5))
        for k in range(0, len(asked), step):
            (asking, q), (holding, t) = (np.unique(x[k : k + step], return_inverse=True) for x in (asked, held))
            (a, norm_a), (b, norm_b) = scaled(vectors.take(asking, axis=0)), scaled(self.vectors.take(holding, axis=0))
            near = np.flatnonzero(np.einsum("ij,ij->i", a.take(q, axis=0), b.take(t, axis=0)) / norm_a[q] / norm_b[t] >= grid.least)
            q, t = q[near], t[near]
            y, z = grid.coordinates(a, norm_a), grid.coordinates(b, norm_b)
            apart = np.ascontiguousarray((y.take(q, axis=0) - z.take(t, axis=0)).T)
            apart *= apart
            parts = np.zeros((len(grid.columns), len(q)))
            for g, (i, j) in enumerate(grid.columns):
                for row in apart[i:j]:
                    parts[g] += row
                parts[g] /= grid.budgets[g]
            i, j = grid.columns[self.group]
            mine, costs = parts.argmin(axis=0) == self.group, np.zeros((2, len(q)))
            (cells_y, *borders_y), (cells_z, *borders_z) = grid.place(self.group, y[:, i:j]), grid.place(self.group, z[:, i:j])
            for d in range(len(cells_y)):
                side = cells_z[d][t] - cells_y[d][q]
                costs[0] += np.where(side > 0, borders_y[1][d][q], np.where(side < 0, borders_y[0][d][q], 0.0))
                costs[1] += np.where(side < 0, borders_z[1][d][t], np.where(side > 0, borders_z[0][d][t], 0.0))
            q, t = asking[q], holding[t]
            mine &= (costs[0] < costs[1]) | (costs[0] == costs[1]) & (ids[q] < self.ids[t])
            q, t = q[mine], t[mine]
            np.add.at(links, q, self.weights[t])
            np.add.at(self.links, t, weights[q])
            self.pairs.append((ids[q], self.ids[t]))
            self.paired += len(q)
            if self.paired >= self.enough:
                self.pairs = [stars(*(np.concatenate(c) for c in zip(*self.pairs)))]
                self.paired = len(self.pairs[0][0])
                self.enough = max(self.enough, 2 * self.paired)

    def result(self) -> Iterator:
        """(class, links) of what it holds."""
        import numpy as np

        if self.held:
            at = np.flatnonzero(self.links)
            yield self.ids[at], self.links[at]


def stars(a, b):
    """(node, root) of every node that isn't the least of those that pairs connect it with."""
    import numpy as np

    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while (open_ := root[u] != root[v]).any():
        u, v = u[open_], v[open_]
        np.minimum.at(root, np.maximum(root[u], root[v]), np.minimum(root[u], root[v]))
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def class_links(blocks: DataFrame, least: float, kind: str) -> DataFrame:
    """(src, dst, links): a class's added links with other classes (dst null), or a link of a spanning forest."""
    spark, shape, most = blocks.sparkSession, "src long, dst long, links long", BLOCK_ROWS
    counts = {r["dim"]: r["classes"] for r in blocks.groupBy("dim").agg(F.sum(F.size("n")).alias("classes")).collect()}
    total, cores, width = sum(counts.values()), spark.sparkContext.defaultParallelism, int(kind[-1])
    if not total:
        return spark.createDataFrame([], shape)
    samples = sampled(blocks, SAMPLE / total, kind)
    grids = {d: Grid(d, n, samples.get(d, ()), least, SMALL_ROWS, GROUPS) for d, n in counts.items()}
    units = [(d, *unit) for d, n in sorted(counts.items()) for unit in grids[d].intervals(n, width, 4 * cores)]
    for grid in grids.values():
        grid.sample = None
    sizes = [u[0] * width * u[-1] for u in units]
    tasks, room = [], 0.0
    for unit, size in zip(units, sizes):
        if room < size:
            tasks.append([])
            room = max(size, min(INTERVAL_BYTES, sum(sizes) / (4 * cores)))
        tasks[-1].append(unit[:5])
        room -= size

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def out(src, links, dst=None):
            return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.nulls(len(src), pa.int64()) if dst is None else pa.array(dst, pa.int64()), pa.array(links, pa.int64())], ["src", "dst", "links"])

        begin("op3")
        units, held, batches = [], 0, iter(batches)

        def taken(batch) -> Iterator:
            nonlocal held
            if not units:
                units.extend((u[0], Interval(grids[u[0]], *u[1:])) for u in tasks[batch.column("task")[0].as_py()])
            turns, dims, blocks = (batch.column(c).to_numpy() for c in ("turn", "dim", "block"))
            sizes = np.diff(batch.column("n").offsets.to_numpy())
            for turn in (0, 1):
                for dim in np.unique(dims[turns == turn]).tolist():
                    mine = [u for d, u in units if d == dim]
                    rows = np.flatnonzero((turns == turn) & (dims == dim))
                    if turn == 0:
                        held += int(sizes[rows].sum())
                    elif held != total:
                        raise RuntimeError(f"{held} of {total} classes came before those that ask")
                    for some in np.split(rows, range(256, len(rows), 256)) if mine else ():
                        part = batch.take(pa.array(some))
                        vectors = np.frombuffer(b"".join(part.column("vectors").to_pylist()), kind).reshape(-1, dim)
                        ids = np.repeat(blocks[some] * most, sizes[some]) + np.concatenate([np.arange(s) for s in sizes[some].tolist()])
                        weights, directions = part.column("n").flatten().to_numpy(), rough(vectors)
                        y: dict = {}
                        for u in mine:
                            if u.group not in y:
                                y[u.group] = u.grid.about(*directions, u.group)
                            if turn == 0:
                                u.hold(ids, weights, vectors, y[u.group])
                                continue
                            if not u.ready:
                                u.order()
                            for src, links in u.ask(ids, weights, vectors, y[u.group]):
                                yield out(src, links)

        while (batch := next(batches, None)) is not None:
            yield from taken(batch)
            batch = None  # not kept while the next one is read
            give_back()
        for _, u in units:
            if u.ready:
                for src, links in (*u.meet(), *u.result()):
                    yield out(src, links)
                if u.pairs:
                    src, dst = stars(*(np.concatenate(c) for c in zip(*u.pairs)))
                    yield out(src, np.zeros(len(src), np.int64), dst)

    # each task is one pair of the product: the table of blocks twice, first to be held and then to ask, and a number
    part = blocks.select("block", "dim", "vectors", "n")
    twice = part.withColumn("turn", F.lit(0)).union(part.withColumn("turn", F.lit(1))).coalesce(1)
    numbers = spark.range(0, len(tasks), 1, len(tasks)).withColumnRenamed("id", "task").hint("shuffle_replicate_nl")
    return materialise(twice.crossJoin(numbers).mapInArrow(run, shape), "links")


def near_vectors(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding)."""
    rows = vectors.select("vec_id", "embedding")
    sound = is_sound(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    single = isinstance(rows.schema["embedding"].dataType.elementType, FloatType)
    typed = rows.where("sound").withColumn("embedding", F.col("embedding").cast("array<float>" if single else "array<double>"))
    blocks, keyed = classes_of(typed.select("vec_id", "embedding"))
    found = class_links(blocks, least, "<f4" if single else "<f8")
    links = found.where("dst IS NULL").groupBy(F.col("src").alias("class")).agg(F.sum("links").alias("others"))
    roots = connected_components(found.where("dst IS NOT NULL").select("src", "dst")).withColumnsRenamed({"node": "class", "component": "root"})
    classes = blocks.select("block", F.posexplode(F.arrays_zip("h0", "h1", "n", "first")).alias("pos", "c")).select((F.col("block") * BLOCK_ROWS + F.col("pos")).alias("class"), "c.*")
    known = materialise(classes.join(links.join(roots, "class"), "class", "left").drop("class"), "known")
    discard(blocks)
    firsts = materialise(known.where("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("component_id")), "firsts")
    joined = known.where("root IS NOT NULL").join(firsts, "root").select("h0", "h1", "n", "others", "component_id")
    single_ones = known.where("root IS NULL").select("h0", "h1", "n", F.lit(0).cast("long").alias("others"), F.col("first").alias("component_id"))
    known = joined.unionByName(single_ones).select("h0", "h1", (F.col("n") - 1 + F.col("others")).alias("n_links"), "component_id")
    linked = keyed.select("vec_id", "h0", "h1").join(known, ["h0", "h1"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE sound AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95
), reached AS (
  SELECT vec_id AS node, vec_id AS least FROM embeddings
  UNION
  SELECT l.b, r.least FROM reached r JOIN links l ON l.a = r.node WHERE r.least < l.b
), roots AS (
  SELECT node, min(least) AS component_id FROM reached GROUP BY node
)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings e JOIN roots r ON r.node = e.vec_id
"""
