"""SimHash near-duplicates by pigeonhole blocks.

A 64-bit fingerprint is cut into blocks.  Two fingerprints that differ in at most ``distance`` bits agree on at least
``blocks - distance`` whole blocks, so they meet under the key that those blocks make.  Distinct fingerprints are
joined on keys, and each pair that meets is verified by its Hamming distance.  A key with very many fingerprints
is dealt into cells: its fingerprints are split into chunks, and every two chunks meet in a cell of their own.
Links leave a task as a spanning forest; all links are verified, and groups never become lists of all their pairs.

Defined results: a null text counts as the empty one, whose fingerprint is zero; equal texts and repeated rows share
a fingerprint and a component; null ids come after all others, and a component of null ids alone has a null id;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators.components import UnionFind, connected_components

from .common import free_name, materialise, table, with_text
from .workers import begin

#: Fingerprints of one key that are compared in one piece; a key with more is dealt into cells.
CHUNK = 2048


def fingerprint(text: str, words: int = 4) -> int:
    """The SimHash of a text's word shingles, as an unsigned 64-bit number."""
    import numpy as np
    from xxhash import xxh64_intdigest

    found = text.encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, ones = len(found) - words + 1, np.zeros(64, np.int64)
    spans = zip(starts[:n].tolist(), ends[words - 1 :].tolist())
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in spans), np.uint64, n)
    for k in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp): ``fp`` holds the fingerprint's bits as a signed long; ``text_hash`` parts rows of one id."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        begin("simhash")
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])

    rows = with_text(docs, "doc_id").withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def block_masks(blocks: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _links(distance: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        sets, kept_cell, kept_fp = UnionFind(), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def compare(cells, fps) -> None:
            starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
            sizes = np.diff(np.append(starts, len(cells)))
            for size in np.unique(sizes[sizes > 1]).tolist():
                at = starts[sizes == size]
                step = max(1, 4_000_000 // (size * size))
                for k in range(0, len(at), step):
                    group = fps[at[k : k + step, None] + np.arange(size)]
                    for row in range(0, size, 512):  # a strip of the distance matrix at a time
                        near = np.bitwise_count((group[:, row : row + 512, None] ^ group[:, None, :]).view(np.uint64)) <= distance
                        g, i, j = np.nonzero(near)
                        i += row
                        g, i, j = (x[i < j] for x in (g, i, j))
                        pairs = np.unique(np.stack((group[g, i], group[g, j])), axis=1) if len(g) else np.zeros((2, 0), np.int64)
                        for a, b in zip(*pairs.tolist()):
                            sets.union(a, b)

        for batch in batches:
            cells = np.concatenate((kept_cell, batch.column("cell").to_numpy()))
            fps = np.concatenate((kept_fp, batch.column("fp").to_numpy()))
            whole = int(np.searchsorted(cells, cells[-1])) if len(cells) else 0  # the last cell may go on
            compare(cells[:whole], fps[:whole])
            kept_cell, kept_fp = cells[whole:], fps[whole:]
        if len(kept_cell):
            compare(kept_cell, kept_fp)
        stars = list(sets.stars())
        for k in range(0, len(stars), 50_000):
            part = stars[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([r for _, r in part], pa.int64())], ["src", "dst"])

    return run


def links(distinct_fps: DataFrame, distance: int = 4, blocks: int = 6) -> DataFrame:
    """(src, dst): a spanning forest, per task, of the links between distinct fingerprints ``fp``."""
    masks = [reduce(int.__or__, some) for some in combinations(block_masks(blocks), blocks - distance)]
    keys = F.explode(F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(masks))))
    keyed = distinct_fps.select("fp", keys.alias("key"))
    shared = keyed.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / CHUNK).alias("chunks"))
    shared = materialise(shared, "shared-keys")  # so that the join can split a key with very many fingerprints
    met = keyed.join(shared, "key").withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")))
    partners = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda c: F.xxhash64("key", F.least(c, F.col("chunk")), F.greatest(c, F.col("chunk"))))
    cells = met.select("fp", F.explode(F.when(F.col("chunks") == 1, F.array("key")).otherwise(partners)).alias("cell"))
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_links(distance), "src long, dst long")


def near_duplicates(docs: DataFrame, distance: int = 4, words: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp, first): ``first`` is the component's least (id is null, doc_id, text_hash)."""
    fps = materialise(fingerprints(docs, words), "simhash")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    by_fp = fps.groupBy("fp").agg(least)
    roots = connected_components(links(by_fp.select("fp"), distance)).withColumnsRenamed({"node": "fp"})
    joined = by_fp.join(roots, "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    firsts = materialise(joined.groupBy("root").agg(F.min("first").alias("first")), "firsts")
    by_fp = joined.select("fp", "root").join(firsts, "root").select("fp", "first")
    return fps.join(by_fp, "fp")


def keep_one(docs: DataFrame, distance: int = 4, words: int = 4) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of least id, null ids last; columns stay as they are."""
    kept = near_duplicates(docs, distance, words).select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_hash").alias("kept_hash")).distinct()
    own = free_name(docs, "own_hash")
    keyed = docs.withColumn(own, F.xxhash64(F.coalesce("text", F.lit(""))))
    same = keyed["doc_id"].eqNullSafe(kept["kept_id"]) & (keyed[own] == kept["kept_hash"])
    return keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", own]).select(*docs.columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))
