"""Best-fit packing of token sequences with large-item matching.

A document's ids end with an end id; only a document longer than a sequence is cut, into whole sequences and a rest.
Pieces longer than a third of a sequence fit at most twice into one, so they are matched greedily: the longest
that is left takes the longest partner that still fits.  Shorter pieces then go, longest first, into the tightest
gap that holds them, and open new sequences where no gap does.

Only the number of pieces of each length matters to the plan, so the driver plans from a histogram of at most
``capacity`` entries, in runs of like sequences.  A piece finds its place by its rank among the pieces of its length:
its rank in its partition, counted as it is made, plus what earlier partitions hold.

Defined results: a null text counts as the empty one (a piece of the end id alone); repeated rows are packed each;
columns besides ``doc_id`` and ``text`` are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, single_threaded_tokenizers, table, tokenizer_path, with_text
from .workers import begin, kept

#: Bytes of memory for the chunks that a worker knows; it bounds memory and never changes a result.
CHUNK_BYTES = 192 << 20
PIECES = "part int, doc_id long, piece int, start long, length long, ids_crc32 long, local_rank long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Where pieces go: (length, first rank, first sequence, pieces a sequence, offset in it), by runs of ranks.

    The run of a length goes on until the next one's first rank.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    used, runs, gaps, order = dict.fromkeys(left, 0), [], {}, []
    sequences = 0

    def put(length: int, count: int, first: int, each: int, offset: int) -> None:
        runs.append((length, used[length], first, each, offset))
        used[length] += count
        left[length] -= count

    def opened(first: int, count: int, gap: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, count))

    large = sorted(n for n in left if 3 * n > capacity)
    for a in reversed(large):
        while left[a]:
            at = bisect_right(large, min(a, capacity - a)) - 1
            while at >= 0 and left[large[at]] < (2 if large[at] == a else 1):
                at -= 1
            if at < 0:
                count = left[a]
                put(a, count, sequences, 1, 0)
                opened(sequences, count, capacity - a)
            else:
                b = large[at]
                count = left[a] // 2 if a == b else min(left[a], left[b])
                put(a, count, sequences, 1, 0)
                put(b, count, sequences, 1, a)
                opened(sequences, count, capacity - a - b)
            sequences += count
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(order, n)
            if at == len(order):
                each = capacity // n
                count = max(1, left[n] // each)
                first, sequences, gap = sequences, sequences + count, capacity
            else:
                gap = order[at]
                first, count = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
                each = gap // n
            full = min(count, left[n] // each)
            if full:
                put(n, full * each, first, each, capacity - gap)
                opened(first, full, gap - each * n)
            elif left[n]:
                rest = left[n]
                put(n, rest, first, rest, capacity - gap)
                opened(first, 1, gap - rest * n)
                full = 1
            opened(first + full, count - full, gap if gap < capacity else 0)
    return runs


def cut(docs: DataFrame, path: str, capacity: int, end_id: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row for each piece of each document, with its partition and its rank among that partition's pieces of its length."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        begin("packing")
        encode, part, ranks = kept((path, chunk_bytes), lambda: word_encoder(path, chunk_bytes)), TaskContext.get().partitionId(), {}
        end, room = end_id.to_bytes(4, "little"), capacity * 4
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = encode(text.as_py()) + end
                for k in range(0, len(ids), room):
                    piece = ids[k : k + room]
                    n = len(piece) // 4
                    rank = ranks[n] = ranks.get(n, -1) + 1
                    rows.append((part, doc_id, k // room, k // 4, n, crc32(piece), rank))
            names = [f.split()[0] for f in PIECES.split(", ")]
            kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)], names)

    return with_text(docs, "doc_id").mapInArrow(run, PIECES)


def word_encoder(path: str, limit: int = CHUNK_BYTES):
    single_threaded_tokenizers()
    from tokenizers import Tokenizer

    from .pieces import WordEncoder

    return WordEncoder(Tokenizer.from_file(path), limit)


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    ``chunk_bytes`` is what a worker may hold of known chunks: less costs time, never changes a result.
    """
    pieces = materialise(cut(docs, path, capacity, end_id, chunk_bytes), "pieces")
    counts = pieces.groupBy("part", "length").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    runs = sorted(plan(histogram, capacity))
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("local_rank"))

    def place(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        begin("packing")
        table = np.array(runs, dtype=np.int64).reshape(-1, 5)
        keys = table[:, 0] * (1 << 48) + table[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run = table[np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1]
            nth = rank - run[:, 1]
            placed = [pa.array(run[:, 2] + nth // run[:, 3]), pa.array(run[:, 4] + nth % run[:, 3] * length)]
            kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *placed], [*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(place, PLACED)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
