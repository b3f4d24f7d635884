"""Token ids in binary shards, each a wavelet matrix.

A shard's file holds, for each bit of the ids from the highest down, a plane of bits and the count of ones before
every block of it.  Each plane orders the ids anew: those with a zero bit first, both kinds in their old order.  From
these alone the file gives the id at a place, the count of an id before a place, and the place of its n-th occurrence.

File: ``QWM2``, then little-endian unsigned numbers: ids (8 bytes), bits of an id (1), documents (8), then the
documents' ids, which of them are null (packed bits) and their ends, and per plane the zeros (8), the packed bits and
the ones before each block of 512 bits; arrays are compressed by zstd, each after its length (8).

Texts are encoded where they are read, and only ids are shuffled, as 16-bit numbers where the vocabulary allows it.
Documents are range-partitioned by id, so shards follow one another in order of ids; a shard is written when it has
``SHARD_TOKENS`` ids, so a task holds one shard at a time.  Shards are rows (place, file) of a table in the
shared folder, written by Spark's committed writers, so that no executor's own disk matters.

Defined results: a null text counts as the empty one (the end id alone); a null doc_id comes first; repeated
rows are written each; columns besides ``doc_id`` and ``text`` are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterator
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, discard, materialise, shared_dir, single_threaded_tokenizers, table, tokenizer_path, with_text
from .workers import begin, kept

SHARD_TOKENS = 1 << 20
#: Bytes of memory for the pieces that a worker knows, for those of Latin letters, and of texts that it cuts at once; they
#: bound memory and never change a result.
PIECE_BYTES, WORD_BYTES, TEXT_BYTES = 320 << 20, 24 << 20, 8 << 20
BLOCK = 512
MAGIC = b"QWM2"
SHARD = "part int, shard int, part_start long, n_tokens long, file binary"


def _packed(values, level: int = 1) -> bytes:
    import zstandard

    data = zstandard.ZstdCompressor(level=level).compress(values.tobytes())
    return struct.pack("<Q", len(data)) + data


class WaveletMatrix:
    """Bit planes of a sequence of unsigned ids, with the count of ones before each block."""

    def __init__(self, n: int, zeros: list[int], planes: list, ranks: list):
        self.n, self.zeros, self.planes, self.ranks = n, zeros, planes, ranks

    @classmethod
    def build(cls, ids) -> WaveletMatrix:
        import numpy as np

        width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        ids = ids.astype(np.uint16 if width <= 16 else np.uint32)
        zeros, planes, ranks = [], [], []
        for bit in range(width - 1, -1, -1):
            ones = (ids >> bit).astype(np.uint8) & 1
            plane = np.packbits(ones)
            planes.append(plane)
            ranks.append(cls.block_ranks(plane))
            ones = ones.view(bool)
            low = ids[np.flatnonzero(~ones)]  # places cost less than a mask
            zeros.append(len(low))
            ids = np.concatenate((low, ids[np.flatnonzero(ones)]))
        return cls(len(ids), zeros, planes, ranks)

    @staticmethod
    def block_ranks(plane):
        import numpy as np

        counts = np.add.reduceat(np.bitwise_count(plane).astype(np.int64), np.arange(0, len(plane), BLOCK // 8)) if len(plane) else np.zeros(0, np.int64)
        return np.concatenate(([0], np.cumsum(counts))).astype(np.uint32)

    def _ones(self, level: int, i: int) -> int:
        """Ones before place i of a plane."""
        import numpy as np

        block = i // BLOCK
        first, last = block * BLOCK // 8, i // 8
        count = int(self.ranks[level][block]) + int(np.bitwise_count(self.planes[level][first:last]).sum())
        return count + (int(self.planes[level][last]) >> (8 - i % 8)).bit_count() if i % 8 else count

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i // 8]) >> (7 - i % 8) & 1

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit, ones = self._bit(level, i), self._ones(level, i)
            value, i = value << 1 | bit, zeros + ones if bit else i - ones
        return value

    def _range(self, symbol: int, end: int) -> tuple[int, int]:
        """The places in the last plane's order of an id's occurrences before ``end``."""
        start, width = 0, len(self.zeros)
        if symbol >> width:
            return 0, 0
        for level, zeros in enumerate(self.zeros):
            a, b = self._ones(level, start), self._ones(level, end)
            start, end = (zeros + a, zeros + b) if symbol >> (width - 1 - level) & 1 else (start - a, end - b)
        return start, end

    def count(self, symbol: int, end: int | None = None) -> int:
        """How often an id occurs before place ``end``."""
        a, b = self._range(symbol, self.n if end is None else end)
        return b - a

    def select(self, symbol: int, k: int) -> int:
        """The place of the k-th occurrence of an id, from 0."""
        a, b = self._range(symbol, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        place, width = a + k, len(self.zeros)
        for level in range(width - 1, -1, -1):
            bit = symbol >> (width - 1 - level) & 1
            place = self._find(level, place - self.zeros[level] if bit else place, bit)
        return place

    def _find(self, level: int, k: int, bit: int) -> int:
        """The place of the k-th bit of a kind in a plane: its block by the counts before blocks, then within it."""
        import numpy as np

        ranks, plane = self.ranks[level], self.planes[level]
        before = lambda block: int(ranks[block]) if bit else block * BLOCK - int(ranks[block])
        block = bisect_right(range(len(ranks)), k, key=before) - 1
        bits = np.unpackbits(plane[block * BLOCK // 8 : (block + 1) * BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - before(block)])

    def all(self):
        """All ids in order: the planes' orders undone from the last plane up."""
        import numpy as np

        width = len(self.zeros)
        ids = np.zeros(self.n, np.uint16 if width <= 16 else np.uint32)
        for level in range(width - 1, -1, -1):
            ones, above = np.unpackbits(self.planes[level], count=self.n).view(bool), np.empty_like(ids)
            above[np.flatnonzero(~ones)] = ids[: self.zeros[level]]
            above[np.flatnonzero(ones)] = ids[self.zeros[level] :] | (1 << (width - 1 - level))
            ids = above
        return ids.astype(np.uint32)


def write_shard(doc_ids: list[int | None], ends, ids) -> bytes:
    """A shard's file for documents that end before the places ``ends`` of ``ids``."""
    import numpy as np

    matrix = WaveletMatrix.build(ids)
    known, absent = np.array([i or 0 for i in doc_ids], "<i8"), np.packbits(np.array([i is None for i in doc_ids], bool))
    parts = [MAGIC, struct.pack("<QBQ", len(ids), len(matrix.zeros), len(doc_ids)), _packed(known), _packed(absent), _packed(ends.astype("<u8"))]
    for zeros, plane, ranks in zip(matrix.zeros, matrix.planes, matrix.ranks):
        parts += [struct.pack("<Q", zeros), _packed(plane), _packed(ranks.astype("<u4"))]
    return b"".join(parts)


def read_shard(data: bytes):
    """(doc_ids, which of them are null, ends, wavelet matrix) of a shard's file."""
    import numpy as np
    import zstandard

    if data[:4] != MAGIC:
        raise ValueError("not a shard")
    (n, width, documents), at, engine = struct.unpack_from("<QBQ", data, 4), 21, zstandard.ZstdDecompressor()

    def array(kind: str):
        nonlocal at
        (size,) = struct.unpack_from("<Q", data, at)
        at += 8 + size
        return np.frombuffer(engine.decompress(data[at - size : at]), dtype=kind)

    doc_ids, absent, ends, zeros, planes, ranks = array("<i8"), array("u1"), array("<u8"), [], [], []
    for _ in range(width):
        zeros.append(struct.unpack_from("<Q", data, at)[0])
        at += 8
        planes.append(array("u1"))
        ranks.append(array("<u4"))
    return doc_ids, np.unpackbits(absent, count=documents).view(bool), ends, WaveletMatrix(n, zeros, planes, ranks)


def column_encoder(path: str, pattern: str):
    """The worker's function from a column of texts to their id bytes for a byte-level vocabulary of the tokenizers library.

    The pattern cuts a text into words and the library's model encodes them; a text that holds an added token's string
    goes to the library as a whole.
    """
    single_threaded_tokenizers()
    import regex
    from tokenizers import Tokenizer

    from .pieces import ColumnIds, ModelIds, PieceIds, library_ids

    library = Tokenizer.from_file(path)
    added = [t.content for t in library.get_added_tokens_decoder().values()]
    by_piece = PieceIds(regex.compile(pattern).findall, ModelIds(library), PIECE_BYTES)
    return ColumnIds(by_piece, lambda text: library_ids(library, text) if any(a in text for a in added) else by_piece(text), added, WORD_BYTES)


def level_encoder(path: str, pattern: str):
    """The same for a single text."""
    return column_encoder(path, pattern).encode


def encoded(docs: DataFrame, path: str, pattern: str, end_id: int) -> DataFrame:
    """(doc_id, wide, ids, tie): each text's ids with the end id, 16 or 32 bits each (``wide``); ``tie`` orders rows of one id."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        begin("token shards")
        encode, end = kept((path, pattern), lambda: column_encoder(path, pattern)), end_id.to_bytes(4, "little")
        for batch in batches:
            for some in by_bytes(batch, TEXT_BYTES):
                rows = []
                for data in encode(some.column("text")):
                    data += end
                    ids = np.frombuffer(data, "<u4")
                    wide = bool(ids.max() >> 16)
                    rows.append((wide, data if wide else ids.astype("<u2").tobytes(), crc32(data)))
                kinds = (pa.bool_(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], ["doc_id", "wide", "ids", "tie"])

    return with_text(docs, "doc_id").mapInArrow(run, "doc_id long, wide boolean, ids binary, tie long")


def write_shards(docs: DataFrame, path: str, pattern: str, folder: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode ``docs`` in ascending order of doc_id and write them to ``folder`` as shards of about ``shard_tokens`` ids."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        begin("token shards")
        part, shard = TaskContext.get().partitionId(), 0
        doc_ids, held, size, before = [], [], 0, 0

        def file():
            data = write_shard(doc_ids, np.cumsum(np.array([len(x) for x in held], np.uint64)), np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([data], pa.binary())], ["part", "shard", "part_start", "n_tokens", "file"])

        for batch in batches:
            for doc_id, wide, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "wide", "ids"))):
                doc_ids.append(doc_id)
                held.append(np.frombuffer(ids, "<u4" if wide else "<u2"))
                size += len(held[-1])
                if size >= shard_tokens:
                    yield file()
                    doc_ids, held, size, before, shard = [], [], 0, before + size, shard + 1
        if doc_ids:
            yield file()

    ids = materialise(encoded(docs, path, pattern, end_id), "encoded")
    ordered = ids.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.select("doc_id", "wide", "ids").mapInArrow(run, SHARD).write.parquet(folder)
    discard(ids)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards of ``folder``.

    The driver adds up the tokens of parts, of which there are as many as the writing job had tasks.
    """
    shards = spark.read.schema(SHARD).parquet(folder)
    totals, starts, total = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect(), {}, 0
    for part, n in sorted(tuple(r) for r in totals):
        starts[part], total = total, total + n

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        begin("token shards")
        for batch in batches:
            for part, before, file in zip(*(batch.column(c).to_pylist() for c in ("part", "part_start", "file"))):
                doc_ids, absent, ends, matrix = read_shard(file)
                data, ends = matrix.all().tobytes(), ends.astype(np.int64)
                begins = np.concatenate(([0], ends[:-1]))
                sums = [crc32(data[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                columns = [pa.array(doc_ids, mask=absent), pa.array(begins + starts[part] + before), pa.array(ends - begins), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("part", "part_start", "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_dir(spark, "token-shards")
    write_shards(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), public_tokenizers.PATTERN, folder)
    return read_documents(spark, folder)
