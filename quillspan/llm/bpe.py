"""Byte-level BPE encoding and decoding by recursive DuckDB queries, one engine per worker process.

Encoding: a text is cut by the vocabulary's pattern; each distinct word becomes rows (word, position, token id),
one per byte.  A recursive query joins neighbouring rows with the merge table and contracts each word's
leftmost pair of least rank, until a word has no pair that the table knows.  Decoding joins (document,
position, id) rows with the vocabulary and concatenates in order of position.

A word of more than ``PIECE`` bytes is contracted in pieces, which are then joined two by two.  Ids are a word's encoding
exactly if each two neighbours are the encoding of their own bytes, as every token's own bytes encode to that token.  So
a seam whose neighbours are not is contracted anew, with twice as many tokens around it each time, until its ends fit.
The work grows with the word's length, whatever its letters.

The work is per partition and needs no shuffle.  A lost executor costs the re-run of its partitions.

Defined results: a null text counts as the empty one (no ids, digest of no bytes); repeated rows are encoded
each; columns besides ``doc_id`` and ``text`` are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from .common import by_bytes, table, tokenizer_path, with_text
from .workers import begin, kept

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Bytes of texts that are cut at once.
TEXT_BYTES = 8 << 20
#: Bytes of a word that are contracted at once.
PIECE = 64
#: Bytes around a seam from which equal least pairs are contracted together rather than one by one.
LONG_SEAM = 255
#: Distinct words, their bytes, and tokens given to one query; they bound memory.
WORDS_AT_ONCE, BYTES_AT_ONCE, TOKENS_AT_ONCE = 60_000, 1_000_000, 1_500_000

#: One contraction a step: of the least (rank, position) of each word.  ``spot`` is word * 256 + position.
CONTRACT = """
WITH RECURSIVE s(spot, id, live) AS (
  SELECT w::BIGINT * 256 + pos, id, true FROM start_rows
  UNION ALL
  (WITH pairs AS MATERIALIZED (
     SELECT spot, id, lead(id) OVER (ORDER BY spot) AS next_id, lead(spot) OVER (ORDER BY spot) AS next_spot FROM s WHERE live
   ), ranked AS MATERIALIZED (
     SELECT p.spot, p.id, p.next_spot, m.rank::BIGINT * 256 + p.spot % 256 AS place
     FROM pairs p LEFT JOIN merges m ON m.pair = p.id::BIGINT * 65536 + p.next_id AND p.spot // 256 = p.next_spot // 256
   ), best AS MATERIALIZED (
     SELECT spot // 256 AS w, min(place) AS place, arg_min(next_spot, place) AS gone FROM ranked WHERE place IS NOT NULL GROUP BY ALL
   )
   SELECT r.spot, CASE WHEN r.place = b.place THEN b.place // 256 ELSE r.id END, b.w IS NOT NULL
   FROM ranked r LEFT JOIN best b ON r.spot // 256 = b.w WHERE b.gone IS DISTINCT FROM r.spot)
)
SELECT spot // 256 AS w, list(id ORDER BY spot) AS ids FROM s WHERE NOT live GROUP BY ALL ORDER BY w
"""

#: All of a word's pairs of the least rank a step, every other one where they overlap.  A merge makes pairs of
#: higher rank only, since each token's own bytes encode to that token, so this equals one at a time.
CONTRACT_LONG = """
WITH RECURSIVE s(w, pos, id, live) AS (
  SELECT w, pos, id, true FROM start_rows
  UNION ALL
  SELECT w, pos, CASE WHEN take THEN least ELSE id END, least IS NOT NULL
  FROM (SELECT w, pos, id, least, take, lag(take) OVER (PARTITION BY w ORDER BY pos) AS gone
        FROM (SELECT w, pos, id, least, hit AND (n - missed) % 2 = 1 AS take
              FROM (SELECT w, pos, id, least, n, hit,
                           max(CASE WHEN NOT hit THEN n ELSE 0 END) OVER (PARTITION BY w ORDER BY pos) AS missed
                    FROM (SELECT w, pos, id, n, least, coalesce(rank = least, false) AS hit
                          FROM (SELECT w, pos, id, n, rank, min(rank) OVER (PARTITION BY w) AS least
                                FROM (SELECT p.w, p.pos, p.id, p.n, m.rank
                                      FROM (SELECT w, pos, id, lead(id) OVER q AS nid, row_number() OVER q AS n
                                            FROM s WHERE live WINDOW q AS (PARTITION BY w ORDER BY pos)) p
                                      LEFT JOIN merges m ON m.pair = p.id::BIGINT * 65536 + p.nid))))))
  WHERE gone IS NOT TRUE
)
SELECT w, list(id ORDER BY pos) AS ids FROM s WHERE NOT live GROUP BY w ORDER BY w
"""

#: Ordered aggregation of token bytes (as hexadecimal digits) by document.
DECODE = """
SELECT d, string_agg(hex, '') AS hex
FROM (SELECT t.d, v.hex FROM tokens t JOIN vocabulary v USING (id) ORDER BY t.d, t.pos) GROUP BY d
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class BpeEngine:
    """Vocabulary and merge table in an in-memory DuckDB database; encodes words and decodes ids in batches."""

    def __init__(self, ranks: dict[bytes, int]):
        import duckdb
        import numpy as np
        import pyarrow as pa

        self.db = duckdb.connect()
        self.db.execute("SET threads = 1")
        self.db.execute("SET memory_limit = '400MB'")
        self.db.execute("SET temp_directory = ''")  # nothing is left on a machine's own disk
        pairs = [
            ((ranks[token[:i]] << 16) | ranks[token[i:]], rank)
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        if len(ranks) > 65536:
            raise ValueError("pairs are packed for ids below 65536")
        given = pa.table({"pair": pa.array([p for p, _ in pairs], pa.int64()), "rank": pa.array([r for _, r in pairs], pa.int32())})
        self._fill("merges", given)
        self._fill("vocabulary", pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "hex": [t.hex() for t in ranks]}))
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.spelling = {rank: token for token, rank in ranks.items()}

    def _fill(self, name: str, rows) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _arrow(self, query: str, **inputs):
        for name, rows in inputs.items():
            self.db.register(name, rows)
        out = self.db.sql(query).to_arrow_table()
        for name in inputs:
            self.db.unregister(name)
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit integers."""
        raw = [w.encode() for w in words]
        long = [i for i, w in enumerate(raw) if len(w) > PIECE]
        out = self._encode([w if len(w) <= PIECE else b"" for w in raw])
        for i, ids in zip(long, self._encode_long([raw[i] for i in long])):
            out[i] = b"".join(x.to_bytes(4, "little") for x in ids)
        return out

    def _encode(self, raw: list[bytes]) -> list[bytes]:
        """Each one's ids, by one contraction a step up to ``LONG_SEAM`` bytes."""
        out = [b""] * len(raw)
        for query, mine in ((CONTRACT, lambda n: n <= LONG_SEAM), (CONTRACT_LONG, lambda n: n > LONG_SEAM)):
            part, size = [], 0
            for i, w in enumerate(raw):
                if not mine(len(w)):
                    continue
                if part and (len(part) == WORDS_AT_ONCE or size + len(w) > BYTES_AT_ONCE):
                    self._contract(query, raw, part, out)
                    part, size = [], 0
                part.append(i)
                size += len(w)
            self._contract(query, raw, part, out)
        return out

    def _ids(self, raw: list[bytes]) -> list[tuple]:
        """``_encode`` as tuples of ids, each different text encoded once."""
        distinct = list(dict.fromkeys(raw))
        known = {w: tuple(memoryview(ids).cast("I")) for w, ids in zip(distinct, self._encode(distinct))}
        return [known[w] for w in raw]

    def _encode_long(self, raw: list[bytes]) -> list[list[int]]:
        """The ids of long words: pieces, joined two by two."""
        counts = [-(-len(w) // PIECE) for w in raw]
        pieces = iter(self._ids([w[k : k + PIECE] for w in raw for k in range(0, len(w), PIECE)]))
        words = [[list(next(pieces)) for _ in range(n)] for n in counts]
        while any(len(parts) > 1 for parts in words):
            joined = iter(self._join([(a, b) for parts in words for a, b in zip(parts[::2], parts[1::2])]))
            words = [[next(joined) for _ in range(len(parts) // 2)] + parts[len(parts) // 2 * 2 :] for parts in words]
        return [parts[0] for parts in words]

    def _join(self, pairs: list[tuple[list[int], list[int]]]) -> list[list[int]]:
        """The ids of each two texts after each other, from the ids of both."""
        spell = lambda ids: b"".join(map(self.spelling.__getitem__, ids))
        out, open_, width = [None] * len(pairs), list(range(len(pairs))), 1
        while open_:
            seams = [(pairs[i][0][-width:], pairs[i][1][:width]) for i in open_]
            anew = [list(ids) for ids in self._ids([spell(a) + spell(b) for a, b in seams])]
            ends = []  # the neighbours that a seam's new ids must fit
            for i, ids in zip(open_, anew):
                left, right = pairs[i][0][:-width], pairs[i][1][width:]
                ends.append([x for x in (left and (left[-1], ids[0]), right and (ids[-1], right[0])) if x])
            asked = list({x for both in ends for x in both})
            fits = {x for x, ids in zip(asked, self._ids([spell(x) for x in asked])) if ids == x}
            left_open = []
            for i, ids, both in zip(open_, anew, ends):
                if all(x in fits for x in both):
                    out[i] = pairs[i][0][:-width] + ids + pairs[i][1][width:]
                else:
                    left_open.append(i)
            open_, width = left_open, 2 * width
        return out

    def _contract(self, query: str, raw: list[bytes], which: list[int], out: list[bytes]) -> None:
        import numpy as np
        import pyarrow as pa

        if not which:
            return
        lengths = np.array([len(raw[i]) for i in which])
        ids = self.byte_id[np.frombuffer(b"".join([raw[i] for i in which]), dtype=np.uint8)]
        pos = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        rows = pa.table({"w": np.repeat(np.arange(len(which), dtype=np.int32), lengths), "pos": pos.astype(np.int32), "id": ids})
        found = self._arrow(query, start_rows=rows).combine_chunks()
        lists = found["ids"].chunk(0) if found.num_rows else None
        if lists is not None:
            offsets, values = lists.offsets.to_numpy() * 4, lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            for k, w in enumerate(found["w"].to_numpy().tolist()):
                out[which[w]] = values[offsets[k] : offsets[k + 1]]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes that each list of ids stands for."""
        import numpy as np
        import pyarrow as pa

        out, start = [b""] * len(ids), 0
        while start < len(ids):
            end, size = start, 0
            while end < len(ids) and (end == start or size + len(ids[end]) // 4 <= TOKENS_AT_ONCE):
                size += len(ids[end]) // 4
                end += 1
            n = np.array([len(x) // 4 for x in ids[start:end]])
            pos = np.arange(size) - np.repeat(np.cumsum(n) - n, n)
            rows = pa.table({"d": np.repeat(np.arange(start, end, dtype=np.int32), n), "pos": pos.astype(np.int32), "id": np.frombuffer(b"".join(ids[start:end]), dtype="<u4").astype(np.int32)})
            found = self._arrow(DECODE, tokens=rows)
            for d, text in zip(found["d"].to_pylist(), found["hex"].to_pylist()):
                out[d] = bytes.fromhex(text)
            start = end
        return out


def engine_for(path: str, pattern: str):
    """A worker process's engine and encoder of columns of texts for a rank file."""
    import regex

    from .pieces import BatchColumnIds

    engine = BpeEngine(read_ranks(path))
    return engine, BatchColumnIds(regex.compile(pattern).findall, engine.encode_words)


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text; see the module for odd inputs."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        begin("bpe")
        engine, encode = kept((path, pattern), lambda: engine_for(path, pattern))
        for batch in batches:
            for some in by_bytes(batch, TEXT_BYTES):
                ids = encode(some.column("text"))
                decoded = engine.decode(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("doc_id"),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return with_text(docs, "doc_id").mapInArrow(run, SCHEMA)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
