"""Removal of repeated byte strings through suffix arrays.

A byte goes if a string of ``width`` bytes that covers it starts anywhere else too.  Every such window has a least hash
among its substrings of ``KMER`` bytes; equal windows have equal least hashes, so they meet under that value.

1. Each text yields the least hashes of its windows; values that occur once are settled.
2. Stretches of windows whose value occurs again become segments, each its windows' bytes.  Texts and segments that
   occur several times are compared once, with a note that they repeat.
3. The distinct segments of a value meet in one task, where a suffix array of them is built by two-stage sorting:
   suffixes smaller than their successors are sorted directly, the rest are induced by scanning buckets in order.
   Windows whose common prefix with a neighbour reaches ``width`` are repeated.
4. Repeated windows go back to their texts, which lose the bytes that they cover.

Where passages of so many words shall go too, however few bytes they have, a text is compared a second time in the same
jobs, each word between ASCII white space standing as a hash of ``width / words`` bytes.

A value with very many distinct segments (texts that share a passage and differ around it) is trimmed first: windows
are counted by the hash of all their bytes, and only stretches of windows whose hash recurs are compared.  Of a common
passage such stretches differ only in where they begin and end, so a value keeps few of them however many texts it has.

Defined results: a null text counts as the empty one for the query and stays null in ``without_repeats``; texts shorter
than a window lose nothing; of equal texts all lose everything, repeated rows included; a character that is cut in
two is dropped from the text; other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, materialise, table
from .pieces import Known
from .workers import begin, kept

WIDTH, KMER = 400, 64
#: Bytes of segments that are sorted at once (a value's segments stay together) and from which a value is trimmed.
SORT_BYTES, TRIM_BYTES = 1 << 18, 1 << 20
#: Rows that a task turns into Python objects at once.
ROWS_AT_ONCE = 200
#: Bytes of memory for the words whose hashes a worker knows, and where the places of hashed words begin in spans.
WORDS_KNOWN, WORDS_AT = 32 << 20, 1 << 48
#: Windows of a text that are hashed at once.
WINDOWS_AT_ONCE = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
_powers: list = []


def _power_tables(n: int):
    """BASE ** i and its inverse, modulo 2 ** 64, for i up to n at least."""
    import numpy as np

    if not _powers or len(_powers[0]) <= n:
        size = 1 << max(16, n.bit_length())
        made = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            table = np.full(size, b, np.uint64)
            table[0] = 1
            made.append(np.multiply.accumulate(table))
        _powers[:] = made
    return _powers


def rolling_hashes(data, size: int):
    """A 64-bit hash of every substring of ``size`` bytes; equal substrings have equal hashes."""
    import numpy as np

    up, down = _power_tables(len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])))
    x = (sums[size:] - sums[:-size]) * down[: len(data) - size + 1]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def sliding(x, size: int, best):
    """``best`` (np.minimum or np.maximum) of every ``size`` neighbours, in time that doesn't depend on ``size``."""
    import numpy as np

    n = len(x)
    pad = np.full(-n % size, x[-1], x.dtype)
    rows = np.concatenate((x, pad)).reshape(-1, size)
    ahead = best.accumulate(rows, axis=1).ravel()
    behind = best.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[: n - size + 1], ahead[size - 1 : n])


def window_values(data, width: int):
    """(k-mer hashes, least hash of each window)."""
    import numpy as np

    hashes = rolling_hashes(data, KMER)
    return hashes, sliding(hashes, width - KMER + 1, np.minimum)


def window_chunks(data, width: int):
    """(first window, k-mer hashes, least hashes) of ``WINDOWS_AT_ONCE`` windows after another."""
    n = len(data) - width + 1
    for a in range(0, n, WINDOWS_AT_ONCE):
        yield a, *window_values(data[a : min(a + WINDOWS_AT_ONCE, n) + width - 1], width)


def anchors(data, width: int):
    """(values, places): the least hashes of a text's windows, with how many k-mers of it have them."""
    import numpy as np

    span, places, values = width - KMER + 1, [], []
    edge = np.zeros(span - 1, np.uint64)
    for a, hashes, least in window_chunks(data, width):
        at = np.flatnonzero(hashes == sliding(np.concatenate((edge, least, edge)), span, np.maximum))
        places.append(at + a)
        values.append(hashes[at])
    first = np.unique(np.concatenate(places), return_index=True)[1]  # a k-mer may be the least of windows in two chunks
    return np.unique(np.concatenate(values)[first], return_counts=True)


def runs_of(mask):
    """(first, last) of every stretch of true values."""
    import numpy as np

    change = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return change[::2], change[1::2] - 1


def segments(data, width: int, wanted):
    """(value, first window, last window) of every stretch of windows whose value is among ``wanted``."""
    import numpy as np

    values, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, _, least in window_chunks(data, width):
        at = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        if a and least[0] == values[-1][-1]:  # the stretch goes on
            at = at[1:]
        if len(at):
            values.append(least[at])
            starts.append(at + a)
    values, starts = np.concatenate(values), np.concatenate(starts)
    ends = np.append(starts[1:], len(data) - width + 1) - 1
    chosen = np.isin(values, wanted)
    return values[chosen], starts[chosen], ends[chosen]


def repeated_windows(parts: list[bytes], width: int):
    """For each part, which of its windows occur again at another place of the parts.

    Two-stage suffix sorting up to ``width`` bytes; a part's end counts as less than any byte.
    """
    import numpy as np

    buffer = b"\0".join(parts) + b"\0"
    text = np.frombuffer(buffer, np.uint8)
    place = np.int32 if len(text) < 1 << 31 else np.int64
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    firsts = np.cumsum(lengths + 1) - lengths - 1
    ends, n = firsts + lengths, len(text)
    step = np.sign(np.diff(text.astype(np.int16), append=0)).astype(np.int8)
    step[ends - 1] = -1
    step[ends] = -1
    turn = np.where(step != 0, np.arange(n, dtype=place), place(n))  # the last place of the stretch of equal bytes that each place is in
    turn = np.minimum.accumulate(turn[::-1])[::-1]
    smaller = step[turn] > 0  # than its successor
    next_small = np.minimum.accumulate(np.where(smaller, np.arange(n, dtype=place), place(n))[::-1])[::-1]
    last_window = ends - width
    until = np.minimum(next_small[last_window], ends - 1)  # later suffixes decide no order
    change = np.zeros(n + 1, np.int32)
    change[firsts] += 1
    change[until + 1] -= 1
    needed = np.cumsum(change[:n], dtype=np.int32) > 0
    part_end = np.repeat(ends.astype(place), lengths + 1)

    bounds = np.arange(257)
    direct = np.flatnonzero(needed & smaller)
    direct = direct[np.argsort(text[direct], kind="stable")]
    direct_at = np.searchsorted(text[direct], bounds)
    for a, b in zip(direct_at.tolist(), direct_at[1:].tolist()):  # only one bucket's bytes are copied at a time
        some = direct[a:b]
        keys = [buffer[i:j] for i, j in zip(some.tolist(), np.minimum(some + width, part_end[some]).tolist())]
        if keys:
            direct[a:b] = some[np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)]
    induced = np.flatnonzero(needed & ~smaller)
    induced = induced[np.argsort(text[induced], kind="stable")]
    induced_at = np.searchsorted(text[induced], bounds)
    rank = np.full(n, -1, place)
    for c in range(256):  # a bucket's induced suffixes come before its direct ones
        a, b, x, y = induced_at[c], induced_at[c + 1], direct_at[c], direct_at[c + 1]
        some = induced[a:b]
        if len(some):
            after = turn[some] + 1
            rank[some[np.lexsort((rank[after], after - some))]] = np.arange(a + x, b + x)
        rank[direct[x:y]] = np.arange(b + x, b + y)

    change[:] = 0
    change[firsts] += 1
    change[last_window + 1] -= 1
    windows = np.flatnonzero(np.cumsum(change[:n], dtype=np.int32) > 0)
    order = windows[np.argsort(rank[windows])]
    views = np.lib.stride_tricks.sliding_window_view(text, width)
    left, right = order[:-1], order[1:]
    same = np.ones(len(left), bool)
    for k in (0, width // 2, width - 8):  # most neighbours differ in one of these words
        at = np.flatnonzero(same)
        same[at] = (views[left[at], k : k + 8] == views[right[at], k : k + 8]).all(axis=1)
    at = np.flatnonzero(same)
    for k in range(0, len(at), 5_000):
        some = at[k : k + 5_000]
        same[some] = (views[left[some]] == views[right[some]]).all(axis=1)
    again = np.zeros(n, bool)
    again[left[same]] = True
    again[right[same]] = True
    return [again[a : e - width + 1] for a, e in zip(firsts, ends)]


def slices(batches: Iterator, rows: int | None = None) -> Iterator:
    """The batches in parts of at most ``rows`` rows (``ROWS_AT_ONCE``)."""
    rows = rows or ROWS_AT_ONCE
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def views(raw: bytes, width: int, words: int) -> Iterator[tuple[int, bytes]]:
    """(place of the first byte, bytes) of what is compared of a text: itself and, if asked, its words as hashes."""
    if len(raw) >= width:
        yield 0, raw
    if words:
        size = width // words
        known = kept(("words", size), lambda: Known(lambda w: hashlib.blake2b(w, digest_size=size).digest(), WORDS_KNOWN))
        hashed = b"".join(map(known.__getitem__, raw.split()))
        if len(hashed) >= width:
            yield WORDS_AT, hashed


def word_spans(raw: bytes, firsts: list[int], lasts: list[int], width: int, words: int) -> tuple[list[int], list[int]]:
    """Stretches of windows of hashed words as stretches of the text's bytes; the others as they are."""
    if not firsts or max(firsts) < WORDS_AT:
        return firsts, lasts
    size, found = width // words, []
    places = [m.span() for m in re.finditer(rb"\S+", raw)]
    for a, b in zip(firsts, lasts):
        if a >= WORDS_AT:
            i, j = -((WORDS_AT - a) // size), (b - WORDS_AT) // size + words - 1  # windows that begin where words do
            if j - i < words - 1:
                continue
            a, b = places[i][0], places[j][1] - width
        found.append((a, b))
    return [a for a, _ in found], [b for _, b in found]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("digest"))


def compared(parts: DataFrame, width: int) -> DataFrame:
    """(key, firsts, lasts): the stretches of repeated windows of distinct segments (key, value, copies, part)."""

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def results(rows):
            out = []
            for (key, copies, _), mask in zip(rows, repeated_windows([r[2] for r in rows], width)):
                if copies > 1:
                    mask[:] = True
                a, b = runs_of(mask)
                if len(a):
                    out.append((key, a.tolist(), b.tolist()))
            kinds = (pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 3, kinds)], ["key", "firsts", "lasts"])

        begin("suffixdedup compare")
        rows, size, value = [], 0, None
        for batch in slices(batches):
            for key, v, copies, part in zip(*(batch.column(c).to_pylist() for c in ("key", "value", "copies", "part"))):
                if v != value and size > SORT_BYTES:
                    yield results(rows)
                    rows, size = [], 0
                value = v
                rows.append((key, copies, part))
                size += len(part)
        if rows:
            yield results(rows)

    ordered = parts.select("key", "value", "copies", "part").repartition("value").sortWithinPartitions("value")
    return ordered.mapInArrow(compare, "key binary, firsts array<long>, lasts array<long>")


def trimmed(parts: DataFrame, width: int) -> DataFrame:
    """What ``compared`` gives, for values with very many segments: only windows whose hash recurs are compared."""
    parts = materialise(parts.select("key", "value", "copies", "part"), "large-values")

    def hashed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        begin("suffixdedup trim")
        for some in slices(batches):
            found = [rolling_hashes(np.frombuffer(p, np.uint8), width) for p in some.column("part").to_pylist()]
            owner = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([*(some.column(c).take(owner) for c in ("key", "value", "copies")), pa.array(np.concatenate(found).view(np.int64))], ["key", "value", "copies", "hash"])

    windows = materialise(parts.mapInArrow(hashed, "key binary, value long, copies long, hash long"), "window-hashes")
    again = materialise(windows.groupBy("value", "hash").agg(F.sum("copies").alias("n")).where("n > 1").select("value", "hash"), "hashes")
    wanted = windows.join(again, ["value", "hash"]).groupBy("key").agg(F.collect_set("hash").alias("wanted"))

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        begin("suffixdedup trim")
        for batch in slices(batches):
            rows = []
            for key, value, copies, part, found in zip(*(batch.column(c).to_pylist() for c in ("key", "value", "copies", "part", "wanted"))):
                kept = np.isin(rolling_hashes(np.frombuffer(part, np.uint8), width), np.array(found, np.int64).view(np.uint64))
                for a, b in zip(*(x.tolist() for x in runs_of(kept))):
                    some = part[a : b + width]
                    rows.append((hashlib.blake2b(some, digest_size=16).digest(), value, key, a, copies, some))
            kinds = (pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, kinds)], ["key", "value", "parent", "at", "copies", "part"])

    pieces = materialise(parts.join(wanted, "key").mapInArrow(cut, "key binary, value long, parent binary, at long, copies long, part binary"), "trimmed")
    distinct = pieces.groupBy("key").agg(F.max("value").alias("value"), F.sum("copies").alias("copies"), F.first("part").alias("part"))
    return moved(pieces.select("key", "parent", "at").join(compared(distinct, width), "key"), "parent").withColumnRenamed("parent", "key")


def moved(found: DataFrame, owner: str) -> DataFrame:
    """Stretches of segments that start ``at`` places of their ``owner``, as the owner's stretches."""
    shifted = lambda c: F.flatten(F.collect_list(F.transform(c, lambda x: x + F.col("at"))))
    return found.groupBy(owner).agg(shifted(F.col("firsts")).alias("firsts"), shifted(F.col("lasts")).alias("lasts"))


def repeated_spans(docs: DataFrame, width: int = WIDTH, words: int = 0) -> DataFrame:
    """(digest, firsts, lasts): of each text that loses bytes, the stretches of its repeated windows.

    ``digest`` is the first half of the text's SHA-256.  With ``words``, stretches of hashed words are among them, from
    ``WORDS_AT`` on.
    """
    if words and (width % words or width // words not in range(8, 65)):
        raise ValueError(f"a word must stand as 8 to 64 bytes, not {width} / {words}")
    keyed = _keyed(docs).where(F.octet_length("text") >= min(width, 2 * words - 1 if words else width))

    def find(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        begin("suffixdedup find")
        for batch in slices(batches):
            values, counts, owners = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for _, data in views(text.encode(), width, words):
                    v, n = anchors(np.frombuffer(data, np.uint8), width)
                    values.append(v)
                    counts.append(n)
                    owners.append(np.full(len(v), i))
            if values:
                digests = batch.column("digest").take(pa.array(np.concatenate(owners)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(values).view(np.int64)), digests, pa.array(np.concatenate(counts), pa.int64())], ["value", "digest", "n"])

    found = materialise(keyed.select("text", "digest").mapInArrow(find, "value long, digest binary, n long"), "anchors")
    # aggregates are written before they are joined: only joins of plain inputs are split where a value or text is hot
    again = materialise(found.groupBy("value").agg(F.sum("n").alias("n")).where("n > 1").select("value"), "values")
    wanted = found.join(again, "value").groupBy("digest").agg(F.collect_set("value").alias("values"))
    classes = keyed.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"))
    info = materialise(wanted.join(classes, "digest"), "wanted")
    mine = keyed.join(info, "digest").where(F.col("doc_id").eqNullSafe(F.col("first")))
    mine = mine.select("digest", "text", "values", "copies").dropDuplicates(["digest"])

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        begin("suffixdedup cut")
        sent: set[bytes] = set()
        for batch in slices(batches):
            rows = []
            for digest, text, values, copies in zip(*(batch.column(i).to_pylist() for i in range(4))):
                wanted = np.array(values, np.int64).view(np.uint64)
                for at, data in views(text.encode(), width, words):
                    for v, a, b in zip(*(x.tolist() for x in segments(np.frombuffer(data, np.uint8), width, wanted))):
                        part = data[a : b + width]
                        key = hashlib.blake2b(part, digest_size=16).digest()
                        new = key not in sent
                        if new and len(sent) < 200_000:  # a segment that is sent twice only costs its bytes
                            sent.add(key)
                        rows.append((key, v - (1 << 64) if v >> 63 else v, digest, a + at, copies, len(part) * new, part if new else None))
            kinds = (pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            for k in range(0, len(rows), 20_000):
                columns = zip(*rows[k : k + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["key", "value", "digest", "at", "copies", "size", "part"])

    pieces = materialise(mine.mapInArrow(cut, "key binary, value long, digest binary, at long, copies long, size long, part binary"), "segments")
    parts = pieces.groupBy("key").agg(F.max("value").alias("value"), F.sum("copies").alias("copies"), F.first("part", ignorenulls=True).alias("part"))
    large = materialise(pieces.groupBy("value").agg(F.sum("size").alias("size")).where(F.col("size") > TRIM_BYTES).select("value"), "large")
    if large.isEmpty():
        repeated = compared(parts, width)
    else:
        parts = materialise(parts, "parts")
        repeated = compared(parts.join(large, "value", "left_anti"), width).unionByName(trimmed(parts.join(large, "value", "left_semi"), width))
    return moved(pieces.select("key", "digest", "at").join(repeated, "key"), "digest")


def kept_bytes(raw: bytes, firsts: list[int], lasts: list[int], width: int) -> tuple[bytes, int, int]:
    """(bytes that stay, how many go, in how many maximal runs)."""
    kept, end, spans, removed = [], 0, 0, 0
    for a, b in sorted(zip(firsts, lasts)):
        if a > end or not spans:
            spans += 1
            kept.append(raw[end:a])
            removed += b + width - a
            end = b + width
        elif b + width > end:
            removed += b + width - end
            end = b + width
    kept.append(raw[end:])
    return b"".join(kept), removed, spans


def without_repeats(docs: DataFrame, width: int = WIDTH, words: int = 0) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text``; with ``words``, repeated runs of so many words too."""
    names, schema = docs.columns, docs.schema
    own = {c: free_name(docs, c) for c in ("digest", "firsts", "lasts")}
    digest = F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32))
    spans = materialise(repeated_spans(docs, width, words), "spans").withColumnsRenamed(own)
    joined = docs.withColumn(own["digest"], digest).join(spans, own["digest"], "left").select(*names, own["firsts"], own["lasts"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        begin("suffixdedup remove")
        for batch in slices(batches):
            texts = []
            for text, a, b in zip(*(batch.column(c).to_pylist() for c in ("text", own["firsts"], own["lasts"]))):
                if a:
                    raw = text.encode()
                    text = kept_bytes(raw, *word_spans(raw, a, b, width, words), width)[0].decode("utf-8", "ignore")
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(run, schema)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = materialise(repeated_spans(docs), "spans")
    texts = _keyed(docs)

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        begin("suffixdedup remove")
        for batch in slices(batches):
            rows = []
            for digest, text, a, b in zip(*(batch.column(c).to_pylist() for c in ("digest", "text", "firsts", "lasts"))):
                kept, removed, runs = kept_bytes(text.encode(), a, b, WIDTH)
                rows.append((digest, removed, runs, hashlib.sha256(kept).hexdigest()))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, kinds)], ["digest", "n_removed", "n_spans", "kept_sha256"])

    firsts = texts.groupBy("digest").agg(F.min("doc_id").alias("first"))
    cuts = texts.join(materialise(spans.join(firsts, "digest"), "first-spans"), "digest").where(F.col("doc_id").eqNullSafe(F.col("first")))
    cuts = cuts.select("digest", "text", "firsts", "lasts").mapInArrow(cut, "digest binary, n_removed long, n_spans long, kept_sha256 string")
    cuts = materialise(cuts.dropDuplicates(["digest"]), "cuts")
    rows = texts.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole")).join(cuts, "digest", "left")
    return rows.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
