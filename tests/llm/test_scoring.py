"""Words, importance resampling, quality and divergence against brute force on small tables with odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillspan.llm import divergence, importance, quality, words

SCHEMA = "doc_id long, text string, lang string, source string, SCORE int, term int"
LETTERS, LETTERS_DIGITS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize(("pattern", "inside"), [(LETTERS, words.letters_only), (LETTERS_DIGITS, words.letters_and_digits)])
def test_words_are_those_of_the_pattern(pattern, inside):
    rng = random.Random(1)
    for _ in range(300):
        texts = [rng.choice([None, "", "a" * rng.randint(0, 30), "".join(rng.choice("aBZ09 -é漢😀{`@[/:\n\x7f\x80") for _ in range(rng.randint(0, 60)))]) for _ in range(rng.randint(0, 6))]
        want = [(i, w.encode()) for i, t in enumerate(texts) for w in re.findall(pattern, lower(t))]
        for block in (1, 3, 7, 1000):
            column = pa.array(["cut off", *texts], pa.string())[1:]
            assert [(int(r), w) for rows, found in words.split(column, inside(), block) for r, w in zip(rows, found.to_pylist())] == want


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    vocabulary = ["the", "The", "of", "naïve", "漢字", "x1", "2024", "b", "cd", "Éa", "éa"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, text(rng.choice([0, 3, 25, 60])), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "é", None])) for i in range(60)]
    rows += [(100 + i, rows[5][1] or "the", "en", "hot") for i in range(30)]  # copies
    rows += [(200, None, "fr", "a"), (201, "", "fr", "b"), (202, "?!", "xx", "alone"), (7, rows[7][1], "en", "a"), (7, rows[7][1], "en", "a"), (None, "the of the", None, None), (203, "longword" * 700_000, "en", "a"), (204, "the of " * 200_000, "de", "b")]
    return spark.createDataFrame([(*r, None, 1) for r in rows], SCHEMA).cache()


def brute_importance(rows, target, percent=10, least=20):
    each = [re.findall(LETTERS_DIGITS, lower(t)) for _, t in rows]
    bucket = lambda w: zlib.crc32(w.encode()) % 10_000
    s = collections.Counter(bucket(w) for e in each for w in e)
    t = collections.Counter(bucket(w) for x in target for w in re.findall(LETTERS_DIGITS, lower(x)))
    held, wanted = sum(s.values()), sum(t.values())
    out = []
    for (i, _), e in zip(rows, each):
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (held + 10_000) / ((s[b] + 1) * (wanted + 10_000)))) for b in map(bucket, e))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(e), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = collections.defaultdict(list)
    for k, r in enumerate(able[: percent * len(able) // 100]):
        drawn[r].append(k + 1)
    return sorted(((*r, drawn[r].pop(0) if drawn[r] else None) for r in out), key=str)


@pytest.mark.parametrize("percent", [10, 60, 100])
def test_importance(spark, docs, percent):
    target = [None, "The of of x1", "of 2024 unseen"]
    found = importance.importance_ranks(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent)
    assert found.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, found.collect()), key=str) == brute_importance(rows, target, percent)


def test_importance_of_nothing(spark, docs):
    none = docs.select("text").limit(0)
    assert importance.importance_ranks(docs.limit(0), none).collect() == []
    assert importance.importance_ranks(docs, none).count() == docs.count()
    assert importance.resample(docs, none, percent=50).columns == docs.columns


def brute_divergence(rows):
    groups, holds, counts = set(), collections.Counter(), collections.Counter()
    for text, lang, source in rows:
        lang, source, found = lang or "", source or "", re.findall(LETTERS, lower(text))
        groups.add((lang, source))
        holds.update((lang, w) for w in set(found))
        counts.update((lang, source, w) for w in found)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [w for (x, w), n in holds.items() if x == lang and n >= 3]
        sources = [s for x, s in groups if x == lang]
        share = lambda n, total: 1 + 10**9 * (n + 1) // (total + len(kept))  # noqa: B023, E731
        total = {s: sum(counts[lang, s, w] for w in kept) for s in sources}
        p = {s: {w: share(counts[lang, s, w], total[s]) for w in kept} for s in sources}
        q = {w: share(sum(counts[lang, s, w] for s in sources), sum(total.values())) for w in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(f(p[s][w], p[o][w]) for w in kept), o.encode()) for o in sources if o != s]
            terms = [(-f(p[s][w], q[w]), w.encode()) for w in kept if counts[lang, s, w] and p[s][w] > q[w]]
            out += [(lang, s, "pair", i.decode(), -v, k + 1) for k, (v, i) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", i.decode(), -v, k + 1) for k, (v, i) in enumerate(sorted(terms)[:200])]
    return sorted(out)


@pytest.mark.parametrize("pairs", [1, 1 << 20])
def test_divergence(docs, monkeypatch, pairs):
    monkeypatch.setattr(divergence, "PAIRS", pairs)
    found = divergence.divergence(docs)
    assert [t for _, t in found.dtypes] == ["string"] * 4 + ["bigint", "int"]
    assert sorted(map(tuple, found.collect())) == brute_divergence([(r.text, r.lang, r.source) for r in docs.collect()])
    assert divergence.divergence(docs.limit(0)).collect() == []


def test_divergence_keeps_runs_together_over_batches(spark, docs):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = divergence.divergence(docs).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, found)) == brute_divergence([(r.text, r.lang, r.source) for r in docs.collect()])


def brute_score(network, text):
    """One place, one filter at a time."""
    w, b = network.weights, (text or "").encode()
    starts = [0] if len(b) <= 256 else sorted({min(192 * k, len(b) - 256) for k in range(1 + -(-(len(b) - 256) // 192))})
    assert {i for s in starts for i in range(s, min(s + 256, len(b)))} == set(range(len(b)))  # all of it is read
    top = np.zeros(quality.HIDDEN)
    for s in starts:
        chunk = b[s : s + 256] + bytes(256 - len(b[s : s + 256]))
        seen = [w["bytes"][list(chunk[k : k + 8])].ravel().astype(float) for k in range(0, 249, 2)]
        pooled = [max(0, max(float(x @ w["filters"][:, f]) for x in seen) + w["offsets"][f]) for f in range(quality.FILTERS)]
        top = np.maximum(top, np.array([*pooled, len(b[s : s + 256]) / 256]) @ w["hidden"] + w["hidden_offsets"])
    return 1 / (1 + math.exp(-(top @ w["out"] + w["out_offset"][0])))


def test_quality_reads_every_byte(spark):
    rng = random.Random(4)
    texts = [None, "", "a", "é" * 100, "x" * 256, "y" * 257] + ["".join(rng.choice("ab é!\n") for _ in range(n)) for n in (255, 448, 449, 700, 3000)]
    network = quality.Network(3)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "a", "clash")], "doc_id long, text string, score string")
    found = {r.doc_id: r.score for r in quality.score(docs, network).collect()}
    assert len(found) == len(texts) + 1
    for i, text in enumerate(texts):
        assert found[i] == pytest.approx(brute_score(network, text), abs=1e-5)


def test_quality_gradients():
    network = quality.Network(5)
    data, offsets = words.text_bytes(pa.array(["good words here " * 40, "BAD!! " * 90, "short"]))
    labels = np.array([1, 0, 1], np.float32)
    loss = lambda: -np.mean(np.log(np.where(labels == 1, s := network.score(data, offsets), 1 - s)))
    before = loss()
    for _ in range(60):
        network.learn(data, offsets, labels, 0.01)
    assert loss() < before / 3


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (2, "b")], "doc_id long, text string")
    labels = "doc_id long, quality int"
    assert [r.score for r in quality.quality_scores(docs, spark.createDataFrame([], labels)).collect()] == [0.5] * 3
    assert {r.score for r in quality.quality_scores(docs, spark.createDataFrame([(1, 1), (2, 1), (2, None), (None, 0)], labels)).collect()} == {1.0}
    assert quality.quality_scores(docs.limit(0), spark.createDataFrame([(1, 1)], labels)).collect() == []


def test_op12_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    found = quality.op12_quality(spark, sf)
    assert found.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = {r.doc_id: r for r in found.collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in rows.items())
    held = [(r.quality, rows[r.doc_id]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    good, bad = ([r.score for q, r in held if q == mark] for mark in (1, 0))
    assert sum(r.predicted == q for q, r in held) / len(held) > 0.93
    assert np.mean([[g > b for g in good] for b in bad]) > 0.97  # a good document is ranked above a bad one
