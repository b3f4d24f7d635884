"""The store changes as a whole: what a batch brings, and what is left of one that dies."""

import datetime

import pytest
from pyspark.sql import functions as F

from quillspan.operators import store as S

DOC = "pos long, source string, source_id string, url string, title string, fp string, content_hash string, seg_version int"
THIN = "pos long, source string, source_id string, url string, title string, fp string, doi string, arxiv_id string, openalex_id string"
NODE = "pos long, id string, kind string, label string, attrs map<string, string>"
EDGE = "pos long, src string, dst string, type string, tier string, method string, attrs map<string, string>"
DAY = [datetime.datetime(2024, 1, n) for n in range(1, 9)]


def at(n):
    return F.lit(DAY[n]).cast("timestamp")


@pytest.fixture
def store(spark, tmp_path):
    return S.Store(spark, f"file://{tmp_path}/store", 4)


def docs(spark, *rows):
    return spark.createDataFrame([(n, "s", i, None, f"title {h}", "fp", h, v) for n, (i, h, v) in enumerate(rows)], DOC)


def test_versions_follow_changes(spark, store):
    assert store.read("documents").count() == 0 and store.manifest() is None
    store.apply(S.Batch(documents=docs(spark, ("a", "1", 1), ("b", "1", 1), (None, "1", 1))), at(0))
    store.apply(S.Batch(documents=docs(spark, ("a", "1", 1), ("b", "2", 1), ("b", "3", 1), ("b", "3", 1), ("c", "1", 1))), at(1))
    store.apply(S.Batch(documents=docs(spark, ("a", "1", 2))), at(2), seq=7, event_hash="x")
    found = {r.source_id: (r.content_hash, r.version, r.first_seen, r.last_seen) for r in store.read("documents").collect()}
    assert found == {"a": ("1", 2, DAY[0], DAY[2]), "b": ("3", 3, DAY[0], DAY[1]), "c": ("1", 1, DAY[1], DAY[1])}
    m = store.manifest()
    assert (m["version"], m["seq"], m["event_hash"]) == (3, 7, "x")
    store.apply(S.Batch(), at(3))
    assert store.manifest()["seq"] == 7 and store.read("documents").count() == 3


def test_graph_rows_and_tombstones(spark, store):
    thin = spark.createDataFrame([(0, "t", "1", "u", " \u00a0 x\u2003", "title:x", "10.1/x", "", None), (1, "t", None, "http://u", " \u00a0 ", "f", None, None, None)], THIN)
    nodes = spark.createDataFrame([(0, "p:1", "person", "Old", {"k": "1"}), (1, "p:1", "other", "New", {}), (2, " ", "person", "none", None), (3, "p:2", "", "none", None)], NODE)
    edges = spark.createDataFrame([(0, "z", "doc:t:1", "conflicts", "M", "m", {"a": "1"}), (1, "doc:t:1", "z", "conflicts", "A", "m", None), (2, "a", "b", "cites", "J", "m", None), (3, "b", "a", "cites", "A", "m", None), (4, "a", "doc:s:full", "cites", "M", "m", None), (5, "", "b", "cites", "M", "m", None)], EDGE)
    store.apply(S.Batch(documents=docs(spark, ("full", "1", 1)), thin=thin, nodes=nodes, edges=edges), at(0))
    kept = {r.id: (r.kind, r.label, r.attrs) for r in store.read("nodes").collect()}
    assert kept == {"doc:t:1": ("document", "x", {"url": "u", "fp": "title:x", "doi": "10.1/x"}), "doc:t:http://u": ("document", None, {"url": "http://u", "fp": "f"}), "p:1": ("person", "New", None)}
    assert sorted((r.src, r.dst, r.type, r.tier) for r in store.read("edges").collect()) == [("a", "doc:s:full", "cites", "M"), ("b", "a", "cites", "A"), ("doc:t:1", "z", "conflicts", "M")]
    gone = spark.createDataFrame([("t", "1"), ("s", "full"), ("never", "seen")], "source string, source_id string")
    store.apply(S.Batch(tombstones=gone, edges=edges.where("pos = 3")), at(1))
    assert store.read("documents").count() == 0
    assert {r.id for r in store.read("nodes").collect()} == {"doc:t:http://u", "p:1"}
    # a full document has no node, so its edges stay
    assert sorted((r.src, r.dst, r.first_seen, r.last_seen) for r in store.read("edges").collect()) == [("a", "doc:s:full", DAY[0], DAY[0]), ("b", "a", DAY[0], DAY[1])]


def test_a_batch_that_dies_leaves_the_version_before_it(spark, store, monkeypatch):
    marks = lambda n, when: spark.createDataFrame([("s", DAY[when], n)], "source string, ran_at timestamp, doc_count long")
    store.apply(S.Batch(documents=docs(spark, ("a", "1", 1)), marks=marks(1, 0)), at(0))
    nodes = spark.createDataFrame([(0, "p:1", "person", "One", None)], NODE)
    second = S.Batch(documents=docs(spark, ("a", "2", 1), ("b", "1", 1)), nodes=nodes, marks=marks(2, 1))
    for broken in ("publish", "touched"):
        with monkeypatch.context() as m:
            calls = []

            def die(*a, real=getattr(store, broken), **k):
                calls.append(a)
                if broken == "publish" or a[0] == "nodes":
                    raise RuntimeError("killed")
                return real(*a, **k)

            m.setattr(store, broken, die)
            with pytest.raises(RuntimeError):
                store.apply(second, at(1))
        assert calls and [(r.source_id, r.content_hash) for r in store.read("documents").collect()] == [("a", "1")]
        assert store.read("nodes").count() == 0 and store.read("marks").first().doc_count == 1
    before = store.manifest()
    store.apply(second, at(1))  # the same batch again
    assert {(r.source_id, r.version) for r in store.read("documents").collect()} == {("a", 2), ("b", 1)}
    assert store.read("nodes").count() == 1 and store.read("marks").first().doc_count == 2
    assert [(r.source_id, r.version) for r in store.read("documents", before).collect()] == [("a", 1)]  # a reader that began earlier


def test_untouched_buckets_stay_and_old_ones_are_emptied(spark, store):
    store.apply(S.Batch(documents=docs(spark, *((str(i), "1", 1) for i in range(40)))), at(0))
    store.apply(S.Batch(documents=docs(spark, ("3", "2", 1))), at(1))
    folders = store.manifest()["folders"]["documents"]
    assert sorted(folders.values()).count(2) == 1 and len(folders) == 4
    store.apply(S.Batch(documents=docs(spark, ("3", "3", 1))), at(2))
    assert store.expire(1) == 2
    assert store.read("documents").count() == 40 and store.manifest()["version"] == 3
    store.apply(S.Batch(documents=docs(spark, ("x", "3", 1))), at(3))
    assert store.read("documents").count() == 41
