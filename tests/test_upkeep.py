"""Caches that end, backlogs that resume, journals that a crash left."""

import datetime
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quillspan.operators import upkeep
from quillspan.streaming import repair

DAY = datetime.datetime(2024, 1, 1)


def at(hours):
    return F.lit(DAY + datetime.timedelta(hours=hours)).cast("timestamp")


def test_cache_ends_and_purges_whole_folders(spark, tmp_path):
    cache = upkeep.Cache(spark, f"file://{tmp_path}/cache", 3600)
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("a",), ("none",)], "key string")
    assert cache.hits(keys, at(0)).count() == 0 and cache.purge(at(0)) == 0
    row = lambda k, v, h: (k, v, DAY + datetime.timedelta(hours=h))
    put = lambda rows, h: cache.put(spark.createDataFrame(rows, "key string, value string, expires_at timestamp"), at(h))
    put([row("a", "old", 9), row("b", "x", 1.5), row("c", None, 5)], 0)
    put([row("a", "new", 3)], 0.5)
    got = lambda h, **k: sorted((r.key, r.value) for r in cache.hits(keys, at(h), **k).collect())
    assert got(1) == [("a", "new"), ("b", "x"), ("c", None)] and got(1.5) == got(1) and got(1.6) == [("a", "new"), ("c", None)]
    assert got(1, margin=3600) == [("a", "new"), ("c", None)] and got(1, fresh=True) == []
    assert got(4) == [("a", "old"), ("c", None)]
    assert cache.purge(at(2)) == 1 and cache.purge(at(2)) == 0 and cache.entries().count() == 3 and got(2) == [("a", "new"), ("c", None)]


def test_catch_up_resumes_and_does_nothing_twice(spark, tmp_path):
    path, made = f"file://{tmp_path}/done", []

    def make(page):
        made.extend(r.key for r in page.collect())
        return page.select("key", F.upper("text").alias("result"))

    todo = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "  ", None, "c", "d", "e"])], "key long, text string")
    assert upkeep.catch_up(todo, path, make, "m1", page=2, most=1) == 1 and made == [0, 1]

    def dies(page):
        make(page)
        raise RuntimeError

    with pytest.raises(RuntimeError):
        upkeep.catch_up(todo, path, dies, "m1", page=2)
    made.clear()
    late = todo.union(spark.createDataFrame([(-1, "late")], "key long, text string"))  # behind the cursor
    assert upkeep.catch_up(late, path, make, "m1", page=2) == 3 and made == [4, 5, 6, -1]
    done = spark.read.parquet(path)
    assert sorted((r.key, r.result) for r in done.collect()) == [(-1, "LATE"), (0, "A"), (1, "B"), (4, "C"), (5, "D"), (6, "E")]
    assert upkeep.catch_up(late, path, make, "m1") == 0 and upkeep.catch_up(late, path, make, "m2", page=4) == 2
    assert upkeep.catch_up(late.limit(0), f"{path}-none", make, "m1") == 0


def event(seq, prev, **changes):
    made = {"kind": "observation", "seq": seq, "prev_hash": prev, "observation_id": "o", "source": "s", "source_id": "é", "observed_at": 1.5, "provenance": "p", "privacy_namespace": "public", "lane": "full", "payload_hash": "h"} | changes
    made["event_hash"] = hashlib.sha256(json.dumps(made, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    return made


def chain(n):
    out, prev = [], ""
    for seq in range(1, n + 1):
        out.append(event(seq, prev))
        prev = out[-1]["event_hash"]
    return out


def written(tmp_path, name, *parts):
    folder = tmp_path / name
    folder.mkdir()
    for i, part in enumerate(parts):
        (folder / f"{i:03d}.jsonl").write_bytes(part)
    return f"file://{folder}"


def as_lines(events):
    return "".join(json.dumps(e, ensure_ascii=False) + "\n" for e in events).encode()


def test_journal_repair(spark, tmp_path):
    five = chain(5)
    whole = as_lines(five)
    seqs = lambda path: [r.seq for r in repair.events(spark, path).sort("seq").collect()]
    assert seqs(written(tmp_path, "sound", as_lines(five[:2]), as_lines(five[2:]))) == [1, 2, 3, 4, 5]
    assert seqs(written(tmp_path, "no-end", whole[:-1])) == [1, 2, 3, 4, 5]  # only the line's end was lost
    cut = written(tmp_path, "torn", whole[:-30])
    assert seqs(cut) == [1, 2, 3, 4]
    assert [r.at for r in repair.torn(repair.lines(spark, cut)).collect()] == [len(as_lines(five[:4]))]
    assert seqs(written(tmp_path, "empty", b"")) == []
    broken = {
        "inside": as_lines(five[:2]) + b"{torn\n" + as_lines(five[2:]), "gap": as_lines([*five[:2], *five[3:]]), "twice": as_lines([*five, five[4]]), "link": as_lines([*five[:4], event(5, "wrong")]),
        "hash": whole.replace(b'"lane": "full"', b'"lane": "thin"', 1), "kind": as_lines([event(1, "", kind="other")]), "payload": as_lines([event(1, "", kind="tombstone")]), "list": b"[1]\n", "utf8": b"\xff\xfe\n" + whole,
    }
    for name, content in broken.items():
        with pytest.raises(ValueError, match="corrupt"):
            repair.events(spark, written(tmp_path, name, content))
    tombstone = [five[0], event(2, five[0]["event_hash"], kind="tombstone", payload_hash=None)]
    assert seqs(written(tmp_path, "tombstone", as_lines(tombstone))) == [1, 2]
