"""Carried facts, resolved names, loosened queries, due sensors and cooldowns, on small cases."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from quillspan.operators import identity, monitor, relax, resolve
from quillspan.streaming import alerts


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_survivors_take_what_they_lack(spark):
    member = "grp long, pos long, source string, content string, attention double, doi string, arxiv string, openalex string, authorships array<string>"
    rows = [
        (1, 1, "a", "long text", None, None, "", None, None), (1, 2, "b", "x", 9.0, "", "2401.1", None, None), (1, 3, "c", "y", 9.0, "10.1/z", None, "W3", ["A3"]), (1, 4, "d", "y", 9.0, "10.1/w", None, "W4", ["A4"]),
        (2, 5, "a", "same", None, "10.1/own", None, "W5", []), (2, 6, "b", "same", 0.0, "10.1/other", "2401.2", "W6", ["A6"]), (3, 7, "a", None, None, None, None, None, None),
    ]
    found = {r.grp: r for r in resolve.carried(spark.createDataFrame(rows, member)).collect()}
    assert tuple(found[1]) == (1, 1, None, "2401.1", "b", "W3", ["A3"])
    assert tuple(found[2]) == (2, 5, None, None, None, None, ["A6"])  # no attention and none at all are alike: the first stays
    assert tuple(found[3]) == (3, 7, None, None, None, None, None)


def test_names_are_resolved_but_not_picked(spark):
    asked = spark.createDataFrame([("Ann Lee", " mit ", "p1"), ("Bo Ek", None, ""), ("Nobody", "", "")], "query string, hint string, paper string")
    person = "query string, pos long, id string, source string, name string, works long, institution string"
    rows = [
        ("Ann Lee", 1, "A1", "openalex", "Lee, Ann", 5, "Oslo"), ("Ann Lee", 2, "A2", "openalex", "Ann B. Lee", 2, "MIT Lab"), ("Ann Lee", 3, "A3", "openalex", "Anna Lee", 99, "MIT"), ("Ann Lee", 4, "s", "s2", "ann lee", 5, None),
        ("Bo Ek", 1, "A5", "openalex", "Bo Ek", 10, None), ("Bo Ek", 2, "A6", "openalex", "Bo Ek", 4, None), ("Bo Ek", 3, "A7", "openalex", "Bo Ek", 1, None), ("Nobody", 1, "A8", "openalex", "Somebody", None, None),
    ]
    found = spark.createDataFrame(rows, person)
    order = lambda q, *a, **k: [(r.id, r.anchored, r.ambiguous) for r in identity.resolved(asked, found, *a, **k).where(F.col("query") == q).sort("nth").collect()]
    assert order("Ann Lee") == [("A2", False, True), ("A1", False, True), ("s", False, True), ("A3", False, True)]  # 5 * 2 >= 2: the hint decides who is first
    assert order("Bo Ek") == [("A5", False, False), ("A6", False, False), ("A7", False, False)] and order("Nobody") == [("A8", False, False)]
    papers = spark.createDataFrame([("p1", 1, "A1", "s2", "Ann Lee"), ("p1", 2, "A9", "s2", "A. Lee"), ("p1", 3, None, "s2", "Ann Lee"), ("p2", 1, "A5", "s2", "Bo Ek")], "paper string, pos long, id string, source string, name string")
    assert order("Ann Lee", papers) == [("A1", True, False), ("A2", False, False), ("s", False, False), ("A3", False, False)]
    tokens = spark.createDataFrame([("Ann Lee",), ("Nobody",), (" A12+ A13",), ("123456",), ("12345",), ("A1+x",)], "token string")
    picked = {r.token: (r.ids, r.source, r.alternatives) for r in identity.picked(tokens, identity.resolved(asked, found)).collect()}
    assert picked == {"Ann Lee": (["A2"], "openalex", ["A1"]), "Nobody": (None, None, []), " A12+ A13": (["A12", "A13"], "openalex", []), "123456": (["123456"], "s2", []), "12345": (None, None, []), "A1+x": (None, None, [])}


def test_ladders():
    assert relax.ladder("how long does PGWP take without a Canadian employer") == [["long", "PGWP", "Canadian", "employer"], ["PGWP", "Canadian"], ["PGWP"]]
    assert relax.ladder("the of") == [["the", "of"], ["the"]] and relax.ladder("of") == [["of"]] and relax.ladder(" ") == [] and relax.ladder("k8s pods") == [["k8s", "pods"], ["k8s"]]


def test_relaxed_takes_the_tightest_step_with_enough(spark):
    texts = ["PGWP for a Canadian employer (long)", "pgwp, canadian", "PGWP2 Canadian", "my PGWP.", None, "", "a.b c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    ids = lambda q, **k: sorted((r.id, r.tier) for r in relax.relaxed(docs, "t", q, **k).collect())
    query = "long PGWP Canadian employer"
    assert ids(query) == [(0, 0)] and ids(query, least=2) == [(0, 1), (1, 1)] and ids(query, least=3) == [(0, 2), (1, 2), (3, 2)]
    assert ids(query, least=4) == [] == ids("nothing") == ids(" ") and ids("a.b") == [(6, 0)]


def test_qualifiers(spark):
    ask = lambda q: tuple(one(spark, relax.qualified(F.lit(q))))
    assert ask("sub:A,b,a,, k") == ("k", ["A", "b"], False) and ask(" Comments : x subreddit : Q ") == ("x", ["Q"], True) and ask("sub:, z") == ("sub:, z", None, False) and ask(None) == ("", None, False)


def test_due_sensors(spark):
    rows = [(1, "hourly", "2024-01-01T23:00:00Z"), (2, "hourly", "2024-01-01T23:00:01+00:00"), (3, "typo", "2024-01-01T12:00:00Z"), (4, "weekly", None), (5, "weekly", "soon"), (6, " WEEKLY ", "2023-12-26T00:00:00Z")]
    due = monitor.due_sensors(spark.createDataFrame(rows, "id long, schedule string, last_run_at string"), F.lit("2024-01-02").cast("timestamp"))
    assert sorted(r.id for r in due.collect()) == [1, 4, 5, 6]


def brute_told(rows, seconds):
    last, out = {}, []
    for key, title, at in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if key not in last or (at - last[key]).total_seconds() >= seconds:
            last[key] = at
            out.append((key, title, at))
    return sorted(out)


def stamped(rng, n, start):
    return [(rng.choice("ab"), f"t{i}", start + datetime.timedelta(seconds=rng.randint(0, 3000))) for i in range(n)]


def test_cooldown_of_tables(spark):
    rows = stamped(random.Random(1), 80, datetime.datetime(2024, 1, 1))
    df = spark.createDataFrame([*rows, (None, "x", rows[0][2])], "key string, title string, at timestamp")
    for seconds in (1, 300, 10_000):
        assert sorted(map(tuple, alerts.told_once(df, seconds).collect())) == brute_told(rows, seconds)
    assert alerts.told_once(df.limit(0), 5).collect() == []


def test_cooldown_of_streams_outlives_a_restart(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", alerts.STATE_STORE)
    try:
        rng, start, seconds = random.Random(2), datetime.datetime(2024, 1, 1), 900
        rounds = [sorted(stamped(rng, 12, start + datetime.timedelta(seconds=3000 * k)), key=lambda r: r[2]) for k in range(3)]
        for k, rows in enumerate(rounds):  # each round is a query of its own over the same checkpoint
            (tmp_path / "in").mkdir(exist_ok=True)
            (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"key": a, "title": b, "at": c.isoformat()}) for a, b, c in rows))
            stream = spark.readStream.schema("key string, title string, at timestamp").json(str(tmp_path / "in"))
            query = alerts.cooled(stream, seconds, "2 hours").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            query.awaitTermination()
        told = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
        assert told == brute_told([r for rows in rounds for r in rows], seconds) != []
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
