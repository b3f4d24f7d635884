"""Hand-computed cases of curated records, canonical JSON and reference facts."""

import datetime
import hashlib
import json

from pyspark.sql import functions as F

from quillspan.functions import canonical as C
from quillspan.operators import curate


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_canonical(spark):
    text = '{"b": [1, {"Access-Token": "x", "ok": "é"}], "a": null, "cookie": 1, "tokens": 2}'
    rows = spark.createDataFrame([(text,), ("no json",), (None,)], "t string")
    got = [tuple(r) for r in rows.select(C.canonical_json("t"), C.public_json("t")).collect()]
    assert got[0] == (C.canonical(json.loads(text)), '{"a":null,"b":[1,{"ok":"é"}],"tokens":2}') and got[1:] == [(None, None)] * 2
    private = ["token", "__Token__", "my-token", "API Key", "api.key", "apikey", "Set--Cookie", "x_credential", "raw", "é_raw", "a\n_secret"]
    public = ["", "tokens", "mytoken", "x_cookie", "x_credentials", "rawest", "api", "key", "cookie_jar"]
    assert all(map(C.is_private, private)) and not any(map(C.is_private, public))
    want = hashlib.sha256(C.canonical({"source": "s", "source_id": "é/1", "privacy_namespace": "p"}).encode()).hexdigest()
    assert one(spark, C.observation_id(F.lit("s"), F.lit("é/1"), F.lit("p"))) == want
    assert one(spark, C.event_digest(F.lit('{"b": 1, "a": 2}'))) == hashlib.sha256(b'{"a":2,"b":1}').hexdigest()


def test_hosts_and_ids(spark):
    hosts = ["https://www.X.com/a?b", "user@x.com:80/p", "//x.com", "X.com.", None, ""]
    assert [one(spark, curate.canonical_host(F.lit(h).cast("string"))) for h in hosts] == ["x.com"] * 4 + ["", ""]
    assert one(spark, curate.candidate_id(F.lit("A New Source!"), F.array(F.lit("b"), F.lit("a")))) == "a-new-source-" + hashlib.sha256(b"A New Source!|a|b").hexdigest()[:8]
    keys = ["2401.01234v2", "https://arxiv.org/pdf/2401.01234", "10.48550/arXiv.2401.01234", "https://doi.org/10.1/AbC", " Some Title "]
    assert [one(spark, curate.paper_key(F.lit(k))) for k in keys] == ["arxiv:2401.01234"] * 3 + ["doi:10.1/abc", "raw:some title"]
    assert [one(spark, curate.seed_id(F.lit(k))) for k in ("2203.02155", "10.1/x", "https://doi.org/10.1/x/", "abc")] == ["ArXiv:2203.02155", "DOI:10.1/x", "DOI:10.1/x", "abc"]


def test_verdicts(spark):
    verdicts = spark.createDataFrame([("a", "keep", None), ("a", "prune", "redundant"), ("b", "prune", "DEAD"), ("c", "prune", "DEAD"), ("a", "prune", "odd"), ("a", "burn", None)], "name string, verdict string, prune_class string")
    flags = spark.createDataFrame([("a", "tap_blind"), ("a", "other"), ("c", "other")], "name string, flag string")
    got = {(r.name, r.verdict, r.prune_class): (r.recorded, r.forbidden_by) for r in curate.gated_verdicts(verdicts, flags).collect()}
    assert got == {("a", "keep", None): (True, []), ("a", "prune", "redundant"): (False, ["tap_blind"]), ("b", "prune", "DEAD"): (False, ["coverage_unknown"]), ("c", "prune", "DEAD"): (True, []), ("a", "prune", "odd"): (False, []), ("a", "burn", None): (False, [])}


def test_candidates(spark):
    t = datetime.datetime(2023, 1, 1)
    current = spark.createDataFrame([("1", "old", "probed", t)], "id string, name string, state string, created timestamp")
    new = spark.createDataFrame([("1", "newer", 0), ("2", "x", 1)], "id string, name string, pos int")
    got = {r.id: (r.name, r.state, r.created.year) for r in curate.submitted(current, new, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert got == {"1": ("newer", "probed", 2023), "2": ("x", "new", 2024)}
    rows = spark.createDataFrame([("1", "new", ["new"]), ("2", "new", ["new"]), ("3", "new", ["new"])], "id string, state string, history array<string>")
    moves = spark.createDataFrame([("1", "probed"), ("2", "admitted")], "id string, to string")
    edges = spark.createDataFrame([("new", "probed")], "a string, b string")
    got = {r.id: (r.state, r.history, r.refused) for r in curate.moved_on(rows, moves, edges).collect()}
    assert got == {"1": ("probed", ["new", "probed"], False), "2": ("new", ["new"], True), "3": ("new", ["new"], False)}
    base, over = spark.createDataFrame([("a", 1)], "name string, v int"), spark.createDataFrame([("a", 2), ("b", 3)], "name string, v int")
    assert sorted(map(tuple, curate.with_overlay(base, over).collect())) == [("a", 1), ("b", 3)]
    urls = spark.createDataFrame([("https://www.a.org/x",), ("https://b.org",)], "url string")
    assert [r.url for r in curate.untried(urls, spark.createDataFrame([("A.org",)], "url string")).collect()] == ["https://b.org"]
    watched = spark.createDataFrame([(1, ["probed"] * 3, None), (2, ["probed"], t), (3, [], None)], "id int, history array<string>, verdict_at timestamp")
    assert sorted(r.id for r in watched.where(curate.watch_expired(watched, F.lit("2024-01-01").cast("timestamp"))).collect()) == [1, 2]


def test_state_and_rows(spark):
    state = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "name string, value int")
    probed, live = spark.createDataFrame([("a", 9)], "name string, value int"), spark.createDataFrame([("a",), ("b",)], "name string")
    assert sorted(map(tuple, curate.partial_update(state, probed, "name", live).collect())) == [("a", 9), ("b", 2)]
    assert curate.partial_update(state, probed, "name", live.limit(0)).count() == 3
    t = datetime.datetime(2024, 1, 1)
    health = spark.createDataFrame([("a", 2, t), ("b", 1, t), ("c", 5, t - datetime.timedelta(hours=9))], "name string, fails int, as_of timestamp")
    assert [r.name for r in curate.down_set(health, F.lit("2024-01-01 01:00:00").cast("timestamp")).collect()] == ["a"]
    readers = spark.createDataFrame([("x", "index", 0), ("y", "deep", 1), ("z", None, 2)], "name string, depth_class string, pos int")
    assert [r.name for r in curate.reader_order(readers, {"deep": 0, "index": 20}).orderBy("nth").collect()] == ["y", "z", "x"]
    rows = spark.createDataFrame([("a", "1", "yes"), (" ", "x", "maybe"), (None, None, None)], "name string, n string, f string")
    assert [r.p for r in rows.select(curate.problems(["name"], ["n"], ["f"]).alias("p")).collect()] == [[], ["name is missing", "n is no number", "f is no truth value"], ["name is missing"]]


def test_references(spark):
    asked = spark.createDataFrame([("10.1/a",), ("10.1/b",), ("https://doi.org/10.1/C",), ("10.1/a",)], "id string")
    notices = spark.createDataFrame([("doi:10.1/a", "retraction"), ("doi:10.1/a", "gossip"), ("doi:10.1/c", "erratum")], "key string, notice string")
    counts = spark.createDataFrame([("doi:10.1/c", 7)], "key string, citations int")
    got = {r.key: (r.retracted, r.notices, r.citations) for r in curate.enriched(asked, notices, counts).collect()}
    assert got == {"doi:10.1/a": (True, ["retraction"], None), "doi:10.1/b": (None, [], None), "doi:10.1/c": (False, ["erratum"], 7)}
    statements = spark.createDataFrame([("claim:c3_wedge", "topic:wedge"), ("claim:turn_level_credit", None)], "src string, dst string")
    assert [r.id for r in curate.similar_anchors("claim:c3_exact_credit_wedge", statements).collect()] == ["claim:c3_wedge"]
    spans = F.array(F.array(F.lit(0), F.lit(1500)), F.array(F.lit(1500), F.lit(2000)), F.array(F.lit(1), F.lit(2)))
    assert [tuple(s) for s in one(spark, curate.timed_segments(spans, F.array(F.lit(" a "), F.lit(" "))))] == [(0.0, 1.5, "a")]
