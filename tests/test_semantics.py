"""Hand-computed cases of the operators' rules."""

import datetime
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspan.functions import records as R
from quillspan.functions import text as X
from quillspan.operators import audit, biblio, evaluate, graph, memory, monitor, rank, recall, relevance, resolve
from quillspan.sources import readers, registry
from quillspan.streaming import journal


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def when(s):
    return F.lit(s).cast("timestamp")


def test_tokens(spark):
    assert one(spark, X.tokens(F.lit("Über café 模型推理 a"))) == ["über", "café", "模型", "型推", "推理", "a"]
    assert one(spark, X.query_terms(F.lit("Über café 模型推理 a café"))) == ["über", "café", "模型", "型推", "推理"]
    assert one(spark, X.query_terms(F.lit("猫 b"))) == ["猫"]
    assert one(spark, X.tokens(F.lit(None).cast("string"))) == []


def test_bm25(spark):
    rows = spark.createDataFrame([(1, "a1 a1 b1"), (2, "b1")], "pos int, body string")
    got = {r.pos: r.score for r in relevance.bm25(rows, [("body", 1.0)], ["a1"]).collect()}
    assert got[1] == pytest.approx(0.8356, abs=1e-4) and got[2] == 0
    assert relevance.filter_rank(rows, [("body", 1.0)], "a", "pos").count() == 2
    assert [r.pos for r in relevance.filter_rank(rows, [("body", 1.0)], "a1", "pos").collect()] == [1]


def test_keys(spark):
    fp = lambda title, url, doi=None: one(spark, X.fingerprint(F.lit(title), F.lit(doi).cast("string"), F.lit(url), F.lit("s"), F.lit("7")))
    assert fp("Short", "https://arxiv.org/abs/2401.01234v2") == "arxiv:2401.01234"
    assert fp("A Long Enough Title, Truly", "") == "title:alongenoughtitletruly"
    assert fp("Short", "x", "https://doi.org/10.1000/AB") == "doi:10.1000/ab"
    assert fp("", "https://www.a.org/x/?q") == "url:a.org/x" and fp("", "") == "id:s:7"
    assert one(spark, X.normal_url(F.lit("HTTPS://www.X.com/a/?q=1#z"))) == "x.com/a"
    assert one(spark, X.name_matches(F.lit("Wenjie Li"), F.lit("Maggie Wenjie Li")))
    assert not one(spark, X.name_matches(F.lit("Zhennan Shen"), F.lit("Zhi-Qiang Shen")))
    assert one(spark, X.statement_type(F.lit("  Works With (many)!"))) == "works_with_many"


def test_identity_union(spark):
    rows = [(0, "s1", "First of the long titles", "10.1/d000"), (1, "s2", "Second of the long titles", "10.1/d000"), (2, "s3", "Second of the long titles", None), (3, "s4", "Third of the long titles", None)]
    docs = spark.createDataFrame([(p, s, str(p), "", t, "x" * p, d, None, None, 0.0, p) for p, s, t, d in rows], "pos long, source string, source_id string, url string, title string, content string, doi string, arxiv string, date timestamp, attention double, backend int")
    found = resolve.survivors(resolve.grouped(docs)).orderBy("grp").collect()
    assert [(r.grp, r.pos, r.members, r.merge_basis, r.corroboration, r.also_in) for r in found] == [(0, 2, 3, "id", 3, ["s1", "s2"]), (3, 3, 1, "title", 1, [])]


def test_ranking_parts(spark):
    rows = spark.createDataFrame([("A", 10.0), ("A", 20.0), ("A", 20.0), ("A", 0.0), ("A", None), ("B", 7.0)], "source string, attention double")
    got = sorted(round(r.eng, 4) for r in rank.engagement(rows).collect())
    assert got == [0, 0, 0.1667, 0.5, 0.6667, 0.6667]
    assert rank.upper_median(spark.createDataFrame([(x,) for x in (0.2, 0.8, 0.4, 0.6)], "r double"), "r").first()["m"] == 0.6
    assert rank.upper_median(spark.createDataFrame([], "r double"), "r").first()["m"] is None
    now = when("2024-03-01")
    assert [round(one(spark, rank.recency(when(d), now)), 6) for d in ("2024-03-01", "2024-01-31", "2025-01-01")] == [1.0, 0.5, 1.0]
    assert [one(spark, rank.freshness(when(d), now)) for d in ("2024-02-29", "2024-02-25", "2024-02-05", "2023-06-01", "2020-01-01", None)] == ["breaking", "recent", "current", "dated", "archival", None]
    ratio = lambda a, b: one(spark, resolve.divergence_ratio(F.lit(float(a)), F.lit(float(b))))
    assert [ratio(*p) for p in ((10, 2), (-10, -2), (0, 3), (-1, 1), (4, 4))] == [5, 5, float("inf"), float("inf"), None]
    base = spark.createDataFrame([(i, 1.0, None, None, 0.0, c) for i, c in enumerate((1, 2, 4, 9))], "pos int, rel double, rrf double, date timestamp, eng double, corroboration int")
    got = [r.composite for r in rank.composite(base, now, True).orderBy("pos").collect()]
    assert [round(x / got[0], 6) for x in got] == [1.0, 1.05, 1.15, 1.15] and got[0] == pytest.approx(0.6 + 0.25 * 0.3)


def test_recall(spark):
    lists = [spark.createDataFrame([(7, r)], "key long, rank int") for r in (1, 2)]
    assert recall.fuse(*lists).first().asDict() == {"key": 7, "rrf": pytest.approx(1 / 61 + 1 / 62), "via": "both"}
    vectors = spark.createDataFrame([(1, [1.0, 0.0], "out"), (2, [0.9, 0.1], "in"), (3, [0.0, 1.0], "in"), (3, [0.5, 0.5], "in"), (4, [0.0, 0.0], "in"), (5, [1.0], "in")], "key long, vector array<double>, scope string")
    assert [r.key for r in recall.vector_search(vectors, [1.0, 0.0], 2, F.col("scope") == "in").collect()] == [2, 3]
    assert recall.vector_search(vectors, [1.0, 0.0], 2, F.lit(False)).count() == 0


def test_passages_and_pages(spark):
    got = one(spark, X.passages(F.lit("T"), F.lit("x" * 5000)))
    assert [len(p) for p in got] == [2002, 1002] and got[0].startswith("T\n")
    assert one(spark, X.passages(F.lit("T"), F.lit("x" * 2000))) == []
    text, at, parts = "line one\n" + "y" * 700 + "\n" + "z" * 900, 0, []
    while at is not None:
        page = one(spark, R.window(F.lit(text), F.lit(at), 600))
        parts.append(page["text"])
        at = page["next"]
    assert "".join(parts) == text and len(parts) > 2
    assert one(spark, X.seconds(F.lit("1:02:03"))) == 3723
    assert one(spark, X.page_text(F.lit("<nav>x</nav><p>A <b>b</b></p><script>1</script>"))) == "A b"
    assert one(spark, X.without_images(F.lit("a ![x](data:image/png;base64,AAA) b"))) == "a  b"
    assert "".join(one(spark, X.hook(F.lit("T"), F.lit("No. The cat sat! A cat and the dog."), F.array(F.lit("cat"), F.lit("dog"))))) == "A cat and the dog."


def test_records(spark):
    body = F.lit('{"a": [{"b": "x"}, {"b": ""}], "m": {"k": {"u": 1}}, "e": [], "n": 3}')
    assert one(spark, R.dig(body, "$.a.0.b")) == "x" and one(spark, R.dig(body, "a.7.b")) is None
    assert one(spark, R.dig_any(body, ["z", "a.1.b", "e", "n"])) == "3"
    assert [one(spark, R.results_state(body, p)) for p in ("a", "e", "m", "n", "q")] == ["rows", "empty", "map", "wrong_type", "absent"]
    assert [one(spark, R.as_boolean(F.lit(v))) for v in ("Yes", "0", "maybe", "on", "N", "")] == [True, False, None, True, False, False]
    assert [one(spark, R.as_whole(F.lit(v))) for v in ("10", "10.7", "x")] == [10, 10, None]
    dates = [one(spark, R.as_date(F.lit(v))) for v in ("2024-01-01T00:00:00Z", "2024/01/01", "20240101", "2024-1-1", "2024-01-01 02:00+0200", "1704067200", "01 Jan 2024", "2024-01", "never", "")]
    assert dates == [datetime.datetime(2024, 1, 1)] * 5 + [None] * 5
    at = lambda v: one(spark, R.date_at(F.lit('{"e": "", "d": %s}' % v), ["e", "d"]))
    assert [at(v) for v in ("1704067200", '"1704067200"', '"2024-01-01"', "0", "true", "[1]", "1e300")] == [datetime.datetime(2024, 1, 1), None, datetime.datetime(2024, 1, 1), datetime.datetime(1970, 1, 1), None, None, None]
    assert one(spark, R.blocked_by(F.lit("<h1>Just a moment</h1>"))) == "just a moment"
    assert one(spark, R.blocked_by(F.lit("Access Denied: checking your browser"))) == "checking your browser"
    assert one(spark, R.blocked_by(F.lit("请进行人机验证"))) == "人机验证"
    assert one(spark, R.blocked_by(F.lit("<script src='/cdn-cgi/challenge/x'></script>"))) == "short_challenge_shell"
    assert one(spark, R.blocked_by(F.lit("<script src='/cdn-cgi/challenge/x'></script>" + "x" * 600))) is None
    assert [one(spark, R.quoted(F.lit(v))) for v in ("plain", 'a: "b"', "")] == ["plain", '"a: \\"b\\""', '""']
    assert one(spark, R.markdown({"source": F.lit("s"), "date": F.lit(None)}, F.lit("T"), F.lit("c"))) == "---\nsource: s\n---\n\n# T\n\nc"
    found = one(spark, R.handles(F.array(F.lit("https://x.org/a.mp3"), F.lit("https://youtu.be/1"), F.lit("https://z.org"))))
    assert found["transcribable"] == ["https://x.org/a.mp3"] and found["captioned"] == ["https://youtu.be/1"]
    assert [one(spark, R.cache_lifetime(F.lit(n), F.lit(900), F.lit(r))) for n, r in ((1, False), (0, True), (0, False))] == [900, 900, 300]
    signals = F.create_map(F.lit("a"), F.struct(F.lit(3.0).alias("value"), F.lit("engagement").alias("kind")), F.lit("b"), F.struct(F.lit(9.0).alias("value"), F.lit("other").alias("kind")))
    assert one(spark, R.first_signal(signals, ["engagement", "citation"])) == 3.0


def test_upsert(spark):
    t = datetime.datetime(2023, 1, 1)
    current = spark.createDataFrame([("s", "1", "h1", 1, t, t, 1, 5), ("s", "2", "h2", 1, t, t, 3, 6), ("s", "3", "h3", 0, t, t, 1, 7)], "source string, source_id string, content_hash string, seg_version int, first_seen timestamp, last_seen timestamp, version int, vector int")
    staged = spark.createDataFrame([("s", "1", "h1", 1, 0), ("s", "2", "new", 1, 0), ("s", "4", "h4", 1, 0)], "source string, source_id string, content_hash string, seg_version int, pos int")
    got = {r.source_id: (r.version, r.vector, r.first_seen.year, r.last_seen.year) for r in memory.upsert(current, staged, when("2024-01-01")).collect()}
    assert got == {"1": (1, 5, 2023, 2024), "2": (4, None, 2023, 2024), "3": (1, 7, 2023, 2023), "4": (1, None, 2024, 2024)}
    once = memory.upsert(current, staged, when("2024-01-01"))
    assert sorted(map(str, memory.upsert(once, staged, when("2024-01-01")).collect())) == sorted(map(str, once.collect()))
    hits = spark.createDataFrame([("s", "1"), ("s", "9")], "source string, source_id string")
    assert {r.source_id: r.seen_before for r in memory.seen_before(hits, current, when("2023-06-01")).collect()} == {"1": True, "9": False}
    assert {r.seen_before for r in memory.seen_before(hits, None, when("2023-06-01")).collect()} == {None}


def test_journal_rules(spark):
    rows = spark.createDataFrame([("o", i, h) for i, h in enumerate("AABA")], "observation_id string, seq long, payload_hash string")
    assert [r.payload_hash for r in memory.journal_events(rows).orderBy("seq").collect()] == ["A", "B", "A"]
    chain = spark.createDataFrame([(1, "", "a"), (2, "a", "b"), (3, "x", "c")], "seq long, prev_hash string, event_hash string")
    assert [r.seq for r in memory.chain_faults(chain).collect()] == [3]


def test_monitor(spark):
    old, new = (spark.createDataFrame(r, "source string, source_id string") for r in ([("page_watch", "x:1"), ("w", "y:1")], [("page_watch", "x:2")]))
    assert monitor.absent(new, old, ["page_watch"]).count() == 0
    assert [r.identity for r in monitor.absent(new.limit(0), old, ["page_watch"]).collect()] == ["x"]
    probes = spark.createDataFrame([("s", 1, False), ("s", 2, None), ("s", 3, False), ("s", 4, True)], "source string, seen long, ok boolean")
    tracked = monitor.streaks(probes)
    assert [r.fails for r in tracked.orderBy("seen").collect()] == [1, 1, 2, 0]
    assert [(r.seen, r.event) for r in monitor.transitions(tracked).orderBy("seen").collect()] == [(3, "down"), (4, "recovered")]
    told = lambda s, now, ran=None: monitor.scheduled(spark.range(1), F.lit(s), when(now), when(ran) if ran else F.lit(None)).first()
    slot, ahead = lambda *a: str(told(*a).slot), lambda *a: str(told(*a).next)
    assert slot("daily@06:30", "2024-03-01 06:00:00") == "2024-02-29 06:30:00"
    assert slot("monthly@31-08:00", "2024-03-01 06:00:00") == slot("weekly@5 00:00", "2024-03-01 06:00:00") == slot("every:60s", "2024-03-01 06:00:00") == "None"
    assert slot("monthly@31-08:00", "2024-04-01 06:00:00") == "2024-03-31 08:00:00"
    assert slot("weekly@FRI-00:00", "2024-03-01 06:00:00") == "2024-03-01 00:00:00" and slot("weekly@sat-00:00", "2024-03-01 06:00:00") == "2024-02-24 00:00:00"
    assert slot("daily@19:17,09:17,14:17", "2024-03-01 15:00:00") == "2024-03-01 14:17:00" and slot("daily@19:17,9:17", "2024-03-01 08:00:00") == "2024-02-29 19:17:00"
    assert ahead("daily@19:17,09:17", "2024-03-01 09:17:00") == "2024-03-01 19:17:00" and ahead("monthly@31-08:00", "2024-03-31 08:00:00") == "None"
    assert ahead("weekly@fri-06:00", "2024-03-01 06:00:00") == "2024-03-08 06:00:00" and ahead("every:60s", "2024-03-01 06:00:00", "2024-02-01 06:00:00") == "2024-03-01 06:00:00"
    bad = ["", "every:0s", "every:5", "daily@", "daily@24:00", "daily@6", "weekly@mon", "weekly@mo-06:00", "weekly@mon-06:00,07:00", "monthly@0-06:00", "monthly@x-06:00", "hourly"]
    assert [one(spark, monitor.parsed_schedule(F.lit(s))) for s in bad] == [None] * len(bad)
    with pytest.raises(Exception, match="not a schedule"):
        one(spark, monitor.checked_schedule(F.lit("hourly")))
    assert told("every:60s", "2024-01-01 00:01:00", "2024-01-01 00:00:00").due and not told("every:60s", "2024-01-01 00:00:59", "2024-01-01 00:00:00").due
    assert not told("daily@06:30", "2024-03-01 07:00:00", "2024-03-01 06:30:00").due and told("daily@06:30", "2024-03-01 07:00:00", "2024-02-20 06:30:00").due
    assert told("every:60s", "2024-01-01 00:01:00").due and not told("hourly", "2024-01-01 00:01:00").due


def test_graph_rules(spark):
    rows = [("B", "A", "coauthored", "M", "m", 1), ("A", "B", "coauthored", "M", "m", 2), ("A", "C", "cites", "J", "m", 1)]
    edges = graph.normal_edges(spark.createDataFrame(rows, "src string, dst string, type string, tier string, method string, first_seen int").withColumn("last_seen", F.col("first_seen")))
    assert [(r.src, r.dst, r.first_seen, r.last_seen) for r in edges.collect()] == [("A", "B", 1, 2)]
    same = spark.createDataFrame([("doc:1", "doc:2", "same_as", "id_eq:doi"), ("doc:2", "work:3", "same_as", "align:title_fp"), ("doc:9", "person:1", "same_as", "id_eq:orcid")], "src string, dst string, type string, method string")
    got = {(r.documents, r.works, r.verdict) for r in graph.voices(same, "conservative").collect()}
    assert got == {(2, 0, "voice"), (1, 0, "unresolved")}
    ruled = spark.createDataFrame([("doc:2", "doc:1", "same"), ("doc:1", "doc:2", "not_same")], "a string, b string, verdict string")
    pairs = lambda policy, r=None: {(e.src, e.dst, e.method) for e in graph.accepted(same, policy, r).collect()}
    by_id, by_title = {("doc:1", "doc:2", "id_eq:doi"), ("doc:9", "person:1", "id_eq:orcid")}, {("doc:2", "work:3", "align:title_fp")}
    assert pairs("conservative", ruled) == pairs("working") == pairs("unheard of", ruled) == by_id and pairs("exploratory") == by_id | by_title
    assert pairs(" Working ", ruled) == {("doc:9", "person:1", "id_eq:orcid")}
    assert pairs("working", spark.createDataFrame([("z", "y", "same")], "a string, b string, verdict string")) == by_id | {("y", "z", "ruling")}
    assert [one(spark, graph.node_kind(F.lit(n))) for n in ("doc:a", "inst:b", "inv:c", "work:d", "e")] == ["document", "institution", "investigation", "work", "unknown"]


def test_biblio(spark):
    papers = [("p1", a) for a in "exy"] + [("p2", a) for a in "exz"] + [("p3", a) for a in ["e", "x", *map(str, range(20))]]
    credit = biblio.coauthor_credit(spark.createDataFrame(papers, "work string, author string"), spark.createDataFrame([("e",)], "author string"))
    top = credit.where("nth = 1").first()
    assert (top.author, round(top.credit, 2), top.papers) == ("x", 0.71, 3)
    works = spark.createDataFrame([("w", ["r", "r", "w"]), ("r", [])], "work string, refs array<string>")
    got = {r.work: (r.in_degree, r.edges, r.seed_refs, r.seed_cites) for r in biblio.citation_degrees(works, spark.createDataFrame([("w",)], "work string")).collect()}
    assert got == {"r": (2, 1, 1, 0), "w": (1, 0, None, None)}
    assert one(spark, biblio.abstract_text(F.from_json(F.lit('{"world": [1], "hello": [0, 2]}'), "map<string,array<int>>"))) == "hello world hello"
    people = spark.createDataFrame([("1", "s", "Ada King"), ("2", "s", "King, Ada"), ("3", "t", "Ada King")], "id string, source string, name string")
    assert [(r.key, r.merged) for r in biblio.likely_same(people, X.name_key(F.col("name"))).collect()] == [("ada king", "1+2")]


def test_evaluate(spark):
    w = one(spark, evaluate.wilson(F.lit(8), F.lit(10)))
    assert (round(w["low"], 3), round(w["high"], 3)) == (0.49, 0.943) and one(spark, evaluate.wilson(F.lit(0), F.lit(0))) is None
    reps = spark.createDataFrame([("a", "pass"), ("a", "fail"), ("a", "pass"), ("b", "skipped"), ("c", "pass"), ("c", "fail"), ("d", "pass"), ("d", "skipped"), ("d", "skipped"), ("e", "pass"), ("e", "skipped"), ("e", "fail"), ("f", "dormant")], "task string, status string")
    assert {r.task: r.status for r in evaluate.majority(reps).collect()} == {"a": "pass", "b": "skipped", "c": "fail", "d": "skipped", "e": "fail", "f": "dormant"}
    rows = spark.createDataFrame([("Ｆｕｌｌ-Width, 3.5\\%", "the fullwidth 3.5% rate"), ("3.5", "35"), ("", "x"), (None, "x"), ("1,000", "cost 1 000"), ("1,000", "cost (1,000)"), ("a-b", "AB"), ("5 %", "5"), ("€5", "5"), ("«a»", "a"), ("3.5", "３．５"), ("Straße", "STRASSE")], "n string, h string")
    assert [r.contained for r in sorted(evaluate.contained(rows.withColumn("i", F.monotonically_increasing_id()), "n", "h").collect(), key=lambda r: r.i)] == [True, False, False, False, False, True, True, True, False, False, True, True]
    odd = ["a,b 1,2 - 3. x\\\\%", " \t1\n2 ", "1,.2", "12:30/1 _", "[x]^{y}`~", "A-1-b 7-8"]
    assert [r.f for r in spark.createDataFrame([(o,) for o in odd], "o string").select(evaluate.ascii_form(F.col("o")).alias("f")).collect()] == list(map(evaluate.plain_form, odd))
    assert evaluate.similar("abcd", "xxabcdxx") == 1.0 and evaluate.similar("", "x") == 0
    assert one(spark, evaluate.in_top(F.array(F.lit("a"), F.lit("https://doi.org/10.1/X")), F.lit("doi:10.1/x"), 2))
    found = lambda got, wanted, k=1: one(spark, evaluate.in_top(F.array(*map(F.lit, got)), F.lit(wanted), k))
    assert found(["https://arxiv.org/pdf/2401.01234v3.pdf?x=1#y"], " arXiv:2401.01234. ") and found(["HTTP://a.org/b/"], "https://A.org/b") and found(["10.1/A.pdf"], "10.1/a")
    assert not found(["arxiv.org/abs/hep-th/9901001", "x"], "x") and found(["q", "arxiv.org/abs/hep-th/9901001v2"], "hep-th/9901001", 2) and not found(["x"], "x", 0)
    assert not found(["https://example.org/2401.01234"], "2401.01234")
    claims = spark.createDataFrame([("a", "p", 0.0, 1), ("a", "q", 2.0, 2), ("a", "r", 8.0, 3), ("a", "r", 80.0, 4), ("b", "p", 0.0, 1), ("b", "q", 2.0, 2)], "item string, provenance string, value double, pos long")
    assert [tuple(r) for r in evaluate.conflicts(claims, 3.0).collect()] == [("a", 4.0)]


def test_audit(spark):
    rules = spark.createDataFrame([("r", "host_suffix", "bad.org", "soft")], "rule string, kind string, value string, severity string")
    rows = spark.createDataFrame([(1, "https://www.a.bad.org/x", "q", True), (2, "https://notbad.org", "q", False), (3, None, None, False)], "id long, url string, query string, discovered boolean")
    assert [(r.id, r.severity) for r in audit.red_lines(rows, rules).collect()] == [(1, "soft")] and [r.severity for r in audit.red_lines(rows, rules, ["r"]).collect()] == ["hard"]
    said = [(None, "403"), (False, "HTTP 403, 429"), (True, "403"), (True, "429 degraded"), (True, "DEGRADED"), (False, "throttling"), (False, None), (True, None), (False, "code 4290")]
    assert [one(spark, audit.probe_class(F.lit(ok).cast("boolean"), F.lit(m).cast("string"))) for ok, m in said] == ["skipped", "blocked", "up", "rate_limited", "degraded", "rate_limited", "down", "up", "down"]
    assert audit.plan(spark.createDataFrame([("a", True, None, ["x"]), ("b", True, "retired", ["x"]), ("c", True, "org_watch_1", ["x"]), ("d", False, None, [])], "name string, enabled boolean, reason string, tokens array<string>"), spark.createDataFrame([("a",)], "name string"), ["x"]).count() == 2


def test_sources(spark, tmp_path):
    answers = spark.createDataFrame([('{"r": [{"u": "http://a", "t": "A", "d": "2024-01-01"}, {"t": "no link"}]}',), ('{"r": []}',), ("{}",), ('{"r": {"k": {"u": "http://b"}}}',)], "body string")
    docs, status = readers.declarative(answers, "src", "r", {"url": ["u"], "title": ["t"], "date": ["d"]})
    assert sorted((r.url, r.title, r.source_id) for r in docs.collect()) == [("http://a", "A", "http://a"), ("http://b", "(no title)", "http://b")]
    assert {r.state: (r.answers, r.rows, r.dropped) for r in status.collect()} == {"rows": (1, 2, 1), "empty": (1, 0, 0), "absent": (1, 0, 0), "map": (1, 1, 0)}
    item = "<item><title>{t}</title><link>http://x/{k}</link><guid>{k}</guid><pubDate>Mon, 01 Jan 2024 00:00:00 +0000</pubDate></item>"
    for name, keys in (("a", "12"), ("b", "23")):
        (tmp_path / f"{name}.xml").write_text("<rss><channel>" + "".join(item.format(t=f"T{k}", k=k) for k in keys) + "</channel></rss>")
    merged = {r.key: len(r.feeds) for r in readers.merged_feeds(readers.feed(spark, str(tmp_path / "*.xml"))).collect()}
    assert merged == {"1": 1, "2": 2, "3": 1}
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("p.csv", 'id;title\n1;"A; b"\n2;C\n')
        z.writestr("o.csv", "project_id;pos;role;name\n1;2;Coordinator;Second\n1;1;coordinator;First\n2;1;partner;P\n")
    projects = readers.archived_csv(spark, str(tmp_path / "x.zip"), "p.csv", "id int, title string")
    organisations = readers.archived_csv(spark, str(tmp_path / "x.zip"), "o.csv", "project_id int, pos int, role string, name string")
    assert sorted((r.id, r.title, r.coordinator) for r in readers.with_coordinator(projects, organisations).collect()) == [(1, "A; b", "First"), (2, "C", None)]
    cube = json.dumps({"dimension": {"time": {"category": {"index": {"2020": 0, "2021": 1}}}}, "value": {"1": 5.5}})
    assert [tuple(r) for r in readers.cube_series(spark.createDataFrame([(cube,)], "body string")).collect()] == [("2021", 5.5)]
    (tmp_path / "n.txt").write_text("\n  Head\nbody")
    assert readers.text_documents(spark, str(tmp_path / "n.txt")).first()["title"] == "Head"


def test_registry(spark):
    known = registry.Registry()

    @known.register("a")
    def a(spark, query, limit):
        """One row."""
        return spark.createDataFrame([("a", query)], "source string, title string")

    with pytest.raises(ValueError):
        known.register("a", a)
    assert known.describe() == {"a": "One row."} and known("a", spark, "q", 1).count() == 1
    with pytest.raises(KeyError):
        known("b")
    registry.SOURCES.register("good", a)
    registry.SOURCES.register("bad", lambda *x: 1 / 0)
    rows, states = registry.search_all(spark, "q")
    assert rows.count() == 1 and dict(states) == {"good": "started", "bad": "failed: ZeroDivisionError"}
    registry.SOURCES.unregister("good")
    registry.SOURCES.unregister("bad")


def write_events(folder, number, rows):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps({"seq": s, "source": "s", "source_id": i, "kind": k, "payload_hash": h, "payload": h, "observed_at": f"2024-01-01T00:00:{s:02d}Z"}) for s, i, k, h in rows]
    (folder / f"{number}.json").write_text("\n".join(lines))


def test_journal_stream(spark, tmp_path):
    store, mark = str(tmp_path / "store"), str(tmp_path / "mark")
    first = [(1, "a", "observation", "A"), (2, "a", "observation", "A"), (3, "b", "observation", "B"), (4, "a", "observation", "C")]
    write_events(tmp_path / "in", 1, first)
    journal.materialise_journal(spark, str(tmp_path / "in"), store, mark)
    got = lambda: {r.source_id: (r.payload_hash, r.version, r.last_seq) for r in journal.read_snapshot(spark, store).collect()}
    assert got() == {"a": ("C", 2, 4), "b": ("B", 1, 3)}
    later = [(5, "b", "tombstone", None), (6, "c", "observation", "D"), (7, "a", "observation", "A")]
    write_events(tmp_path / "in", 2, later)
    journal.materialise_journal(spark, str(tmp_path / "in"), store, mark)
    assert got() == {"a": ("A", 3, 7), "c": ("D", 1, 6)}
    journal.materialise_journal(spark, str(tmp_path / "in"), store, mark)
    assert got() == {"a": ("A", 3, 7), "c": ("D", 1, 6)}
    journal.materialise_journal(spark, str(tmp_path / "in"), str(tmp_path / "again"), str(tmp_path / "other"))
    assert {r.source_id: r.version for r in journal.read_snapshot(spark, str(tmp_path / "again")).collect()} == {"a": 3, "c": 1}


def run_stream(spark, frame, name, mode):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def test_streams_equal_batches(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    obs = events.selectExpr("event_id AS seq", "'s' AS source", "CAST(user_id AS STRING) AS source_id", "sha2(event_type, 256) AS payload_hash")
    obs.repartition(1).write.parquet(str(tmp_path / "obs"))
    stream = spark.readStream.schema(obs.schema).parquet(str(tmp_path / "obs"))
    got = run_stream(spark, journal.appended(stream), "appended", "append").select("seq").collect()
    want = memory.journal_events(obs.withColumnRenamed("source_id", "observation_id")).select("seq").collect()
    assert sorted(got) == sorted(want)
    probes = events.selectExpr("concat('u', user_id % 20) AS source", "event_id AS seen", "CASE WHEN event_type IN ('error', 'purchase') THEN false WHEN event_type = 'view' THEN NULL ELSE true END AS ok")
    probes.repartition(1).write.parquet(str(tmp_path / "probes"))
    stream = spark.readStream.schema(probes.schema).parquet(str(tmp_path / "probes"))
    got = run_stream(spark, journal.health(stream), "health", "append").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, monitor.transitions(monitor.streaks(probes)).collect()))
    hits = events.selectExpr("event_type AS source", "CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 20 AS INT) END AS rank")
    hits.write.parquet(str(tmp_path / "hits"))
    stream = spark.readStream.schema(hits.schema).parquet(str(tmp_path / "hits"))
    got = run_stream(spark, journal.running_yields(stream), "yields", "complete").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, journal.running_yields(hits).collect()))


def test_similar_slides_by_one():
    from difflib import SequenceMatcher

    needle = "thequickbrownfoxjumpsoverthelazydogwhilethecatlooksonand"
    assert evaluate.similar(needle, "sevench" + needle + "tail" * 9) == 1.0
    rng = random.Random(6)
    for _ in range(60):
        text = "".join(rng.choice("abcde") for _ in range(rng.randint(1, 60)))
        n = "".join(rng.choice("abcde") for _ in range(rng.randint(1, 30)))
        windows = [text[i : i + len(n)] for i in range(max(1, len(text) - len(n) + 1))]
        assert evaluate.similar(n, text) == max(SequenceMatcher(None, n, w, autojunk=False).ratio() for w in windows)
