"""Statements and the views over stored, derived and stated edges, on small graphs."""

import contextlib
import datetime
import io

import pytest
from pyspark.sql import functions as F

from quillspan.operators import evidence, statements
from quillspan.operators.keyindex import KeyIndex

REQUEST = "seq long, op string, src string, dst string, type string, note string, doc string, stated_at string"
NO_TIME = datetime.datetime(2024, 1, 1)


def asked(spark, *rows):
    return spark.createDataFrame([(n, *r, None, f"2024-01-{n + 1:02d}T00:00:00Z") for n, r in enumerate(rows)], REQUEST)


def triples(df):
    return sorted((r.src, r.dst, r.type, r.note) for r in df.collect())


def test_statements_are_state_by_directed_triple(spark):
    first = statements.settled(None, asked(spark, ("save", "a", "b", "Advises on", "n1"), ("save", "b", "a", "advises_on", "other way"), ("save", "a", "b", " ADVISES  on ", "n2"), ("save", "c", "d", "t", "x"), ("delete", "c", "d", "T", None)))
    assert triples(first) == [("a", "b", "advises_on", "n2"), ("b", "a", "advises_on", "other way")]
    again = statements.settled(first, asked(spark, ("delete", "b", "a", "advises on", ""), ("delete", "never", "said", "t", ""), ("save", "c", "d", "t", "back")))
    assert triples(again) == [("a", "b", "advises_on", "n2"), ("c", "d", "t", "back")]
    assert triples(statements.settled(first, asked(spark).limit(0))) == triples(first)


def test_refused_statements(spark):
    rows = [("save", " ", "b", "t", "n"), ("save", "a", "b", "?!", "n"), ("save", "a", "b", "x" * 41, "n"), ("save", "a", "b", "Same as", "n"), ("save", "a", "b", "not-same_as", "n"), ("save", "a", "b", "t", "  "), ("delete", "a", "b", "t", None), ("save", "a", "b", "x" * 40, "n"), ("save", "a", "b", None, "n")]
    found = [r.refused for r in statements.checked(asked(spark, *rows)).sort("seq").collect()]
    assert found == ["no ends", "no type", "long type", "identity", "identity", "no note", None, None, "no type"]
    assert triples(statements.settled(None, asked(spark, *rows))) == [("a", "b", "x" * 40, "n")]


@pytest.fixture(scope="module")
def graph(spark):
    node = lambda i, label, day: (i, i.split(":")[0], label, NO_TIME + datetime.timedelta(days=day))
    nodes = spark.createDataFrame([node("person:a", "Ann", 3), node("person:b", "Bo", 2), node("work:doi:10.1/x", "X", 9), node("hub:h", None, 5), *(node(f"person:h{i}", f"H{i}", 0) for i in range(12))], "id string, kind string, label string, last_seen timestamp")
    edge = lambda s, d, t="knows", m="tap", tier="M", day=0: (s, d, t, tier, m, NO_TIME + datetime.timedelta(days=day))
    edges = [edge("person:a", "hub:h", day=1), edge("person:b", "hub:h", day=5), *(edge(f"person:h{i}", "hub:h") for i in range(12)), edge("person:a", "work:doi:10.1/x", "authored", day=9), edge("person:a", "person:b", "same_as", "id_eq:orcid", "A", 2), edge("person:a", "person:h1", "same_as", "align:name_match", "A", 3)]
    docs = [("doc:s:1", "One title", "title:onetitle", None, " 10.1/X ", None, NO_TIME), ("doc:t:2", "One  title", "title:onetitle", None, None, None, NO_TIME), ("doc:t:3", "Three", "url:x", "W3", None, "2401.1", NO_TIME), ("doc:u:4", "Alone", "url:y", None, None, None, NO_TIME)]
    rulings = [("person:b", "person:a", "not_same"), ("person:a", "person:b", "same"), ("person:h2", "person:b", "same"), ("doc:t:3", "doc:u:4", "same")]
    said = [("person:b", "claim:label:big wedge", "refutes", "why", "doc:s:1", "2024-02-01T00:00:00+00:00"), ("person:b", "person:a", "advises", "so", "", "2024-03-01"), ("person:b", "", "x", "y", "", "2024-03-01")]
    return evidence.Evidence(
        nodes, spark.createDataFrame(edges, "src string, dst string, type string, tier string, method string, first_seen timestamp"),
        spark.createDataFrame(docs, "id string, title string, fp string, openalex string, doi string, arxiv string, last_seen timestamp"),
        spark.createDataFrame(rulings, "a string, b string, verdict string"), spark.createDataFrame(said, "src string, dst string, type string, note string, doc string, stated_at string"),
    )


def edges_of(sub):
    return sorted((r.src, r.dst, r.method) for r in sub.edges.collect())


def test_a_policy_says_what_a_hop_unites(graph):
    around = lambda anchor, policy, **more: edges_of(evidence.neighborhood(graph, anchor, 1, policy=policy, **more))
    hub, tie = ("person:b", "hub:h", "tap"), ("person:a", "person:b", "id_eq:orcid")
    assert around("person:b", "conservative") == sorted([tie, hub])
    judged = [hub, ("person:b", "claim:label:big wedge", "statement"), ("person:b", "person:a", "statement"), ("person:b", "person:h2", "ruling")]
    assert around("person:b", " Working ") == sorted(judged)  # the refusal takes the tie away, and beats the ruling that says the same
    assert around("person:b", "no such policy") == sorted([tie, hub])
    assert around("person:b", "working", types=["advises"]) == [("person:b", "person:a", "statement"), ("person:b", "person:h2", "ruling")]
    assert around("doc:s:1", "conservative") == [("doc:s:1", "work:doi:10.1/x", "id_eq:doi")]
    assert around("doc:s:1", "exploratory") == [("doc:s:1", "doc:t:2", "align:title_fp"), ("doc:s:1", "work:doi:10.1/x", "id_eq:doi")]
    assert around("doc:t:3", "conservative") == [("doc:t:3", "work:arxiv:2401.1", "id_eq:arxiv"), ("doc:t:3", "work:openalex:W3", "id_eq:openalex")]
    assert around("work:doi:10.1/x", "conservative") == [("person:a", "work:doi:10.1/x", "tap")]  # ids are looked up from the document's side


def test_nodes_are_cut_by_recency_then_degree(graph):
    sub = evidence.neighborhood(graph, "person:a", 2, policy="conservative", most=4)
    assert [(r.id, r.kind, r.label, r.capped) for r in sub.nodes.sort("id").collect()] == [("hub:h", "hub", None, True), ("person:a", "person", "Ann", True), ("person:b", "person", "Bo", True), ("work:doi:10.1/x", "work", "X", True)]
    assert len(edges_of(sub)) == 4
    assert [r.id for r in evidence.neighborhood(graph, "person:h5", 1, most=1).nodes.collect()] == ["person:h5"]
    alone = evidence.neighborhood(graph, "claim:label:nobody", 0)
    assert [(r.id, r.kind, r.label, r.capped) for r in alone.nodes.collect()] == [("claim:label:nobody", "claim", "nobody", False)] and not edges_of(alone)


def test_since_takes_what_has_a_time(graph):
    sub = evidence.since(graph, "person:b", "2024-01-04")
    assert sorted((r.method, r.added) for r in sub.edges.collect()) == [("statement", datetime.datetime(2024, 2, 1)), ("statement", datetime.datetime(2024, 3, 1)), ("tap", datetime.datetime(2024, 1, 6))]
    assert edges_of(evidence.since(graph, "person:b", "2024-02-15T00:00:00Z", ["advises"])) == [("person:b", "person:a", "statement")]
    with pytest.raises(ValueError):
        evidence.since(graph, "person:b", "yesterday")


def test_paths_between(graph):
    paths = lambda *a, **k: [tuple(r.path) for r in evidence.between(graph, *a, **k).sort("nth").collect()]
    assert paths("person:a", "person:b")[:2] == [("person:a", "person:b"), ("person:a", "hub:h", "person:b")]
    assert paths("person:a", "claim:label:big wedge") == []
    assert paths("person:a", "claim:label:big wedge", policy="working") == [("person:a", "person:b", "claim:label:big wedge"), ("person:a", "hub:h", "person:b", "claim:label:big wedge"), ("person:a", "hub:h", "person:h2", "person:b", "claim:label:big wedge")]
    found = evidence.between(graph, "person:a", "claim:label:big wedge", policy="working", most_nodes=4)
    assert [(r.nth, r.edges, r.capped) for r in found.sort("nth").collect()] == [(1, 2, True), (2, 3, True)]
    steps = evidence.path_edges(graph, found.limit(1), "working")
    assert sorted((r.src, r.dst, r.method) for r in steps.collect()) == [("person:b", "claim:label:big wedge", "statement"), ("person:b", "person:a", "statement")]
    with pytest.raises(ValueError):
        evidence.between(graph, "person:a", "person:a")


def test_the_shortest_paths_through_hubs_are_those_of_brute_force(spark, graph):
    import itertools
    import random

    rng = random.Random(2)
    links = {tuple(sorted(rng.sample(range(14), 2))) for _ in range(45)}
    rows = [(f"n:{a:02d}", f"n:{b:02d}", "knows", "M", "tap", NO_TIME) for a, b in links]
    tangled = graph._replace(edges=spark.createDataFrame(rows, graph.edges.schema))
    near = lambda a, b: tuple(sorted((a, b))) in links
    for a, b in [(0, 1), (2, 9), (4, 13)]:
        inner = [x for x in range(14) if x not in (a, b)]
        brute = [(a, *mid, b) for n in range(4) for mid in itertools.permutations(inner, n) if all(near(x, y) for x, y in itertools.pairwise((a, *mid, b)))]
        want = [tuple(f"n:{x:02d}" for x in p) for p in sorted(brute, key=lambda p: (len(p), p))[:8]]
        found = evidence.between(tangled, f"n:{a:02d}", f"n:{b:02d}").sort("nth").collect()
        assert [tuple(r.path) for r in found] == want and all(r.capped == (len(brute) > 8) for r in found)


def test_voices_of_documents(graph):
    ids = ["doc:s:1", "doc:t:2", "doc:t:3", "doc:u:4", "person:a"]
    told = lambda policy: sorted((r.verdict, tuple(r.docs), tuple(r.works), tuple(r.persons), r.speaker_known) for r in evidence.voices(graph, ids, policy).collect())
    three = ("voice", ("doc:t:3",), ("work:arxiv:2401.1", "work:openalex:W3"), (), False)
    assert told("conservative") == [("skipped", (), (), (), False), ("unresolved", ("doc:t:2",), (), (), False), ("unresolved", ("doc:u:4",), (), (), False), ("voice", ("doc:s:1",), ("work:doi:10.1/x",), ("person:a",), True), three]
    assert told("exploratory") == [("skipped", (), (), (), False), ("voice", ("doc:s:1", "doc:t:2"), ("work:doi:10.1/x",), ("person:a",), True), ("voice", ("doc:t:3", "doc:u:4"), *three[2:])]
    with pytest.raises(ValueError):
        evidence.voices(graph, [f"doc:s:{i}" for i in range(65)])


def test_stamps_and_stores(spark, graph):
    texts = ["2024-01-02", "2024-01-02T03:04:05", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05+02:00", "soon", "", None, "2024-13-01"]
    found = [r.t for r in spark.createDataFrame([(t,) for t in texts], "s string").select(evidence.instant(F.col("s")).alias("t")).collect()]
    day = datetime.datetime(2024, 1, 2)
    assert found == [day, *[day.replace(hour=3, minute=4, second=5)] * 2, day.replace(hour=1, minute=4, second=5), None, None, None, None]
    thin = graph.documents.limit(0).unionByName(spark.createDataFrame([("doc:s:1", "hidden", "", None, None, None, NO_TIME), ("doc:v:9", "thin", "title:z", None, None, None, NO_TIME)], graph.documents.schema))
    assert sorted(r.title for r in evidence.known_documents(graph.documents, thin).collect()) == ["Alone", "One  title", "One title", "Three", "thin"]


def test_the_index_reads_few_buckets_and_joins_without_a_shuffle(spark, graph):
    index = KeyIndex(graph.documents, 8)
    try:
        def plan(df):
            with contextlib.redirect_stdout(io.StringIO()) as out:
                df.explain("formatted")
            return out.getvalue()

        looked = index.lookup("key", ["title:onetitle"])
        assert sorted(r.id for r in looked.collect()) == ["doc:s:1", "doc:t:2"]
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # a plan tells its buckets then alone
        assert "SelectedBucketsCount: 1 out of 8" in plan(index.lookup("key", ["title:onetitle"]))
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        assert index.title_of("doc:t:2") == "title:onetitle" and index.title_of("doc:t:3") is None and index.title_of("none") is None
        found = sorted((r.src, r.dst, r.method) for r in index.edges(["doc:s:1", "doc:t:3", "gone"]).collect())
        assert found == [("doc:s:1", "doc:t:2", "align:title_fp"), ("doc:s:1", "work:doi:10.1/x", "id_eq:doi"), ("doc:t:3", "work:arxiv:2401.1", "id_eq:arxiv"), ("doc:t:3", "work:openalex:W3", "id_eq:openalex")]
        assert index.edges([]).count() == 0
        counted = index.partners()
        assert [tuple(r) for r in counted.collect()] == [("title:onetitle", 2)] and "Exchange" not in plan(counted)
        with pytest.raises(ValueError):
            index.lookup("id", ["x"] * 1001)
    finally:
        index.drop()
