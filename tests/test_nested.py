"""Walking JSON of any depth, paths, provenance and compiled assertions, against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillspan.operators import nested


def brute_members(value, place=()):
    items = sorted(value.items()) if isinstance(value, dict) else [(None, v) for v in value] if isinstance(value, list) else []
    for n, (key, v) in enumerate(items):
        yield (*place, n), key, v
        yield from brute_members(v, (*place, n))


def random_json(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice([None, True, False, 0, 7, -2.5, "", "x", "cited", []])
    if rng.random() < 0.4:
        return [random_json(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    keys = ["count", "Citation_Count", "value", "source", "kind", "provider", "deep", "computed_by"]
    return {k: rng.choice(["arxiv", "Cited by", "s"]) if k in ("source", "kind", "provider") and rng.random() < 0.6 else random_json(rng, depth - 1) for k in rng.sample(keys, rng.randint(0, 5))}


def brute_provenance(value, inherited=""):
    if isinstance(value, dict):
        said = str(value.get("kind") if isinstance(value.get("kind"), str) else "").lower()
        named = next((value[c] for c in ("computed_by", "provenance", "source", "provider") if value.get(c)), None)
        own = (json.dumps(named, separators=(",", ":"), sort_keys=True) if not isinstance(named, str) else named) if named else f"kind:{said}" if said in ("arxiv", "doi") else inherited
        for key, v in sorted(value.items()):
            plain = isinstance(v, (int, float)) and not isinstance(v, bool)
            if plain and (key.lower() in nested.COUNTS or key.lower() == "value" and ("citat" in own.lower() or "cited" in own.lower())):
                yield float(v), own
            else:
                yield from brute_provenance(v, own)
    elif isinstance(value, list):
        for v in value:
            yield from brute_provenance(v, inherited)


@pytest.fixture(scope="module")
def results(spark):
    rng = random.Random(8)
    made = [random_json(rng, 6) for _ in range(60)] + [{"a": {"b": [[[{"count": 1}]]]}}, [], {}, "text", None]
    rows = [(i, json.dumps(v)) for i, v in enumerate(made)] + [(90, "{broken"), (91, None), (92, "")]
    return made, spark.createDataFrame(rows, "id long, json string").cache()


def test_walk_meets_every_member(results):
    made, df = results
    want = sorted((i, p, k) for i, v in enumerate(made) for p, k, _ in brute_members(v))
    assert sorted(((r.id, tuple(r.place), r.key) for r in nested.walk(df).collect()), key=str) == sorted(want, key=str)
    assert nested.walk(df.limit(0)).count() == 0


def test_numbers_keep_their_provenance(results):
    made, df = results
    want = sorted((i, *x) for i, v in enumerate(made) for x in brute_provenance(v))
    found = nested.numeric_provenance(df)
    assert sorted((r.id, r.value, r.provenance) for r in found.collect()) == want != []


def test_paths(spark):
    assert nested.path_tokens(" $.a.b[0].c ") == ["a", "b", 0, "c"] and nested.path_tokens("$") == [] and nested.path_tokens("$x[*]") == ["x", "*"]
    body = F.parse_json(F.lit('{"a": [{"b": null}, 2], "0": "zero", "t": {"0": 1}}'))
    at = lambda p: spark.range(1).select(F.to_json(nested.at_path(body, p)).alias("v")).first().v
    assert [at(p) for p in ("a.1", "$.a[0].b", "a[7]", "a.b", "t.0", "0", "a[0].b.c")] == ["2", "null", None, None, None, None, None]


def holds(spark, value, rule):
    return spark.range(1).select(nested.assertion(F.parse_json(F.lit(json.dumps(value))), rule).alias("v")).first().v


@pytest.mark.parametrize(
    ("rule", "good", "bad"),
    [
        ({"path": "a", "exists": True}, [{"a": None}], [{}, {"b": 1}]),
        ({"path": "a", "exists": False}, [{}, []], [{"a": None}]),
        ({"path": "a", "equals": 1}, [{"a": 1}, {"a": 1.0}, {"a": True}], [{"a": "1"}, {"a": None}, {}]),
        ({"path": "a", "equals": "x"}, [{"a": "x"}], [{"a": "X"}, {"a": ["x"]}]),
        ({"path": "a", "equals": None}, [{"a": None}], [{"a": 0}, {}]),
        ({"path": "a", "equals": {"k": [1, "y"]}}, [{"a": {"k": [1, "y"]}}], [{"a": {"k": [1]}}]),
        ({"path": "a", "gt": 1, "gte": 2}, [{"a": 2}], [{"a": 1}, {"a": 1.5}, {"a": "9"}, {"a": None}]),
        ({"path": "a", "gte": "b"}, [{"a": "b"}, {"a": "ba"}], [{"a": "a"}, {"a": 3}]),
        ({"path": "a", "gt": [1]}, [], [{"a": [2]}]),
        ({"path": "a", "reduction": True}, [{"a": {"in": 2, "out": 1.5}}], [{"a": {"in": 1, "out": 1}}, {"a": {"in": 1}}, {"a": [2, 1]}, {"a": {"in": "2", "out": 1}}]),
        ({"path": "a", "each": {"fields": ["x"]}}, [{"a": []}, {"a": [{"x": None}, {"x": 1}]}], [{"a": [{}]}, {"a": [3]}, {"a": {"x": 1}}]),
        ({"path": "a", "each": {"exists_any": ["x", "y"]}}, [{"a": [{"x": 1}, {"y": 2}]}], [{"a": [{"z": 1}]}]),
        ({"path": "a", "each": ["x"]}, [], [{"a": []}]),
        ({"path": "a", "each_provenance": True}, [{"a": [{"source": "s", "url": "u"}, {"source_name": "s", "metadata": {"id": 4}}]}, {"a": []}], [{"a": [{"source": "s"}]}, {"a": [{"source": "", "url": "u"}]}, {"a": [1]}, {"a": {}}]),
        ({"any_of": [{"path": "a"}, {"path": "b"}]}, [{"b": 1}], [{}]),
        ({"any_of": []}, [], [{}]),
        ({"exists": True}, [], [{}]),
    ],
)
def test_assertions(spark, rule, good, bad):
    assert [holds(spark, v, rule) for v in (*good, *bad)] == [True] * len(good) + [False] * len(bad)


def test_judged_boxes_what_is_no_object(spark):
    rows = spark.createDataFrame([(1, "t", "[1, 2]"), (2, "t", "not json"), (3, "t", '{"result": "x"}'), (4, "t", None), (5, "other", "{}"), (6, "odd", "{}")], "id long, task string, json string")
    found = {r.id: (r.status, r.failed) for r in nested.judged(rows, {"t": [{"path": "result[0]", "equals": 1}, {"path": "result", "exists": True}], "odd": {"no": "list"}}).collect()}
    assert found == {1: ("pass", []), 2: ("fail", [0]), 3: ("fail", [0]), 4: ("fail", [0]), 5: ("unknown", []), 6: ("fail", [0])}


def test_conflicts(spark):
    rows = [(1, [0], 2.0, "a"), (1, [1], 50.0, "a"), (1, [2], 9.0, "b"), (1, [3], 1.0, ""), (2, [0], 0.0, "a"), (2, [1], 4.0, "b"), (3, [0], 4.0, "a")]
    found = nested.citation_conflicts(spark.createDataFrame(rows, "id long, place array<int>, value double, provenance string"), 4.5)
    assert sorted(map(tuple, found.collect())) == [(1, 2, 4.5, True), (2, 2, 0.0, False), (3, 1, 0.0, False)]
