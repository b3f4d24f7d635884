"""Names that nearly agree, against all pairs by brute force."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from quillspan.operators import names
from quillspan.plans import names as plans


def brute(left, right, least):
    ratio = lambda a, b: difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio()
    return sorted((a, b, round(r, 3)) for a in {x for x in left if x} for b in {x for x in right if x} if a != b and (r := ratio(a, b)) >= least)


def joined(spark, left, right, least):
    make = lambda rows: spark.createDataFrame([(r,) for r in rows], "name string")
    return sorted(map(tuple, names.similar_names(make(left), make(right), least).collect()))


@pytest.mark.parametrize("least", [0.7, 0.85, 1.0])
def test_random_names(spark, least):
    rng = random.Random(int(least * 100))
    some = lambda letters: ["".join(rng.choice(letters) for _ in range(rng.randint(0, 9))) for _ in range(100)] + [None, "", "é漢字x", "É漢字x"]
    left, right = some("abC"), some("abc")
    assert joined(spark, left, right, least) == brute(left, right, least)


def test_names_of_the_tables(spark, sf):
    people = [r[0] for t, c in (("customer", "c_name"), ("supplier", "s_name")) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(c).collect()]
    suppliers = [p for p in people if p.startswith("S")]
    assert joined(spark, suppliers, people, 0.85) == brute(suppliers, people, 0.85) != []
    found = [r[0] for r in plans.page_names(spark, sf).collect()]
    assert sorted(map(tuple, plans.similar_hosts(spark, sf).collect())) == brute(found, found, 0.85) != []


def test_no_cross_join_and_bounds(spark):
    few = spark.createDataFrame([("ab",)], "name string")
    plan = names.similar_names(few, few)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert names.similar_names(few.limit(0), few).collect() == []
    with pytest.raises(ValueError):
        names.similar_names(few, few, 0.6)


def test_hosts(spark):
    urls = ["https://User@WWW.A.org:80/x?y", "http://b.net", "ftp://c.d/e", "no link", "", None, "https://"]
    assert [r.h for r in spark.createDataFrame([(u,) for u in urls], "u string").select(names.host(F.col("u")).alias("h")).collect()] == ["www.a.org", "b.net", "c.d", "", "", "", ""]
