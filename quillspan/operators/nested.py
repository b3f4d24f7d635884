"""JSON of any depth as rows and as columns: walking, paths, numbers with their provenance, compiled assertions.

JSON is held as variants.  A walk goes level by level: each level's members are written, and its containers are the
next level, so the work grows with the documents and the number of jobs with their depth.  Objects have no order of
their own: their members are walked by name.  Text that is no JSON has no members.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.storage import materialise

# The names under which results count citations.
COUNTS = ["citation_count", "citationcount", "cited_by_count", "citedbycount", "count"]


def members_of(value: Column) -> Column:
    """An object as MAP<STRING, VARIANT>; null for anything else."""
    return F.try_variant_get(value, "$", "map<string, variant>")


def items_of(value: Column) -> Column:
    """A list as ARRAY<VARIANT>; null for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


def kind(value: Column) -> Column:
    """object, array, number, boolean, string or null; a SQL null where there is no value."""
    plain = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), None).when(members_of(value).isNotNull(), "object").when(items_of(value).isNotNull(), "array").when(plain == "STRING", "string")
        .when(plain == "BOOLEAN", "boolean").when(plain == "VOID", "null").otherwise("number")
    )


def number(value: Column) -> Column:
    """The number that a value is; a boolean or a text of digits is none."""
    return F.when(kind(value) == "number", F.try_variant_get(value, "$", "double"))


def amount(value: Column) -> Column:
    """The number that a value is or, for a boolean, counts as."""
    return F.when(kind(value).isin("number", "boolean"), F.try_variant_get(value, "$", "double"))


def filled(value: Column) -> Column:
    """Whether a value says something: a text, list or object that isn't empty, a number but zero, true."""
    k = kind(value)
    size = F.coalesce(F.size(members_of(value)), F.size(items_of(value)))
    return F.coalesce(F.when(k == "string", F.try_variant_get(value, "$", "string") != "").when(k == "number", number(value) != 0).when(k == "boolean", F.try_variant_get(value, "$", "boolean")).otherwise(size > 0), F.lit(False))


def spelled(value: Column) -> Column:
    return F.when(filled(value), F.try_variant_get(value, "$", "string"))


def walk(docs: DataFrame, inherit: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(id, place, names, key, kind, value, inherited): every member of every object and list of ``docs`` (id, json).

    ``place`` orders the members as a walk meets them, ``names`` leads to them from the top, ``key`` is null in lists.
    ``inherit`` says, from an object's members and what it inherited itself, what its own members inherit.
    """
    level = docs.select("id", F.try_parse_json("json").alias("value"), F.array().cast("array<int>").alias("place"), F.array().cast("array<string>").alias("names"), F.lit("").alias("inherited"))
    found = []
    while True:
        fields = F.transform(F.map_entries(members_of(F.col("value"))), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
        listed = F.transform(items_of(F.col("value")), lambda v: F.struct(F.lit(None).cast("string").alias("key"), v.alias("value")))
        passed = F.when(members_of(F.col("value")).isNotNull(), inherit(members_of(F.col("value")), F.col("inherited"))).otherwise(F.col("inherited")) if inherit else F.col("inherited")
        parts = level.select("id", "place", "names", passed.alias("inherited"), F.posexplode(F.coalesce(fields, listed)).alias("n", "part"))
        name = F.coalesce("part.key", F.col("n").cast("string"))
        made = parts.select("id", F.array_append("place", F.col("n")).alias("place"), F.array_append("names", name).alias("names"), "part.key", kind(F.col("part.value")).alias("kind"), "part.value", "inherited")
        found.append(materialise(made, "walk"))
        level = found[-1].where("kind IN ('object', 'array')").select("id", "value", "place", "names", "inherited")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)


def provenance(members: Column, inherited: Column) -> Column:
    """What an object says its numbers come from: a named origin, the kind of identifier it has, or what it is part of."""
    said = F.lower(F.try_variant_get(members["kind"], "$", "string"))
    named = [spelled(members[c]) for c in ("computed_by", "provenance", "source", "provider")]
    return F.coalesce(*named, F.when(said.isin("arxiv", "doi"), F.concat(F.lit("kind:"), said)), inherited)


def numeric_provenance(docs: DataFrame) -> DataFrame:
    """(id, place, value, provenance): the citation counts that results (id, json) hold at any depth."""
    rows = walk(docs, provenance).where("kind = 'number'")
    key, cited = F.lower("key"), F.lower("inherited").rlike("citat|cited")
    return rows.where(key.isin(COUNTS) | ((key == "value") & cited)).select("id", "place", number(F.col("value")).alias("value"), F.col("inherited").alias("provenance"))


def citation_conflicts(values: DataFrame, floor: float) -> DataFrame:
    """(id, provenances, ratio, passed): whether the first value of each provenance disagrees by max / min >= ``floor``.

    Values that are not positive count as provenances but not in the ratio, which is 0 with fewer than two others.
    """
    first = values.where("provenance <> ''").groupBy("id", "provenance").agg(F.min_by("value", "place").alias("value"))
    positive = F.when(F.col("value") > 0, F.col("value"))
    spread = first.groupBy("id").agg(F.count("*").alias("provenances"), F.count(positive).alias("n"), (F.max(positive) / F.min(positive)).alias("r"))
    rated = spread.select("id", "provenances", F.when(F.col("n") >= 2, F.col("r")).otherwise(F.lit(0.0)).alias("ratio"))
    return rated.withColumn("passed", (F.col("provenances") >= 2) & (F.col("ratio") >= floor))


def path_tokens(path: str) -> list[str | int]:
    """The steps of a path such as $.a.b[0]; a step of digits alone is a place in a list."""
    path = path.strip()
    found = re.findall(r"[^.\[\]]+", path[1:] if path.startswith("$") else path)
    return [int(t) if t.isdigit() else t for t in found]


def at_path(value: Column, path: str) -> Column:
    """The value that a path leads to, null where it leads nowhere; a JSON null is a value."""
    for token in path_tokens(path):
        value = F.get(items_of(value), F.lit(token)) if isinstance(token, int) else F.try_element_at(members_of(value), F.lit(token))
    return value


def has_any(value: Column, names: list[str]) -> Column:
    return reduce(Column.__or__, (F.map_contains_key(members_of(value), n) for n in names), F.lit(False))


def has_all(value: Column, names: list[str]) -> Column:
    return reduce(Column.__and__, (F.map_contains_key(members_of(value), n) for n in names), members_of(value).isNotNull())


def _literal(expected) -> Column:
    return F.parse_json(F.lit(json.dumps(expected)))


def _equals(value: Column, expected) -> Column:
    """Numbers and booleans by amount, texts by their characters, all else by its canonical JSON."""
    if isinstance(expected, (bool, int, float)):
        return amount(value) == float(expected)
    if isinstance(expected, str):
        return (kind(value) == "string") & (F.try_variant_get(value, "$", "string") == expected)
    return F.to_json(value) == F.to_json(_literal(expected))


def _compare(value: Column, expected, strict: bool) -> Column:
    if isinstance(expected, str):
        mine, ok = F.try_variant_get(value, "$", "string"), kind(value) == "string"
    elif isinstance(expected, (bool, int, float)):
        mine, ok, expected = amount(value), F.lit(True), float(expected)
    else:
        return F.lit(False)
    return ok & ((mine > expected) if strict else (mine >= expected))


def _each(value: Column, rules) -> Column:
    if not isinstance(rules, dict):
        return F.lit(False)
    some, every = list(rules.get("exists_any", [])), list(rules.get("fields", []))
    good = lambda v: has_all(v, every) & (has_any(v, some) if some else F.lit(True))
    return items_of(value).isNotNull() & F.forall(items_of(value), good)


def _located(item: Column) -> Column:
    m = members_of(item)
    inner = members_of(m["metadata"])
    said = lambda names, of: reduce(Column.__or__, (filled(of[n]) for n in names))
    return m.isNotNull() & said(["source", "source_name"], m) & (said(["url", "id"], m) | said(["url", "id"], inner))


def assertion(value: Column, rule: dict) -> Column:
    """Whether a result (a variant) meets one rule: a boolean without nulls.

    ``any_of`` takes the first that holds.  Else ``path`` leads to a value, and ``exists``, ``equals``, ``gt``, ``gte``, ``reduction``
    (in above out), ``each`` (fields of every item) and ``each_provenance`` (source and locator of every item) all hold of it.
    """
    if "any_of" in rule:
        return reduce(Column.__or__, (assertion(value, r) for r in rule["any_of"]), F.lit(False)) if isinstance(rule["any_of"], list) else F.lit(False)
    if not isinstance(rule.get("path"), str):
        return F.lit(False)
    found = at_path(value, rule["path"])
    if "exists" in rule and not rule["exists"]:
        return found.isNull() if rule["exists"] is False else F.lit(False)
    holds = [found.isNotNull()]
    if "equals" in rule:
        holds.append(_equals(found, rule["equals"]))
    holds += [_compare(found, rule[c], c == "gt") for c in ("gt", "gte") if c in rule]
    if "reduction" in rule:
        m = members_of(found)
        holds.append(amount(m["in"]) > amount(m["out"]))
    if "each" in rule:
        holds.append(_each(found, rule["each"]))
    if rule.get("each_provenance"):
        holds.append(items_of(found).isNotNull() & F.forall(items_of(found), _located))
    return F.coalesce(reduce(Column.__and__, holds), F.lit(False))


def judged(results: DataFrame, rules: dict[str, list]) -> DataFrame:
    """(id, task, status, failed) of results (id, task, json): all rules of a task at once, in one pass over the results.

    ``failed`` has the places of a task's rules that don't hold.  A result that is no object stands under ``result``, one
    that is no JSON is a text.  A task without rules here is ``unknown``; rules that are no list, or no objects, fail.
    """
    text = F.get(items_of(F.parse_json(F.to_json(F.array("json")))), F.lit(0))
    raw = F.coalesce(F.try_parse_json("json"), text)
    value = F.col("_value")
    status = F.lit(None).cast("array<int>")
    for task, listed in rules.items():
        checks = [assertion(value, r) if isinstance(r, dict) else F.lit(False) for r in listed] if isinstance(listed, list) else [F.lit(False)]
        failed = F.filter(F.array(*(F.when(~c, F.lit(i)) for i, c in enumerate(checks))), lambda i: i.isNotNull()) if checks else F.array().cast("array<int>")
        status = F.when(F.col("task") == task, failed).otherwise(status)
    boxed = results.select("id", "task", raw.alias("_raw")).withColumn("_value", F.when(members_of(F.col("_raw")).isNotNull(), F.col("_raw")).otherwise(F.to_variant_object(F.struct(F.col("_raw").alias("result")))))
    out = boxed.select("id", "task", status.alias("failed"))
    return out.select("id", "task", F.when(F.col("failed").isNull(), "unknown").when(F.size("failed") == 0, "pass").otherwise("fail").alias("status"), F.coalesce("failed", F.array().cast("array<int>")).alias("failed"))
