"""Sources as tables: declarative JSON records, feeds, delimited bulk files in archives, pages, and row-list series.

A live answer is a file in a folder here; each reader returns documents or long rows and keeps "empty", "wrong" and
"failed" apart in a status table.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions import records as R
from quillspan.functions import text as X
from quillspan.operators.nested import items_of, kind, members_of, spelled

DOCUMENT = ["source", "source_id", "url", "title", "content", "date"]


def declarative(raw: DataFrame, source: str, results_path: str, fields: dict[str, list[str]], body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(documents, status) of answers ``body`` (JSON) by a field map; a row without a link is dropped.

    The status counts rows found and dropped for each state of the results path.
    """
    state = R.results_state(F.col(body), results_path)
    found = R.dig(F.col(body), results_path) if results_path else F.col(body)
    items = raw.select(state.alias("state"), F.when(state == "rows", F.from_json(found, "array<string>")).when(state == "map", F.map_values(F.from_json(found, "map<string,string>"))).alias("items"))
    rows = items.select(F.explode("items").alias("item"))
    pick = lambda name: R.dig_any(F.col("item"), fields.get(name, [name]))
    docs = rows.select(
        F.lit(source).alias("source"), F.coalesce(pick("source_id"), pick("url")).alias("source_id"), pick("url").alias("url"), F.coalesce(pick("title"), F.lit("(no title)")).alias("title"),
        F.coalesce(pick("content"), pick("title"), F.lit("(no title)")).alias("content"), R.date_at(F.col("item"), fields.get("date", ["date"])).alias("date"),
    )
    status = items.select("state", F.coalesce(F.size("items"), F.lit(0)).alias("n"), F.coalesce(F.size(F.filter("items", lambda i: R.dig_any(i, fields.get("url", ["url"])).isNull())), F.lit(0)).alias("bad"))
    return docs.where("url IS NOT NULL"), status.groupBy("state").agg(F.count("*").alias("answers"), F.sum("n").alias("rows"), F.sum("bad").alias("dropped"))


def feed(spark: SparkSession, path: str, tag: str = "item") -> DataFrame:
    """Entries of RSS or Atom files with the file they came from: (feed, key, url, title, content, date)."""
    kinds = "title string, link string, guid string, id string, description string, content string, summary string, pubDate string, published string, updated string"
    rows = spark.read.format("xml").option("rowTag", tag).schema(kinds).load(path)
    key = F.coalesce(F.nullif("guid", F.lit("")), F.nullif("id", F.lit("")), "link")
    date = F.coalesce(F.try_to_timestamp(F.regexp_replace("pubDate", "^[A-Za-z]+, ", ""), F.lit("d MMM yyyy HH:mm:ss Z")), R.as_date(F.col("published")), R.as_date(F.col("updated")))
    return rows.select(F.input_file_name().alias("feed"), key.alias("key"), F.col("link").alias("url"), "title", F.coalesce("content", "description", "summary").alias("content"), date.alias("date")).where("key IS NOT NULL")


def merged_feeds(entries: DataFrame) -> DataFrame:
    """One row for each key, the first by feed, with all its ``feeds``."""
    return entries.groupBy("key").agg(F.min_by(F.struct("url", "title", "content", "date"), F.struct("feed", "title")).alias("e"), F.array_sort(F.collect_set("feed")).alias("feeds")).select("key", "e.*", "feeds")


def archived_csv(spark: SparkSession, path: str, member: str, schema: str, sep: str = ";") -> DataFrame:
    """Rows of a delimited file inside zip archives; an archive is one task's work and is read as a stream of lines."""

    def lines(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for content in batch.column("content").to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(member) as f:
                    some = []
                    for i, line in enumerate(io.TextIOWrapper(f, "utf-8-sig")):
                        if i:
                            some.append(line.rstrip("\r\n"))
                        if len(some) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["line"])
                            some = []
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["line"])

    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(lines, "line string")
    return found.select(F.from_csv("line", schema, {"sep": sep, "quote": '"'}).alias("r")).select("r.*")


def with_coordinator(projects: DataFrame, organisations: DataFrame) -> DataFrame:
    """Each project with its first organisation whose role is coordinator, if it has one."""
    first = organisations.where("lower(role) = 'coordinator'").groupBy("project_id").agg(F.min_by("name", "pos").alias("coordinator"))
    return projects.join(first, projects["id"] == first["project_id"], "left").drop("project_id")


def cube_series(answers: DataFrame) -> DataFrame:
    """(period, value) of JSON-stat cubes ``body`` whose other dimensions have one place: a place's value by its number."""
    index = F.from_json(F.get_json_object("body", "$.dimension.time.category.index"), "map<string,int>")
    values = F.from_json(F.get_json_object("body", "$.value"), "map<string,double>")
    rows = answers.select(F.explode(index).alias("period", "place"), values.alias("v"))
    return rows.select("period", F.try_element_at("v", F.col("place").cast("string")).alias("value")).where("value IS NOT NULL")


def newest_facts(facts: DataFrame) -> DataFrame:
    """One value of each concept: the newest end, then the shorter span, then the later filing."""
    span = F.datediff("end", "start")
    return facts.groupBy("concept").agg(F.max_by("value", F.struct(F.col("end"), -span, F.col("filed"))).alias("value"), F.max("end").alias("end"))


def watched_pages(pages: DataFrame) -> DataFrame:
    """(url, version, content): the visible text and its digest; pages with less than 200 characters give nothing."""
    text = pages.select("url", X.page_text(F.col("html")).alias("content"))
    return text.where(F.length("content") >= 200).select("url", F.substring(F.sha2("content", 256), 1, 16).alias("version"), "content")


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: (url, title, content); the title is the first line that is not blank."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("content"))
    return rows.withColumn("title", F.regexp_extract("content", r"^\s*([^\n]*\S)", 1))


def bulk_subset(rows: DataFrame, terms: list[str], *columns: str) -> DataFrame:
    """Rows of a bulk file that mention a term of a list; the subset is what is kept."""
    blob = F.lower(F.concat_ws(" ", *columns))
    return rows.where(R.any_of([F.contains(blob, F.lit(t.lower())) for t in terms]))


def answers_of_questions(questions: DataFrame) -> DataFrame:
    """A row for each question and one for its answer with most votes: (id, part, text)."""
    best = F.array_max(F.transform("answers", lambda a: F.struct(a["votes"].alias("votes"), (-a["id"]).alias("n"), a["text"].alias("text"))))
    asked = questions.select("id", F.lit("question").alias("part"), "text")
    return asked.unionByName(questions.select("id", F.lit("answer").alias("part"), best["text"].alias("text")).where("text IS NOT NULL"))


def per_source(rows: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows of each source."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy("source").orderBy(*order))).where(F.col("_nth") <= n).drop("_nth")


def year_series(answers: DataFrame) -> DataFrame:
    """(country, indicator, name, iso3, unit, years, latest_year, latest_value) of row lists ``json``; those without a number give no row.

    A row is a year and a value; a later row of a year wins, a value that is none leaves the year as it was.  Labels come
    from the first row that has one, codes stand in for names.
    """
    rows = answers.select("country", "indicator", F.posexplode(items_of(F.try_parse_json("json"))).alias("pos", "row")).withColumn("m", members_of(F.col("row")))
    said = lambda v: F.try_variant_get(v, "$", "string")
    m = F.col("m")
    year = F.when(kind(m["date"]).isin("number", "string"), F.when(F.trim(said(m["date"])).rlike(r"^[+-]?\d+$"), F.trim(said(m["date"])).try_cast("int")))
    value = F.when(kind(m["value"]).isin("number", "string"), F.trim(said(m["value"])).try_cast("double"))
    parts = rows.where("m IS NOT NULL").select("country", "indicator", "pos", year.alias("year"), value.alias("value"), spelled(members_of(m["indicator"])["value"]).alias("name"), spelled(m["countryiso3code"]).alias("iso3"), spelled(m["unit"]).alias("unit")).where("year IS NOT NULL")
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c) for c in ("name", "iso3", "unit")]
    by_year = parts.groupBy("country", "indicator", "year").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("pos"))).alias("value")).where("value IS NOT NULL")
    latest = by_year.groupBy("country", "indicator").agg(F.count("*").alias("years"), F.max("year").alias("latest_year"), F.max_by("value", "year").alias("latest_value"))
    labels = parts.groupBy("country", "indicator").agg(*first)
    named = latest.join(labels, ["country", "indicator"])
    return named.select("country", "indicator", F.coalesce("name", "indicator").alias("name"), F.coalesce("iso3", "country").alias("iso3"), F.coalesce("unit", F.lit("")).alias("unit"), "years", "latest_year", "latest_value")
