"""Queries over pages, records and texts: what readers and projections make of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import records as R
from quillspan.functions import text as X
from quillspan.sources import readers
from quillspan.plans.retrieval import table


def page_texts(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), X.page_text(F.col("html")).alias("content"), R.blocked_by(F.col("html")).alias("blocked"))


def page_versions(spark, sf):
    return readers.watched_pages(table(spark, sf, "pages")).select("url", "version")


def normal_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.normal_url(F.col("url")).alias("url"))


def tail_passages(spark, sf):
    docs = table(spark, sf, "documents")
    cut = docs.select("doc_id", F.posexplode(X.passages(F.substring_index("text", "\n", 1), F.col("text"))).alias("chunk", "passage"))
    return cut.select("doc_id", "chunk", F.length("passage").alias("chars"), F.sha2("passage", 256).alias("digest"))


def text_pages(spark, sf):
    """Every page of each text, of 1,000 characters at most; one row of nulls for a null text."""
    paged = table(spark, sf, "documents").select("doc_id", F.posexplode_outer(R.pages(F.col("text"), 1000)).alias("page", "p"))
    return paged.select("doc_id", "page", "p.start", F.length("p.text").alias("chars"), "p.next", F.sha2("p.text", 256).alias("digest"))


def record_fields(spark, sf):
    e = table(spark, sf, "events")
    body = F.concat(F.lit('{"data": {"rows": ['), "props", F.lit('], "none": [], "at": "'), "event_id", F.lit('"}}'))
    return e.select("event_id", R.as_whole(R.dig(F.col("props"), "$.k")).alias("k"), R.as_whole(R.dig(body, "data.rows.0.k")).alias("deep"), R.results_state(body, "data.rows").alias("rows"), R.results_state(body, "data.none").alias("none"), R.results_state(body, "data.at").alias("at_state"), R.results_state(body, "missing.path").alias("missing"), R.dig_any(body, ["missing", "data.none", "data.at"]).alias("any_of"))


def dates_read(spark, sf):
    e = table(spark, sf, "events")
    forms = [F.date_format("ts", f) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "dd MMM yyyy", "MMM dd, yyyy", "yyyyMMdd", "yyyy-M-d'T'H:m:s", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "yyyy-MM-dd HH:mm:ss'+02:00'", "yyyy-MM", "yyyy")]
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")
    texts = F.array(*(F.concat(F.lit('"'), f, F.lit('"')) for f in (*forms, seconds, F.lit("soon"))), seconds, F.lit("86400.5"), F.lit("true"), F.lit("null"))
    which = (F.col("event_id") / 4 % 17).cast("int")
    record = F.concat(F.lit('{"none": "", "at": {"when": '), F.element_at(texts, which + 1), F.lit("}}"))
    return e.select("event_id", R.date_at(record, ["none", "at.when"]).alias("date"))


def agent_views(spark, sf):
    view = R.agent_view(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(view["content"], 256).alias("content"), view["content_truncated"].alias("content_truncated"), view["content_full_chars"].alias("content_full_chars"))


def summary_lines(spark, sf):
    docs = table(spark, sf, "documents")
    date = F.when(F.col("doc_id") % 7 != 0, F.expr("timestampadd(DAY, CAST(doc_id % 400 AS INT), TIMESTAMP '2024-01-01')"))
    return docs.select("doc_id", R.summary_line(F.col("source"), F.substring_index("text", "\n", 1), F.lit(None).cast("string"), date).alias("line"))


def inverted_abstracts(spark, sf):
    from quillspan.operators.biblio import abstract_text

    docs = table(spark, sf, "documents")
    words = docs.select("doc_id", F.posexplode(F.split("text", r"\s+")).alias("place", "word"))
    index = words.groupBy("doc_id", "word").agg(F.array_sort(F.collect_list("place")).alias("places")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("inverted"))
    return index.select("doc_id", abstract_text(F.col("inverted")).alias("abstract"))


def conversation_answers(spark, sf):
    turns = table(spark, sf, "conversations")
    answers = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("turn").alias("id"), F.length("text").alias("votes"), "text")).alias("answers"))
    asked = turns.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return readers.answers_of_questions(asked.join(answers, "conv_id", "left").withColumnRenamed("conv_id", "id"))


def newest_values(spark, sf):
    lines = table(spark, sf, "lineitem")
    facts = lines.select((F.col("l_partkey") % 300).alias("concept"), F.col("l_extendedprice").alias("value"), F.to_date("l_shipdate").alias("end"), F.date_sub(F.to_date("l_shipdate"), F.col("l_quantity").cast("int")).alias("start"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("filed"))
    facts = facts.groupBy("concept", "end", "start", "filed").agg(F.min("value").alias("value"))
    return readers.newest_facts(facts)


def source_quota(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return readers.per_source(docs, 5, F.desc("n_chars"), "doc_id")


def year_series(spark, sf):
    """Orders of a customer and priority are one row list; some rows are no years, no numbers or no objects."""
    o = table(spark, sf, "orders")
    date = F.expr("CASE WHEN o_orderkey % 11 = 0 THEN '\"soon\"' WHEN o_orderkey % 11 = 1 THEN CAST(year(o_orderdate) AS STRING) ELSE concat('\" ', year(o_orderdate), '\"') END")
    value = F.expr("CASE WHEN o_orderkey % 7 = 0 THEN 'null' WHEN o_orderkey % 7 = 1 THEN 'true' WHEN o_orderkey % 7 = 2 THEN concat('\" ', o_orderkey, '\"') WHEN o_orderkey % 7 = 3 THEN '\"x\"' ELSE CAST(o_orderkey AS STRING) END")
    label = F.expr("CASE WHEN o_orderkey % 3 = 0 THEN concat(', \"unit\": \"u', o_orderkey, '\", \"indicator\": {\"value\": \"\"}') WHEN o_orderkey % 3 = 1 THEN concat(', \"countryiso3code\": \"C', o_orderkey, '\", \"indicator\": {\"value\": \"i', o_orderkey, '\"}') ELSE '' END")
    row = F.when(F.col("o_orderkey") % 13 == 0, F.lit("7")).otherwise(F.concat(F.lit('{"date": '), date, F.lit(', "value": '), value, label, F.lit("}")))
    answers = o.groupBy(F.concat(F.lit("c"), F.col("o_custkey") % 97).alias("country"), F.col("o_orderpriority").alias("indicator")).agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("r")))), lambda x: x["r"]), ", "), F.lit("]")).alias("json"))
    return readers.year_series(answers)


def record_marks(spark, sf):
    docs = table(spark, sf, "documents")
    low, high = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id").cast("double")), F.when(F.col("doc_id") % 4 != 0, F.col("n_chars").cast("double"))
    return docs.select("doc_id", R.midpoint(low, high).alias("midpoint"), F.round(R.log_attention(high - 500), 9).alias("attention"), R.comment_anchor(F.col("source"), F.col("doc_id").cast("string"), F.lit("c1")).alias("anchor"))


QUERIES = {
    "year_series": year_series, "record_marks": record_marks,
    "page_texts": page_texts, "page_versions": page_versions, "normal_urls": normal_urls, "tail_passages": tail_passages, "text_pages": text_pages, "record_fields": record_fields, "dates_read": dates_read,
    "agent_views": agent_views, "summary_lines": summary_lines, "inverted_abstracts": inverted_abstracts, "conversation_answers": conversation_answers, "newest_values": newest_values, "source_quota": source_quota,
}
_DROP = "|".join("script style noscript nav header footer svg".split())


def _visible(html: str) -> str:
    for tag in _DROP.split("|"):
        html = f"regexp_replace({html}, '<{tag}\\b.*?</{tag}>', ' ', 'gsi')"
    return f"trim(regexp_replace(regexp_replace(regexp_replace({html}, '<!--.*?-->', ' ', 'gs'), '<[^>]+>', ' ', 'gs'), '\\s+', ' ', 'g'))"


# The markers of block pages in their order, stated apart from the engine's.
_MARKERS = [
    "just a moment", "attention required", "checking your browser", "verify you are human",
    "enable javascript and cookies", "access denied", "403 forbidden", "unusual traffic",
    "are you a robot", "captcha", "cf-chl", "__cf_chl", "ddos-guard",
    "访问频次异常", "操作太频繁", "请稍候再试", "请稍后再试", "您两次操作间隔", "人机验证",
    "拖动滑块", "访问链接异常", "检测到非正常操作", "账号异常",
]
ORACLE_SQL = {
    "year_series": """WITH o AS (SELECT 'c' || (o_custkey % 97) AS country, o_orderpriority AS indicator, o_orderkey AS k, CASE WHEN k % 11 <> 0 THEN year(o_orderdate) END AS y, CASE WHEN k % 7 IN (2, 4, 5, 6) THEN k::DOUBLE END AS v FROM orders WHERE k % 13 <> 0),
g AS (SELECT *  FROM o WHERE y IS NOT NULL), b AS (SELECT country, indicator, y, arg_max(v, k) FILTER (v IS NOT NULL) AS v FROM g GROUP BY ALL HAVING count(v) > 0),
l AS (SELECT country, indicator, count(*) AS years, max(y)::INTEGER AS latest_year, arg_max(v, y) AS latest_value FROM b GROUP BY ALL), n AS (SELECT country, indicator, min(k) FILTER (k % 3 = 1) AS named, min(k) FILTER (k % 3 = 0) AS unit FROM g GROUP BY ALL)
SELECT country, indicator, coalesce('i' || named, indicator) AS name, coalesce('C' || named, country) AS iso3, coalesce('u' || unit, '') AS unit, years, latest_year, latest_value FROM l JOIN n USING (country, indicator)""",
    "record_marks": "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 AND doc_id % 4 <> 0 THEN (doc_id + n_chars) / 2.0 WHEN doc_id % 3 <> 0 THEN doc_id WHEN doc_id % 4 <> 0 THEN n_chars END::DOUBLE AS midpoint, round(CASE WHEN doc_id % 4 <> 0 AND n_chars > 500 THEN least(1, log10(n_chars - 499) / 4) ELSE 0 END, 9)::DOUBLE AS attention, source || ':' || doc_id || '#comment-c1' AS anchor FROM documents",
    "page_texts": f"SELECT page_id, regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'si') AS title, {_visible('html')} AS content, CASE {' '.join(f'WHEN contains(lower(html), {chr(39)}{m}{chr(39)}) THEN {chr(39)}{m}{chr(39)}' for m in _MARKERS)} WHEN length(html) < 600 AND (contains(lower(html), 'challenge-platform') OR contains(lower(html), '/cdn-cgi/challenge')) THEN 'short_challenge_shell' END AS blocked FROM pages",
    "page_versions": f"WITH v AS (SELECT url, {_visible('html')} AS content FROM pages) SELECT url, substr(sha256(content), 1, 16) AS version FROM v WHERE length(content) >= 200",
    "normal_urls": "SELECT page_id, regexp_replace(lower(regexp_replace(regexp_replace(url, '[?#].*$', '', 's'), '/+$', '')), '^https?://(www\\.)?', '') AS url FROM pages",
    "tail_passages": """WITH c AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, i, substr(text, i * 2000 + 1, 2000) AS s FROM documents, unnest(range(1, 17)) AS r(i) WHERE length(text) > i * 2000),
k AS (SELECT *, title || chr(10) || s AS p FROM c WHERE trim(s) <> '') SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS chunk, length(p)::INTEGER AS chars, sha256(p) AS digest FROM k""",
    "text_pages": """WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, text, length(text) AS n FROM documents),
p AS (SELECT doc_id, 0 AS page, 0 AS start FROM d WHERE n IS NOT NULL UNION ALL SELECT doc_id, page + 1, ends FROM (SELECT p.doc_id, page, start + length(raw) - CASE WHEN contains(right(raw, 400), chr(10)) THEN length(regexp_extract(raw, '[^\\n]*$')) ELSE 0 END AS ends
  FROM (SELECT p.*, substr(text, start + 1, 1000) AS raw, n FROM p JOIN d USING (doc_id)) p WHERE start + 1000 < n)),
e AS (SELECT doc_id, page, start, lead(start) OVER (PARTITION BY doc_id ORDER BY page) AS next FROM p)
SELECT doc_id, page::INTEGER AS page, start::INTEGER AS start, (coalesce(next, n) - start)::INTEGER AS chars, next::INTEGER AS next, sha256(substr(text, start + 1, coalesce(next, n) - start)) AS digest FROM d LEFT JOIN e USING (doc_id)""",
    "record_fields": "SELECT event_id, (props->>'$.k')::BIGINT AS k, (props->>'$.k')::BIGINT AS deep, 'rows' AS rows, 'empty' AS none, 'wrong_type' AS at_state, 'absent' AS missing, event_id::VARCHAR AS any_of FROM events",
    "dates_read": "SELECT event_id, CASE event_id // 4 % 17 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('day', ts) WHEN 2 THEN date_trunc('day', ts) WHEN 5 THEN date_trunc('day', ts) WHEN 6 THEN date_trunc('second', ts) WHEN 7 THEN ts WHEN 8 THEN date_trunc('second', ts) - INTERVAL 2 HOUR WHEN 13 THEN date_trunc('second', ts) WHEN 14 THEN TIMESTAMP '1970-01-02 00:00:00.5' END::TIMESTAMP AS date FROM events",
    "agent_views": "SELECT doc_id, sha256(substr(text, 1, 2000)) AS content, length(text) > 2000 AS content_truncated, length(text)::INTEGER AS content_full_chars FROM documents",
    "summary_lines": "SELECT doc_id, concat_ws(' | ', '[' || source || ']', nullif(split_part(text, chr(10), 1), ''), CASE WHEN doc_id % 7 <> 0 THEN strftime(TIMESTAMP '2024-01-01' + to_days((doc_id % 400)::INTEGER), '%Y-%m-%d') END) AS line FROM documents",
    "inverted_abstracts": "SELECT doc_id, array_to_string(regexp_split_to_array(text, '\\s+'), ' ') AS abstract FROM documents",
    "conversation_answers": """WITH q AS (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id), a AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS nth FROM conversations WHERE role = 'assistant')
SELECT conv_id AS id, 'question' AS part, text FROM q UNION ALL SELECT q.conv_id, 'answer', a.text FROM q JOIN a ON a.conv_id = q.conv_id AND nth = 1""",
    "newest_values": """WITH f AS (SELECT l_partkey % 300 AS concept, l_shipdate::DATE AS e, l_shipdate::DATE - trunc(l_quantity)::INTEGER AS s, l_orderkey * 10 + l_linenumber AS filed, min(l_extendedprice) AS value FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY e DESC, e - s, filed DESC) AS nth FROM f) SELECT concept, value, e AS "end" FROM r WHERE nth = 1""",
    "source_quota": "WITH r AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS nth FROM documents) SELECT doc_id, source, n_chars FROM r WHERE nth <= 5",
}
