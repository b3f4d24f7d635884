"""Queries over documents and vectors: scoring, deduplication, ranking, recall; with SQL that gives the same rows.

``documents`` stand in for what sources return: the first line is the title, identifiers and dates are made from doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import text as X
from quillspan.operators import rank, recall, relevance, resolve
from quillspan.storage import materialise, spread

QUERY = "the tion of and erthe with 9 a"
NOW = "2025-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS pos", "source", "CAST(doc_id AS STRING) AS source_id", "split_part(text, '\\n', 1) AS title", "text AS content",
        "concat('https://www.Site', doc_id % 50, '.org/p/', doc_id % 700, '/?q=', doc_id) AS url",
        "CASE WHEN doc_id % 50 = 3 THEN concat('https://doi.org/10.1234/W', doc_id % 11) END AS doi",
        "CASE WHEN doc_id % 90 = 4 THEN concat('2401.0', 1000 + doc_id % 5) END AS arxiv",
        "CASE WHEN doc_id % 7 <> 0 THEN timestampadd(DAY, CAST(doc_id % 400 AS INT), TIMESTAMP '2024-01-01') END AS date",
        "CAST(CASE WHEN doc_id % 5 = 0 THEN 0 ELSE n_chars END AS DOUBLE) AS attention", "CAST(substr(source, 4) AS INT) % 5 AS backend", "lang",
    )


DOCS = r"""docs AS (
  SELECT doc_id AS pos, source, doc_id::VARCHAR AS source_id, split_part(text, chr(10), 1) AS title, text AS content,
    'https://www.Site' || (doc_id % 50) || '.org/p/' || (doc_id % 700) || '/?q=' || doc_id AS url,
    CASE WHEN doc_id % 50 = 3 THEN 'https://doi.org/10.1234/W' || (doc_id % 11) END AS doi,
    CASE WHEN doc_id % 90 = 4 THEN '2401.0' || (1000 + doc_id % 5) END AS arxiv,
    CASE WHEN doc_id % 7 <> 0 THEN TIMESTAMP '2024-01-01' + to_days((doc_id % 400)::INTEGER) END AS date,
    (CASE WHEN doc_id % 5 = 0 THEN 0 ELSE n_chars END)::DOUBLE AS attention, substr(source, 4)::INTEGER % 5 AS backend, lang
  FROM documents)"""
TOKENS = r"regexp_extract_all(lower({0}), '[a-z0-9À-ÖØ-öø-ɏ]+|[\p{{L}}\p{{Nl}}\p{{No}}]+')"
TERMS = ["the", "tion", "of", "and", "erthe", "with"]  # of QUERY; the last two words are single characters
SCORED = f"""tok AS (SELECT pos, {TOKENS.format('title')} AS t, {TOKENS.format('content')} AS c FROM docs),
len AS (SELECT pos, 3.0 * len(t) + len(c) AS dl FROM tok),
tf AS (SELECT pos, term, 3.0 * len(list_filter(t, lambda x: x = term)) + len(list_filter(c, lambda x: x = term)) AS f FROM tok, unnest({TERMS}) AS q(term)),
df AS (SELECT term, count(*) FILTER (f > 0) AS d FROM tf GROUP BY term),
scored AS (SELECT tf.pos, sum(CASE WHEN f > 0 THEN ln(1 + (n - d + 0.5) / (d + 0.5)) * (f * 2.2) / (f + 1.2 * (0.25 + 0.75 * dl / av)) ELSE 0 END)::DOUBLE AS score
  FROM tf JOIN df USING (term) JOIN len USING (pos), (SELECT count(*)::DOUBLE AS n, avg(dl) AS av FROM len) GROUP BY tf.pos)"""
FIELDS = [("title", 3.0), ("content", 1.0)]

FP = r"""fps AS (
  SELECT *, regexp_replace(lower(title), '[^\p{L}\p{N}]+', '', 'g') AS nt,
    regexp_replace(lower(doi), '^https?://(dx\.)?doi\.org/', '') AS nd,
    regexp_replace(lower(rtrim(split_part(split_part(url, '?', 1), '#', 1), '/')), '^https?://(www\.)?', '') AS nu FROM docs
), keyed AS (
  SELECT *, CASE WHEN length(nt) >= 20 THEN 'title:' || nt WHEN nd IS NOT NULL THEN 'doi:' || nd WHEN nu <> '' THEN 'url:' || nu ELSE 'id:' || source || ':' || source_id END AS fp FROM fps
)"""
GROUPS = f"""{FP}, firsts AS (SELECT fp, min(pos) AS fp_pos FROM keyed GROUP BY fp),
holders AS (SELECT DISTINCT unnest(list_filter(['doi:' || nd, 'arxiv:' || arxiv], lambda x: x IS NOT NULL)) AS strong, fp FROM keyed),
edges AS (SELECT DISTINCT a.fp_pos AS a, b.fp_pos AS b FROM holders x JOIN holders y USING (strong) JOIN firsts a ON a.fp = x.fp JOIN firsts b ON b.fp = y.fp WHERE x.fp <> y.fp),
reach AS (SELECT fp_pos AS node, fp_pos AS least FROM firsts UNION SELECT e.b, r.least FROM reach r JOIN edges e ON e.a = r.node WHERE r.least < e.b),
placed AS (SELECT f.fp, min(r.least) AS grp, f.fp_pos IN (SELECT a FROM edges) AS united FROM firsts f JOIN reach r ON r.node = f.fp_pos GROUP BY f.fp, f.fp_pos),
members AS (SELECT k.*, p.grp, p.united FROM keyed k JOIN placed p USING (fp))"""
SURVIVORS = f"""{GROUPS}, best AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY length(content) DESC, attention DESC, pos) AS nth FROM members),
facts AS (SELECT grp, list_sort(list(DISTINCT source)) AS sources, count(DISTINCT backend) AS backends, count(*) AS n,
  arg_min(date, pos) FILTER (date IS NOT NULL) AS d, arg_min(source, pos) FILTER (date IS NOT NULL) AS ds, bool_or(united) AS united, arg_min(fp, pos) AS fp FROM members GROUP BY grp),
survivors AS (SELECT grp, b.pos, b.source, f.n AS members, list_filter(sources, lambda s: s <> b.source) AS also_in, sources AS live_sources,
  greatest(backends, 1) AS corroboration, coalesce(b.date, d) AS date, CASE WHEN b.date IS NULL THEN ds END AS date_from,
  CASE WHEN f.united OR NOT starts_with(f.fp, 'title:') THEN 'id' ELSE 'title' END AS merge_basis, b.title, b.content, b.attention
  FROM best b JOIN facts f USING (grp) WHERE nth = 1)"""
ENG = """counts AS (SELECT source, attention, count(*) AS n FROM {0} WHERE attention > 0 GROUP BY ALL),
shares AS (SELECT source, attention, ((coalesce(sum(n) OVER (PARTITION BY source ORDER BY attention ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 0.5 * n) / sum(n) OVER (PARTITION BY source))::DOUBLE AS eng FROM counts),
engaged AS (SELECT d.*, coalesce(eng, 0) AS eng FROM {0} d LEFT JOIN shares USING (source, attention))"""


def bm25_topk(spark, sf_dir):
    scored = relevance.bm25(corpus(spark, sf_dir), FIELDS, relevance.term_list(spark, QUERY), keep=["pos", "source"])
    return scored.orderBy(F.desc("score"), "pos").limit(20).select("pos", "source", F.round("score", 6).alias("score"))


def keyword_filter(spark, sf_dir):
    scored = relevance.bm25(corpus(spark, sf_dir), FIELDS, relevance.term_list(spark, QUERY))
    return scored.where("score > 0").select("pos", F.round("score", 6).alias("score"))


def plain_term_counts(spark, sf_dir):
    return relevance.term_counts(corpus(spark, sf_dir), "title", "content", ["the", "tion"]).where("score > 0").select("pos", "score")


def tokenized(spark, sf_dir):
    t = X.tokens(F.col("content"))
    return corpus(spark, sf_dir).select("pos", F.size(t).alias("n_tokens"), F.sha2(F.array_join(t, " "), 256).alias("segment"))


def fingerprints(spark, sf_dir):
    key = X.fingerprint(*(F.col(c) for c in ("title", "doi", "url", "source", "source_id")))
    return corpus(spark, sf_dir).select("pos", key.alias("fp"))


def dedup_survivors(spark, sf_dir):
    found = resolve.survivors(resolve.grouped(materialise(spread(corpus(spark, sf_dir)).select(*resolve.narrow_columns()), "narrow")))
    return found.select("pos", "source", "members", F.array_join("also_in", ",").alias("also_in"), F.array_join("live_sources", ",").alias("live_sources"), "corroboration", "date", "date_from", "merge_basis")


def engagement_percentile(spark, sf_dir):
    return rank.engagement(corpus(spark, sf_dir)).select("pos", F.round("eng", 9).alias("eng"))


def signal_divergence(spark, sf_dir):
    """Quantities of one part by one supplier in different orders stand for what sources say of one work."""
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey AS grp", "l_orderkey * 10 + l_linenumber AS pos", "concat('s', l_suppkey % 7) AS source", "stack(2, 'quantity', l_quantity, 'net', round(l_extendedprice * (0.05 - l_discount), 2)) AS (signal, value)"
    )
    lines = lines.groupBy("grp", "pos", "signal").agg(F.min("source").alias("source"), F.min("value").alias("value"))
    return resolve.divergences(lines)


def merged_rank(spark, sf_dir, limit: int = 25):
    """Flagship: deduplicate all candidates, score, blend and cut, with the stamps of each survivor."""
    docs, now = corpus(spark, sf_dir), F.lit(NOW).cast("timestamp")
    terms = relevance.term_list(spark, QUERY)
    # one scan of the texts gives all that is needed of them until the last rows are known
    counted = materialise(relevance.frequencies(spread(docs), FIELDS, terms, resolve.narrow_columns()), "narrow")
    counts = [c for c in counted.columns if c.startswith("_")]
    kept = resolve.survivors(resolve.grouped(counted.drop(*counts))).select("pos", "source", "corroboration", "date")
    candidates = materialise(kept.join(counted.select("pos", "attention", *counts), "pos"), "candidates")
    narrow = materialise(relevance.scored(candidates, terms, "rel").withColumn("rrf", F.lit(None).cast("double")), "scored")
    blended = rank.composite(rank.engagement(narrow), now, bool(terms))
    top = blended.orderBy(F.desc(F.round("composite", 9)), "pos").limit(limit)
    stamped = F.broadcast(top.drop("attention")).join(docs.select("pos", "title", "content"), "pos")  # ``limit`` rows
    return stamped.select("pos", "source", "corroboration", F.round("composite", 6).alias("composite"), rank.freshness(F.col("date"), now).alias("freshness_class"), X.hook(F.col("title"), F.col("content"), F.array(*map(F.lit, terms))).alias("relevance_hook"))


def source_diversity(spark, sf_dir):
    """Of the best twenty rows: how many of each label (language, backend) and which labels have none."""
    top = relevance.bm25(corpus(spark, sf_dir), FIELDS, relevance.term_list(spark, QUERY), keep=["pos", "source", "lang", "backend"]).orderBy(F.desc("score"), "pos").limit(20)
    labelled = top.select(F.explode(F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("backend:"), "backend"))).alias("label"), "source")
    present = labelled.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))
    known = corpus(spark, sf_dir).select(F.explode(F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("backend:"), "backend"))).alias("label")).distinct()
    return known.join(present, "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("sources", F.lit(0)).cast("long").alias("sources"))


def _vectors(spark, sf_dir):
    """Heads are the rows themselves; rows of the upper half are further passages of the lower half's documents."""
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 250).alias("key"), F.col("embedding").alias("vector"), "label", "vec_id")


def _query_vector(spark, sf_dir, vec_id: int) -> list[float]:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]


def vector_topk(spark, sf_dir):
    found = recall.vector_search(_vectors(spark, sf_dir), _query_vector(spark, sf_dir, 7), 20, F.col("label").isin(1, 2, 3, 4))
    return found.select("key", F.round("cos", 6).alias("cos"))


def similar_rows(spark, sf_dir):
    """The nearest rows of an anchor by rank; no scores leave the operator, and ``capped`` says that more exist."""
    rows = table(spark, sf_dir, "embeddings").where("vec_id <> 11").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    found = recall.vector_search(rows, _query_vector(spark, sf_dir, 11), 11).withColumn("cos", F.round("cos", 9))
    top = recall.ranked(found, F.desc("cos"), F.col("key"), k=11)
    return top.select("key", "rank", F.max(F.col("rank") > 10).over(_everything()).alias("capped")).where("rank <= 10")


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy()


def hybrid_recall(spark, sf_dir):
    scored = relevance.bm25(corpus(spark, sf_dir), FIELDS, relevance.term_list(spark, QUERY), keep=["pos"]).where("score > 0").select((F.col("pos") % 250).alias("key"), F.round("score", 6).alias("score"))
    lexical = recall.ranked(scored.groupBy("key").agg(F.max("score").alias("score")), F.desc("score"), F.col("key"), k=50)
    near = recall.vector_search(_vectors(spark, sf_dir), _query_vector(spark, sf_dir, 7), 50).withColumn("cos", F.round("cos", 9))
    vector = recall.ranked(near, F.desc("cos"), F.col("key"), k=50)
    return recall.fuse(lexical, vector).select("key", F.round("rrf", 9).alias("rrf"), "via")


COS = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[]) / sqrt(list_dot_product({0}::DOUBLE[], {0}::DOUBLE[])) / sqrt(list_dot_product({1}::DOUBLE[], {1}::DOUBLE[]))"
QUERIES = {
    "bm25_topk": bm25_topk, "keyword_filter": keyword_filter, "plain_term_counts": plain_term_counts, "tokenized": tokenized, "fingerprints": fingerprints,
    "dedup_survivors": dedup_survivors, "engagement_percentile": engagement_percentile, "signal_divergence": signal_divergence, "merged_rank": merged_rank,
    "source_diversity": source_diversity, "vector_topk": vector_topk, "similar_rows": similar_rows, "hybrid_recall": hybrid_recall,
}

ORACLE_SQL = {
    "bm25_topk": f"WITH {DOCS}, {SCORED} SELECT pos, source, round(score, 6) AS score FROM scored JOIN docs USING (pos) ORDER BY scored.score DESC, pos LIMIT 20",
    "keyword_filter": f"WITH {DOCS}, {SCORED} SELECT pos, round(score, 6) AS score FROM scored WHERE score > 0",
    "plain_term_counts": f"""WITH {DOCS}, c AS (SELECT pos, ({' + '.join(f"(length(lower(content)) - length(replace(lower(content), '{t}', ''))) // {len(t)} + 3 * ((length(lower(title)) - length(replace(lower(title), '{t}', ''))) // {len(t)})" for t in ('the', 'tion'))})::BIGINT AS score FROM docs) SELECT * FROM c WHERE score > 0""",
    "tokenized": f"WITH {DOCS} SELECT pos, len({TOKENS.format('content')})::INTEGER AS n_tokens, sha256(array_to_string({TOKENS.format('content')}, ' ')) AS segment FROM docs",
    "fingerprints": f"WITH {DOCS}, {FP} SELECT pos, fp FROM keyed",
    "dedup_survivors": f"WITH RECURSIVE {DOCS}, {SURVIVORS} SELECT pos, source, members, array_to_string(also_in, ',') AS also_in, array_to_string(live_sources, ',') AS live_sources, corroboration, date, date_from, merge_basis FROM survivors",
    "engagement_percentile": f"WITH {DOCS}, {ENG.format('docs')} SELECT pos, round(eng, 9)::DOUBLE AS eng FROM engaged",
    "signal_divergence": """
WITH raw AS (SELECT DISTINCT l_partkey AS grp, l_orderkey * 10 + l_linenumber AS pos, 's' || (l_suppkey % 7) AS source, l_quantity AS q, round(l_extendedprice * (0.05 - l_discount), 2) AS v FROM lineitem),
one AS (SELECT grp, pos, min(source) AS source, min(q) AS q, min(v) AS v FROM raw GROUP BY ALL),
s AS (SELECT grp, pos, source, 'quantity' AS signal, q AS value FROM one UNION ALL SELECT grp, pos, source, 'net', v FROM one),
p AS (SELECT a.grp, a.signal, a.source AS source_a, b.source AS source_b, a.pos AS pos_a, b.pos AS pos_b,
  CASE WHEN a.value = b.value THEN NULL WHEN a.value * b.value < 0 OR least(abs(a.value), abs(b.value)) = 0 THEN 'inf'::DOUBLE ELSE greatest(abs(a.value), abs(b.value)) / least(abs(a.value), abs(b.value)) END AS ratio
  FROM s a JOIN s b ON a.grp = b.grp AND a.signal = b.signal AND a.pos < b.pos AND a.source <> b.source),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ratio DESC, pos_a, pos_b, signal) AS nth FROM p WHERE ratio IS NOT NULL)
SELECT grp, signal, source_a, source_b, pos_a, pos_b, CASE WHEN isinf(ratio) THEN ratio ELSE round(ratio * pow(10.0, 2 - floor(log10(ratio)))) / pow(10.0, 2 - floor(log10(ratio))) END AS ratio, nth::INTEGER AS nth FROM r WHERE nth <= 3""",
    "merged_rank": f"""WITH RECURSIVE {DOCS}, {SURVIVORS}, {SCORED.replace('FROM docs)', 'FROM survivors)')}, {ENG.format('survivors')},
aged AS (SELECT pos, CASE WHEN date IS NOT NULL THEN 1 / (1 + greatest(0, (epoch(TIMESTAMP '{NOW}') - epoch(date)) / 86400) / 30) END AS rec FROM survivors),
med AS (SELECT list_sort(list(rec))[len(list(rec)) // 2 + 1] AS m FROM aged WHERE rec IS NOT NULL),
blend AS (SELECT e.pos, e.source, e.corroboration, e.date, e.title, e.content, (0.6 * s.score / (SELECT max(score) FROM scored) + 0.25 * coalesce(a.rec, (SELECT m FROM med)) + 0.15 * e.eng) * (1 + 0.15 * least(1, (e.corroboration - 1) / 3)) AS c
  FROM engaged e JOIN scored s USING (pos) JOIN aged a USING (pos)),
top AS (SELECT *, (epoch(TIMESTAMP '{NOW}') - epoch(date)) / 86400 AS days FROM blend ORDER BY round(c, 9) DESC, pos LIMIT 25),
sents AS (SELECT pos, unnest(range(1, len(s) + 1)) AS i, unnest(s) AS s FROM (SELECT pos, list_filter(list_transform(string_split(regexp_replace(title || '. ' || substr(content, 1, 500), '([.!?])\\s+|\\n|。', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM top)),
hits AS (SELECT pos, i, s, len(list_intersect({TERMS}, {TOKENS.format('s')})) AS n FROM sents),
hook AS (SELECT pos, substr(s, 1, 120) AS h, row_number() OVER (PARTITION BY pos ORDER BY n DESC, i) AS nth FROM hits WHERE n > 0)
SELECT pos, source, corroboration, round(c, 6)::DOUBLE AS composite, CASE WHEN round(days, 1) <= 1 THEN 'breaking' WHEN round(days, 1) <= 7 THEN 'recent' WHEN round(days, 1) <= 30 THEN 'current' WHEN round(days, 1) <= 365 THEN 'dated' WHEN days IS NOT NULL THEN 'archival' END AS freshness_class, coalesce(h, '') AS relevance_hook
FROM top LEFT JOIN hook USING (pos) WHERE coalesce(nth, 1) = 1""",
    "source_diversity": f"""WITH {DOCS}, {SCORED}, top AS (SELECT * FROM scored JOIN docs USING (pos) ORDER BY score DESC, pos LIMIT 20),
l AS (SELECT unnest(['lang:' || lang, 'backend:' || backend]) AS label, source FROM top), k AS (SELECT DISTINCT unnest(['lang:' || lang, 'backend:' || backend]) AS label FROM docs)
SELECT k.label, count(l.label) AS n, count(DISTINCT l.source) AS sources FROM k LEFT JOIN l USING (label) GROUP BY k.label""",
    "vector_topk": f"""SELECT vec_id % 250 AS key, round(max({COS.format('e.embedding', 'q.embedding')}), 6) AS cos FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE label IN (1, 2, 3, 4) GROUP BY 1 ORDER BY max({COS.format('e.embedding', 'q.embedding')}) DESC, key LIMIT 20""",
    "similar_rows": f"""WITH s AS (SELECT vec_id AS key, row_number() OVER (ORDER BY round({COS.format('e.embedding', 'q.embedding')}, 9) DESC, vec_id) AS rank FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 11) q WHERE vec_id <> 11) SELECT key, rank::INTEGER AS rank, (SELECT count(*) > 10 FROM s) AS capped FROM s WHERE rank <= 10""",
    "hybrid_recall": f"""WITH {DOCS}, {SCORED}, lk AS (SELECT pos % 250 AS key, max(round(score, 6)) AS score FROM scored WHERE score > 0 GROUP BY 1),
l AS (SELECT key, row_number() OVER (ORDER BY score DESC, key) AS rank FROM lk),
vk AS (SELECT vec_id % 250 AS key, max({COS.format('e.embedding', 'q.embedding')}) AS cos FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q GROUP BY 1),
v AS (SELECT key, row_number() OVER (ORDER BY round(cos, 9) DESC, key) AS rank FROM vk),
u AS (SELECT key, rank, 'lexical' AS arm FROM l WHERE rank <= 50 UNION ALL SELECT key, rank, 'vector' FROM v WHERE rank <= 50)
SELECT key, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, CASE WHEN count(DISTINCT arm) > 1 THEN 'both' ELSE min(arm) END AS via FROM u GROUP BY key""",
}
