"""Divergence of sources: which sources of a language use its words differently, and which words set them apart.

Sort-based streaming.  A task sorts its documents' words by (lang, source, term, document) and scans the runs, so what is
shuffled are runs with their numbers of documents and occurrences.  Those are repartitioned by (lang, term), sorted by
(lang, term, source) and scanned again: each term's run yields its document frequency, its total and its count in each
source.  A second scan over the kept terms emits, for each run, the partial sums of all pairs of sources that hold it.

Most terms are missing in most sources.  For two sources g and o, with p0 for a missing term, the sum over all kept
terms of f(p_g, p_o) is taken as

    (kept - held_g - held_o) f(p0_g, p0_o) + sum over terms of g of f(p_g, p0_o) + sum over terms of o of f(p0_g, p_o)
    + sum over terms of both of [f(p_g, p_o) - f(p_g, p0_o) - f(p0_g, p_o) + f(p0_g, p0_o)]

in whole numbers, so that only the last sum visits terms, and only those that both hold; the middle ones follow from
how many terms of a source have each probability.

Defined results: null text, lang or source count as the empty one; a row is a document, repeated rows too; a group without
terms has pairs all the same (value 0 where its language keeps none); an empty table gives an empty result; equal
values rank by item.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words
from .common import discard, materialise, table
from .workers import begin

LEAST_DOCS, MOST_TERMS = 3, 200
#: Pairs of sources that a scan expands at once.
PAIRS = 1 << 20


def changes(*columns):
    """By row, whether any of the columns differs from the row before; the first row does."""
    import numpy as np
    import pyarrow.compute as pc

    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return out


def codes(column):
    """(number of each row's value, the values)."""
    import numpy as np

    known = column.dictionary_encode()
    return known.indices.to_numpy().astype(np.int64), known.dictionary


def document_runs(docs: DataFrame) -> DataFrame:
    """(lang, source, term, docs, n): for a batch of documents, how many hold a term and how often it occurs."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        begin("divergence")
        inside = words.letters_only()
        for batch in batches:
            (lang, langs), (source, sources) = codes(batch.column("lang")), codes(batch.column("source"))
            group = lang * len(sources) + source
            seen: dict[bytes, int] = {}
            places, terms = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for rows, pieces in words.split(batch.column("text"), inside):
                known = pieces.dictionary_encode()
                numbers = np.fromiter((seen.setdefault(w, len(seen)) for w in known.dictionary.to_pylist()), np.int64)
                places.append(rows)
                terms.append(numbers[known.indices.to_numpy()])
            rows, size = np.concatenate(places), max(1, len(batch))
            keys = np.sort((group[rows] * max(1, len(seen)) + np.concatenate(terms)) * size + rows)
            if not len(keys):
                continue
            of = keys // size
            starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            holds = np.add.reduceat(np.append(True, keys[1:] != keys[:-1]).astype(np.int64), starts)
            group, term = np.divmod(of[starts], len(seen))
            lang, source = np.divmod(group, len(sources))
            spelled = pa.array(list(seen), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(lang)), sources.take(pa.array(source)), spelled.take(pa.array(term)), pa.array(holds), pa.array(np.diff(np.append(starts, len(keys))))], ["lang", "source", "term", "docs", "n"])

    return docs.mapInArrow(run, "lang string, source string, term string, docs long, n long")


def runs_of(batches: Iterator, fold) -> Iterator:
    """Sorted batches cut where (lang, term) changes: a run that may go on waits, as ``fold`` leaves it."""
    import numpy as np
    import pyarrow as pa

    waiting = None
    for batch in batches:
        if not batch.num_rows:
            continue
        found = pa.Table.from_batches([batch]) if waiting is None else pa.concat_tables([waiting, pa.Table.from_batches([batch])])
        found = fold(found.combine_chunks())
        last = int(np.flatnonzero(changes(*(found.column(c).chunk(0) for c in ("lang", "term"))))[-1])
        if last:
            yield found.slice(0, last).combine_chunks()
        waiting = found.slice(last).combine_chunks()
    if waiting is not None:
        yield waiting


def kept_terms(runs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, source, n, total, lead) of the terms in enough documents; ``lead`` marks one row of each term."""

    def fold(found):
        """One row for each (lang, term, source), so that a very common term waits as one row for each source."""
        import numpy as np
        import pyarrow as pa

        starts = np.flatnonzero(changes(*(found.column(c).chunk(0) for c in ("lang", "term", "source"))))
        sums = {c: pa.array(np.add.reduceat(found.column(c).to_numpy(), starts)) for c in ("docs", "n")}
        firsts = found.select(["lang", "term", "source"]).take(pa.array(starts))
        return pa.table({c: firsts.column(c) for c in firsts.column_names} | sums).combine_chunks()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        begin("divergence")
        for found in runs_of(batches, fold):
            lead = changes(*(found.column(c).chunk(0) for c in ("lang", "term")))
            starts, of = np.flatnonzero(lead), np.cumsum(lead) - 1
            docs, total = (np.add.reduceat(found.column(c).to_numpy(), starts) for c in ("docs", "n"))
            out = found.select(["lang", "term", "source", "n"]).append_column("total", pa.array(total[of])).append_column("lead", pa.array(lead))
            yield from out.filter(pa.array((docs >= least_docs)[of])).to_batches()

    keys = ["lang", "term", "source"]
    ordered = runs.select(*keys, "docs", "n").repartition("lang", "term").sortWithinPartitions(*keys)
    return ordered.mapInArrow(run, "lang string, term string, source string, n long, total long, lead boolean")


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(10^9 (count + 1) / (total + kept)), exact beyond 64 bits."""
    return F.expr(f"1 + (CAST(1000000000 AS DECIMAL(10, 0)) * ({count} + 1)) div ({total} + {kept})")


def gap(p: str, q: str) -> str:
    """floor((p - q)^2 / q); shares are at most 10^9 + 1, so the square fits 64 bits."""
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div ({q})"


def shared_terms(probable: DataFrame) -> DataFrame:
    """(lang, source, item, value): partial sums over terms that two sources both hold."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        begin("divergence")
        gaps = lambda p, q: (p - q) * (p - q) // q
        for found in runs_of(batches, lambda x: x):
            lead = changes(*(found.column(c).chunk(0) for c in ("lang", "term")))
            starts, of = np.flatnonzero(lead), np.cumsum(lead) - 1
            sizes = np.diff(np.append(starts, len(of)))[of]  # by row, the sources of its term
            (lang, langs), (source, sources) = codes(found.column("lang").chunk(0)), codes(found.column("source").chunk(0))
            p, p0 = found.column("p").to_numpy(), found.column("p0").to_numpy()
            ahead, at = np.cumsum(sizes), 0
            while at < len(of):
                stop = max(at + 1, int(np.searchsorted(ahead, (ahead[at - 1] if at else 0) + PAIRS, "right")))
                one = np.repeat(np.arange(at, stop), sizes[at:stop])
                nth = np.arange(len(one)) - np.repeat(np.append(0, np.cumsum(sizes[at:stop]))[:-1], sizes[at:stop])
                two, at = starts[of[one]] + nth, stop
                one, two = one[one != two], two[one != two]
                if not len(one):
                    continue
                net = gaps(p[one], p[two]) - gaps(p[one], p0[two]) - gaps(p0[one], p[two]) + gaps(p0[one], p0[two])
                key = (lang[one] * len(sources) + source[one]) * len(sources) + source[two]
                order = np.argsort(key, kind="stable")
                key, net = key[order], net[order]
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                pair, other = np.divmod(key[first], len(sources))
                tongue, own = np.divmod(pair, len(sources))
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(tongue)), sources.take(pa.array(own)), sources.take(pa.array(other)), pa.array(np.add.reduceat(net, first))], ["lang", "source", "item", "value"])

    keys = ["lang", "term", "source"]
    ordered = probable.select(*keys, "p", "p0").repartition("lang", "term").sortWithinPartitions(*keys)
    return ordered.mapInArrow(run, "lang string, source string, item string, value long")


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows for the other sources, ``term`` rows for leading terms."""
    docs = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = materialise(kept_terms(document_runs(docs), least_docs), "kept-terms")
    langs = kept.where("lead").groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_n"))
    held = kept.groupBy("lang", "source").agg(F.count("*").alias("held"), F.sum("n").alias("source_n"))
    groups = docs.select("lang", "source").distinct().join(held, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["held", "source_n", "kept", "lang_n"])
    groups = materialise(groups.withColumn("p0", F.when(F.col("kept") > 0, share("0", "source_n", "kept"))), "groups")
    shares = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", share("n", "source_n", "kept").alias("p"), share("total", "lang_n", "kept").alias("q"), "p0")
    shares = materialise(shares, "shares")
    discard(kept)

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    apart = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(gap("p", "q")).alias("value"))
    terms = apart.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most_terms)

    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("item_p0"), F.col("held").alias("item_held"))
    pairs = groups.join(other, "lang").where("source <> item")
    big = "CAST({0} AS DECIMAL(20, 0)) * ({1})"
    missing = pairs.select("lang", "source", "item", F.expr("coalesce(" + big.format("kept - held - item_held", gap("p0", "item_p0")) + ", 0)").alias("value"))
    levels = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("n")).join(other, "lang").where("source <> item")
    alone = levels.groupBy("lang", "source", "item").agg(F.expr("sum(" + big.format("n", gap("p", "item_p0")) + ")").alias("own"), F.expr("sum(" + big.format("n", gap("item_p0", "p")) + ")").alias("others"))
    both = alone.select("lang", F.explode(F.array(F.struct("source", "item", F.col("own").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("others").alias("value")))).alias("x")).select("lang", "x.*")
    parts = [x.select("lang", "source", "item", F.col("value").cast("decimal(38, 0)").alias("value")) for x in (missing, both, shared_terms(shares))]
    summed = parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    ranked = summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
    return ranked.unionByName(terms)


#: By the definition: every kept term in every group.
SQL = r"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS MATERIALIZED (SELECT id, lang, source, term, count(*) AS n FROM (SELECT id, lang, source, unnest(terms) AS term FROM d) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(n)::HUGEINT AS n FROM t GROUP BY ALL HAVING count(*) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang),
c AS MATERIALIZED (SELECT lang, source, term, sum(t.n)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (SELECT lang, gn.source, term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (gn.n + v.v) AS p FROM gn JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
every AS (SELECT lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0)::BIGINT AS value FROM g a JOIN g b USING (lang) LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source WHERE a.source <> b.source),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (kept.n + 1)) // (v.n + v.v) AS q FROM kept JOIN v USING (lang)),
apart AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM every UNION ALL SELECT * FROM apart))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200"""


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))
