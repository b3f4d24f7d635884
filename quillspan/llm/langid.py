"""Language identification by a string kernel.

The kernel of two texts is the number of n-grams (one to three bytes of the lower-cased text, as hashed features) that
both hold, divided by the root of the product of how many each holds: the blended spectrum kernel of n-gram presence.
Landmark texts give a Nyström approximation, and kernel ridge regression separates each language from the rest.
The regression's weights are folded through the landmarks, so a batch of texts is scored by one product of its
presence matrix with a matrix of a column for each language.

The fit uses a bounded sample of labelled rows, ``SAMPLE`` in all, dealt evenly to the languages and chosen by a hash of
doc_id; ``LANDMARKS`` of them become landmarks.  Prediction reads whole texts.

Defined results: a text that is null or has no letter gets ``und`` with score 0; so does every text if there is no
labelled row to learn from.  Repeated rows get equal predictions; null ids are never learned from and count as not
held out; other columns pass through or are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, table
from .workers import begin

SAMPLE, LANDMARKS = 2048, 256
FEATURES_LOG2 = 15
BYTES_AT_ONCE = 1 << 20
RIDGE = 1e-3
NO_LANGUAGE = "und"


def feature_ids(b):
    """The hashed feature of every n-gram occurrence in an array of bytes."""
    import numpy as np

    b = b.astype(np.uint32)
    two = (b[:-1] << 8 | b[1:]) + np.uint32(1 << 24)
    three = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) + np.uint32(1 << 25)
    mixed = np.concatenate((b, two, three)) * np.uint32(2654435761)
    return mixed >> np.uint32(32 - FEATURES_LOG2)


def presence(texts: list[str]):
    """A row of zeros and ones for each text: which features it holds.  ``BYTES_AT_ONCE`` bytes of a text are hashed at once."""
    import numpy as np

    rows = np.zeros((len(texts), 1 << FEATURES_LOG2), np.float32)
    for row, text in zip(rows, texts):
        data = np.frombuffer(text.lower().encode(), dtype=np.uint8)
        for k in range(0, len(data), BYTES_AT_ONCE):
            row[feature_ids(data[k : k + BYTES_AT_ONCE + 2])] = 1  # n-grams over the cut are met once more
    return rows


def fit(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE):
    """(languages, weights): a text's one-versus-rest scores are presence @ weights / sqrt(its features)."""
    import numpy as np

    rows = sorted(rows)
    languages = sorted({lang for lang, _ in rows})
    order = np.random.default_rng(7).permutation(len(rows))[: min(landmarks, len(rows))]
    anchors = presence([rows[i][1] for i in order])
    anchors /= np.sqrt(anchors.sum(axis=1, keepdims=True))
    kernel = []
    for k in range(0, len(rows), 128):
        part = presence([text for _, text in rows[k : k + 128]])
        kernel.append(part @ anchors.T / np.sqrt(part.sum(axis=1, keepdims=True)))
    kernel = np.concatenate(kernel).astype(np.float64)
    values, vectors = np.linalg.eigh((anchors @ anchors.T).astype(np.float64))
    kept = values > 1e-6 * values[-1]
    root = vectors[:, kept] / np.sqrt(values[kept])
    mapped = kernel @ root
    known = np.array([languages.index(lang) for lang, _ in rows])
    targets = np.where(known[:, None] == np.arange(len(languages)), 1.0, -1.0)
    each = 1.0 / np.bincount(known, minlength=len(languages))[known]  # languages count alike
    weighted = mapped * each[:, None]
    solved = np.linalg.solve(weighted.T @ mapped + ridge * np.eye(mapped.shape[1]), weighted.T @ targets)
    return languages, (anchors.T @ (root @ solved)).astype(np.float32)


def training_rows(docs: DataFrame, sample: int = SAMPLE) -> list[tuple[str, str]]:
    """About ``sample`` (lang, text) of labelled rows outside the held-out fold, dealt evenly to the languages."""
    remainder = F.crc32(F.col("doc_id").cast("string")) % 3
    labelled = docs.where((remainder != 1) & F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return []
    share, fine = max(1, sample // len(counts)), 1 << 30
    bounds = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(fine, -(-fine * share // n)))))
    chosen = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language sample")), F.lit(fine)) < bounds[F.col("lang")]
    rows = labelled.where(chosen & F.col("text").rlike(r"\p{L}")).select("lang", "text").collect()
    return [(r["lang"], r["text"]) for r in rows]


def has_letters() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the columns ``pred`` and ``score`` appended; ``model`` comes from ``fit``, or is None for nothing learned."""
    spark, names, mark = docs.sparkSession, docs.columns, free_name(docs, "letters")
    held = spark.sparkContext.broadcast(model)  # features times languages
    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        begin("langid")
        for batch in batches:
            letters = batch.column(mark).to_pylist()
            texts = batch.column("text").to_pylist()
            langs, scores = np.full(len(texts), NO_LANGUAGE, dtype=object), np.zeros(len(texts))
            given = [i for i, has in enumerate(letters) if has] if held.value else []
            for k in range(0, len(given), 256):
                which = given[k : k + 256]
                rows = presence([texts[i] for i in which])
                found = rows @ held.value[1] / np.sqrt(rows.sum(axis=1, keepdims=True))
                langs[which] = np.array(held.value[0], dtype=object)[found.argmax(axis=1)]
                scores[which] = np.clip((found.max(axis=1).astype(np.float64) + 1) / 2, 0, 1)
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores)], [*names, pred, score])

    return docs.select("*", has_letters().alias(mark)).mapInArrow(run, schema)


def identify(docs: DataFrame, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the columns ``pred`` and ``score``, learned from its own labelled rows."""
    rows = training_rows(docs)
    return predict(docs, fit(rows) if rows else None, pred, score)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents with letters; a missing ``lang`` takes the prediction, and stays null where nothing was learned."""
    pred = free_name(docs, "lang_pred")
    found = identify(docs, pred, free_name(docs, "score")).where((F.col(pred) != NO_LANGUAGE) | has_letters())
    return found.withColumn("lang", F.coalesce("lang", F.nullif(pred, F.lit(NO_LANGUAGE)))).select(*docs.columns)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = training_rows(docs)
    found = predict(docs.select("doc_id", "text"), fit(rows) if rows else None)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
