"""Document quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are laid out in chunks of ``CHUNK`` that overlap and together cover all of it; a shorter text is one
padded chunk.  Every byte has a learned vector; learned filters of ``WIDTH`` bytes slide over a chunk, and each filter
keeps its largest answer.  A hidden layer reads those answers and how full the chunk is, each hidden unit keeps its
largest answer over all chunks of the document, and a logistic unit makes one probability of them.  A chunk of one
repeated word answers few filters, which is how monotony shows.

The fit runs on the driver over a bounded sample: at most ``SAMPLE`` labelled documents, half of either label where there
are enough, chosen by a hash of doc_id, each of at most ``SAMPLE_BYTES`` bytes.  Scoring reads whole texts, in blocks, with
the model as its only state.

Defined results: null text is the empty one and is scored like any other; repeated rows get equal scores; a document
labelled twice counts with the lower label; null ids are never learned from and count as not held out.  Without
labelled documents of both kinds nothing is learned, and every score is the share of label 1 (0.5 with no label).
Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, with_text
from .words import text_bytes
from .workers import begin

SAMPLE, SAMPLE_BYTES, STEPS, THRESHOLD = 1200, 8192, 600, 0.3
#: Documents of label 0 and of label 1 in a step: the threshold lies below one half, so the rarer label weighs more.
BATCH, RATE = (12, 6), 0.01
CHUNK, STEP, WIDTH, STRIDE = 256, 192, 8, 2
VECTOR, FILTERS, HIDDEN = 4, 32, 16
#: Chunks that pass the filters at once.
BLOCK = 512


def chunk_starts(offsets):
    """(document of each chunk, its first byte) for documents at ``offsets``; the last chunk ends with the document."""
    import numpy as np

    sizes = np.diff(offsets)
    n = np.where(sizes <= CHUNK, 1, 1 + -(-(sizes - CHUNK) // STEP))
    doc = np.repeat(np.arange(len(sizes)), n)
    nth = np.arange(len(doc)) - np.repeat(np.append(0, np.cumsum(n))[:-1], n)
    return doc, offsets[doc] + np.minimum(nth * STEP, np.maximum(sizes[doc] - CHUNK, 0))


def chunk_bytes(data, starts, ends):
    """(bytes of each chunk, how full it is); bytes beyond the document's end are 0."""
    import numpy as np

    at = starts[:, None] + np.arange(CHUNK)
    beyond = at >= ends[:, None]
    at[beyond] = 0
    out = data[at] if len(data) else np.zeros(at.shape, np.uint8)
    out[beyond] = 0
    return out, (1 - beyond.mean(axis=1)).astype(np.float32)


class Network:
    """The weights, the forward pass over chunks, and one step of learning."""

    def __init__(self, seed: int = 11):
        import numpy as np

        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.weights = {"bytes": rng.normal(0, 0.5, (256, VECTOR)).astype(np.float32), "filters": normal(WIDTH * VECTOR, FILTERS), "offsets": np.zeros(FILTERS, np.float32), "hidden": normal(FILTERS + 1, HIDDEN), "hidden_offsets": np.full(HIDDEN, 0.1, np.float32), "out": normal(HIDDEN, 1)[:, 0], "out_offset": np.zeros(1, np.float32)}
        self.moments: dict = {}
        self.steps = 0

    def windows(self, chunks):
        """What each filter sees: (chunks, places, WIDTH * VECTOR)."""
        import numpy as np

        flat = np.take(self.weights["bytes"], chunks, axis=0).reshape(len(chunks), -1)
        return np.lib.stride_tricks.sliding_window_view(flat, WIDTH * VECTOR, axis=1)[:, :: STRIDE * VECTOR]

    def chunk_answers(self, chunks, full):
        """(hidden answers, filter answers, windows and answers by place) of chunks."""
        import numpy as np

        w = self.weights
        seen = np.ascontiguousarray(self.windows(chunks))
        answers = seen @ w["filters"]  # a product for each chunk: small enough to stay on one core
        pooled = np.maximum(answers.max(axis=1) + w["offsets"], 0)
        read = np.concatenate((pooled, full[:, None]), axis=1)
        return np.maximum(read @ w["hidden"] + w["hidden_offsets"], 0), read, seen, answers

    def score(self, data, offsets):
        """The probability of each document of a batch."""
        import numpy as np

        doc, starts = chunk_starts(offsets)
        top = np.zeros((len(offsets) - 1, HIDDEN), np.float32)  # answers are not negative
        for k in range(0, len(doc), BLOCK):
            part = slice(k, k + BLOCK)
            hidden = self.chunk_answers(*chunk_bytes(data, starts[part], offsets[doc[part] + 1]))[0]
            docs, first = np.unique(doc[part], return_index=True)
            top[docs] = np.maximum(top[docs], np.maximum.reduceat(hidden, first))
        return self.probability(top)

    def probability(self, top):
        import numpy as np

        odds = top.astype(np.float64) @ self.weights["out"] + self.weights["out_offset"]
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))

    def learn(self, data, offsets, labels, rate: float) -> None:
        """One step down the gradient of the log loss; maxima pass it to the place that they came from."""
        import numpy as np

        w, (doc, starts) = self.weights, chunk_starts(offsets)
        chunks, full = chunk_bytes(data, starts, offsets[doc + 1])
        hidden, read, seen, answers = self.chunk_answers(chunks, full)
        bounds = np.searchsorted(doc, np.arange(len(labels) + 1))
        best = np.stack([a + hidden[a:b].argmax(axis=0) for a, b in zip(bounds, bounds[1:])])
        top = np.take_along_axis(hidden, best, axis=0)
        wrong = ((self.probability(top) - labels) / len(labels)).astype(np.float32)
        grad = {"out": top.T @ wrong, "out_offset": wrong.sum(keepdims=True)}
        back = np.zeros_like(hidden)
        np.add.at(back, (best, np.arange(HIDDEN)), wrong[:, None] * w["out"] * (top > 0))
        grad |= {"hidden": read.T @ back, "hidden_offsets": back.sum(axis=0)}
        pooled = (back @ w["hidden"].T)[:, :FILTERS] * (read[:, :FILTERS] > 0)
        place = answers.argmax(axis=1)
        looked = np.take_along_axis(seen, place[:, :, None], axis=1)  # what each filter saw where it answered most
        grad |= {"filters": np.einsum("cfk,cf->kf", looked, pooled), "offsets": pooled.sum(axis=0)}
        to_bytes = (pooled[:, :, None] * w["filters"].T).reshape(-1, VECTOR)
        at = np.take_along_axis(chunks[:, None, :], place[:, :, None] * STRIDE + np.arange(WIDTH), axis=2).ravel()
        grad["bytes"] = np.stack([np.bincount(at, to_bytes[:, v], 256) for v in range(VECTOR)], axis=1).astype(np.float32)
        self.steps += 1
        for name, g in grad.items():
            mean, square = self.moments.get(name, (0, 0))
            mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
            self.moments[name] = mean, square
            w[name] -= rate * (mean / (1 - 0.9**self.steps)) / (np.sqrt(square / (1 - 0.99**self.steps)) + 1e-6)


def fit(texts: list[str], labels: list[int], steps: int = STEPS, seed: int = 11):
    """A trained network, from batches of ``BATCH`` documents of each label; where a label is missing, the share of label 1."""
    import numpy as np
    import pyarrow as pa

    if len(set(labels)) < 2:
        return float(np.mean(labels)) if labels else 0.5
    network, rng = Network(seed), np.random.default_rng(seed)
    kinds = [np.flatnonzero(np.array(labels) == mark) for mark in (0, 1)]
    for step in range(steps):
        part = np.concatenate([rng.choice(kind, n) for kind, n in zip(kinds, BATCH)])
        marks = np.repeat(np.array([0, 1], np.float32), BATCH)
        network.learn(*text_bytes(pa.array([texts[i] for i in part], pa.string())), marks, RATE * (1 - step / steps))
    network.moments = {}
    return network


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> list:
    """At most ``sample`` (doc_id, text, quality) outside the held-out fold, in an order of their own."""
    learnable = labels.where((F.crc32(F.col("doc_id").cast("string")) % 5 != 0) & F.col("quality").isin(0, 1))
    marked = learnable.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = F.xxhash64("doc_id", F.lit("quality sample"))
    short = with_text(docs, "doc_id").where(F.octet_length("text") <= most_bytes)
    rows = []
    for quality in (0, 1):
        held = short.join(marked.where(F.col("quality") == quality), "doc_id")
        ids = held.select("doc_id").orderBy(order, "doc_id").limit(sample // 2)  # ids alone are sorted; at most half a sample
        rows += held.join(F.broadcast(ids.distinct()), "doc_id", "left_semi").orderBy(order, "doc_id", "text").limit(sample // 2).collect()
    return sorted((r["doc_id"], r["text"], r["quality"]) for r in rows)


def score(docs: DataFrame, model) -> DataFrame:
    """(doc_id, score) of every whole text; ``model`` comes from ``fit``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a network of fixed size

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        begin("quality")
        for batch in batches:
            scores = np.full(len(batch), sent.value) if isinstance(sent.value, float) else sent.value.score(*text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_text(docs, "doc_id").mapInArrow(run, f"doc_id {kind}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), learned from ``labels`` (doc_id, quality) outside the held-out fold."""
    rows = training_rows(docs, labels)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    found = score(docs, fit([text for _, text, _ in rows], [quality for _, _, quality in rows]))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
