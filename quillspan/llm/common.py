"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.storage import discard, materialise, shared_dir

__all__ = ["by_bytes", "discard", "free_name", "materialise", "shared_dir", "single_threaded_tokenizers", "table", "tokenizer_path", "with_text"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores before it until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def with_text(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and ``text`` of ``docs`` alone (clashing extra columns go), a null text as the empty one."""
    return docs.select(*columns, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def by_bytes(batch, size: int) -> Iterator:
    """The batch in parts whose texts have at most ``size`` bytes, or that are one row."""
    import numpy as np
    import pyarrow.compute as pc

    ends, k = np.cumsum(pc.binary_length(batch.column("text")).to_numpy().astype(np.int64)), 0
    while k < batch.num_rows:
        stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + size, "right")))
        yield batch.slice(k, stop - k)
        k = stop


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Where a vocabulary file lies: in ``folder`` if given, else where the public_tokenizers package keeps it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def single_threaded_tokenizers() -> None:
    """An executor's cores are taken by its tasks; the library's own threads would oversubscribe them."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
