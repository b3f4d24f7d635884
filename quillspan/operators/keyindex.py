"""An index of the keys that documents carry: title fingerprints and ids of works, in tables bucketed for lookups and joins.

One copy is bucketed by key, one by document.  A lookup of few values reads the buckets that they hash to and no other
file; a join or an aggregation on the bucketed column shuffles the other side alone, or nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.storage import shared_dir

BUCKETS = 64
#: As many values are looked up one by one; more are joined.
FEW = 1000


def keys_of(documents: DataFrame) -> DataFrame:
    """(id, kind, key) of documents (id, fp, openalex, doi, arxiv): a title fingerprint, and the works that the ids name."""
    held = [F.struct(F.lit("title").alias("kind"), F.when(F.startswith("fp", F.lit("title:")), F.col("fp")).alias("key"))]
    for name in ("openalex", "doi", "arxiv"):
        value = F.trim(F.lower(name)) if name == "doi" else F.col(name)
        held.append(F.struct(F.lit(name).alias("kind"), F.when(value != "", F.concat(F.lit(f"work:{name}:"), value)).alias("key")))
    rows = documents.select("id", F.explode(F.array(*held)).alias("k")).select("id", "k.kind", "k.key")
    return rows.where("id IS NOT NULL AND key IS NOT NULL").distinct()


class KeyIndex:
    """The two bucketed tables of some documents, under names of their own in the session's catalog."""

    def __init__(self, documents: DataFrame, buckets: int = BUCKETS):
        self.spark: SparkSession = documents.sparkSession
        self.buckets, self.names = buckets, {}
        rows = keys_of(documents)
        for column in ("key", "id"):
            self.names[column] = f"quillspan_{column}_{uuid.uuid4().hex}"
            dealt = rows.repartition(buckets, column)  # one file for each bucket
            dealt.write.bucketBy(buckets, column).sortBy(column).option("path", shared_dir(self.spark, f"index-{column}")).saveAsTable(self.names[column])

    def by(self, column: str) -> DataFrame:
        """All rows, bucketed by ``key`` or by ``id``."""
        return self.spark.table(self.names[column])

    def lookup(self, column: str, values: list[str]) -> DataFrame:
        """The rows of at most ``FEW`` values: only their buckets are read."""
        if len(values) > FEW:
            raise ValueError(f"look up at most {FEW} values; join more")
        return self.by(column).where(F.col(column).isin(values))

    def title_of(self, document: str) -> str | None:
        """A document's title fingerprint; none where it has no long title."""
        row = self.lookup("id", [document]).where("kind = 'title'").first()
        return row["key"] if row else None

    def edges(self, anchors: list[str]) -> DataFrame:
        """(src, dst, type, method) of the identities that few anchors have by title and by ids."""
        mine = self.lookup("id", anchors).collect()  # a handful of keys for each anchor
        works = self.spark.createDataFrame([(r["id"], r["key"], "same_as", f"id_eq:{r['kind']}") for r in mine if r["kind"] != "title"], "src string, dst string, type string, method string")
        titles = [r for r in mine if r["kind"] == "title"]
        if not titles:
            return works
        own = self.spark.createDataFrame([(r["id"], r["key"]) for r in titles], "one string, key string")
        others = self.lookup("key", sorted({r["key"] for r in titles})).join(F.broadcast(own), "key").where("id <> one")
        alike = others.select(F.least("one", "id").alias("src"), F.greatest("one", "id").alias("dst"), F.lit("same_as").alias("type"), F.lit("align:title_fp").alias("method"))
        return works.unionByName(alike.distinct())

    def partners(self) -> DataFrame:
        """(key, documents): how many documents share each title, counted bucket by bucket without a shuffle."""
        return self.by("key").where("kind = 'title'").groupBy("key").agg(F.count("*").alias("documents"))

    def drop(self) -> None:
        for name in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
