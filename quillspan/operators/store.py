"""A store of documents, graph nodes, edges and source marks that changes as a whole.

Rows lie in buckets by a hash of their whole key, so no hot source or hub fills one.  A batch reads and rewrites the
buckets that its keys fall in, into folders of its own version; the other buckets stay where they are.  Then one small
manifest names every bucket's folder.  It is a single file that appears by one rename, so whoever reads sees all of a
batch or nothing of it, and a batch that died half-way leaves the version before it.  One writer at a time.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.operators.graph import SYMMETRIC

#: The longest label of a thin document, and the ids that it keeps.
LONGEST_LABEL = 200
CARRIED_IDS = ["doi", "arxiv_id", "openalex_id"]
SCHEMAS = {
    "documents": "source string, source_id string, title string, fp string, content_hash string, seg_version int, first_seen timestamp, last_seen timestamp, version int",
    "nodes": "id string, kind string, label string, attrs map<string, string>, first_seen timestamp, last_seen timestamp",
    "edges": "src string, dst string, type string, method string, tier string, attrs map<string, string>, first_seen timestamp, last_seen timestamp",
    "marks": "source string, ran_at timestamp, doc_count long",
}
KEYS = {"documents": ["source", "source_id"], "nodes": ["id"], "edges": ["src", "dst", "type", "method"], "marks": ["source"]}
MANIFEST = "version int, folders map<string, map<string, int>>, seq long, event_hash string"


class Batch(NamedTuple):
    """What one observation brings; any part may be missing.  ``pos`` orders the rows of a part.

    documents: pos, source, source_id, url, title, fp, content_hash, seg_version; thin: pos, source, source_id, url, title, fp,
    doi, arxiv_id, openalex_id; tombstones: source, source_id; nodes: pos, id, kind, label, attrs; edges: pos, src, dst,
    type, tier, method, attrs; marks: source, ran_at, doc_count (one row for each source).
    """

    documents: DataFrame | None = None
    thin: DataFrame | None = None
    tombstones: DataFrame | None = None
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    marks: DataFrame | None = None


def filled(c: str) -> Column:
    """A text without the white space around it, of any script; a null is empty."""
    return F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def identified(rows: DataFrame) -> DataFrame:
    """``rows`` whose missing source_id is their url; those without a source or an id go."""
    own = F.coalesce(F.nullif("source_id", F.lit("")), F.nullif("url", F.lit("")))
    return rows.withColumn("source_id", own).where((filled("source") != "") & F.col("source_id").isNotNull())


def document_id() -> Column:
    return F.concat(F.lit("doc:"), "source", F.lit(":"), "source_id")


def upserted_documents(held: DataFrame, staged: DataFrame, now: Column) -> DataFrame:
    """A row that is as it was moves last_seen alone; each change in the order of ``pos`` takes the next version."""
    keys = KEYS["documents"]
    rows = identified(staged).join(held.select(*keys, F.struct("content_hash", "seg_version").alias("_was")), keys, "left")
    before = F.coalesce(F.lag(F.struct("content_hash", "seg_version")).over(Window.partitionBy(*keys).orderBy("pos")), "_was")
    # a hash that stays and a segmentation that isn't newer leave the row alone
    same = F.coalesce((F.col("content_hash") == before["content_hash"]) & (before["seg_version"] >= F.col("seg_version")), F.lit(False))
    seen = F.struct(F.col("pos").alias("_pos"), "title", "fp", "content_hash", "seg_version")
    latest = rows.withColumn("_same", same).groupBy(*keys).agg(F.max(F.when(~F.col("_same"), seen)).alias("new"), F.count_if(~F.col("_same")).cast("int").alias("changes"))
    both = held.join(latest, keys, "full_outer")
    take = lambda c: F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c)
    return both.select(*keys, *map(take, ("title", "fp", "content_hash", "seg_version")), F.coalesce("first_seen", now).alias("first_seen"), F.when(F.col("changes").isNull(), F.col("last_seen")).otherwise(now).alias("last_seen"), (F.coalesce("version", F.lit(0)) + F.coalesce("changes", F.lit(0))).alias("version"))


def thin_nodes(thin: DataFrame) -> DataFrame:
    """(pos, id, kind, label, attrs) of documents that are anchored without their content."""
    kept = [F.when(F.col(c).cast("string") != "", F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value"))) for c in CARRIED_IDS]
    fixed = [F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in ("url", "fp")]
    attrs = F.map_from_entries(F.array_compact(F.array(*fixed, *kept)))
    label = F.nullif(F.substring(filled("title"), 1, LONGEST_LABEL), F.lit(""))
    return identified(thin).select("pos", document_id().alias("id"), F.lit("document").alias("kind"), label.alias("label"), attrs.alias("attrs"))


def upserted_nodes(held: DataFrame, staged: DataFrame, now: Column) -> DataFrame:
    """The last label and attributes win; a node's kind and first sight stay as they were first."""
    clean = staged.withColumns({"id": filled("id"), "kind": filled("kind")}).where("id <> '' AND kind <> ''")
    seen = F.struct("label", F.when(F.size("attrs") > 0, F.col("attrs")).alias("attrs"))  # maps have no order: by pos alone
    latest = clean.groupBy("id").agg(F.min_by("kind", "pos").alias("_kind"), F.max_by(seen, "pos").alias("new"))
    return _refreshed(held, latest, ["id"], {"kind": "_kind"}, ["label", "attrs"], now)


def upserted_edges(held: DataFrame, staged: DataFrame, now: Column) -> DataFrame:
    """Edges of tier M or A by (src, dst, type, method), undirected types with the lesser end first; tier stays as first."""
    clean = staged.withColumns({c: filled(c) for c in ("src", "dst", "type", "method", "tier")}).where("src <> '' AND dst <> '' AND type <> '' AND method <> '' AND tier IN ('M', 'A')")
    turned = F.col("type").isin(SYMMETRIC) & (F.col("dst") < F.col("src"))
    clean = clean.withColumns({"src": F.when(turned, F.col("dst")).otherwise(F.col("src")), "dst": F.when(turned, F.col("src")).otherwise(F.col("dst"))})
    latest = clean.groupBy(*KEYS["edges"]).agg(F.min_by("tier", "pos").alias("_tier"), F.max_by(F.struct(F.when(F.size("attrs") > 0, F.col("attrs")).alias("attrs")), "pos").alias("new"))
    return _refreshed(held, latest, KEYS["edges"], {"tier": "_tier"}, ["attrs"], now)


def _refreshed(held: DataFrame, latest: DataFrame, keys: list[str], fixed: dict[str, str], fresh: list[str], now: Column) -> DataFrame:
    both = held.join(latest, keys, "full_outer")
    first = [F.coalesce(c, new).alias(c) for c, new in fixed.items()]
    last = [F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in fresh]
    seen = [F.coalesce("first_seen", now).alias("first_seen"), F.when(F.col("new").isNotNull(), now).otherwise(F.col("last_seen")).alias("last_seen")]
    return both.select(*keys, *first, *last, *seen)


class Store:
    """A folder with the tables of SCHEMAS; ``buckets`` is fixed when it is made and bounds what a manifest holds."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def manifest(self):
        """The last manifest, or None for a new store."""
        try:
            rows = self.spark.read.schema(MANIFEST).json(f"{self.path}/manifests/*")
            return rows.where("version IS NOT NULL").orderBy(F.desc("version")).limit(1).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(*KEYS[name]), F.lit(self.buckets)).cast("int")

    def read(self, name: str, manifest="last", buckets: set[int] | None = None) -> DataFrame:
        """A table at a manifest, the last one by default; ``buckets`` reads no more than those."""
        manifest = self.manifest() if manifest == "last" else manifest
        folders = (manifest["folders"] or {}).get(name, {}) if manifest else {}
        paths = [f"{self.path}/{name}/v={v}/bucket={b}" for b, v in folders.items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths)

    def touched(self, name: str, *keys: DataFrame) -> set[int]:
        """The buckets that rows fall in: at most ``buckets`` numbers come to the driver."""
        found = reduce(DataFrame.union, (k.select(self.bucket(name).alias("b")) for k in keys))
        return {r["b"] for r in found.distinct().collect()}

    def apply(self, batch: Batch, now: Column, seq: int | None = None, event_hash: str | None = None) -> int:
        """Apply a batch and return its version.  ``seq`` and ``event_hash`` say how far a journal is applied by it.

        Documents and thin documents come first, then tombstones, then the graph's own nodes and edges, then marks.  A
        tombstone takes the document; where it is thin, it takes its node and the edges that touch it too.
        """
        was = self.manifest()
        version = (was["version"] if was else 0) + 1
        folders = {name: dict(held) for name, held in (was["folders"] or {}).items()} if was else {}
        gone = batch.tombstones.select("source", "source_id").distinct() if batch.tombstones is not None else None
        gone_ids = gone.select(document_id().alias("id")) if gone is not None else None

        def change(name: str, staged: list[DataFrame], make) -> None:
            if not staged:
                return
            buckets = self.touched(name, *staged)
            folders.setdefault(name, {})
            made = make(self.read(name, was, buckets)).withColumn("bucket", self.bucket(name)).where(F.col("bucket").isin(list(buckets)))
            folder = f"{self.path}/{name}/v={version}"
            made.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
            written = {r["bucket"] for r in self.spark.read.schema(f"{SCHEMAS[name]}, bucket int").parquet(folder).select("bucket").distinct().collect()}
            folders[name] = {b: v for b, v in folders[name].items() if int(b) not in buckets} | {str(b): version for b in written}

        staged = [identified(batch.documents)] if batch.documents is not None else []
        documents = lambda held: _without(upserted_documents(held, batch.documents, now) if batch.documents is not None else held, gone, KEYS["documents"])
        change("documents", staged + ([gone] if gone is not None else []), documents)

        thin = thin_nodes(batch.thin) if batch.thin is not None else None
        lost = None
        if gone_ids is not None:  # only a thin document's edges go with it
            known = self.read("nodes", was).select("id") if thin is None else self.read("nodes", was).select("id").union(thin.select("id"))
            lost = gone_ids.join(known, "id", "left_semi")

        def nodes(held: DataFrame) -> DataFrame:
            held = _without(upserted_nodes(held, thin, now) if thin is not None else held, gone_ids, ["id"])
            return upserted_nodes(held, batch.nodes, now) if batch.nodes is not None else held

        staged = [x.select(filled("id").alias("id")) for x in (thin, batch.nodes, lost) if x is not None]
        change("nodes", staged, nodes)

        staged, cut = [], None
        if lost is not None:
            held = self.read("edges", was).select(*KEYS["edges"])
            cut = held.join(lost.withColumnRenamed("id", "src"), "src", "left_semi").select(*KEYS["edges"]).union(held.join(lost.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*KEYS["edges"])).distinct()
            staged.append(cut)
        if batch.edges is not None:
            staged.append(upserted_edges(self.spark.createDataFrame([], SCHEMAS["edges"]), batch.edges, now).select(*KEYS["edges"]))

        def edges(held: DataFrame) -> DataFrame:
            held = _without(held, cut, KEYS["edges"])
            return upserted_edges(held, batch.edges, now) if batch.edges is not None else held

        change("edges", staged, edges)
        if batch.marks is not None:
            change("marks", [batch.marks], lambda held: _without(held, batch.marks, ["source"]).unionByName(batch.marks.select("source", "ran_at", "doc_count")))
        self.publish(version, {k: v for k, v in folders.items() if v}, seq if seq is not None else was and was["seq"], event_hash or was and was["event_hash"])
        return version

    def publish(self, version: int, folders: dict, seq, event_hash) -> None:
        """The switch: one row in one file of a folder of its own."""
        row = self.spark.createDataFrame([(version, folders, seq, event_hash)], MANIFEST)
        row.coalesce(1).write.mode("overwrite").json(f"{self.path}/manifests/m={version:012d}")

    def expire(self, keep: int = 2) -> int:
        """Empty the folders that only manifests before the last ``keep`` name; how many were emptied."""
        rows = self.spark.read.schema(MANIFEST).json(f"{self.path}/manifests/*").where("version IS NOT NULL").orderBy(F.desc("version")).collect()  # a row for each version
        named = lambda rs: {(n, v, b) for r in rs for n, held in r["folders"].items() for b, v in held.items()}
        stale = named(rows[keep:]) - named(rows[:keep])
        for name, v, b in stale:
            self.spark.range(0).write.mode("overwrite").parquet(f"{self.path}/{name}/v={v}/bucket={b}")
        for r in rows[keep:]:
            self.spark.createDataFrame([], MANIFEST).write.mode("overwrite").json(f"{self.path}/manifests/m={r['version']:012d}")
        return len(stale)


def _without(rows: DataFrame, gone: DataFrame | None, keys: list[str]) -> DataFrame:
    return rows if gone is None else rows.join(gone.select(*keys), keys, "left_anti").select(*rows.columns)
