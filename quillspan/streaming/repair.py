"""Reading journal files that a crash may have left: a torn tail is cut, any other fault stops the job.

A journal is a folder of files whose names are in order; each holds lines of JSON, one event a line.  Files are read as bytes, so that a
line is known by its offset: only the last line of a file may lack its end, if the writer died.  If that line is no
whole event it is cut; if it is one, only its end was lost.  A line inside that is no event, a gap in the numbers, a
broken chain or a wrong hash are faults.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators.memory import chain_faults

#: What an event holds at least.
REQUIRED = ["kind", "seq", "prev_hash", "event_hash", "observation_id", "source", "source_id", "observed_at", "provenance", "privacy_namespace", "lane", "payload_hash"]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, line, ended, seq, prev_hash, event_hash, made_hash, fault): every line with its byte offset.

    ``made_hash`` is that of the event without its own hash; ``fault`` says what is wrong with the line by itself.
    """
    kinds = "file string, at long, line string, ended boolean, seq long, prev_hash string, event_hash string, made_hash string, fault string"

    def run(batches: Iterator) -> Iterator:
        import hashlib
        import json

        import pyarrow as pa

        def faults(event) -> str | None:
            if not isinstance(event, dict):
                return "no object"
            if any(name not in event for name in REQUIRED):
                return "fields missing"
            if event["kind"] not in ("observation", "tombstone"):
                return "unknown kind"
            if (event["kind"] == "observation") != bool(event["payload_hash"]) or event["kind"] == "tombstone" and event["payload_hash"] is not None:
                return "payload hash"
            return None if isinstance(event["seq"], int) else "seq"

        names = [k.split()[0] for k in kinds.split(", ")]
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows, at = [], 0
                for raw in content.splitlines(keepends=True) if content else []:
                    try:
                        event = json.loads(raw.decode())
                        fault = faults(event)
                    except ValueError:
                        event, fault = None, "no JSON"
                    held = event if fault is None else {}
                    unsigned = json.dumps({k: v for k, v in held.items() if k != "event_hash"}, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
                    rows.append((file, at, raw.decode(errors="replace").rstrip("\n"), raw.endswith(b"\n"), held.get("seq"), held.get("prev_hash"), held.get("event_hash"), hashlib.sha256(unsigned.encode()).hexdigest() if held else None, fault))
                    at += len(raw)
                types = (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 9, types)], names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, kinds)


def torn(found: DataFrame) -> DataFrame:
    """(file, at): where a file must be cut; its last line has no end and is no JSON."""
    return found.where("NOT ended AND fault = 'no JSON'").select("file", "at")


def faults(found: DataFrame) -> DataFrame:
    """(seq, file, at, fault) of everything but torn tails: bad lines, hashes, numbers, links."""
    whole = found.where("ended OR fault IS DISTINCT FROM 'no JSON'")
    own = whole.where("fault IS NOT NULL").select("seq", "file", "at", "fault")
    good = whole.where("fault IS NULL")
    hashes = good.where("event_hash IS DISTINCT FROM made_hash").select("seq", "file", "at", F.lit("event hash").alias("fault"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("file", "string"), ("at", "long"))]
    numbers = good.groupBy("seq").count().where("count > 1 OR seq < 1").select("seq", *none, F.lit("seq").alias("fault"))
    ends = good.agg(F.max("seq").alias("seq"), F.count_distinct("seq").alias("n")).where("seq <> n").select("seq", *none, F.lit("gap").alias("fault"))
    links = chain_faults(good.select("seq", "prev_hash", "event_hash")).select("seq", *none, F.lit("chain").alias("fault"))
    return own.unionByName(hashes).unionByName(numbers).unionByName(ends).unionByName(links)


def events(spark: SparkSession, path: str) -> DataFrame:
    """(seq, line) of a sound journal without a torn tail; the job fails where anything else is wrong."""
    found = lines(spark, path)
    wrong = faults(found).limit(1).collect()
    if wrong:
        raise ValueError(f"journal is corrupt: {wrong[0].asDict()}")
    return found.where("fault IS NULL").select("seq", "line")
