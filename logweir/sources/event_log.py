"""Scans of an event log, and a log kept as a folder of Parquet commits with optimistic concurrency."""

from __future__ import annotations

import json
import logging
import threading
import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .schema import EVENT_LOG, FIXTURE, INBOX, parse_stream, stream_parts


def global_scan(log: DataFrame, after: int, most: int) -> DataFrame:
    """Events after an offset in order, `most` of them, cut where an offset is missing between two of them."""
    page = log.where(F.col("global_offset") > after).orderBy("global_offset").limit(most)
    gap = F.col("global_offset") - F.row_number().over(Window.orderBy("global_offset"))  # over a page, so of a known size
    return page.withColumn("_gap", gap).withColumn("_first", F.min("_gap").over(Window.partitionBy())).where("_gap = _first").drop("_gap", "_first")


def stream_scan(log: DataFrame, kind: str, ident: str, after: int = 0, most: int | None = None) -> DataFrame:
    rows = log.where((F.col("aggregate_type") == kind) & (F.col("aggregate_id") == ident) & (F.col("version") > after)).orderBy("version")
    return rows if most is None else rows.limit(most)


def head(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.max("global_offset"), F.lit(0)).alias("head"))


def stream_heads(log: DataFrame) -> DataFrame:
    return log.groupBy("aggregate_type", "aggregate_id").agg(F.max("version").alias("version"))


def offset_range(log: DataFrame, first: int, last: int) -> DataFrame:
    return log.where(F.col("global_offset").between(first, last))


def read_fixture(spark: SparkSession, path: str) -> DataFrame:
    """A recorded stream (a JSON array) as a log; offsets are given in the order of the file."""
    rows = spark.read.schema(FIXTURE).option("multiLine", True).json(path)
    kind, ident = stream_parts(F.col("streamId"))
    m = F.col("metadata")
    place = Window.orderBy(F.monotonically_increasing_id())  # a recorded stream is one small file
    at = m["timestamp"].cast("timestamp")
    meta = F.struct(
        m["eventId"].alias("event_id"), m["commandId"].alias("command_id"), m["traceId"].alias("trace_id"), m["correlationId"].alias("correlation_id"), m["causationId"].alias("causation_id"), m["userId"].alias("user_id"),
        at.alias("timestamp"), m["baggage"].alias("baggage"), F.struct(m["sagaOrigin"]["sagaType"].alias("saga_type"), m["sagaOrigin"]["sagaId"].alias("saga_id"), m["sagaOrigin"]["hop"].alias("hop")).alias("saga_origin"),
        F.lit(None).cast("struct<trace_id:string,span_id:string>").alias("span_context"),
    )
    return rows.select(
        F.row_number().over(place).cast("long").alias("global_offset"), kind.alias("aggregate_type"), ident.alias("aggregate_id"), "version", F.col("eventType").alias("event_type"), "payload",
        F.col("schemaVersion").alias("schema_version"), at.alias("created_at"), meta.alias("metadata"),
    )


def fixture_text(rows: list[Row]) -> str:
    """Events as a recorded stream, with sorted keys and without offsets."""

    def one(r: Row) -> dict:
        m = r["metadata"]
        origin = m["saga_origin"] if m["saga_origin"] and m["saga_origin"]["saga_type"] else None
        return {
            "streamId": f"{r['aggregate_type']}:{r['aggregate_id']}", "version": r["version"], "eventType": r["event_type"], "schemaVersion": r["schema_version"], "payload": json.loads(r["payload"]),
            "metadata": {
                "eventId": m["event_id"], "commandId": m["command_id"], "correlationId": m["correlation_id"], "traceId": m["trace_id"], "causationId": m["causation_id"], "userId": m["user_id"],
                "timestamp": m["timestamp"].replace(tzinfo=timezone.utc).isoformat().replace("+00:00", "Z"), "baggage": m["baggage"] or {}, "sagaOrigin": origin and {"sagaType": origin["saga_type"], "sagaId": origin["saga_id"], "hop": origin["hop"]},
            },
        }

    return json.dumps([one(r) for r in rows], sort_keys=True, indent=2, ensure_ascii=False)


#: Where events carry the idempotency key and the type of their command.
KEY, COMMAND = "idempotency-key", "command-type"


class StaleVersion(Exception):
    """The stream is not at the expected version."""


class KeyBound(Exception):
    """The idempotency key belongs to another command or stream."""


class StoredLog:
    """A log under one folder: a commit appends one Parquet file of events whose offsets follow the last. One driver writes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.lock = spark, path.rstrip("/"), threading.RLock()
        #: Called with the events of each commit, after it; a failure is logged and has no effect on the commit.
        self.after_commit: list[Callable[[DataFrame], None]] = []

    def _read(self, name: str, schema) -> DataFrame:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = hadoop.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(hadoop)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def events(self) -> DataFrame:
        return self._read("events", EVENT_LOG)

    def inbox(self) -> DataFrame:
        return self._read("inbox", INBOX)

    def append(self, stream: str, events: list[dict], expected: int) -> list[int]:
        """Appends events (event_type, payload, schema_version, metadata) to a stream that is at the expected version; their offsets.
        An empty list stores nothing and looks at nothing."""
        kind, ident = parse_stream(stream)
        if not events:
            return []
        with self.lock:
            log = self.events()
            at, top = log.agg(F.max(F.when((F.col("aggregate_type") == kind) & (F.col("aggregate_id") == ident), F.col("version"))), F.max("global_offset")).first()
            if (at or 0) != expected:
                raise StaleVersion(f"{stream} is at {at or 0}, not at {expected}")
            now, rows = datetime.fromtimestamp(time.time()), []
            for i, e in enumerate(events):
                rows.append(((top or 0) + 1 + i, kind, ident, expected + 1 + i, e["event_type"], e["payload"] if isinstance(e["payload"], str) else json.dumps(e["payload"]), e.get("schema_version", 1), now, e.get("metadata")))
                if "\\u0000" in rows[-1][5] or "\0" in rows[-1][5]:
                    raise ValueError("a payload can't hold U+0000")
            self.spark.createDataFrame(rows, EVENT_LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/events")
        for listener in self.after_commit:
            try:
                listener(self.spark.createDataFrame(rows, EVENT_LOG))
            except Exception:
                logging.getLogger(__name__).exception("an inline projection failed")
        return [r[0] for r in rows]

    def append_once(self, stream: str, events: list[dict], expected: int, key: str, command: str) -> tuple[list[int], int, bool]:
        """(offsets, final version, already applied): the first call with a key appends, a later one gets its result."""
        kind, ident = parse_stream(stream)
        with self.lock:
            found = self.inbox().where(F.col("idempotency_key") == key).first()
            if found:
                if (found["command_type"], found["aggregate_type"], found["aggregate_id"]) != (command, kind, ident):
                    raise KeyBound(key)
                return found["global_offsets"], found["final_version"], True
            # events carry the key, so a call that was cut off before its inbox row is found by them, and gets that row now
            own = F.col("metadata.baggage")
            past = self.events().where(own[KEY] == key).select("global_offset", "aggregate_type", "aggregate_id", "version", own[COMMAND].alias("command")).orderBy("version").collect()
            if past and (past[0]["command"], past[0]["aggregate_type"], past[0]["aggregate_id"]) != (command, kind, ident):
                raise KeyBound(key)
            marked = [e | {"metadata": (m := e.get("metadata") or {}) | {"baggage": (m.get("baggage") or {}) | {KEY: key, COMMAND: command}}} for e in events]
            offsets = [r["global_offset"] for r in past] or self.append(stream, marked, expected)
            final = past[-1]["version"] if past else expected + len(offsets)
            self.spark.createDataFrame([(key, command, kind, ident, offsets, final)], INBOX).coalesce(1).write.mode("append").parquet(f"{self.path}/inbox")
            return offsets, final, bool(past)
