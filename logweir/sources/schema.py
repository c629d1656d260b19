"""Schemas of the engine's tables and the rules of its identifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, L, I, TS = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


METADATA = _struct(
    event_id=S, command_id=S, trace_id=S, correlation_id=S, causation_id=S, user_id=S, timestamp=TS, baggage=T.MapType(S, S),
    saga_origin=_struct(saga_type=S, saga_id=S, hop=I), span_context=_struct(trace_id=S, span_id=S),
)
EVENT_LOG = _struct(global_offset=L, aggregate_type=S, aggregate_id=S, version=L, event_type=S, payload=S, schema_version=I, created_at=TS, metadata=METADATA)
SNAPSHOT = _struct(aggregate_type=S, aggregate_id=S, version=L, state=S, snapshot_version=I, purge_generation=L)
VIEW = _struct(id=S, data=S, version=L, updated_at=TS)
OUTBOX = _struct(seq=L, entry_id=S, aggregate_type=S, aggregate_id=S, status=S, attempts=I, next_retry_at=TS, claimed_by=S, processed_at=TS, payload=S)
SAGA = _struct(saga_type=S, saga_id=S, status=S, version=L, last_applied_offset=L, created_at=TS, updated_at=TS, deadline=TS, prior_status=S)
INBOX = _struct(idempotency_key=S, command_type=S, aggregate_type=S, aggregate_id=S, global_offsets=T.ArrayType(L), final_version=L)
DEAD_RANGE = _struct(projection=S, from_offset=L, to_offset=L, attempts=I, error=S, failed_at=TS)
FIXTURE = _struct(streamId=S, version=L, eventType=S, schemaVersion=I, payload=S, metadata=_struct(
    eventId=S, commandId=S, correlationId=S, traceId=S, causationId=S, userId=S, timestamp=S, baggage=T.MapType(S, S), sagaOrigin=_struct(sagaType=S, sagaId=S, hop=I)))

# The forms of identifiers.
AGGREGATE_TYPE = r"^[a-z][a-z0-9_]{0,31}$"
PROJECTION = r"^[a-z_][a-z0-9_]{0,57}$"
FIELD = r"^[A-Za-z0-9_]+$"
SYSTEM_FIELDS = frozenset(("id", "version", "updated_at"))
ID_LENGTH, KEY_LENGTH = 255, 512


def stream_text(kind: Column, ident: Column) -> Column:
    """A stream's name, type:id."""
    return F.concat_ws(":", kind, ident)


def stream_parts(text: Column) -> tuple[Column, Column]:
    """Type and id, parted at the first colon."""
    return F.substring_index(text, ":", 1), F.substring(text, F.locate(":", text) + 1, F.length(text))


def parse_stream(text: str) -> tuple[str, str]:
    kind, colon, ident = text.partition(":")
    if not colon or not re.match(AGGREGATE_TYPE, kind) or not ident or len(ident) > ID_LENGTH:
        raise ValueError(f"not a stream id: {text!r}")
    return kind, ident


def projection_table(name: str) -> str:
    """The view of a projection; its name must be a plain identifier."""
    if not re.match(PROJECTION, name):
        raise ValueError(f"not a projection name: {name!r}")
    return f"{name}_view"


def snake_name(class_name: str) -> str:
    """The projection name of a class name: words of its capitals, without a final 'projection'."""
    words = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z0-9]+", class_name)
    if len(words) > 1 and words[-1] == "Projection":
        words.pop()
    return "_".join(w.lower() for w in words)


def invalid_ids(log: DataFrame) -> DataFrame:
    """Rows of a log that break the rules of identifiers or of numbers."""
    fine = F.col("aggregate_type").rlike(AGGREGATE_TYPE) & F.char_length("aggregate_id").between(1, ID_LENGTH) & ~F.col("aggregate_id").rlike(r"\p{Cc}")
    return log.where(~F.coalesce(fine & (F.col("version") >= 1) & (F.col("global_offset") >= 1), F.lit(False)))
