"""Scalar functions with semantics of their own: canonical text of values, identifiers, backoff, log lines, hashes."""

from __future__ import annotations

import json
from datetime import timedelta
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The zero of coded times (2024-01-01 in ms), widths and limits.
EPOCH_MS = 1_704_067_200_000
TIME_WIDTH = 9
LOG_CAP, TRACE_CAP, FREE_CAP = 64, 256, 2048


def number_text(value: Any) -> str:
    """A number in plain notation with its scale: 19.90, 12345678 for 1.2345678E7, 0.00010 for 1.0E-4, 0.0 for -0.0."""
    d = value if isinstance(value, Decimal) else Decimal(repr(value)) if isinstance(value, float) else Decimal(value)
    if d.is_zero():
        d = abs(d)
    return format(d, "f")


def value_text(value: Any) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, timedelta):
        micros = (value.days * 86400 + value.seconds) * 10**6 + value.microseconds
        return f"{'-' * (micros < 0)}{abs(micros) // 10**6}.{abs(micros) % 10**6:06d}000"
    if isinstance(value, (int, float, Decimal)):
        return number_text(value)
    return json.dumps(value, separators=(", ", ": "), ensure_ascii=False, default=number_text)


def canonical_text(value: Any, kind: T.DataType | None = None) -> Column:
    """The text by which a value is filtered and sorted. A column of a type with a canonical text of its own stays in the JVM."""
    if not isinstance(value, Column):
        return F.lit(value_text(value))
    if kind is None or isinstance(kind, T.StringType):
        return value
    if isinstance(kind, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return value.cast("string")
    if isinstance(kind, T.DecimalType):  # plain text needs a scale above Spark's switch to exponents
        return F.when(value == 0, F.abs(value).cast("string")).otherwise(value.cast("string")) if kind.scale <= 6 else F.format_string("%s", value)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return _float_text(value.cast("double") if isinstance(kind, T.DoubleType) else value.cast("string").cast("double"))
    return value.cast("string")


@F.pandas_udf(T.StringType())
def _float_text(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if pd.isna(v) else number_text(float(v)))


@F.pandas_udf(T.StringType())
def json_field_text(data: pd.Series, field: pd.Series) -> pd.Series:
    """The canonical text of a top-level field of JSON; null where it is missing or null."""

    def one(text: str | None, name: str) -> str | None:
        found = json.loads(text, parse_float=Decimal, parse_int=Decimal) if text else None
        return value_text(found.get(name)) if isinstance(found, dict) else None

    return pd.Series([one(t, f) for t, f in zip(data, field)])


def time_code(ms: Column) -> Column:
    """Milliseconds since 2024 in base 36, so that ids sort by time."""
    return F.lpad(F.lower(F.conv((ms - F.lit(EPOCH_MS)).cast("string"), 10, 36)), TIME_WIDTH, "0")


def new_id(prefix: str, ms: Column) -> Column:
    return F.concat(F.lit(prefix), time_code(ms), F.substring(F.translate(F.base64(F.unhex(F.replace(F.uuid(), F.lit("-"), F.lit("")))), "+/=", "-_"), 1, 16))


def correlation_id() -> Column:
    return F.concat(F.lit("corr_"), F.uuid())


def backoff_ms(attempt: Column, initial: float = 50, factor: float = 2.0, jitter: Column | None = None) -> Column:
    """The wait before an attempt, from 1 on. With jitter, numbers from 0 to 1 (F.rand()), it is half to one and a half times that."""
    wait = F.lit(initial) * F.pow(F.lit(factor), attempt - 1)
    return wait if jitter is None else wait * (F.lit(0.5) + jitter)


def poll_backoff_ms(failures: Column, initial: int = 1000, most: int = 60_000, jitter: Column | None = None) -> Column:
    """The wait of a poll after failures, from 1 on. With jitter, numbers from 0 to 1, half of it and up to half more is waited."""
    wait = F.least(F.lit(initial) * F.pow(F.lit(2.0), F.least(failures - 1, F.lit(32))), F.lit(most)).cast("long")
    if jitter is None:
        return wait
    half = F.floor(wait / 2)
    return (half + F.least(F.floor(jitter * (wait - half + 1)), wait - half)).cast("long")


def log_safe(text: Column, cap: int = LOG_CAP) -> Column:
    """Text without control, format, surrogate and separator characters, cut with an ellipsis."""
    clean = F.regexp_replace(text, r"[\p{Cc}\p{Cf}\p{Cs}\p{Zl}\p{Zp}]", "")
    return F.when(F.char_length(clean) > cap, F.concat(F.substring(clean, 1, cap), F.lit("..."))).otherwise(clean)


def log_free_text(text: Column, cap: int = FREE_CAP) -> Column:
    return log_safe(F.regexp_replace(text, r"[\r\n\u0085  ]+", " "), cap)


def subject_hash(subject: Column) -> Column:
    return F.sha2(subject, 256)


def scoped_key(scope: Column, *parts: Column) -> Column:
    """An idempotency key within a scope."""
    return F.concat_ws("|", scope, *(p.cast("string") for p in parts))
