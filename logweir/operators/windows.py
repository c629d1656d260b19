"""Event-time windows over batches: tumbling and sliding, with watermark, grace and a policy for late events.

The watermark is the largest event time of all earlier batches, so disorder inside a batch is never late. An event is late for a window
whose end plus grace that watermark has reached. DROP leaves late events out; REOPEN folds them into a closed window while
the watermark has not passed its end by more than twice the grace, and emits the new state as not final, once for each event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DROP, REOPEN = "DROP", "REOPEN"
GRACE_S = 300
#: Numbers of batches that are ordered in one task.
SPAN = 4096


def checked(size_s: float, slide_s: float | None, grace_s: float) -> float:
    """The slide that counts: none and one beyond the size are a tumbling window."""
    if size_s <= 0 or slide_s is not None and slide_s <= 0 or grace_s < 0:
        raise ValueError("size and slide must be positive, grace not negative")
    return size_s if slide_s is None else min(slide_s, size_s)


def _seconds(x: float) -> Column:
    return F.expr(f"make_dt_interval(0, 0, 0, {x:.3f})")


def pairs(events: DataFrame, size_s: float, slide_s: float | None = None, ts: str = "ts") -> DataFrame:
    """A row for each event and window that holds it, with window_start and window_end."""
    slide = checked(size_s, slide_s, 0)
    text = lambda s: f"{round(s * 1000)} milliseconds"
    rows = events.withColumn("_w", F.window(ts, text(size_s), text(slide)) if slide < size_s else F.window(ts, text(size_s)))
    return rows.withColumn("window_start", F.col("_w.start")).withColumn("window_end", F.col("_w.end")).drop("_w")


def before(tops: DataFrame, batch: str, value: str, out: str) -> DataFrame:
    """(_b, out) for each row of tops (batch, a whole number, and value): the largest value of all earlier batches. Spans of SPAN numbers are
    ordered each on its own; only the table of spans, a row each, is ordered as a whole."""
    rows = tops.select(F.col(batch).alias("_b"), F.col(value).alias("_v"), F.floor(F.col(batch) / SPAN).alias("_span"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy("_span").agg(F.max("_v").alias("_most"))
    spans = spans.select("_span", F.max("_most").over(earlier(Window.orderBy("_span"))).alias("_past"))
    inside = rows.withColumn("_in", F.max("_v").over(earlier(Window.partitionBy("_span").orderBy("_b"))))
    return inside.join(spans, "_span").select("_b", F.greatest("_past", "_in").alias(out))


def classified(events: DataFrame, size_s: float, slide_s: float | None, grace_s: float, ts: str = "ts", batch: str = "batch") -> DataFrame:
    """pairs() with wm_prev and late."""
    marks = before(events.groupBy(batch).agg(F.max(ts).alias("_max")), batch, "_max", "wm_prev")
    rows = pairs(events, size_s, slide_s, ts)
    rows = rows.join(marks, rows[batch] == marks["_b"]).drop("_b")
    return rows.withColumn("late", F.coalesce(F.col("wm_prev") >= F.col("window_end") + _seconds(grace_s), F.lit(False)))


def fenced(events: DataFrame, batch: str = "batch", offset: str = "global_offset") -> DataFrame:
    """Events without those at or below the highest offset of an earlier batch, and each offset once a batch."""
    tops = before(events.groupBy(batch).agg(F.max(offset).alias("_top")), batch, "_top", "_fence")
    return events.join(tops, events[batch] == tops["_b"]).where(F.col("_fence").isNull() | (F.col(offset) > F.col("_fence"))).drop("_b", "_fence").dropDuplicates([batch, offset])


def finals(events: DataFrame, folds: dict[str, Column], size_s: float, slide_s: float | None = None, grace_s: float = GRACE_S, batched: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """Closed windows with their folds (aggregates over the columns of events). Without batches all events are one batch.
    keys are further keys of the windows; the watermark is that of all events."""
    rows = classified(events, size_s, slide_s, grace_s).where(~F.col("late")) if batched else pairs(events, size_s, slide_s)
    top = events.agg(F.max("ts").alias("_wm"))
    states = rows.groupBy(*keys, "window_start", "window_end").agg(*(c.alias(n) for n, c in folds.items()))
    # one row, so its size is known
    return states.join(F.broadcast(top), F.col("window_end") + _seconds(grace_s) <= F.col("_wm")).drop("_wm")


def reopened(events: DataFrame, size_s: float, slide_s: float | None = None, grace_s: float = GRACE_S) -> DataFrame:
    """Every emission of a count under REOPEN: (window_start, window_end, state, is_final, at_offset). Final rows have no offset."""
    rows = classified(events, size_s, slide_s, grace_s)
    on_time = rows.where(~F.col("late")).groupBy("window_start", "window_end").agg(F.count("*").alias("state"))
    top = events.agg(F.max("ts").alias("_wm"))
    closed = on_time.join(F.broadcast(top), F.col("window_end") + _seconds(grace_s) <= F.col("_wm")).drop("_wm")
    again = rows.where(F.col("late") & (F.col("wm_prev") <= F.col("window_end") + _seconds(2 * grace_s)))
    run = Window.partitionBy("window_start", "window_end").orderBy("batch", "global_offset").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    again = again.withColumn("_n", F.count("*").over(run)).join(on_time, ["window_start", "window_end"])
    re = again.select("window_start", "window_end", (F.col("state") + F.col("_n")).alias("state"), F.lit(False).alias("is_final"), F.col("global_offset").alias("at_offset"))
    return closed.select("window_start", "window_end", "state", F.lit(True).alias("is_final"), F.lit(None).cast("long").alias("at_offset")).unionByName(re)
