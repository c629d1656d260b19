"""Every query of the engine over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.crypto import decrypted, encrypted, export, forgotten
from ..functions.evolution import Chain, Migrations, renamed
from ..functions.text import backoff_ms, log_safe, poll_backoff_ms, scoped_key, subject_hash, time_code
from ..operators import audit, fold, readmodel, saga, windows, workqueue
from ..sources import adapters as A
from ..sources import event_log as log
from ..sources.schema import stream_parts, stream_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# scans


@query("global_scan", f"""with page as (select * from {A.LOG} where event_id not in (1600, 1601) and global_offset > 1200 order by global_offset limit 500),
    g as (select *, global_offset - row_number() over (order by global_offset) as gap from page)
    select global_offset, aggregate_id, event_type, value from g where gap = (select min(gap) from g)""")  # fmt: skip
def global_scan(spark, d):
    """Offsets 1601 and 1602 are missing, so the page of 500 ends before them."""
    rows = A.log_scan(spark, d).where(~F.col("event_id").isin(1600, 1601))
    return log.global_scan(rows, 1200, 500).select("global_offset", "aggregate_id", "event_type", "value")


@query("stream_scan", f"select version, global_offset, event_type, ts, value from {A.LOG} where aggregate_id = '42' and version > 3 order by version limit 40")
def stream_scan(spark, d):
    one = A.event_log(spark, d).where("aggregate_type = 'user' and aggregate_id = '42'")
    return log.stream_scan(one, "user", "42", 3, 40).select("version", "global_offset", "event_type", "ts", "value")


@query("log_head", "select coalesce(max(event_id + 1), 0) as head from events")
def log_head(spark, d):
    return log.head(A.log_scan(spark, d))


@query("stream_head", "select 'user' as aggregate_type, cast(user_id as varchar) as aggregate_id, count(*) as version from events group by user_id")
def stream_head(spark, d):
    return A.log_scan(spark, d).groupBy("aggregate_type", "aggregate_id").agg(F.count("*").alias("version"))


def _snapshots(spark, d):
    rows = fold.snapshot_points(A.event_log(spark, d), 20)
    return rows.groupBy(*fold.STREAM).agg(F.max("version").alias("version"))


@query("aggregate_load", f"""with l as {A.LOG}, s as (select aggregate_id, max(version) as v from l where version % 20 = 0 group by aggregate_id)
    select l.aggregate_id, coalesce(s.v, 0) as snapshot_version, l.version, l.event_type from l left join s using (aggregate_id) where l.version > coalesce(s.v, 0)""")
def aggregate_load(spark, d):
    return fold.load(A.event_log(spark, d), _snapshots(spark, d)).select("aggregate_id", "snapshot_version", "version", "event_type")


# folds

_FOLD = """select aggregate_id, count(*) as n_events, count(*) filter (event_type = 'purchase') as n_purchases, arg_max(event_type, global_offset) as last_type, max(global_offset) as last_offset"""


def _fold(rows):
    return rows.groupBy("aggregate_id").agg(
        F.count("*").alias("n_events"), F.count_if(F.col("event_type") == "purchase").alias("n_purchases"), F.max_by("event_type", "global_offset").alias("last_type"), F.max("global_offset").alias("last_offset")
    )


@query("stream_fold", f"{_FOLD} from {A.LOG} group by aggregate_id")
def stream_fold(spark, d):
    return _fold(A.log_scan(spark, d))


@query("stream_fold_ordered", f"""with l as {A.LOG}, p as (select aggregate_id, max(version) as v from l where event_type = 'purchase' group by aggregate_id)
    select l.aggregate_id, count(*) filter (event_type = 'click' and version > coalesce(v, 0)) as clicks_since_purchase, max(version) as version from l left join p using (aggregate_id) group by l.aggregate_id""")
def stream_fold_ordered(spark, d):
    """A fold that depends on order: clicks since the last purchase."""
    start = F.struct(F.lit(0).cast("long").alias("clicks"), F.lit(0).cast("long").alias("version"))
    step = lambda a, e: F.struct(F.when(e["event_type"] == "purchase", F.lit(0).cast("long")).otherwise(a["clicks"] + (e["event_type"] == "click").cast("long")).alias("clicks"), (a["version"] + 1).alias("version"))
    rows = fold.fold_reduce(A.log_scan(spark, d), ("event_type",), start, step, order="global_offset")
    return rows.select("aggregate_id", F.col("state.clicks").alias("clicks_since_purchase"), F.col("state.version").alias("version"))


@query("stream_fold_asof", f"{_FOLD} from {A.LOG} where ts <= timestamp '2024-01-15 00:00:00' group by aggregate_id")
def stream_fold_asof(spark, d):
    return _fold(fold.as_of(A.log_scan(spark, d), ts="2024-01-15 00:00:00"))


@query("snapshot_points", f"select aggregate_id, version, global_offset from {A.LOG} where version % 25 = 0")
def snapshot_points(spark, d):
    return fold.snapshot_points(A.event_log(spark, d), 25).select("aggregate_id", "version", "global_offset")


@query("projection_latest", f"select aggregate_id as id, arg_max(event_type, global_offset) as last_type, arg_max(value, global_offset) as last_value, count(*) - 1 as version from {A.LOG} group by aggregate_id")
def projection_latest(spark, d):
    rows = A.log_scan(spark, d).select(F.col("aggregate_id").alias("id"), "global_offset", F.col("event_type").alias("last_type"), F.col("value").alias("last_value"))
    return fold.latest(rows, ("id",), "global_offset").drop("global_offset")


@query("projection_counts", "select event_type, count(*) as n from events group by event_type")
def projection_counts(spark, d):
    return A.log_scan(spark, d).groupBy("event_type").agg(F.count("*").alias("n"))


# windows: sizes in seconds

def _folds():
    return {"n": F.count("*"), "top": F.max("value")}


def _bucket(size: int, slide: int, source: str) -> str:
    return f"""select e.*, to_timestamp(0)::timestamp + to_seconds(s) as window_start, to_timestamp(0)::timestamp + to_seconds(s + {size}) as window_end
        from (select *, unnest(range(cast(floor((epoch(ts) - {size}) / {slide}) as bigint) * {slide} + {slide}, cast(floor(epoch(ts) / {slide}) as bigint) * {slide} + 1, {slide})) as s from {source}) e where s + {size} > epoch(ts)"""


def _window_sql(size: int, slide: int, grace: int) -> str:
    return f"""with p as ({_bucket(size, slide, A.LOG)}) select window_start, window_end, count(*) as n, max(value) as top from p group by 1, 2
        having window_end + to_seconds({grace}) <= (select max(ts) from events)"""


@query("window_tumbling", _window_sql(3600, 3600, 300))
def window_tumbling(spark, d):
    return windows.finals(A.log_scan(spark, d), _folds(), 3600)


@query("window_sliding", _window_sql(7200, 1800, 300))
def window_sliding(spark, d):
    return windows.finals(A.log_scan(spark, d), _folds(), 7200, 1800)


@query("window_slide_gt_size", _window_sql(1800, 1800, 0))
def window_slide_gt_size(spark, d):
    return windows.finals(A.log_scan(spark, d), _folds(), 1800, 5400, 0)


def _late_sql(size: int, slide: int, grace: int) -> str:
    return f"""a as {A.ARRIVALS}, b as (select batch, max(max(ts)) over (order by batch rows between unbounded preceding and 1 preceding) as wm_prev from a group by batch),
        p as ({_bucket(size, slide, "a")}), c as (select p.*, wm_prev, coalesce(wm_prev >= window_end + to_seconds({grace}), false) as late from p join b using (batch))"""


@query("window_drop_late", f"""with {_late_sql(1800, 1800, 600)} select window_start, window_end, count(*) as n, max(value) as top from c where not late group by 1, 2
    having window_end + to_seconds(600) <= (select max(ts) from a)""")
def window_drop_late(spark, d):
    return windows.finals(A.arrivals(spark, d), _folds(), 1800, None, 600, batched=True)


_REOPEN = f"""with {_late_sql(3600, 1800, 600)}, o as (select window_start, window_end, count(*) as state from c where not late group by 1, 2),
    f as (select window_start, window_end, state, true as is_final, cast(null as bigint) as at_offset from o where window_end + to_seconds(600) <= (select max(ts) from a)),
    r as (select window_start, window_end, global_offset, count(*) over (partition by window_start order by batch, global_offset) as n from c where late and wm_prev <= window_end + to_seconds(1200)),
    x as (select r.window_start, r.window_end, state + n as state, false as is_final, global_offset as at_offset from r join o on r.window_start = o.window_start)"""


@query("window_reopen_emissions", f"{_REOPEN} select window_start, window_end, state, is_final, coalesce(at_offset, -1) as at_offset from (select * from f union all select * from x)")
def window_reopen_emissions(spark, d):
    return windows.reopened(A.arrivals(spark, d), 3600, 1800, 600).withColumn("at_offset", F.coalesce("at_offset", F.lit(-1)))


@query("window_reopen_final", f"{_REOPEN} select window_start, window_end, max(state) as state from (select * from f union all select * from x) group by 1, 2")
def window_reopen_final(spark, d):
    return windows.reopened(A.arrivals(spark, d), 3600, 1800, 600).groupBy("window_start", "window_end").agg(F.max("state").alias("state"))


@query("window_redelivery", _window_sql(3600, 3600, 300))
def window_redelivery(spark, d):
    """Each event arrives in a batch of its own and, with all events of the fifty before, in the next one; it counts once."""
    rows = A.log_scan(spark, d).withColumn("batch", F.floor(F.col("event_id") / 50))
    again = rows.withColumn("batch", F.col("batch") + 1)
    return windows.finals(windows.fenced(rows.unionByName(again)), _folds(), 3600)


# audit

_RANGE = ("2024-01-05 00:00:00", "2024-01-20 12:00:00")
_IN = "occurred_at >= timestamp '2024-01-05 00:00:00' and occurred_at <= timestamp '2024-01-20 12:00:00'"
_TOTALS = "select count(*) filter (aggregate_id is not null) as n_commands, count(*) filter (aggregate_id is null) as n_queries, count(*) filter (outcome = 'FAILURE') as n_failures"


@query("compliance_totals", f"{_TOTALS} from {A.AUDIT} where {_IN}")
def compliance_totals(spark, d):
    return audit.totals(A.audit_log(spark, d), *_RANGE)


@query("compliance_for_user", f"{_TOTALS} from {A.AUDIT} where {_IN} and user_id = '42'")
def compliance_for_user(spark, d):
    return audit.totals(A.audit_log(spark, d), *_RANGE, user="42")


@query("compliance_by_type", f"select command_type, count(*) as n from {A.AUDIT} where {_IN} and aggregate_id is not null group by 1")
def compliance_by_type(spark, d):
    return audit.by_type(A.audit_log(spark, d), *_RANGE)


@query("compliance_by_query_type", f"select command_type, count(*) as n from {A.AUDIT} where {_IN} and aggregate_id is null group by 1")
def compliance_by_query_type(spark, d):
    return audit.by_type(A.audit_log(spark, d), *_RANGE, queries=True)


@query("compliance_activity", f"select user_id, count(*) as n from {A.AUDIT} where {_IN} and user_id is not null group by 1")
def compliance_activity(spark, d):
    return audit.activity(A.audit_log(spark, d), *_RANGE)


_CMD = ("command_id", "command_type", "user_id", "occurred_at", "outcome", "event_count")


@query("audit_by_command", f"select {', '.join(_CMD)} from {A.AUDIT} where command_id = 'cmd-77' order by occurred_at desc limit 1")
def audit_by_command(spark, d):
    return audit.last_of_command(A.audit_log(spark, d), "cmd-77").select(*_CMD)


def _audit_page(spark, d, where, number=1, size=20):
    return audit.page(A.audit_log(spark, d), where & audit.between(*_RANGE), number, size, "n").select(*_CMD)


def _audit_sql(where: str, number=1, size=20) -> str:
    return f"select {', '.join(_CMD)} from {A.AUDIT} where {where} and {_IN} order by occurred_at, n limit {size} offset {number * size}"


@query("audit_page_user", _audit_sql("user_id = '7'", 0))
def audit_page_user(spark, d):
    return _audit_page(spark, d, F.col("user_id") == "7", 0)


@query("audit_page_outcome", _audit_sql("outcome = 'FAILURE'"))
def audit_page_outcome(spark, d):
    return _audit_page(spark, d, F.col("outcome") == "FAILURE")


@query("audit_page_type", _audit_sql("command_type = 'purchase'", 2))
def audit_page_type(spark, d):
    return _audit_page(spark, d, F.col("command_type") == "purchase", 2)


_EV = ("event_id", "event_type", "aggregate_id", "command_id", "correlation_id", "causation_id", "user_id", "occurred_at")


def _events(spark, d, where):
    return A.event_audit_log(spark, d).where(where).orderBy("occurred_at", "n").select(*_EV)


@query("event_audit_by_correlation", f"select {', '.join(_EV)} from {A.EVENT_AUDIT} where correlation_id = 'corr-7'")
def event_audit_by_correlation(spark, d):
    return _events(spark, d, F.col("correlation_id") == "corr-7")


@query("event_audit_by_command", f"select {', '.join(_EV)} from {A.EVENT_AUDIT} where command_id = 'cmd-77'")
def event_audit_by_command(spark, d):
    return _events(spark, d, F.col("command_id") == "cmd-77")


@query("event_audit_by_stream", f"select {', '.join(_EV)} from {A.EVENT_AUDIT} where aggregate_type = 'user' and aggregate_id = '9'")
def event_audit_by_stream(spark, d):
    return _events(spark, d, (F.col("aggregate_type") == "user") & (F.col("aggregate_id") == "9"))


@query("event_audit_by_user", f"select {', '.join(_EV)} from {A.EVENT_AUDIT} where user_id = '8' and {_IN}")
def event_audit_by_user(spark, d):
    return _events(spark, d, (F.col("user_id") == "8") & audit.between(*_RANGE))


@query("causation_chain", f"""with recursive e as {A.EVENT_AUDIT}, c as (select event_id, causation_id, occurred_at from e where event_id = 'evt-3001' union select e.event_id, e.causation_id, e.occurred_at from e join c on e.causation_id = c.event_id)
    select event_id, causation_id, occurred_at from c""")
def causation_chain(spark, d):
    rows = A.event_audit_log(spark, d).select("event_id", "causation_id", "occurred_at")
    return audit.causation_closure(rows, "evt-3001")


# read models

_ROW = ("id", "customer", "segment", "status", "total", "version")
_ROW_SQL = "id, customer, segment, status, cast(total as double) as total, version"


def _row(view):
    return view.select(*(F.col(c).cast("double").alias(c) if c == "total" else F.col(c) for c in _ROW))


def _page_sql(where: str, order: str, number: int, size: int) -> str:
    return f"select {_ROW_SQL} from {A.VIEW} where {where} order by {order} limit {size} offset {number * size}"


def _page(spark, d, request, field=None, value=None):
    view = A.order_view(spark, d)
    where = readmodel.matches(view, field, value) if field else None
    return _row(readmodel.page_rows(view, request, where))


@query("rm_find_by_id", f"select {_ROW_SQL} from {A.VIEW} where id = '1234'")
def rm_find_by_id(spark, d):
    return _row(readmodel.find_by_id(A.order_view(spark, d), "1234"))


@query("rm_find_all", f"select {_ROW_SQL} from {A.VIEW}")
def rm_find_all(spark, d):
    return _row(A.order_view(spark, d))


@query("rm_page_sorted", _page_sql("true", "customer desc nulls first, total_text, id", 3, 25))
def rm_page_sorted(spark, d):
    return _page(spark, d, readmodel.PageRequest(3, 25, (("customer", False), ("total", True))))


@query("rm_page_filtered", _page_sql("status = 'P'", "segment asc nulls last, id", 1, 30))
def rm_page_filtered(spark, d):
    return _page(spark, d, readmodel.PageRequest(1, 30, (("segment", True),)), "status", "P")


@query("rm_page_nulls", _page_sql("true", "segment desc nulls first, status asc nulls last, id", 0, 40))
def rm_page_nulls(spark, d):
    return _page(spark, d, readmodel.PageRequest(0, 40, (("segment", False), ("status", True))))


@query("rm_page_unsorted", _page_sql("true", "id", 2, 50))
def rm_page_unsorted(spark, d):
    return _page(spark, d, readmodel.PageRequest(2, 50))


@query("rm_page_by_version", _page_sql("true", "version desc nulls first, id", 0, 35))
def rm_page_by_version(spark, d):
    return _page(spark, d, readmodel.PageRequest(0, 35, (("version", False),)))


@query("rm_page_beyond_end", f"select count(*) as n_total, cast(null as varchar) as id from {A.VIEW} where status = 'P'")
def rm_page_beyond_end(spark, d):
    view = A.order_view(spark, d)
    return readmodel.page_with_total(view, readmodel.PageRequest(10**6, 10), readmodel.matches(view, "status", "P")).select("n_total", "id")


@query("rm_page_total", f"""with v as {A.VIEW} select t.n_total, p.id from (select count(*) as n_total from v where status = 'F') t, (select id from v where status = 'F' order by id limit 10) p""")
def rm_page_total(spark, d):
    view = A.order_view(spark, d)
    return readmodel.page_with_total(view, readmodel.PageRequest(0, 10), readmodel.matches(view, "status", "F")).select("n_total", "id")


@query("rm_number_text", f"select id, total_text from {A.VIEW} where total_text like '%.50'")
def rm_number_text(spark, d):
    """Decimals are compared as text in plain notation with their scale."""
    view = A.order_view(spark, d)
    return view.select("id", readmodel.canonical_text(F.col("total"), view.schema["total"].dataType).alias("total_text")).where(F.col("total_text").endswith(".50"))


@query("rm_upsert_version", f"""with w as (select aggregate_id as id, event_type as last_type, global_offset, event_type = 'error' as deleted from {A.LOG}), l as (select id, max(global_offset) filter (deleted) as gone, max(global_offset) as last from w group by id)
    select w.id, arg_max(last_type, global_offset) as last_type, count(*) - 1 as version from w join l using (id) where global_offset > coalesce(gone, 0) group by w.id""")
def rm_upsert_version(spark, d):
    """Each event writes its user's row, an error deletes it."""
    rows = A.log_scan(spark, d).select(F.col("aggregate_id").alias("id"), "global_offset", F.col("event_type").alias("last_type"), (F.col("event_type") == "error").alias("deleted"))
    return readmodel.upserts(rows).select("id", "last_type", "version")


# work queues

_DUE = f"(next_retry_at is null or next_retry_at <= timestamp '{A.AS_OF}')"


def _claim_sql(ahead: str) -> str:
    return f"""with o as {A.OUTBOX}, h as (select *, row_number() over (partition by aggregate_id order by seq) as r from o where aggregate_id is not null and status in ({ahead})),
    e as (select seq from o where aggregate_id is null and status = 'PENDING' and {_DUE} union all
        select seq from h where r = 1 and status = 'PENDING' and {_DUE} and aggregate_id not in (select aggregate_id from o where status = 'IN_PROGRESS' and aggregate_id is not null))
    select o.seq, o.entry_id, o.aggregate_id, o.status from o join e using (seq) order by seq limit 100"""


def _claim(spark, d, mode):
    return workqueue.claimable(A.outbox(spark, d), A.AS_OF, 100, mode).select("seq", "entry_id", "aggregate_id", "status")


@query("outbox_claim_availability", _claim_sql("'PENDING'"))
def outbox_claim_availability(spark, d):
    return _claim(spark, d, workqueue.AVAILABILITY_FIRST)


@query("outbox_claim_strict", _claim_sql("'PENDING', 'FAILED'"))
def outbox_claim_strict(spark, d):
    return _claim(spark, d, workqueue.STRICT_PER_AGGREGATE)


@query("outbox_blockage", f"select count(distinct aggregate_id) as n_streams, min(processed_at) as oldest, count(*) filter (aggregate_id is null) as n_free from {A.OUTBOX} where status = 'FAILED'")
def outbox_blockage(spark, d):
    return workqueue.blockage(A.outbox(spark, d))


@query("outbox_counts", f"select status, count(*) as n from {A.OUTBOX} group by status")
def outbox_counts(spark, d):
    return workqueue.counts(A.outbox(spark, d))


@query("outbox_by_status", f"select seq, entry_id, aggregate_id from {A.OUTBOX} where status = 'FAILED' order by seq limit 60")
def outbox_by_status(spark, d):
    return workqueue.by_status(A.outbox(spark, d), "FAILED", 60).select("seq", "entry_id", "aggregate_id")


@query("outbox_retention", f"""select seq, status from {A.OUTBOX} where not coalesce(status = 'DELIVERED' and processed_at < timestamp '{A.MID}', false)
    and not coalesce(status = 'SKIPPED' and skipped_at < timestamp '{A.MID}', false)""")
def outbox_retention(spark, d):
    return workqueue.outbox_retained(A.outbox(spark, d), A.MID).select("seq", "status")


_BOX = ("seq", "status", "attempts", "next_retry_at", "processed_at", "claimed_by", "claimed_at", "last_error", "skipped_at", "skipped_by", "skip_reason")


def _transition_sql(where: str, **changes: str) -> str:
    """Every entry; in those for which `where` holds and whose seq is a multiple of three the columns are as given."""
    hit = f"seq % 3 = 0 and {where}"
    return f"select {', '.join(f'case when {hit} then {changes[c]} else {c} end as {c}' if c in changes else c for c in _BOX)} from {A.OUTBOX}"


def _transition(spark, d, kind, claimer="relay-0", **given):
    box = A.outbox(spark, d)
    asked = box.where("seq % 3 = 0").select("seq", *(F.lit(v).alias(k) for k, v in given.items()))
    return workqueue.transition(box, asked, kind, claimer, A.AS_OF, 90).select(*_BOX)


_CLAIMED, _AT = "status = 'IN_PROGRESS' and claimed_by = 'relay-0'", f"timestamp '{A.AS_OF}'"
_FREE = {"claimed_by": "null", "claimed_at": "null"}


@query("outbox_transition", _transition_sql("status = 'FAILED'", status="'PENDING'", attempts="0", last_error="null", next_retry_at="null", **_FREE))
def outbox_transition(spark, d):
    """An operator resets every third entry; it counts for failed ones only."""
    return _transition(spark, d, "reset")


@query("outbox_deliver", _transition_sql(_CLAIMED, status="'DELIVERED'", attempts="attempts + 1", processed_at=_AT))
def outbox_deliver(spark, d):
    return _transition(spark, d, "deliver")


@query("outbox_fail", _transition_sql(_CLAIMED, status="'FAILED'", attempts="9", last_error="'boom'", processed_at=_AT))
def outbox_fail(spark, d):
    return _transition(spark, d, "fail", attempts=9, error="boom")


@query("outbox_retry", _transition_sql(_CLAIMED, status="'PENDING'", attempts="4", last_error="'slow'", next_retry_at=f"{_AT} + interval 90 second", **_FREE))
def outbox_retry(spark, d):
    return _transition(spark, d, "retry", attempts=4, error="slow")


@query("outbox_release", _transition_sql(_CLAIMED, status="'PENDING'", **_FREE))
def outbox_release(spark, d):
    return _transition(spark, d, "release")


@query("outbox_skip", _transition_sql("status = 'FAILED'", status="'SKIPPED'", skipped_at=_AT, skipped_by="'ann'", skip_reason="'obsolete'"))
def outbox_skip(spark, d):
    return _transition(spark, d, "skip", claimer=None, by="ann", reason="obsolete")


@query("outbox_reclaim", f"""select seq, case when old then 'PENDING' else status end as status, case when not old then claimed_by end as claimed_by, case when not old then claimed_at end as claimed_at
    from (select *, coalesce(status = 'IN_PROGRESS' and claimed_at < timestamp '{A.MID}' - interval 240 second, false) as old from {A.OUTBOX})""")
def outbox_reclaim(spark, d):
    return workqueue.reclaimed(A.outbox(spark, d), A.MID, "claimed_at", 240).select("seq", "status", "claimed_by", "claimed_at")


@query("saga_timed_out", f"""with s as (select * from {A.SAGAS} where saga_type = 'order'), b as (select timestamp '{A.MID}' - interval 30 day as t),
    f as (select saga_id, created_at from s, b where status in ('STARTED', 'RUNNING') and created_at < t order by created_at, saga_id limit 75),
    c as (select saga_id, updated_at from s, b where status = 'COMPENSATING' and updated_at < t order by updated_at, saga_id limit 75)
    select saga_id, slot, population from (select saga_id, row_number() over (order by created_at, saga_id) as slot, 0 as population from f
        union all select saga_id, row_number() over (order by updated_at, saga_id), 1 from c) order by slot, population limit 75""")
def saga_timed_out(spark, d):
    return workqueue.timed_out(A.saga_state(spark, d), A.MID, 30, 75, "order").select("saga_id", "slot", "population")


@query("saga_timed_out_bounds", f"""select saga_id from {A.SAGAS} where saga_type = 'order' and (status in ('STARTED', 'RUNNING') and created_at < timestamp '{A.MID}' - interval 30 day
    or status = 'COMPENSATING' and updated_at < timestamp '{A.MID}' - interval 30 day)""")
def saga_timed_out_bounds(spark, d):
    """All of them, rows on the bound left out."""
    return workqueue.overdue(A.saga_state(spark, d), A.MID, 30, "order").select("saga_id")


@query("saga_compensating", f"""select saga_id, updated_at, episode_claimed_at from {A.SAGAS} where saga_type = 'order' and status = 'COMPENSATING' and updated_at < timestamp '{A.MID}' - interval 5 day
    order by updated_at, saga_id limit 50""")
def saga_compensating(spark, d):
    return workqueue.compensating(A.saga_state(spark, d), A.MID, 5, 50, "order").select("saga_id", "updated_at", "episode_claimed_at")


@query("saga_by_status", f"select saga_id, updated_at from {A.SAGAS} where saga_type = 'refund' and status = 'FAULTED' order by updated_at desc, saga_id limit 40")
def saga_by_status(spark, d):
    return workqueue.sagas_by_status(A.saga_state(spark, d), "refund", "FAULTED", 40).select("saga_id", "updated_at")


@query("saga_counts", f"select status, count(*) as n from {A.SAGAS} where saga_type = 'order' group by status")
def saga_counts(spark, d):
    return workqueue.counts(A.saga_state(spark, d).where("saga_type = 'order'"))


_SHIELDED = f"exists (select 1 from {A.SAGAS} ss where ss.saga_id = l.saga_id and (ss.status = 'FAULTED' or ss.dead_letter_pending) and ss.saga_type = l.saga_type)"
_RESOLVED = "(l.saga_id is null and l.target_saga_id is not null)"
_ROWLESS = f"(l.saga_id is not null and not exists (select 1 from {A.SAGAS} ro where ro.saga_id = l.saga_id and ro.saga_type = l.saga_type))"


@query("saga_dlq_backlog", f"""select count(*) filter (s or r or o) as n, count(*) filter (s) as n_shielded, count(*) filter (r) as n_resolved, count(*) filter (o) as n_rowless
    from (select {_SHIELDED} as s, {_RESOLVED} as r, {_ROWLESS} as o from {A.SAGA_DLQ} l)""")
def saga_dlq_backlog(spark, d):
    return workqueue.saga_backlog(A.saga_dead_letters(spark, d), A.saga_state(spark, d))


@query("saga_dlq_retention", f"""select global_offset, saga_id, saga_type, target_saga_id from {A.SAGA_DLQ} l
    where not (first_faulted_at < timestamp '{A.MID}' and not {_SHIELDED} and not {_RESOLVED} and not {_ROWLESS})""")
def saga_dlq_retention(spark, d):
    return workqueue.saga_letters_retained(A.saga_dead_letters(spark, d), A.saga_state(spark, d), A.MID).select("global_offset", "saga_id", "saga_type", "target_saga_id")


_STEPS = "(select n, saga_id, case when n % 17 = 0 then 'other' else saga_type end as st, case when n % 3 = 0 then version + 1 else version end as v, case when n % 2 = 0 then 'COMPENSATING' else 'RUNNING' end as s, n % 70 as o, n % 4 = 0 as st_, n % 5 = 0 as rp, 'e-' || n as ev from s)"
_STEP_COLUMNS = ("saga_id", "status", "version", "pre_fault_status", "genesis_applied", "last_applied_offset", "last_replayed_offset", "episode_version", "episode_claimed_at", "episode_cause_event_id", "updated_at")
_STEP_OK = "(s.status not in ('COMPLETED', 'COMPENSATED', 'FAILED') and s.version = t.v and s.saga_type = t.st)"


@query("saga_apply_steps", f"""select * replace (coalesce(last_applied_offset, -1) as last_applied_offset, coalesce(last_replayed_offset, -1) as last_replayed_offset, coalesce(episode_version, -1) as episode_version) from (with s as (select * from {A.SAGAS}), t as {_STEPS} select s.saga_id, case when {_STEP_OK} then t.s else s.status end as status, case when {_STEP_OK} then s.version + 1 else s.version end as version,
    case when not {_STEP_OK} then s.pre_fault_status end as pre_fault_status, s.genesis_applied or ({_STEP_OK} and t.st_) as genesis_applied,
    case when {_STEP_OK} then greatest(coalesce(s.last_applied_offset, -1), t.o) else s.last_applied_offset end as last_applied_offset, case when {_STEP_OK} and t.rp then t.o else s.last_replayed_offset end as last_replayed_offset,
    case when {_STEP_OK} and t.s = 'COMPENSATING' and s.episode_version is null then s.version + 1 else s.episode_version end as episode_version,
    case when {_STEP_OK} and t.s = 'COMPENSATING' and s.episode_version is null then timestamp '{A.AS_OF}' else s.episode_claimed_at end as episode_claimed_at,
    case when {_STEP_OK} and t.s = 'COMPENSATING' and s.episode_version is null then t.ev else s.episode_cause_event_id end as episode_cause_event_id,
    case when {_STEP_OK} then timestamp '{A.AS_OF}' else s.updated_at end as updated_at from s join t on s.saga_id = t.saga_id)""")
def saga_apply_steps(spark, d):
    """A step for every saga; some are of another type, some of another version."""
    rows, n = A.saga_state(spark, d), F.col("n")
    steps = rows.select(
        "saga_id", F.when(n % 17 == 0, "other").otherwise(F.col("saga_type")).alias("saga_type"), F.when(n % 3 == 0, F.col("version") + 1).otherwise(F.col("version")).alias("version"),
        F.when(n % 2 == 0, "COMPENSATING").otherwise("RUNNING").alias("status"), (n % 70).alias("offset"), (n % 4 == 0).alias("start"), (n % 5 == 0).alias("replay"), F.concat(F.lit("e-"), n.cast("string")).alias("event_id"),
    )
    numbers = ("last_applied_offset", "last_replayed_offset", "episode_version")
    return saga.apply_steps(rows, steps, A.AS_OF).select(*(F.coalesce(c, F.lit(-1)).alias(c) if c in numbers else c for c in _STEP_COLUMNS))


_FAULT_OK = "(status not in ('COMPLETED', 'COMPENSATED', 'FAILED') and n % 3 <> 0 and n % 17 <> 0)"


@query("saga_mark_faulted", f"""select saga_id, case when {_FAULT_OK} then 'FAULTED' else status end as status, case when {_FAULT_OK} then version + 1 else version end as version,
    case when not {_FAULT_OK} or status = 'FAULTED' then pre_fault_status when not genesis_applied and status <> 'COMPENSATING' then null else status end as pre_fault_status,
    case when {_FAULT_OK} then timestamp '{A.AS_OF}' else updated_at end as updated_at from {A.SAGAS}""")
def saga_mark_faulted(spark, d):
    """A fault for every saga; one in three has another version, one in seventeen another type."""
    rows, n = A.saga_state(spark, d), F.col("n")
    asked = rows.select("saga_id", F.when(n % 17 == 0, "other").otherwise(F.col("saga_type")).alias("saga_type"), F.when(n % 3 == 0, F.col("version") + 1).otherwise(F.col("version")).alias("version"))
    return saga.mark_faulted(rows, asked, A.AS_OF).select("saga_id", "status", "version", "pre_fault_status", "updated_at")


_SINCE, _DLQ_FIT = "coalesce(last_attempt_at, published_at)", f"attempts < 5 and idempotency_key is not null and first_attempt_at >= timestamp '{A.MID}'"


@query("dlq_retryable", f"""select n, idempotency_key, attempts from {A.DLQ} where {_DLQ_FIT} and {_SINCE} + to_seconds(cast(30 * pow(2, attempts) as integer)) <= timestamp '{A.AS_OF}' order by {_SINCE}, n limit 80""")
def dlq_retryable(spark, d):
    """Keyed letters whose command was received in the window, which begins at its bound."""
    return workqueue.retryable(A.dead_letters(spark, d), A.AS_OF, 80, received_since=A.MID).select("n", "idempotency_key", "attempts")


@query("dlq_retryable_unkeyed", f"""select n, attempts from {A.DLQ} where attempts < 3 and {_SINCE} + to_seconds(cast(86400 * pow(2, attempts) as integer)) <= timestamp '{A.MID}' order by {_SINCE}, n limit 60""")
def dlq_retryable_unkeyed(spark, d):
    return workqueue.retryable(A.dead_letters(spark, d), A.MID, 60, attempts=3, unkeyed=True, initial_s=86400).select("n", "attempts")


@query("dlq_awaiting_operator", f"select count(*) as n from {A.DLQ} where attempts < 5 and (idempotency_key is null or (idempotency_key is not null and first_attempt_at < timestamp '{A.MID}'))")
def dlq_awaiting_operator(spark, d):
    return workqueue.awaiting_operator(A.dead_letters(spark, d), received_before=A.MID)


@query("dlq_newest", f"select n, published_at from {A.DLQ} order by published_at desc, n desc limit 45")
def dlq_newest(spark, d):
    return workqueue.newest_letters(A.dead_letters(spark, d), 45).select("n", "published_at")


@query("dlq_by_key", f"select n, idempotency_key from {A.DLQ} where idempotency_key = (select min(idempotency_key) from {A.DLQ})")
def dlq_by_key(spark, d):
    rows = A.dead_letters(spark, d)
    return workqueue.letters_of_key(rows, rows.agg(F.min("idempotency_key")).first()[0]).select("n", "idempotency_key")


@query("dlq_publish", f"""select n, idempotency_key from {A.DLQ} union all select n + 10000000, case when n % 3 = 0 then 'new-' || n else idempotency_key end from {A.DLQ} where n % 2 = 1 and n % 3 = 0
    union all select n + 20000000, null from {A.DLQ} where n % 4 = 0""")
def dlq_publish(spark, d):
    """Letters come again: those under their old key store nothing, those under a new one or without a key do."""
    rows, n = A.dead_letters(spark, d), F.col("n")
    again = rows.where(n % 2 == 1).withColumn("idempotency_key", F.when(n % 3 == 0, F.concat(F.lit("new-"), n.cast("string"))).otherwise(F.col("idempotency_key"))).withColumn("n", n + 10000000)
    return workqueue.published(rows, again.unionByName(rows.where(n % 4 == 0).withColumn("n", n + 20000000))).select("n", "idempotency_key")


@query("projection_dlq_upsert", f"""with o as (select global_offset as f, global_offset + 9 as t, 1 + global_offset % 4 as a from {A.LOG} where global_offset % 20 = 0), w as (select global_offset as f, global_offset + 9 as t, 2 as a from {A.LOG} where global_offset % 30 = 0)
    select 'p' as projection, coalesce(w.f, o.f) as from_offset, coalesce(w.t, o.t) as to_offset, case when o.f is null then w.a when w.f is null then o.a else greatest(o.a + 1, w.a) end as attempts from o full join w on o.f = w.f and o.t = w.t""")
def projection_dlq_upsert(spark, d):
    at, rows = F.col("global_offset"), A.log_scan(spark, d)
    part = lambda every, attempts: rows.where(at % every == 0).select(F.lit("p").alias("projection"), at.alias("from_offset"), (at + 9).alias("to_offset"), attempts.cast("long").alias("attempts"))
    return workqueue.merge_dead_ranges(part(20, 1 + at % 4), part(30, F.lit(2)))


@query("dlq_range", f"select global_offset, event_type from {A.LOG} where global_offset between 301 and 420")
def dlq_range(spark, d):
    return log.offset_range(A.log_scan(spark, d), 301, 420).select("global_offset", "event_type")


# functions, evolution, keys


@query("upcast_events", """select event_id + 1 as global_offset, case when event_type = 'purchase' then 2 else 1 end as schema_version,
    case when event_type = 'purchase' then json_extract_string(props, '$.k') end as key_value, case when event_type <> 'purchase' then json_extract_string(props, '$.k') end as k_value from events""")
def upcast_events(spark, d):
    """Payloads of purchases are lifted from version 1, where the key is k, to version 2, where it is key."""
    rows = Chain().add("purchase", 1, renamed("k", "key")).apply(A.log_scan(spark, d).withColumn("schema_version", F.lit(1)))
    return rows.select("global_offset", "schema_version", F.get_json_object("payload", "$.key").alias("key_value"), F.get_json_object("payload", "$.k").alias("k_value"))


@query("outbox_udtf", """select 'out-' || event_id || '-' || i as entry_id, event_id + 1 as global_offset, case i when 0 then 'billing' else 'shipping' end as destination from events, (select unnest([0, 1]) as i) where event_type = 'purchase'""")
def outbox_udtf(spark, d):
    """A mapper that turns a purchase into two entries of the outbox."""
    rows = A.log_scan(spark, d).where("event_type = 'purchase'").select("event_id", "global_offset", F.posexplode(F.array(F.lit("billing"), F.lit("shipping"))).alias("i", "destination"))
    return rows.select(F.concat_ws("-", F.lit("out"), "event_id", "i").alias("entry_id"), "global_offset", "destination")


@query("inbox_dedup", """select user_id || '|' || event_type || '|' || cast(floor(epoch(ts) / 86400) as bigint) as idempotency_key, min(event_id + 1) as global_offset, count(*) - 1 as n_replays from events group by 1""")
def inbox_dedup(spark, d):
    """The first command with a key wins; the later ones are replays of it."""
    key = scoped_key(F.col("user_id").cast("string"), F.col("event_type"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400))
    return A.log_scan(spark, d).groupBy(key.alias("idempotency_key")).agg(F.min("global_offset").alias("global_offset"), (F.count("*") - 1).alias("n_replays"))


def _keys(spark, d):
    users = A.log_scan(spark, d).select("user_id").distinct()
    return users.select("user_id", subject_hash(F.col("user_id").cast("string")).alias("subject_hash"), F.unhex(F.substring(F.sha2(F.concat(F.lit("key-"), F.col("user_id").cast("string")), 256), 1, 32)).alias("key"))


@query("crypto_redaction", """select event_id + 1 as global_offset, case when user_id % 3 = 0 then '[REDACTED]' else event_type end as event_type from events""")
def crypto_redaction(spark, d):
    """A field encrypted under its user's key; the keys of every third user are forgotten before it is read."""
    keys = _keys(spark, d)
    rows = A.log_scan(spark, d).select("global_offset", "event_type", F.col("user_id").cast("string").alias("subject"))
    secret = encrypted(rows, ["event_type"], "subject", keys)
    return decrypted(secret, ["event_type"], "subject", keys.where("user_id % 3 <> 0")).select("global_offset", "event_type")


@query("subject_export", f"""select 'events' as section, cast(global_offset as varchar) as item, event_type as detail from {A.LOG} where aggregate_id = '42'
    union all select 'audit', cast(n as varchar), outcome from {A.AUDIT} where user_id = '42' union all select 'outbox', cast(seq as varchar), status from {A.OUTBOX} where aggregate_id = '42'""")
def subject_export(spark, d):
    part = lambda rows, item, detail: rows.select(F.col(item).cast("string").alias("item"), F.col(detail).alias("detail"))
    sections = {
        "events": part(A.log_scan(spark, d).where("aggregate_id = '42'"), "global_offset", "event_type"), "audit": part(A.audit_log(spark, d).where("user_id = '42'"), "n", "outcome"),
        "outbox": part(A.outbox(spark, d).where("aggregate_id = '42'"), "seq", "status"), "none": None,
    }
    return export("42", sections).select("section", F.get_json_object("row", "$.item").alias("item"), F.get_json_object("row", "$.detail").alias("detail"))


@query("subject_forget", "select event_id + 1 as global_offset, case when user_id in (42, 7) then '[REDACTED]' else event_type end as event_type from events where user_id < 60")
def subject_forget(spark, d):
    """Two subjects are forgotten: their keys go, and what was encrypted under them reads as redacted."""
    keys = _keys(spark, d)
    rows = A.log_scan(spark, d).where("user_id < 60").select("global_offset", "event_type", F.col("user_id").cast("string").alias("subject"))
    left = forgotten(keys, A.log_scan(spark, d).where("user_id in (42, 7)").select(F.col("user_id").cast("string").alias("subject")).distinct())
    return decrypted(encrypted(rows, ["event_type"], "subject", keys), ["event_type"], "subject", left).select("global_offset", "event_type")


def _saved(spark, d):
    return _snapshots(spark, d).withColumn("state", F.concat(F.lit("v"), F.col("version").cast("string"))).withColumn("purge_generation", F.lit(0).cast("long"))


_SAVED = f"(select aggregate_id, max(version) as version from {A.LOG} where version % 20 = 0 group by aggregate_id)"


@query("snapshot_purge", f"select aggregate_id, version, case when cast(aggregate_id as bigint) % 3 <> 0 then 'v' || version end as state, case when cast(aggregate_id as bigint) % 3 = 0 then 1 else 0 end as purge_generation from {_SAVED}")
def snapshot_purge(spark, d):
    """The snapshots of every third stream lose their state, and their generation goes up."""
    rows = _saved(spark, d)
    asked = rows.where(F.col("aggregate_id").cast("long") % 3 == 0)
    return fold.purge_snapshots(rows, asked.unionByName(asked)).select("aggregate_id", "version", "state", "purge_generation")


@query("snapshot_save", f"""select aggregate_id, case when cast(aggregate_id as bigint) % 3 = 0 then version else version + 5 end as version, case when cast(aggregate_id as bigint) % 3 = 0 then null else 'new' end as state,
    case when cast(aggregate_id as bigint) % 3 = 0 then 1 else 0 end as purge_generation from {_SAVED}""")
def snapshot_save(spark, d):
    """Snapshots that were made before a purge are not saved after it."""
    rows = _saved(spark, d)
    purged = fold.purge_snapshots(rows, rows.where(F.col("aggregate_id").cast("long") % 3 == 0))
    new = rows.withColumn("version", F.col("version") + 5).withColumn("state", F.lit("new"))
    return fold.save_snapshots(purged, new).select("aggregate_id", "version", "state", "purge_generation")


@query("snapshot_migration", f"""select aggregate_id, 4 as schema, case when cast(aggregate_id as bigint) % 5 = 0 then cast(version as varchar) end as m_value,
    case when cast(aggregate_id as bigint) % 5 <> 0 then cast(version as varchar) end as v_value from {_SAVED} where cast(aggregate_id as bigint) % 5 in (0, 2, 3)""")
def snapshot_migration(spark, d):
    """Snapshots of schemas 1 to 5, of which 1 and 3 lead to schema 4; those of 2 and 5 go."""
    rows = _saved(spark, d).withColumn("schema", (F.col("aggregate_id").cast("long") % 5 + 1).cast("int")).withColumn("state", F.to_json(F.create_map(F.lit("v"), F.col("version").cast("string"))))
    chain = Migrations().add(1, 3, renamed("v", "n")).add(3, 4, renamed("n", "m")).add(2, 5, renamed("v", "w"))
    lifted = chain.apply(rows, 4)
    return lifted.select("aggregate_id", "schema", F.get_json_object("state", "$.m").alias("m_value"), F.get_json_object("state", "$.v").alias("v_value"))


@query("stream_heads", f"select aggregate_type, aggregate_id, max(version) as version from {A.LOG} group by 1, 2")
def stream_heads(spark, d):
    return log.stream_heads(A.event_log(spark, d))


@query("rm_compare_and_set", f"select id, case when cast(id as bigint) % 2 = 0 and cast(id as bigint) % 3 <> 0 then 'new' else customer end as customer, case when cast(id as bigint) % 2 = 0 and cast(id as bigint) % 3 <> 0 then version + 1 else version end as version from {A.VIEW}")
def rm_compare_and_set(spark, d):
    """Every second row is written again; for every third the writer has seen another version."""
    view, n = A.order_view(spark, d).select("id", "customer", "version"), F.col("id").cast("long")
    asked = view.where(n % 2 == 0).select("id", F.lit("new").alias("customer"), F.when(n % 3 == 0, F.col("version") + 7).otherwise(F.col("version")).alias("expected"))
    return readmodel.compare_and_set(view, asked)[0].select("id", "customer", "version")


@query("rm_delete", f"select id, customer from {A.VIEW} where cast(id as bigint) % 5 <> 0")
def rm_delete(spark, d):
    view = A.order_view(spark, d).select("id", "customer", "version")
    return readmodel.deleted(view, view.where(F.col("id").cast("long") % 5 == 0).select("id")).select("id", "customer")


@query("compliance_by_type_of_user", f"select command_type, count(*) as n from {A.AUDIT} where {_IN} and aggregate_id is not null and user_id = '42' group by 1")
def compliance_by_type_of_user(spark, d):
    return audit.by_type(A.audit_log(spark, d), *_RANGE, user="42")


@query("event_audit_by_causation", f"select {', '.join(_EV)} from {A.EVENT_AUDIT} where causation_id = 'evt-3001'")
def event_audit_by_causation(spark, d):
    return _events(spark, d, F.col("causation_id") == "evt-3001")


@query("event_audit_by_stream_range", f"select {', '.join(_EV)} from {A.EVENT_AUDIT} where aggregate_type = 'user' and aggregate_id = '9' and {_IN}")
def event_audit_by_stream_range(spark, d):
    return _events(spark, d, (F.col("aggregate_type") == "user") & (F.col("aggregate_id") == "9") & audit.between(*_RANGE))


@query("saga_fold", f"""with l as {A.LOG}, s as (select aggregate_id, min(global_offset) as s from l where event_type = 'signup' group by 1),
    p as (select l.aggregate_id, min(global_offset) filter (event_type = 'purchase' and global_offset > s) as p, min(global_offset) filter (event_type = 'error' and global_offset > s) as e from l join s using (aggregate_id) group by 1),
    x as (select s.aggregate_id, s, e is not null and (p is null or e < p) as back, p from s join p using (aggregate_id))
    select aggregate_id, case when p is not null then case when back then 'COMPENSATED' else 'COMPLETED' end when back then 'COMPENSATING' when n > 1 then 'RUNNING' else 'STARTED' end as status, n as n_steps, last_offset
    from (select x.*, (select count(*) from l where l.aggregate_id = x.aggregate_id and global_offset >= s and global_offset <= coalesce(p, 1000000000)) as n,
        (select max(global_offset) from l where l.aggregate_id = x.aggregate_id and global_offset <= coalesce(p, 1000000000)) as last_offset from x)""")
def saga_fold(spark, d):
    return saga.saga_states(A.event_log(spark, d), "signup", "purchase", "error").drop("aggregate_type")


_PLAN = f"""(select saga, saga_type, global_offset, min(rank) = 1 as resolved, count(distinct rank) = 2 as shadows from (select saga_id as saga, saga_type, global_offset, 0 as rank from {A.SAGA_DLQ} where saga_id is not null
    union all select target_saga_id, saga_type, global_offset, 1 from {A.SAGA_DLQ} where saga_id is null and target_saga_id is not null) group by 1, 2, 3)"""


@query("saga_interleave_dlq", f"select *, row_number() over (partition by saga, saga_type order by global_offset) as place from {_PLAN}")
def saga_interleave_dlq(spark, d):
    """What drains feed, saga by saga in the order of offsets."""
    return saga.drain_plan(A.saga_dead_letters(spark, d))


@query("saga_drain", f"""with recursive p as (select p.*, row_number() over (partition by p.saga, p.saga_type order by global_offset) as place, coalesce(s.status in ('COMPLETED', 'COMPENSATED', 'FAILED'), false) as over_,
        coalesce(s.genesis_applied or coalesce(s.pre_fault_status, s.status) = 'COMPENSATING', false) as begun, global_offset % 7 = 0 as bad, global_offset % 3 = 0 as start_
        from {_PLAN} p left join {A.SAGAS} s on s.saga_id = p.saga and s.saga_type = p.saga_type),
    one as (select saga, saga_type, cast(0 as bigint) as place, false as landed, false as stopped, cast('' as varchar) as outcome from (select distinct saga, saga_type from p)
        union all select p.saga, p.saga_type, p.place, o.landed or (not o.stopped and start_ and not bad), o.stopped or (bad and not over_ and (begun or start_ or o.landed)),
            case when o.stopped then 'NOT_TRIED' when over_ then 'REPLAYED' when not begun and not start_ and not o.landed then 'SAGA_ROW_PENDING' when bad then 'STILL_POISON' else 'REPLAYED' end
        from one o join p on p.saga = o.saga and p.saga_type = o.saga_type and p.place = o.place + 1),
    l as (select saga, saga_type, bool_or(landed) as landed, bool_or(stopped) as stopped from one group by 1, 2),
    two as (select o.saga, o.saga_type, o.place, o.outcome, p.bad, o.outcome = 'SAGA_ROW_PENDING' and l.landed and not l.stopped as again from one o join p using (saga, saga_type, place) join l using (saga, saga_type))
    select p.saga, p.saga_type, p.global_offset, case when again and exists (select 1 from two x where x.saga = t.saga and x.saga_type = t.saga_type and x.place < t.place and x.again and x.bad) then 'SAGA_ROW_PENDING'
        when again and t.bad then 'STILL_POISON' when again then 'REPLAYED' else outcome end as outcome from two t join p using (saga, saga_type, place)""")
def saga_drain(spark, d):
    """Drains of all sagas, where every seventh event is poison and every third a start."""
    letters = A.saga_dead_letters(spark, d)
    at = letters.select("global_offset")
    return saga.drained(letters, A.saga_state(spark, d), at.where("global_offset % 7 = 0"), at.where("global_offset % 3 = 0")).select("saga", "saga_type", "global_offset", "outcome")


@query("id_functions", f"""select global_offset, 'user:' || aggregate_id as stream, aggregate_id as parsed, sha256(aggregate_id) as hash, 50.0 * pow(2, global_offset % 5) as backoff, case when length(event_type) > 5 then left(event_type, 5) || '...' else event_type end as safe from {A.LOG}""")
def id_functions(spark, d):
    rows = A.log_scan(spark, d)
    stream = stream_text(F.col("aggregate_type"), F.col("aggregate_id"))
    return rows.select(
        "global_offset", stream.alias("stream"), stream_parts(stream)[1].alias("parsed"), subject_hash(F.col("aggregate_id")).alias("hash"), backoff_ms(F.col("global_offset") % 5 + 1).alias("backoff"), log_safe(F.col("event_type"), 5).alias("safe")
    )


@query("backoff_waits", f"""with w as (select global_offset, (global_offset % 10) / 10e0 as j, cast(least(1000 * pow(2, global_offset % 9), 60000) as bigint) as poll_ms, 50 * pow(2, global_offset % 9) as wait from {A.LOG})
    select global_offset, poll_ms, poll_ms // 2 + least(cast(floor(j * (poll_ms - poll_ms // 2 + 1)) as bigint), poll_ms - poll_ms // 2) as poll_with_jitter, wait * (0.5e0 + j) as wait_with_jitter from w""")
def backoff_waits(spark, d):
    """Waits of polls and of retries for numbers that stand for random ones."""
    rows, n = A.log_scan(spark, d), F.col("global_offset") % 9 + 1
    jitter = (F.col("global_offset") % 10) / F.lit(10.0)
    return rows.select("global_offset", poll_backoff_ms(n).alias("poll_ms"), poll_backoff_ms(n, jitter=jitter).alias("poll_with_jitter"), backoff_ms(n, jitter=jitter).alias("wait_with_jitter"))


@query("command_outcomes", f"""with c as (select *, case when global_offset % 11 = 0 then 'FAILURE' when global_offset % 7 = 0 then 'VETOED' else 'SUCCESS' end as outcome from {A.LOG})
    select cast(global_offset as varchar) as command_id, outcome, case when outcome = 'FAILURE' then 'failed' end as error_message,
    case when outcome = 'SUCCESS' and global_offset % 5 <> 0 then cast(global_offset % 4 as int) else 0 end as event_count from c""")
def command_outcomes(spark, d):
    """Audit rows of commands: a failure counts before a veto, and only a success has events."""
    at = F.col("global_offset")
    rows = A.log_scan(spark, d).select(
        at.cast("string").alias("command_id"), F.when(at % 7 == 0, True).when(at % 2 == 0, False).alias("vetoed"), F.when(at % 11 == 0, "failed").alias("error"),
        F.when(at % 5 != 0, (at % 4).cast("int")).alias("n_events"),
    )
    return audit.command_rows(rows).select("command_id", "outcome", "error_message", "event_count")


@query("event_ids", "select event_id + 1 as global_offset, 'evt_' || lower(to_base(epoch_us(ts) // 1000 - 1704067200000, 36, 9)) as code from events")
def event_ids(spark, d):
    """Codes of event times in base 36, which sort by time."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return A.log_scan(spark, d).select("global_offset", F.concat(F.lit("evt_"), time_code(ms)).alias("code"))
