"""The driver's tables seen as the engine's tables. Each mapping exists twice, as a DataFrame and as a SQL subquery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What stands for now in every query on due times.
AS_OF = "1999-06-01 00:00:00"
#: The same for queries with bounds in the middle of the data, some rows of which lie on the bound.
MID = "1996-06-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log without versions, which would take a shuffle."""
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("global_offset"), F.lit("user").alias("aggregate_type"), F.col("user_id").cast("string").alias("aggregate_id"),
        "event_type", F.col("props").alias("payload"), "ts", "value", "event_id", "user_id",
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = Window.partitionBy("aggregate_id").orderBy("global_offset")
    return log_scan(spark, sf_dir).withColumn("version", F.row_number().over(place).cast("long"))


LOG = """(select event_id + 1 as global_offset, 'user' as aggregate_type, cast(user_id as varchar) as aggregate_id, event_type, props as payload, ts, value, event_id, user_id,
    row_number() over (partition by user_id order by event_id) as version from events)"""


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in disorder: events arrive up to 160 minutes late, and those of an hour of arrival are a batch."""
    due = F.col("ts") + F.make_dt_interval(mins=((F.col("event_id") * 7) % 17 * 10).cast("int"))
    return log_scan(spark, sf_dir).withColumn("batch", F.floor(F.unix_seconds(due.cast("timestamp")) / 3600))


ARRIVALS = f"""(select *, cast(floor(epoch(date_trunc('second', ts + to_minutes(cast((event_id * 7) % 17 * 10 as integer)))) / 3600) as bigint) as batch from {LOG})"""


def event_audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, local = F.col("event_id"), F.col("event_id") % 1000
    parent = n - local + F.floor((local - 1) / 3)
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("evt-"), n.cast("string")).alias("event_id"), "event_type", F.lit("user").alias("aggregate_type"), F.col("user_id").cast("string").alias("aggregate_id"),
        F.concat(F.lit("cmd-"), F.floor(n / 2).cast("string")).alias("command_id"), F.concat(F.lit("corr-"), F.floor(n / 100).cast("string")).alias("correlation_id"),
        F.when(local != 0, F.concat(F.lit("evt-"), parent.cast("string"))).alias("causation_id"), F.when(F.col("user_id") % 10 != 9, F.col("user_id").cast("string")).alias("user_id"), F.col("ts").alias("occurred_at"), n.alias("n"),
    )


EVENT_AUDIT = """(select 'evt-' || event_id as event_id, event_type, 'user' as aggregate_type, cast(user_id as varchar) as aggregate_id, 'cmd-' || (event_id // 2) as command_id,
    'corr-' || (event_id // 100) as correlation_id, case when event_id % 1000 <> 0 then 'evt-' || (event_id - event_id % 1000 + (event_id % 1000 - 1) // 3) end as causation_id,
    case when user_id % 10 <> 9 then cast(user_id as varchar) end as user_id, ts as occurred_at, event_id as n from events)"""


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    query, failed = F.col("event_type") == "view", F.col("event_type") == "error"
    outcome = F.when(failed, "FAILURE").when(F.col("event_id") % 13 == 0, "VETOED").otherwise("SUCCESS")
    return table(spark, sf_dir, "events").select(
        F.when(~query, F.concat(F.lit("cmd-"), F.col("event_id").cast("string"))).alias("command_id"), F.col("event_type").alias("command_type"), F.when(~query, "user").alias("aggregate_type"),
        F.when(~query, F.col("user_id").cast("string")).alias("aggregate_id"), F.when(F.col("user_id") % 10 != 9, F.col("user_id").cast("string")).alias("user_id"), F.col("ts").alias("occurred_at"),
        outcome.alias("outcome"), F.when(outcome == "SUCCESS", 1).otherwise(0).cast("long").alias("event_count"), F.col("event_id").alias("n"),
    )


AUDIT = """(select case when event_type <> 'view' then 'cmd-' || event_id end as command_id, event_type as command_type, case when event_type <> 'view' then 'user' end as aggregate_type,
    case when event_type <> 'view' then cast(user_id as varchar) end as aggregate_id, case when user_id % 10 <> 9 then cast(user_id as varchar) end as user_id, ts as occurred_at, o as outcome,
    cast(o = 'SUCCESS' as bigint) as event_count, event_id as n
    from (select *, case when event_type = 'error' then 'FAILURE' when event_id % 13 = 0 then 'VETOED' else 'SUCCESS' end as o from events))"""


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    failed = F.col("o_orderstatus") == "F"
    status = F.when(F.col("o_orderstatus") == "P", "PENDING").when(failed & (k % 9 == 0), "SKIPPED").when(failed, "FAILED").when(k % 7 == 0, "IN_PROGRESS").otherwise("DELIVERED")
    return table(spark, sf_dir, "orders").select(
        k.alias("seq"), F.concat(F.lit("entry-"), k.cast("string")).alias("entry_id"), F.lit("customer").alias("aggregate_type"), F.when(F.col("o_custkey") % 20 != 0, F.col("o_custkey").cast("string")).alias("aggregate_id"),
        status.alias("status"), (k % 6).alias("attempts"), F.when(k % 3 != 0, at).alias("next_retry_at"), at.alias("processed_at"), F.when(status == "IN_PROGRESS", F.concat(F.lit("relay-"), (k % 3).cast("string"))).alias("claimed_by"),
        F.when(status == "IN_PROGRESS", at).alias("claimed_at"), F.when(failed, "timeout").alias("last_error"), F.when(status == "SKIPPED", at + F.make_dt_interval(days=F.lit(10))).alias("skipped_at"),
        F.when(status == "SKIPPED", "ops").alias("skipped_by"), F.when(status == "SKIPPED", "old").alias("skip_reason"),
    )


OUTBOX = """(select *, case when status = 'IN_PROGRESS' then 'relay-' || (seq % 3) end as claimed_by, case when status = 'IN_PROGRESS' then processed_at end as claimed_at,
    case when status in ('FAILED', 'SKIPPED') then 'timeout' end as last_error, case when status = 'SKIPPED' then processed_at + interval 10 day end as skipped_at,
    case when status = 'SKIPPED' then 'ops' end as skipped_by, case when status = 'SKIPPED' then 'old' end as skip_reason
    from (select o_orderkey as seq, 'entry-' || o_orderkey as entry_id, 'customer' as aggregate_type, case when o_custkey % 20 <> 0 then cast(o_custkey as varchar) end as aggregate_id,
    case when o_orderstatus = 'P' then 'PENDING' when o_orderstatus = 'F' and o_orderkey % 9 = 0 then 'SKIPPED' when o_orderstatus = 'F' then 'FAILED' when o_orderkey % 7 = 0 then 'IN_PROGRESS' else 'DELIVERED' end as status,
    o_orderkey % 6 as attempts, case when o_orderkey % 3 <> 0 then o_orderdate end as next_retry_at, o_orderdate as processed_at from orders))"""


def saga_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k, at = F.substring("o_orderpriority", 1, 1), F.col("o_orderkey"), F.col("o_orderdate")
    status = F.when(p == "1", "STARTED").when(p == "2", "RUNNING").when(p == "3", "COMPENSATING").when(p == "4", "COMPLETED").otherwise("FAULTED")
    stamped = (status == "COMPENSATING") & (k % 2 == 0)
    return table(spark, sf_dir, "orders").select(
        F.when(k % 13 == 0, "refund").otherwise("order").alias("saga_type"), F.concat(F.lit("saga-"), k.cast("string")).alias("saga_id"), status.alias("status"), (k % 11).alias("version"), at.alias("created_at"),
        (at + F.make_dt_interval(days=(k % 30).cast("int"))).alias("updated_at"), k.alias("n"), (k % 8 == 0).alias("dead_letter_pending"), (k % 6 != 0).alias("genesis_applied"),
        F.when(status == "FAULTED", F.when(k % 3 == 0, "COMPENSATING").otherwise("RUNNING")).alias("pre_fault_status"), F.when(k % 4 != 0, k % 50).alias("last_applied_offset"), F.when(k % 10 == 0, k % 40).alias("last_replayed_offset"),
        F.when(stamped, k % 11).alias("episode_version"), F.when(stamped, at).alias("episode_claimed_at"), F.when(stamped & (k % 4 == 0), F.concat(F.lit("evt-"), k.cast("string"))).alias("episode_cause_event_id"),
    )


SAGAS = """(select *, case when status = 'FAULTED' then case when n % 3 = 0 then 'COMPENSATING' else 'RUNNING' end end as pre_fault_status, case when n % 4 <> 0 then n % 50 end as last_applied_offset,
    case when n % 10 = 0 then n % 40 end as last_replayed_offset, case when status = 'COMPENSATING' and n % 2 = 0 then n % 11 end as episode_version,
    case when status = 'COMPENSATING' and n % 2 = 0 then created_at end as episode_claimed_at, case when status = 'COMPENSATING' and n % 4 = 0 then 'evt-' || n end as episode_cause_event_id
    from (select case when o_orderkey % 13 = 0 then 'refund' else 'order' end as saga_type, 'saga-' || o_orderkey as saga_id, case left(o_orderpriority, 1) when '1' then 'STARTED' when '2' then 'RUNNING' when '3' then 'COMPENSATING'
    when '4' then 'COMPLETED' else 'FAULTED' end as status, o_orderkey % 11 as version, o_orderdate as created_at, o_orderdate + to_days(cast(o_orderkey % 30 as integer)) as updated_at, o_orderkey as n,
    o_orderkey % 8 = 0 as dead_letter_pending, o_orderkey % 6 <> 0 as genesis_applied from orders))"""


def saga_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order in five is a dead letter of the saga of the last order before it whose number is a multiple of twenty. Some name no saga, and some
    of these have a target; some name a saga that has no row, some are of another type; some have a named twin at their offset."""
    k = F.col("o_orderkey")
    owner = F.concat(F.when((k - k % 20) % 100 == 0, "lost-").otherwise("saga-"), (k - k % 20).cast("string"))
    kind = F.when(k % 35 == 0, "other").when((k - k % 20) % 13 == 0, "refund").otherwise("order")
    rows = table(spark, sf_dir, "orders").where(k % 5 == 0)
    one = rows.select(k.alias("global_offset"), F.when(k % 15 != 0, owner).alias("saga_id"), kind.alias("saga_type"), F.when(k % 30 == 0, owner).alias("target_saga_id"), F.col("o_orderdate").alias("first_faulted_at"))
    twin = rows.where(k % 45 == 0).select(k.alias("global_offset"), owner.alias("saga_id"), kind.alias("saga_type"), F.lit(None).cast("string").alias("target_saga_id"), F.col("o_orderdate").alias("first_faulted_at"))
    return one.unionByName(twin)


SAGA_DLQ = """(select k as global_offset, case when twin or k % 15 <> 0 then owner end as saga_id, case when k % 35 = 0 then 'other' when (k - k % 20) % 13 = 0 then 'refund' else 'order' end as saga_type,
    case when not twin and k % 30 = 0 then owner end as target_saga_id, first_faulted_at from (select o_orderkey as k, t.twin, o_orderdate as first_faulted_at,
    case when (o_orderkey - o_orderkey % 20) % 100 = 0 then 'lost-' else 'saga-' end || (o_orderkey - o_orderkey % 20) as owner from orders, (values (false), (true)) t(twin) where o_orderkey % 5 = 0 and (not t.twin or o_orderkey % 45 = 0)))"""


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F").select(
        k.alias("n"), F.when(k % 4 != 0, F.concat(F.lit("key-"), k.cast("string"))).alias("idempotency_key"), F.lit("Ship").alias("command_type"), F.lit("customer").alias("aggregate_type"), F.col("o_custkey").cast("string").alias("aggregate_id"),
        (k % 7).alias("attempts"), (at - F.make_dt_interval(days=(k % 10).cast("int"))).alias("first_attempt_at"), at.alias("published_at"), F.when(k % 2 == 0, at + F.make_dt_interval(days=F.lit(1))).alias("last_attempt_at"),
    )


DLQ = """(select o_orderkey as n, case when o_orderkey % 4 <> 0 then 'key-' || o_orderkey end as idempotency_key, 'Ship' as command_type, 'customer' as aggregate_type, cast(o_custkey as varchar) as aggregate_id,
    o_orderkey % 7 as attempts, o_orderdate - to_days(cast(o_orderkey % 10 as integer)) as first_attempt_at, o_orderdate as published_at, case when o_orderkey % 2 = 0 then o_orderdate + interval 1 day end as last_attempt_at
    from orders where o_orderstatus = 'F')"""


def order_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with their customers as a read model; status and segment are missing for some."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    k = F.col("o_orderkey")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        k.cast("string").alias("id"), F.col("c_name").alias("customer"), F.when(k % 9 != 0, F.col("c_mktsegment")).alias("segment"), F.when(k % 11 != 0, F.col("o_orderstatus")).alias("status"),
        F.col("o_totalprice").cast("decimal(15,2)").alias("total"), F.col("o_totalprice").cast("decimal(15,2)").cast("string").alias("total_text"), (k % 4).alias("version"), F.col("o_orderdate").alias("updated_at"),
    )


VIEW = """(select cast(o_orderkey as varchar) as id, c_name as customer, case when o_orderkey % 9 <> 0 then c_mktsegment end as segment, case when o_orderkey % 11 <> 0 then o_orderstatus end as status,
    cast(o_totalprice as decimal(15,2)) as total, cast(cast(o_totalprice as decimal(15,2)) as varchar) as total_text, o_orderkey % 4 as version, o_orderdate as updated_at from orders join customer on o_custkey = c_custkey)"""
