"""Audit queries: totals and counts for compliance, filtered pages, and the closure of causes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def between(since: str | None, until: str | None, at: str = "occurred_at") -> Column:
    """Both ends belong to the range."""
    out = F.lit(True)
    if since is not None:
        out &= F.col(at) >= F.lit(since).cast("timestamp_ntz")
    if until is not None:
        out &= F.col(at) <= F.lit(until).cast("timestamp_ntz")
    return out


def totals(audit: DataFrame, since: str, until: str, user: str | None = None) -> DataFrame:
    """n_commands (rows with an aggregate), n_queries (without) and n_failures of a range, of one user or of all."""
    rows = audit.where(between(since, until))
    if user is not None:
        rows = rows.where(F.col("user_id") == user)
    return rows.agg(
        F.count_if(F.col("aggregate_id").isNotNull()).alias("n_commands"), F.count_if(F.col("aggregate_id").isNull()).alias("n_queries"), F.count_if(F.col("outcome") == "FAILURE").alias("n_failures")
    )


def by_type(audit: DataFrame, since: str, until: str, queries: bool = False, user: str | None = None) -> DataFrame:
    kind = F.col("aggregate_id").isNull() if queries else F.col("aggregate_id").isNotNull()
    if user is not None:
        kind &= F.col("user_id") == user
    return audit.where(between(since, until) & kind).groupBy("command_type").agg(F.count("*").alias("n"))


def activity(audit: DataFrame, since: str, until: str) -> DataFrame:
    return audit.where(between(since, until) & F.col("user_id").isNotNull()).groupBy("user_id").agg(F.count("*").alias("n"))


def page(rows: DataFrame, where: Column, number: int, size: int, tie: str) -> DataFrame:
    """A page by time; the caller's order is not asked for, ties go by `tie`."""
    return rows.where(where).orderBy("occurred_at", tie).offset(number * size).limit(size)


def last_of_command(audit: DataFrame, command: str) -> DataFrame:
    return audit.where(F.col("command_id") == command).orderBy(F.desc("occurred_at")).limit(1)


def event_audit(log: DataFrame) -> DataFrame:
    """The event audit rows that a log of envelopes gives."""
    m = F.col("metadata")
    return log.select(
        m["event_id"].alias("event_id"), "event_type", "aggregate_type", "aggregate_id", "version", m["command_id"].alias("command_id"), m["correlation_id"].alias("correlation_id"),
        m["causation_id"].alias("causation_id"), m["user_id"].alias("user_id"), m["timestamp"].alias("occurred_at"),
    )


def command_rows(outcomes: DataFrame) -> DataFrame:
    """Audit rows of commands (command_id, command_type, stream columns, user_id, occurred_at, vetoed, error, n_events) and of audited
    queries, which have no command id and no aggregate: SUCCESS with the events' number, VETOED or FAILURE with none."""
    outcome = F.when(F.col("error").isNotNull(), "FAILURE").when(F.coalesce("vetoed", F.lit(False)), "VETOED").otherwise("SUCCESS")
    return outcomes.withColumn("outcome", outcome).withColumn("event_count", F.when(F.col("outcome") == "SUCCESS", F.coalesce("n_events", F.lit(0))).otherwise(0)).withColumnRenamed("error", "error_message").drop("vetoed", "n_events")


def causation_closure(events: DataFrame, root: str, most_hops: int | None = None) -> DataFrame:
    """All events that the root caused, directly or not, and the root itself. A hop is a join of the frontier with events whose
    cause it is; what was seen before is left out, so cycles end. Each hop is cut off by a checkpoint."""
    spark = events.sparkSession
    _checkpointed(spark)
    frontier = events.where(F.col("event_id") == root).checkpoint()
    seen = frontier
    hops = 0
    while not frontier.isEmpty() and (most_hops is None or hops < most_hops):
        cause = frontier.select(F.col("event_id").alias("_cause")).distinct()
        step = events.join(cause, F.col("causation_id") == F.col("_cause"), "left_semi").join(seen.select("event_id"), "event_id", "left_anti")
        frontier = step.select(*events.columns).checkpoint()
        seen = seen.unionByName(frontier)
        hops += 1
    return seen


def _checkpointed(spark) -> None:
    """Sets a folder for checkpoints where none is named, as in tests; a cluster without one is an error."""
    import tempfile

    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="logweir-checkpoint-"))
