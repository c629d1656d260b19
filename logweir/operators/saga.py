"""Sagas as folds: the algebra of statuses, the step rules, and replay of their dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fold import fold_reduce

# Statuses, and those that end a saga. FAULTED holds a saga until an operator resolves it.
STATUSES = ("STARTED", "RUNNING", "COMPLETED", "COMPENSATING", "COMPENSATED", "FAILED", "FAULTED")
TERMINAL = ("COMPLETED", "COMPENSATED", "FAILED")


def step(acc: Column, event: Column, starts: str, completes: str, fails: str) -> Column:
    """The next state (status, n_steps, last_offset): nothing before a start event, at or below the last offset, or after the end;
    a failing event turns to compensation, and a completing one ends it."""
    kind, status = event["event_type"], acc["status"]
    next_ = (
        F.when(status.isNull(), F.when(kind == starts, "STARTED"))
        .when((kind == completes) & (status == "COMPENSATING"), "COMPENSATED")
        .when(kind == completes, "COMPLETED")
        .when(kind == fails, "COMPENSATING")
        .when(status == "STARTED", "RUNNING")
        .otherwise(status)
    )
    stale = F.coalesce(status.isin(*TERMINAL, "FAULTED"), F.lit(False)) | (event["global_offset"] <= acc["last_offset"])
    moved = ~stale & next_.isNotNull()
    return F.struct(
        F.when(moved, next_).otherwise(status).alias("status"), (acc["n_steps"] + moved.cast("long")).alias("n_steps"), F.when(moved, event["global_offset"]).otherwise(acc["last_offset"]).alias("last_offset")
    )


def saga_states(log: DataFrame, starts: str, completes: str, fails: str) -> DataFrame:
    """The state of each stream's saga; streams without a start event have none."""
    none = F.struct(F.lit(None).cast("string").alias("status"), F.lit(0).cast("long").alias("n_steps"), F.lit(-1).cast("long").alias("last_offset"))
    rows = fold_reduce(log, ("event_type", "global_offset"), none, lambda a, e: step(a, e, starts, completes, fails))
    return rows.select("aggregate_type", "aggregate_id", "state.*").where("status is not null")


def apply_steps(sagas: DataFrame, steps: DataFrame, as_of: str | None = None) -> DataFrame:
    """Sagas after applied events. steps: saga_id, saga_type, version, status, offset, and if they are known start and replay (booleans) and
    event_id. A step counts if the saga of that name and type is not over and has that version. It adds one to the version, ends a fault,
    keeps the largest offset as the last applied one and a replay's offset as the last replayed; a step into COMPENSATING stamps the
    episode (version, time, cause) unless one is stamped. Columns that sagas does not have are left out."""
    given = {c: f"_{c}" for c in ("saga_type", "version", "status", "offset", "start", "replay", "event_id") if c in steps.columns}
    rows = sagas.join(steps.select("saga_id", *(F.col(c).alias(n) for c, n in given.items())), "saga_id", "left")
    ok = ~F.col("status").isin(*TERMINAL) & (F.col("version") == F.col("_version"))
    if "saga_type" in given:
        ok &= F.col("saga_type") == F.col("_saga_type")
    ok, flag = F.coalesce(ok, F.lit(False)), lambda c: F.coalesce(F.col(given[c]), F.lit(False)) if c in given else F.lit(False)
    now = F.lit(as_of).cast("timestamp_ntz")
    stamps = (F.col("_status") == "COMPENSATING") & (F.col("episode_version").isNull() if "episode_version" in sagas.columns else F.lit(False))
    changes = {
        "status": F.col("_status"), "version": F.col("version") + 1, "updated_at": now, "pre_fault_status": F.lit(None),
        "genesis_applied": F.expr("genesis_applied") | flag("start") if "genesis_applied" in sagas.columns else None,
        "last_applied_offset": F.greatest(F.coalesce("last_applied_offset", F.lit(-1)), "_offset") if "last_applied_offset" in sagas.columns else None,
        "last_replayed_offset": F.when(flag("replay"), F.col("_offset")).otherwise(F.col("last_replayed_offset")) if "last_replayed_offset" in sagas.columns else None,
        "episode_version": F.when(stamps, F.col("version") + 1).otherwise(F.col("episode_version")) if "episode_version" in sagas.columns else None,
        "episode_claimed_at": F.when(stamps, now).otherwise(F.col("episode_claimed_at")) if "episode_claimed_at" in sagas.columns else None,
        "episode_cause_event_id": F.when(stamps, F.col(given["event_id"]) if "event_id" in given else F.lit(None)).otherwise(F.col("episode_cause_event_id")) if "episode_cause_event_id" in sagas.columns else None,
    }
    new = {c: F.when(ok, v.cast(sagas.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c, v in changes.items() if c in sagas.columns}
    return rows.select(*(new.get(c, F.col(c)) for c in sagas.columns))


def mark_faulted(sagas: DataFrame, asked: DataFrame, as_of: str | None = None) -> DataFrame:
    """Sagas after faults (saga_id, saga_type, version): one counts if the saga of that name and type is not over and has that version, which
    goes up. The status before the fault is kept: that of the first fault when it was faulted already, and none while the start is not
    applied, unless it was compensating."""
    ask = asked.select(F.col("saga_id"), F.col("saga_type").alias("_type"), F.col("version").alias("_version")).distinct()
    rows = sagas.join(ask, "saga_id", "left")
    ok = F.coalesce(~F.col("status").isin(*TERMINAL) & (F.col("version") == F.col("_version")) & (F.col("saga_type") == F.col("_type")), F.lit(False))
    begun = F.col("genesis_applied") if "genesis_applied" in sagas.columns else F.lit(True)
    before = F.when(F.col("status") == "FAULTED", F.col("pre_fault_status")).when(~begun & (F.col("status") != "COMPENSATING"), None).otherwise(F.col("status"))
    changes = {"pre_fault_status": before, "status": F.lit("FAULTED"), "version": F.col("version") + 1, "updated_at": F.lit(as_of).cast("timestamp_ntz")}
    new = {c: F.when(ok, v.cast(sagas.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c, v in changes.items() if c in sagas.columns}
    return rows.select(*(new.get(c, F.col(c)) for c in sagas.columns))


def step_keys(steps: DataFrame) -> DataFrame:
    """Commands of steps (saga_id, offset, commands) with an idempotency key from saga, offset and place."""
    rows = steps.select("saga_id", "offset", F.posexplode("commands").alias("place", "command"))
    return rows.withColumn("idempotency_key", F.concat_ws("|", "saga_id", F.col("offset").cast("string"), F.col("place").cast("string")))


def drain_plan(letters: DataFrame, saga: str | None = None, kind: str | None = None) -> DataFrame:
    """(saga, saga_type, global_offset, resolved, shadows) of what a drain feeds, of one saga or of all, `place` being its turn: the saga's own
    letters and those without a saga that were resolved to it, in the order of offsets. Of a named and a resolved one of an offset
    the named one counts, and shadows the other; of several resolved ones the one that faulted last."""
    own = letters.where("saga_id is not null").select(F.col("saga_id").alias("saga"), "saga_type", "global_offset", F.lit(0).alias("rank"))
    lone = letters.where("saga_id is null and target_saga_id is not null").select(F.col("target_saga_id").alias("saga"), "saga_type", "global_offset", F.lit(1).alias("rank")).distinct()
    rows = own.unionByName(lone)
    if saga is not None:
        rows = rows.where(F.col("saga") == saga)
    if kind is not None:
        rows = rows.where(F.col("saga_type") == kind)
    items = rows.groupBy("saga", "saga_type", "global_offset").agg((F.min("rank") == 1).alias("resolved"), (F.count_distinct("rank") == 2).alias("shadows"))
    turn = Window.partitionBy("saga", "saga_type").orderBy("global_offset")
    return items.withColumn("place", F.row_number().over(turn).cast("long"))


def drained(letters: DataFrame, sagas: DataFrame, poison: DataFrame, starts: DataFrame) -> DataFrame:
    """drain_plan with the outcome of each turn: a letter of a saga that is over is moot, and counts as REPLAYED; one that is no start
    waits (SAGA_ROW_PENDING) while its saga has no row or no applied start, unless it was compensating, until a start before it in the
    drain was fed, after which it gets a second turn; a poison (global_offset) is STILL_POISON and stops the drain, and what is
    behind it is NOT_TRIED. starts has the offsets of start events."""
    plan = drain_plan(letters)
    state = sagas.select(
        F.col("saga_id").alias("saga"), "saga_type", F.col("status").isin(*TERMINAL).alias("over"), (F.col("genesis_applied") | (F.coalesce("pre_fault_status", "status") == "COMPENSATING")).alias("begun")
    )
    rows = plan.join(state, ["saga", "saga_type"], "left").join(poison.select("global_offset", F.lit(True).alias("_bad")).distinct(), "global_offset", "left")
    rows = rows.join(starts.select("global_offset", F.lit(True).alias("_start")).distinct(), "global_offset", "left").na.fill(False, ["over", "begun", "_bad", "_start"])
    turn = Window.partitionBy("saga", "saga_type").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("saga", "saga_type")
    # what is tried in the first turns: poison stops them if it is fed, which a deferred letter is not
    landed = F.coalesce(F.max(F.when(F.col("_start") & ~F.col("_bad"), 1)).over(turn), F.lit(0)) == 1
    rows = rows.withColumn("waits", ~F.col("over") & ~F.col("begun") & ~F.col("_start") & ~landed)
    rows = rows.withColumn("stops", F.col("_bad") & ~F.col("over") & ~F.col("waits"))
    rows = rows.withColumn("behind", F.coalesce(F.max(F.col("stops").cast("int")).over(turn), F.lit(0)) == 1)
    rows = rows.withColumn("halted", F.max(F.col("stops").cast("int")).over(whole) == 1).withColumn("begins", F.max((F.col("_start") & ~F.col("_bad") & ~F.col("behind")).cast("int")).over(whole) == 1)
    # the second turns, of what waited, in order
    rows = rows.withColumn("again", F.col("waits") & ~F.col("behind") & F.col("begins") & ~F.col("halted"))
    bad_before = F.coalesce(F.max((F.col("again") & F.col("_bad")).cast("int")).over(turn), F.lit(0)) == 1
    outcome = (
        F.when(F.col("behind"), "NOT_TRIED").when(F.col("stops"), "STILL_POISON").when(~F.col("waits"), "REPLAYED")
        .when(~F.col("again") | bad_before, "SAGA_ROW_PENDING").when(F.col("_bad"), "STILL_POISON").otherwise("REPLAYED")
    )
    return rows.select("saga", "saga_type", "global_offset", "resolved", "shadows", "place", outcome.alias("outcome"))
