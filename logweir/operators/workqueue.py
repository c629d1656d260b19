"""Set queries over work queues: claims of an outbox, sagas that are due, dead letters, gauges and retention.

`as_of` stands for the clock in every query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AVAILABILITY_FIRST, STRICT_PER_AGGREGATE = "AVAILABILITY_FIRST", "STRICT_PER_AGGREGATE"
TERMINAL = ("COMPLETED", "COMPENSATED", "FAILED")
STREAM = ("aggregate_type", "aggregate_id")


def _now(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def due(as_of: str, at: str = "next_retry_at") -> Column:
    return F.col(at).isNull() | (F.col(at) <= _now(as_of))


def claimable(outbox: DataFrame, as_of: str, most: int, mode: str = AVAILABILITY_FIRST) -> DataFrame:
    """Entries to claim, in the order of seq: due entries without a stream, and of each stream without an entry in progress the
    first pending one if it is due. Under STRICT_PER_AGGREGATE a failed entry ahead of it blocks its stream."""
    ahead = ("PENDING",) if mode == AVAILABILITY_FIRST else ("PENDING", "FAILED")
    free = outbox.where((F.col("status") == "PENDING") & F.col("aggregate_id").isNull() & due(as_of))
    inside = outbox.where(F.col("aggregate_id").isNotNull())
    # the head of a stream by an aggregate that is combined before the shuffle; busy streams fall out in the same pass
    columns = [c for c in outbox.columns if c not in STREAM]
    open_ = F.col("status").isin(*ahead)
    heads = inside.where(F.col("status").isin("IN_PROGRESS", *ahead)).groupBy(*STREAM).agg(
        F.min_by(F.when(open_, F.struct(*columns)), F.when(open_, F.col("seq"))).alias("_h"), F.max((F.col("status") == "IN_PROGRESS").cast("int")).alias("_busy")
    )
    heads = heads.where("_busy = 0 and _h is not null").select(*STREAM, "_h.*").where((F.col("status") == "PENDING") & due(as_of))
    top = lambda rows: rows.select(*outbox.columns).orderBy("seq").limit(most)
    return top(top(free).unionByName(top(heads)))


def claimed(outbox: DataFrame, claims: DataFrame, claimer: str) -> DataFrame:
    """The outbox after a claim."""
    mine = claims.select("seq", F.lit(claimer).alias("_by"))
    rows = outbox.join(mine, "seq", "left")
    return rows.withColumn("status", F.when(F.col("_by").isNotNull(), "IN_PROGRESS").otherwise(F.col("status"))).withColumn("claimed_by", F.coalesce("_by", F.col("claimed_by")) if "claimed_by" in outbox.columns else F.col("_by")).drop("_by")


#: What a transition turns a status into, and the status that it starts from.
TRANSITIONS = {
    "deliver": ("IN_PROGRESS", "DELIVERED"), "fail": ("IN_PROGRESS", "FAILED"), "retry": ("IN_PROGRESS", "PENDING"), "release": ("IN_PROGRESS", "PENDING"),
    "skip": ("FAILED", "SKIPPED"), "reset": ("FAILED", "PENDING"),
}


def transition(outbox: DataFrame, asked: DataFrame, kind: str, claimer: str | None = None, as_of: str | None = None, backoff_s: float = 0) -> DataFrame:
    """The outbox after a transition of the asked entries; one applies only from its status and, in progress, by its claimer.

    asked has seq and, for fail and retry, the attempts made and the error; for skip by and reason. A delivery counts an attempt;
    deliver and fail stamp processed_at and keep the claim's name; retry and release give the claim back, release without a trace of
    an attempt; skip stamps its own columns only; reset starts anew. Columns that the outbox does not have are left out.
    """
    source, target = TRANSITIONS[kind]
    given = {c: f"_{c}" for c in ("attempts", "error", "by", "reason") if c in asked.columns}
    rows = outbox.join(asked.select("seq", *(F.col(c).alias(n) for c, n in given.items()), F.lit(True).alias("_asked")).dropDuplicates(["seq"]), "seq", "left")
    ok = F.coalesce(F.col("_asked"), F.lit(False)) & (F.col("status") == source)
    if source == "IN_PROGRESS":
        ok &= F.coalesce(F.col("claimed_by") == claimer, F.lit(False))
    rows = rows.withColumn("_ok", ok)
    of = lambda c, other=None: F.col(given[c]) if c in given else F.lit(other) if not isinstance(other, Column) else other
    now, none = _now(as_of) if as_of else F.lit(None), F.lit(None)
    unclaimed = {"claimed_by": none, "claimed_at": none}
    changes = {"status": F.lit(target)} | {
        "deliver": {"attempts": F.col("attempts") + 1, "processed_at": now},
        "fail": {"attempts": of("attempts", F.col("attempts")), "last_error": of("error"), "processed_at": now},
        "retry": unclaimed | {"attempts": of("attempts", F.col("attempts")), "last_error": of("error"), "next_retry_at": now + F.expr(f"make_dt_interval(0, 0, 0, {backoff_s:.3f})") if as_of else none},
        "release": unclaimed,
        "skip": {"skipped_at": now, "skipped_by": of("by"), "skip_reason": of("reason")},
        "reset": unclaimed | {"attempts": F.lit(0), "last_error": none, "next_retry_at": none},
    }[kind]
    new = {c: F.when(F.col("_ok"), changes[c].cast(outbox.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c in changes if c in outbox.columns}
    return rows.select(*(new.get(c, F.col(c)) for c in outbox.columns))


def insert(outbox: DataFrame, entries: DataFrame) -> DataFrame:
    """The outbox with new entries; an entry_id that it has, or that comes twice, counts once."""
    fresh = entries.dropDuplicates(["entry_id"]).join(outbox.select("entry_id"), "entry_id", "left_anti")
    return outbox.unionByName(fresh.select(*outbox.columns))


def reclaimed(outbox: DataFrame, as_of: str, claimed_at: str, lease_s: float) -> DataFrame:
    """Entries in progress whose claim is older than the lease are pending again, without a claim."""
    old = F.coalesce((F.col("status") == "IN_PROGRESS") & (F.col(claimed_at) < _now(as_of) - F.expr(f"make_dt_interval(0, 0, 0, {lease_s:.3f})")), F.lit(False))
    new = {"status": F.when(old, "PENDING").otherwise(F.col("status")), "claimed_by": F.when(~old, F.col("claimed_by")), claimed_at: F.when(~old, F.col(claimed_at))}
    return outbox.select(*(new.get(c, F.col(c)).alias(c) for c in outbox.columns))


def newest_letters(letters: DataFrame, most: int) -> DataFrame:
    return letters.orderBy(F.desc("published_at"), F.desc("n")).limit(most)


def letters_of_key(letters: DataFrame, key: str) -> DataFrame:
    return letters.where(F.col("idempotency_key") == key).orderBy("published_at", "n")


def blockage(outbox: DataFrame) -> DataFrame:
    """n_streams blocked by failed entries, the oldest failure, and n_free failed entries without a stream."""
    key = F.when(F.col("aggregate_id").isNotNull(), F.struct(*STREAM))
    failed = outbox.where("status = 'FAILED'")
    return failed.agg(F.count_distinct(key).alias("n_streams"), F.min("processed_at").alias("oldest"), F.count_if(F.col("aggregate_id").isNull()).alias("n_free"))


def counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def by_status(outbox: DataFrame, status: str, most: int) -> DataFrame:
    return outbox.where(F.col("status") == status).orderBy("seq").limit(most)


def retained(rows: DataFrame, old: Column, before: str, at: str) -> DataFrame:
    """What retention leaves: all but rows for which `old` holds and whose time is before the bound."""
    return rows.where(~F.coalesce(old & (F.col(at) < _now(before)), F.lit(False)))


def outbox_retained(outbox: DataFrame, before: str) -> DataFrame:
    """What retention leaves of an outbox: delivered entries go by processed_at, skipped ones by skipped_at, failed ones never."""
    old = ((F.col("status") == "DELIVERED") & (F.col("processed_at") < _now(before))) | ((F.col("status") == "SKIPPED") & (F.col("skipped_at") < _now(before)))
    return outbox.where(~F.coalesce(old, F.lit(False)))


def _of_type(sagas: DataFrame, kind: str | None) -> DataFrame:
    return sagas if kind is None else sagas.where(F.col("saga_type") == kind)


def timed_out(sagas: DataFrame, as_of: str, timeout_days: int, most: int, kind: str | None = None) -> DataFrame:
    """Sagas of a type that are forward and were started, or are compensating and were last changed, before the timeout (not at it), taken
    in turns, forward first. A population of fewer rows leaves its places to the other."""
    bound = _now(as_of) - F.expr(f"make_dt_interval({timeout_days})")

    def turn(rows: DataFrame, at: str, who: int) -> DataFrame:
        rows = rows.where(F.col(at) < bound).orderBy(at, "saga_id").limit(most)
        return rows.withColumn("slot", F.row_number().over(Window.orderBy(at, "saga_id")).cast("long")).withColumn("population", F.lit(who))  # over a page

    forward = turn(_of_type(sagas, kind).where(F.col("status").isin("STARTED", "RUNNING")), "created_at", 0)
    back = turn(_of_type(sagas, kind).where("status = 'COMPENSATING'"), "updated_at", 1)
    return forward.unionByName(back).orderBy("slot", "population").limit(most)


def overdue(sagas: DataFrame, as_of: str, timeout_days: int, kind: str | None = None) -> DataFrame:
    """All that timed_out() takes its page from, in no order, forward ones with `population` 0 and compensating ones with 1."""
    bound = _now(as_of) - F.expr(f"make_dt_interval({timeout_days})")
    forward, back = F.col("status").isin("STARTED", "RUNNING") & (F.col("created_at") < bound), (F.col("status") == "COMPENSATING") & (F.col("updated_at") < bound)
    return _of_type(sagas, kind).where(forward | back).withColumn("population", F.when(F.col("status") == "COMPENSATING", 1).otherwise(0))


def compensating(sagas: DataFrame, as_of: str, idle_days: int, most: int, kind: str | None = None) -> DataFrame:
    """Compensating sagas of a type that were last changed before the bound, idle longest first."""
    bound = _now(as_of) - F.expr(f"make_dt_interval({idle_days})")
    return _of_type(sagas, kind).where((F.col("status") == "COMPENSATING") & (F.col("updated_at") < bound)).orderBy("updated_at", "saga_id").limit(most)


def sagas_by_status(sagas: DataFrame, kind: str, status: str, most: int) -> DataFrame:
    """Sagas of a type in a status, those changed last first."""
    return _of_type(sagas, kind).where(F.col("status") == status).orderBy(F.desc("updated_at"), "saga_id").limit(most)


def _protected(letters: DataFrame, sagas: DataFrame) -> DataFrame:
    """letters (saga_id, saga_type, target_saga_id, ...) with why retention spares them: `shielded`, the saga of that name and type is faulted
    or has letters pending; `resolved`, a letter without a saga whose target is known; `rowless`, no saga of that name and type."""
    owners = sagas.select(F.col("saga_id").alias("_s"), F.col("saga_type").alias("_t"), ((F.col("status") == "FAULTED") | F.col("dead_letter_pending")).alias("_held"))
    rows = letters.join(owners, (letters["saga_id"] == owners["_s"]) & (letters["saga_type"] == owners["_t"]), "left")
    return rows.select(
        *letters.columns, F.coalesce("_held", F.lit(False)).alias("shielded"), (F.col("saga_id").isNull() & F.col("target_saga_id").isNotNull()).alias("resolved"),
        (F.col("saga_id").isNotNull() & F.col("_s").isNull()).alias("rowless"),
    )


def saga_backlog(letters: DataFrame, sagas: DataFrame) -> DataFrame:
    """How many letters retention spares, of any age, and how many for each of the three reasons."""
    rows = _protected(letters, sagas)
    return rows.agg(F.count_if(F.expr("shielded or resolved or rowless")).alias("n"), *(F.count_if(c).alias(f"n_{c}") for c in ("shielded", "resolved", "rowless")))


def saga_letters_retained(letters: DataFrame, sagas: DataFrame, before: str) -> DataFrame:
    """What retention leaves of saga dead letters: those that first faulted at the bound or later, and those that are protected."""
    rows = _protected(letters, sagas).where((F.col("first_faulted_at") >= _now(before)) | F.expr("shielded or resolved or rowless"))
    return rows.select(*letters.columns)


def republished(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Saga dead letters after new ones for named sagas: a letter of the same saga and offset is refreshed, but the first fault, the first
    replay and the target stay as they are."""
    key, kept = ["saga_id", "global_offset"], ["first_faulted_at", "first_replay_started_at", "target_saga_id"]
    old = stored.select(*key, F.lit(True).alias("_old"), *(F.col(c).alias(f"_{c}") for c in kept))
    fresh = new.dropDuplicates(key).join(old, key, "left")
    fresh = fresh.select(*(F.when(F.col("_old"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in kept else F.col(c) for c in stored.columns))
    return stored.join(new.select(*key).distinct(), key, "left_anti").unionByName(fresh)


def retryable(letters: DataFrame, as_of: str, most: int, attempts: int = 5, unkeyed: bool = False, received_since: str | None = None, initial_s: float = 30, factor: float = 2.0) -> DataFrame:
    """Dead letters due for a retry, those without activity longest first: with attempts left, keyed ones unless unkeyed ones may be
    replayed too, keyed ones only if their command was first received in the window in which its key is remembered, and past their
    backoff."""
    since = F.coalesce("last_attempt_at", "published_at")
    wait = F.lit(initial_s) * F.pow(F.lit(factor), F.col("attempts").cast("double"))
    ready = since + F.make_dt_interval(secs=wait.cast("decimal(18,6)")) <= _now(as_of)
    key = F.col("idempotency_key")
    fit = (F.col("attempts") < attempts) & (F.lit(unkeyed) | key.isNotNull())
    if received_since is not None:
        fit &= key.isNull() | (F.col("first_attempt_at") >= _now(received_since))
    return letters.where(fit & ready).orderBy(since, "n").limit(most)


def awaiting_operator(letters: DataFrame, attempts: int = 5, unkeyed: bool = True, received_before: str | None = None) -> DataFrame:
    """How many dead letters with attempts left no schedule replays: unkeyed ones, if they count, and keyed ones whose command was first
    received before the window in which its key is remembered."""
    key = F.col("idempotency_key")
    waits = F.lit(unkeyed) & key.isNull()
    if received_before is not None:
        waits |= key.isNotNull() & (F.col("first_attempt_at") < _now(received_before))
    return letters.where((F.col("attempts") < attempts) & waits).agg(F.count("*").alias("n"))


def published(queue: DataFrame, new: DataFrame) -> DataFrame:
    """Command dead letters after new ones: a keyed command that is stored under its key already, for its type and stream, stores nothing."""
    key = ["idempotency_key", "command_type", "aggregate_type", "aggregate_id"]
    there = queue.where("idempotency_key is not null").select(*(F.col(c).alias(f"_{c}") for c in key)).distinct()
    keyed = new.where("idempotency_key is not null").dropDuplicates(key)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) if c.startswith("aggregate") else F.col(c) == F.col(f"_{c}") for c in key]
    return queue.unionByName(new.where("idempotency_key is null")).unionByName(keyed.join(there, same, "left_anti"))


def merge_dead_ranges(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Projection dead letters after an upsert: attempts are the larger of one more than before and those given."""
    key = ["projection", "from_offset", "to_offset"]
    old = stored.select(*key, F.col("attempts").alias("_old"))
    merged = new.join(old, key, "left").withColumn("attempts", F.when(F.col("_old").isNull(), F.col("attempts")).otherwise(F.greatest(F.col("_old") + 1, F.col("attempts")))).drop("_old")
    return stored.join(new.select(*key), key, "left_anti").unionByName(merged.select(*stored.columns))
