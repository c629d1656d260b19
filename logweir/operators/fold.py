"""Left folds of streams into states, snapshots, and loads from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STREAM = ("aggregate_type", "aggregate_id")


def fold_columns(log: DataFrame, folds: dict[str, Column], keys: tuple[str, ...] = STREAM) -> DataFrame:
    """States that aggregates express: partial states are combined before the shuffle."""
    return log.groupBy(*keys).agg(*(c.alias(n) for n, c in folds.items()))


def fold_reduce(log: DataFrame, fields: tuple[str, ...], initial: Column, step: Callable[[Column, Column], Column], order: str = "version", keys: tuple[str, ...] = STREAM) -> DataFrame:
    """A state for each stream by a column function step(state, event) in the order of versions. A stream's events meet in one row, so
    this is for streams, or tails after a snapshot, that fit in memory; fold_python takes streams of any length."""
    rows = log.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("_events"))
    return rows.select(*keys, F.aggregate("_events", initial, step).alias("state"))


def fold_python(log: DataFrame, evolve: Callable[[dict, dict], dict], initial: Callable[[], dict], schema: str, order: str = "version", keys: tuple[str, ...] = STREAM) -> DataFrame:
    """The same with a Python function over dictionaries; schema names the keys and the fields of the state. Streams are sorted by a
    sort that spills and read batch by batch with one state in hand, so a stream of any length takes no more memory than a batch."""
    import pandas as pd

    columns = list(log.columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for batch in batches:
            done = []
            for event in batch.to_dict("records"):
                key = tuple(event[k] for k in keys)
                if key != at:
                    if at is not None:
                        done.append({**dict(zip(keys, at)), **state})
                    at, state = key, initial()
                state = evolve(state, event)
            if done:
                yield pd.DataFrame(done)
        if at is not None:
            yield pd.DataFrame([{**dict(zip(keys, at)), **state}])

    return log.repartition(*keys).sortWithinPartitions(*keys, order).select(*columns).mapInPandas(run, schema)


def as_of(log: DataFrame, ts: str | None = None, version: int | None = None, offset: int | None = None) -> DataFrame:
    """The log up to an instant, a version or an offset, all inclusive."""
    for bound, column in ((ts, "ts"), (version, "version"), (offset, "global_offset")):
        if bound is not None:
            log = log.where(F.col(column) <= (F.lit(bound).cast("timestamp_ntz") if column == "ts" else F.lit(bound)))
    return log


def snapshot_points(log: DataFrame, every: int) -> DataFrame:
    """The events after which a stream gets a snapshot: every n versions."""
    if every < 1:
        raise ValueError("a snapshot needs at least one event")
    return log.where(F.col("version") % every == 0)


def save_snapshots(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Snapshots after an upsert: one counts only if the purge generation that it was made under is still the stored one."""
    at = stored.select(*(F.col(k).alias(f"_{k}") for k in STREAM), F.col("purge_generation").alias("_g"))
    joined = new.join(at, [new[k] == at[f"_{k}"] for k in STREAM], "left")
    fit = joined.where(F.col("_g").isNull() | (F.col("_g") == F.col("purge_generation"))).select(*new.columns)
    return stored.join(fit.select(*STREAM), list(STREAM), "left_anti").unionByName(fit.select(*stored.columns))


def purge_snapshots(stored: DataFrame, streams: DataFrame) -> DataFrame:
    """Snapshots of the given streams lose their state, and their generation goes up, so that none made before is saved."""
    hit = streams.select(*STREAM, F.lit(True).alias("_hit")).distinct()
    rows = stored.join(hit, list(STREAM), "left")
    return rows.withColumn("state", F.when(F.col("_hit"), None).otherwise(F.col("state"))).withColumn("purge_generation", F.col("purge_generation") + F.coalesce(F.col("_hit").cast("long"), F.lit(0))).select(*stored.columns)


def load(log: DataFrame, snapshots: DataFrame, expected: int = 0, reachable: tuple[int, ...] = ()) -> DataFrame:
    """The log's tail of every stream: events after its snapshot, with snapshot_version. expected -1 ignores snapshots, 0
    takes any, n takes those of version n or of a reachable (migratable) one."""
    if expected < 0:
        return log.withColumn("snapshot_version", F.lit(0).cast("long"))
    if expected:
        snapshots = snapshots.where(F.col("schema").isin(expected, *reachable))
    at = snapshots.select(*(F.col(k).alias(f"_{k}") for k in STREAM), F.col("version").alias("_v"))
    joined = log.join(at, [log[k] == at[f"_{k}"] for k in STREAM], "left").withColumn("snapshot_version", F.coalesce("_v", F.lit(0).cast("long")))
    return joined.where(F.col("version") > F.col("snapshot_version")).drop("_v", *(f"_{k}" for k in STREAM))


def latest(rows: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """The last row of each key, with how often it was written before as `version`: an upsert log read as a table."""
    columns = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_last"), (F.count("*") - 1).alias("version"))
    return last.select(*keys, *(F.col(f"_last.{c}").alias(c) for c in columns if c != "version"), "version")
