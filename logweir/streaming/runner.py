"""Projections over the log as streaming queries: checkpoints with a fence, error strategies, dead letters, replay, rebuild."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.schema import projection_table

HALT, SKIP, DEAD_LETTER = "HALT", "SKIP", "DEAD_LETTER"
POISON, TRANSIENT = "POISON", "TRANSIENT"
#: Failures in a row before a transient error counts as lasting, and the bounds of the wait between them.
MOST_FAILURES, FIRST_WAIT_S, LONGEST_WAIT_S = 50, 1.0, 60.0
_POISON = (ValueError, TypeError, KeyError, AttributeError, ArithmeticError, UnicodeError, AssertionError)


def classify(error: BaseException) -> str:
    """POISON if the error or one of its causes comes from the data, else TRANSIENT."""
    seen: set[int] = set()
    while error is not None and id(error) not in seen:
        seen.add(id(error))
        if isinstance(error, (OSError, TimeoutError, ConnectionError)):
            return TRANSIENT
        if isinstance(error, _POISON):
            return POISON
        error = error.__cause__ or error.__context__
    return TRANSIENT


#: Errors of Spark that come from what is read and stay when it is read again, by the beginnings of their names.
_UNREADABLE = ("MALFORMED_", "CANNOT_PARSE_", "CAST_INVALID_INPUT", "INVALID_JSON", "USER_RAISED_EXCEPTION", "FAILED_READ_FILE.PARQUET_COLUMN_DATA_TYPE_MISMATCH")
#: Failures of reading in a row by what is read before a projection halts.
MOST_POISONED_READS = 5


class ReadPoison(RuntimeError):
    """The log can't be read from the checkpoint on, and never will be."""


def unreadable(error: BaseException) -> bool:
    """Whether an error of reading comes from the data. A schema that is ahead does not: a later release reads it."""
    seen: set[int] = set()
    found = False
    while error is not None and id(error) not in seen:
        seen.add(id(error))
        if "schema ahead" in str(error):
            return False
        condition = getattr(error, "getCondition", lambda: None)() or ""
        found = found or condition.startswith(_UNREADABLE) or isinstance(error, _POISON)
        error = error.__cause__ or error.__context__
    return found


@dataclass
class Projection:
    name: str
    update: Callable[[DataFrame], None]
    on_error: str = HALT
    batch: int = 100


@dataclass
class Runner:
    """Drives projections over a log; what it keeps is a small JSON file for each, moved into place whole."""

    spark: SparkSession
    log: Callable[[], DataFrame]
    path: str
    most_failures: int = MOST_FAILURES
    most_poisoned_reads: int = MOST_POISONED_READS
    wait: Callable[[float], None] = time.sleep
    dead: list[dict] = field(default_factory=list)

    def _file(self, name: str) -> str:
        os.makedirs(self.path, exist_ok=True)
        return f"{self.path}/{projection_table(name)}.json"

    def position(self, name: str) -> dict:
        try:
            with open(self._file(name)) as f:
                return json.load(f)
        except FileNotFoundError:
            return {"offset": 0, "epoch": 0, "dead": []}

    def _save(self, name: str, value: dict) -> None:
        at = self._file(name)
        with open(at + ".new", "w") as f:
            json.dump(value, f)
        os.replace(at + ".new", at)

    def advance(self, name: str, offset: int, epoch: int = 0) -> bool:
        """Moves the checkpoint on; never back, and not for an epoch that is over."""
        at = self.position(name)
        if epoch < at["epoch"] or offset <= at["offset"]:
            return False
        self._save(name, at | {"offset": offset, "epoch": max(epoch, at["epoch"])})
        return True

    def reset(self, name: str) -> None:
        """The next run rebuilds from the start."""
        self._save(name, self.position(name) | {"offset": 0})

    def lag(self, name: str, degraded_at: int = 1000) -> tuple[int, bool]:
        head = self.log().agg(F.coalesce(F.max("global_offset"), F.lit(0))).first()[0]
        behind = head - self.position(name)["offset"]
        return behind, behind >= degraded_at

    def catch_up(self, projection: Projection, epoch: int = 0) -> int:
        """Delivers everything after the checkpoint, a batch at a time; the number of batches. At least once: a batch counts when its
        checkpoint is saved."""
        done = failures = misread = poisoned = 0
        while True:
            after = self.position(projection.name)["offset"]
            try:
                ahead = self.log().where(F.col("global_offset") > after).select("global_offset").orderBy("global_offset").limit(projection.batch)
                first, last = ahead.agg(F.min("global_offset"), F.max("global_offset")).first()
                if last is None:
                    return done
                # a range of offsets, which goes to the files; all columns are read, so that what can't be read is no error of the projection
                rows = self.log().where(F.col("global_offset").between(first, last)).orderBy("global_offset")
                rows.agg(F.max(F.length(F.to_json(F.struct(*rows.columns))))).first()
            except Exception as error:
                # other failures of reading pass, so they are waited for, however often they come
                misread, poisoned = misread + 1, poisoned + 1 if unreadable(error) else 0
                if poisoned >= self.most_poisoned_reads:
                    raise ReadPoison(f"{projection.name}: unreadable after offset {after}, {poisoned} times") from error
                self.wait(min(FIRST_WAIT_S * 2 ** min(misread - 1, 32), LONGEST_WAIT_S))
                continue
            misread = poisoned = 0
            try:
                projection.update(rows)
                failures = 0
            except Exception as error:
                failures += 1
                kind = classify(error)
                if projection.on_error == HALT or projection.on_error == DEAD_LETTER and kind == TRANSIENT:
                    if failures < self.most_failures and (projection.on_error != HALT or kind == TRANSIENT):
                        self.wait(min(FIRST_WAIT_S * 2 ** (failures - 1), LONGEST_WAIT_S))
                        continue
                    if projection.on_error == HALT:
                        raise
                if projection.on_error == DEAD_LETTER:  # if this can't be written the checkpoint stays
                    self._bury(projection.name, first, last, error)
                failures = 0
            if not self.advance(projection.name, last, epoch):
                raise RuntimeError(f"{projection.name}: another run has moved the checkpoint")
            done += 1

    def _bury(self, name: str, first: int, last: int, error: BaseException) -> None:
        at = self.position(name)
        same = next((d for d in at["dead"] if (d["from_offset"], d["to_offset"]) == (first, last)), None)
        kept = [d for d in at["dead"] if d is not same]
        self._save(name, at | {"dead": [*kept, {"from_offset": first, "to_offset": last, "attempts": (same["attempts"] + 1) if same else 1, "error": str(error)[:500]}]})

    def replay(self, projection: Projection) -> dict[str, int]:
        """Delivers the ranges of dead letters again, in the order of offsets: what succeeds is discarded, what fails is kept."""
        out = {"done": 0, "failed": 0}
        for d in sorted(self.position(projection.name)["dead"], key=lambda d: d["from_offset"]):
            try:
                projection.update(self.log().where(F.col("global_offset").between(d["from_offset"], d["to_offset"])).orderBy("global_offset"))
            except Exception as error:
                self._bury(projection.name, d["from_offset"], d["to_offset"], error)
                out["failed"] += 1
                continue
            at = self.position(projection.name)
            self._save(projection.name, at | {"dead": [x for x in at["dead"] if (x["from_offset"], x["to_offset"]) != (d["from_offset"], d["to_offset"])]})
            out["done"] += 1
        return out


def run_all(runner: Runner, projections: list[Projection]) -> dict[str, int | BaseException]:
    """Each projection in a thread of its own; a failure stops its projection and no other."""
    from concurrent.futures import ThreadPoolExecutor

    def one(p: Projection) -> int | BaseException:
        try:
            return runner.catch_up(p)
        except Exception as error:
            return error

    with ThreadPoolExecutor(max(1, len(projections))) as pool:
        return dict(zip((p.name for p in projections), pool.map(one, projections)))


def run_scheduled(runner: Runner, projection: Projection, cron, now: Callable[[], object], ticks: int) -> list[int]:
    """One catch-up at each of the next `ticks` times of a cron expression."""
    done = []
    for _ in range(ticks):
        at = cron.next_fire(now())
        if at is None:
            break
        runner.wait(max(0.0, (at - now()).total_seconds()))
        done.append(runner.catch_up(projection))
    return done


def follow_stream(spark: SparkSession, path: str, schema, kind: str, ident: str, update: Callable[[DataFrame, int], None], checkpoint: str, after: int = 0, **trigger):
    """The events of one stream; the checkpoint moves on with the whole log, the filter goes to the files. With after at the head
    of the log it is a live feed without a replay."""
    stream = spark.readStream.schema(schema).parquet(path)
    mine = stream.where((F.col("aggregate_type") == kind) & (F.col("aggregate_id") == ident) & (F.col("global_offset") > after))
    return mine.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def measured(df: DataFrame, name: str) -> DataFrame:
    """Counts the rows and the offsets that pass, as a named observation of the query."""
    return df.observe(name, F.count("*").alias("rows"), F.max("global_offset").alias("last_offset"))


def follow(spark: SparkSession, path: str, schema, update: Callable[[DataFrame, int], None], checkpoint: str, files_per_batch: int = 100, **trigger):
    """A projection as a streaming query over the folder of a log: availableNow for one pass, processingTime to stay."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def once(update: Callable[[DataFrame], None], offset_of: Callable[[], int], column: str = "global_offset") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that leaves out what offset_of() says is applied already, for sinks that keep their offset."""

    def each(batch: DataFrame, batch_id: int) -> None:
        update(batch.where(F.col(column) > offset_of()))

    return each
