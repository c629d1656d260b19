"""The window operator over a stream: one micro-batch is one batch of the batch evaluator, and gives the same emissions.

State is a folder of versions, each written before the pointer that names it moves, so a batch that fails half-way leaves
the last version. The pointer names the batch too: one that is delivered again, since its sink failed, gets the emissions that were
written for it, never others and never none; other batches with events that were seen are fenced off by offsets. Windows are worked on in parallel; only the
watermark and the fence are single values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.windows import DROP, GRACE_S, REOPEN, checked, pairs
from .state import VersionedState

#: How partial states of a fold are merged: count and sum by adding, the others by themselves.
MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


class WindowOperator:
    """folds: name -> (kind, column), kind one of count, sum, min, max."""

    def __init__(self, spark: SparkSession, path: str, folds: dict[str, tuple[str, str]], size_s: float, slide_s: float | None = None, grace_s: float = GRACE_S, policy: str = REOPEN, ts: str = "ts", offset: str = "global_offset"):
        checked(size_s, slide_s, grace_s)
        if policy not in (DROP, REOPEN):
            raise ValueError(policy)
        self.store = VersionedState(spark, path, {"watermark": None, "fence": -1})
        self.folds, self.size, self.slide, self.grace, self.policy, self.ts, self.offset = folds, size_s, slide_s, grace_s, policy, ts, offset

    def pointer(self) -> dict:
        return self.store.pointer()

    # a batch

    def process(self, batch: DataFrame, batch_id: int | None = None) -> DataFrame:
        """Takes a batch in and gives its emissions: window_start, window_end, the folds, is_final and at_offset."""
        at = self.pointer()
        if batch_id is not None and at.get("batch") == batch_id:
            return self.store.table(at["version"], "emissions")
        fresh = batch.where(F.col(self.offset) > at["fence"]).dropDuplicates([self.offset]).withColumn(self.ts, F.col(self.ts).cast("timestamp"))
        top, fence = fresh.agg(F.max(self.ts).cast("double"), F.max(self.offset)).first()
        before, now = at["watermark"], max((x for x in (at["watermark"], top) if x is not None), default=None)
        rows = pairs(fresh, self.size, self.slide, self.ts)
        end = F.col("window_end").cast("double")
        late = F.lit(before is not None) & (F.lit(before if before is not None else 0.0) >= end + self.grace)
        one = {n: F.lit(1).cast("long") if k == "count" else F.col(c) for n, (k, c) in self.folds.items()}
        rows = rows.select("window_start", "window_end", F.col(self.offset).alias("_o"), late.alias("_late"), *(c.alias(n) for n, c in one.items()))
        old = self.store.table(at["version"], "state")
        opened = rows.where("not _late").groupBy("window_start", "window_end").agg(*(MERGE[k](n).alias(n) for n, (k, _) in self.folds.items()))
        opened = opened.withColumn("closed", F.lit(False))
        if old is not None:
            both = old.where("not closed").unionByName(opened)
            opened = both.groupBy("window_start", "window_end").agg(*(MERGE[k](n).alias(n) for n, (k, _) in self.folds.items())).withColumn("closed", F.lit(False))
        parts = []
        closed = old.where("closed") if old is not None else None
        if closed is not None and self.policy == REOPEN:
            # late events of windows that are still kept, with the state that each of them leaves
            names = list(self.folds)
            again = rows.where("_late").join(closed.select("window_start", *(F.col(n).alias(f"_was_{n}") for n in names)), "window_start")
            run = Window.partitionBy("window_start").orderBy("_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            merge = {"count": lambda a, b: a + b, "sum": lambda a, b: a + b, "min": F.least, "max": F.greatest}
            for n, (k, _) in self.folds.items():
                again = again.withColumn(f"_run_{n}", merge[k](F.col(f"_was_{n}"), MERGE[k](n).over(run)))
            emitted = again.select("window_start", "window_end", *(F.col(f"_run_{n}").alias(n) for n in names), F.lit(False).alias("is_final"), F.col("_o").alias("at_offset"))
            parts.append(emitted)
            last = emitted.groupBy("window_start").agg(F.max_by(F.struct(*names), "at_offset").alias("_s"))
            closed = closed.join(last, "window_start", "left").select("window_start", "window_end", *(F.coalesce(F.col(f"_s.{n}"), F.col(n)).alias(n) for n in names), "closed")
        done = F.lit(now is not None) & (F.lit(now if now is not None else 0.0) >= end + self.grace)
        parts.append(opened.where(done).select("window_start", "window_end", *self.folds, F.lit(True).alias("is_final"), F.lit(None).cast("long").alias("at_offset")))
        state = opened.withColumn("closed", done)
        state = state.unionByName(closed) if closed is not None else state
        state = state.where(~F.col("closed") | ~(F.lit(now if now is not None else 0.0) > end + 2 * self.grace))
        if self.policy == DROP:
            state = state.where(~F.col("closed"))
        out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        values = {"batch": batch_id, "watermark": now, "fence": max(at["fence"], fence if fence is not None else -1)}
        version = self.store.commit(at, values, {"emissions": out, "state": state})
        return self.store.table(version, "emissions")

    def emissions(self) -> DataFrame:
        """The emissions of all batches that count."""
        last = self.pointer()["version"]
        return self.store.spark.read.parquet(*(f"{self.store.path}/v{v}/emissions" for v in range(last + 1)))

    def start(self, stream: DataFrame, checkpoint: str, sink=None, **trigger):
        """Runs the operator on a streaming DataFrame; sink(emissions, batch_id) gets what each batch emits."""

        def each(batch: DataFrame, batch_id: int) -> None:
            out = self.process(batch, batch_id)
            if sink:
                sink(out, batch_id)

        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
