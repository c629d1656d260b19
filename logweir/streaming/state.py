"""State of streaming operators as versions of a Parquet folder, and a keyed fold that uses it."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedState:
    """Tables written under v<n>, and a pointer, moved last, that names the version that counts. A batch that fails half-way leaves
    the version before."""

    def __init__(self, spark: SparkSession, path: str, first: dict):
        self.spark, self.path, self.first = spark, path.rstrip("/"), {"version": -1, **first}

    def _fs(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def pointer(self) -> dict:
        where, fs = self._fs("pointer.json")
        if not fs.exists(where):
            new, _ = self._fs("pointer.new")
            if not fs.exists(new):
                return dict(self.first)
            fs.rename(new, where)  # a move was cut off between its two halves
        return json.loads(self.spark.read.text(f"{self.path}/pointer.json", wholetext=True).first()[0])

    def table(self, version: int, name: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/v{version}/{name}") if version >= 0 else None

    def commit(self, before: dict, values: dict, tables: dict[str, DataFrame], kept: str = "emissions") -> int:
        """Writes tables as the version after `before`, then moves the pointer; tables of the version before the last go, but `kept`."""
        version = before["version"] + 1
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.path}/v{version}/{name}")
        new, fs = self._fs("pointer.new")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps({"version": version, **values}).encode()))
        out.close()
        where, _ = self._fs("pointer.json")
        fs.delete(where, False)
        fs.rename(new, where)
        for name in tables:
            if version >= 2 and name != kept:
                old, _ = self._fs(f"v{version - 2}/{name}")
                fs.delete(old, True)
        return version


class KeyedFold:
    """States of keys under step(state, event), batch by batch: sagas, aggregates, projections. Offsets at or below the fence were folded
    before and are left out, so a batch that is delivered again changes nothing.

    initial is a struct column, step(state, event) gives a struct of the same fields; event has the fields named and the offset.
    """

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...], fields: tuple[str, ...], initial: Callable[[], Column], step: Callable[[Column, Column], Column], offset: str = "global_offset"):
        self.store, self.keys, self.fields, self.initial, self.step, self.offset = VersionedState(spark, path, {"fence": -1}), keys, fields, initial, step, offset

    def process(self, batch: DataFrame, batch_id: int | None = None) -> DataFrame:
        """The states (keys, state) of the keys that the batch touched."""
        at = self.store.pointer()
        if batch_id is not None and at.get("batch") == batch_id:
            return self.store.table(at["version"], "emissions")  # the sink failed: the same again
        fresh = batch.where(F.col(self.offset) > at["fence"]).dropDuplicates([self.offset])
        top = fresh.agg(F.max(self.offset)).first()[0]
        events = fresh.groupBy(*self.keys).agg(F.array_sort(F.collect_list(F.struct(self.offset, *self.fields))).alias("_events"))
        old = self.store.table(at["version"], "states")
        first = self.initial()
        if old is None:
            moved = events.select(*self.keys, F.aggregate("_events", first, self.step).alias("state"))
            states = moved
        else:
            joined = events.join(old.withColumnRenamed("state", "_old"), list(self.keys), "left").withColumn("_from", F.coalesce("_old", first))
            moved = joined.select(*self.keys, F.aggregate("_events", F.col("_from"), self.step).alias("state"))
            states = old.join(events.select(*self.keys), list(self.keys), "left_anti").unionByName(moved)
        version = self.store.commit(at, {"batch": batch_id, "fence": max(at["fence"], top if top is not None else -1)}, {"emissions": moved, "states": states})
        return self.store.table(version, "emissions")

    def states(self) -> DataFrame | None:
        return self.store.table(self.store.pointer()["version"], "states")

    def start(self, stream: DataFrame, checkpoint: str, sink=None, **trigger):
        def each(batch: DataFrame, batch_id: int) -> None:
            out = self.process(batch, batch_id)
            if sink:
                sink(out, batch_id)

        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
