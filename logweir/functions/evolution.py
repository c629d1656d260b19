"""Schema evolution of payloads and snapshots: chains of steps from a version to the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = Callable[[Column], Column]


class Chain:
    """Steps by (type, version); a step lifts the payload, a column, from its version to the next."""

    def __init__(self) -> None:
        self.steps: dict[str, dict[int, Step]] = {}

    def add(self, kind: str, version: int, step: Step) -> Chain:
        steps = self.steps.setdefault(kind, {})
        if version < 1 or version in steps:
            raise ValueError(f"{kind} has a step from {version} already, or the version is below 1")
        steps[version] = step
        return self

    def current(self, kind: str) -> int:
        return max(self.steps.get(kind, {}), default=0) + 1

    def can_reach(self, kind: str, version: int, target: int) -> bool:
        return version >= target or all(v in self.steps.get(kind, {}) for v in range(version, target))

    def apply(self, rows: DataFrame, kind: str = "event_type", payload: str = "payload", version: str = "schema_version") -> DataFrame:
        """Rows with payloads lifted to the current version of their type. A version ahead of it, or a hole in the chain, is an error."""
        for name, steps in self.steps.items():
            top = self.current(name)
            for v in range(1, top):
                if v not in steps:
                    raise ValueError(f"{name} has no step from {v}")
                due = (F.col(kind) == name) & (F.col(version) == v)
                rows = rows.withColumn(payload, F.when(due, steps[v](F.col(payload))).otherwise(F.col(payload))).withColumn(version, F.when(due, v + 1).otherwise(F.col(version)))
            ahead = (F.col(kind) == name) & (F.col(version) > top)
            rows = rows.withColumn(version, F.when(ahead, F.raise_error(F.concat(F.lit(f"schema ahead: {name} "), F.col(version).cast("string"))).cast(rows.schema[version].dataType)).otherwise(F.col(version)))
        return rows


def renamed(old: str, new: str) -> Step:
    """A step that renames a key of a flat JSON object of strings."""
    return lambda p: _json(F.transform_keys(_map(p), lambda k, _: F.when(k == old, F.lit(new)).otherwise(k)))


def added(name: str, value: str) -> Step:
    """A step that adds a key where it is missing."""
    lone = lambda: F.create_map(F.lit(name), F.lit(value))
    return lambda p: _json(F.when(F.map_contains_key(_map(p), name), _map(p)).otherwise(F.map_concat(_map(p), lone())))


def dropped(name: str) -> Step:
    return lambda p: _json(F.map_filter(_map(p), lambda k, _: k != name))


def _map(payload: Column) -> Column:
    return F.from_json(payload, "map<string,string>")


def _json(fields: Column) -> Column:
    return F.to_json(fields)


class Migrations:
    """Steps between schemas of snapshots; a step may skip versions. Only a chain that lands on the wanted version counts."""

    def __init__(self) -> None:
        self.steps: dict[int, tuple[int, Step]] = {}

    def add(self, version: int, to: int, step: Step) -> Migrations:
        if version < 1 or to <= version or version in self.steps:
            raise ValueError(f"a step from {version} to {to} doesn't go up, or there is one from {version} already")
        self.steps[version] = (to, step)
        return self

    def path(self, version: int, target: int) -> list[int] | None:
        """The versions whose steps lead to the target, or None."""
        found = []
        while version < target and version in self.steps:
            found.append(version)
            version = self.steps[version][0]
        return found if version == target else None

    def reachable(self, target: int) -> tuple[int, ...]:
        """The versions, the target aside, from which it can be reached: what load() takes."""
        return tuple(sorted(v for v in self.steps if v < target and self.path(v, target) is not None))

    def apply(self, snapshots: DataFrame, target: int, state: str = "state", version: str = "schema") -> DataFrame:
        """Snapshots of the target version, lifted where a chain leads there; the others go, so that their streams are folded from the
        start. A step that makes null of a state is an error."""
        rows = snapshots.where(F.col(version).isin(target, *self.reachable(target)))
        for v in (v for v in sorted(self.steps) if self.path(v, target)):
            to, step = self.steps[v]
            due, made = F.col(version) == v, step(F.col(state))
            lost = F.raise_error(F.lit(f"the step from {v} to {to} gave no state")).cast(rows.schema[state].dataType)
            lifted = F.when(F.col(state).isNull(), F.col(state)).otherwise(F.coalesce(made, lost))
            rows = rows.withColumn(state, F.when(due, lifted).otherwise(F.col(state))).withColumn(version, F.when(due, F.lit(to).cast(rows.schema[version].dataType)).otherwise(F.col(version)))
        return rows
