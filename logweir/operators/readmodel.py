"""Read-model queries: get, scan, filter by field, sort by several keys, page with an exact total; and the writes of a view."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_text
from ..sources.schema import FIELD, SYSTEM_FIELDS

#: Fields whose type makes them sort by value; all others sort by their text.
BY_VALUE = frozenset(("version", "updated_at"))
INT_MAX = 2**31 - 1


@dataclass(frozen=True)
class PageRequest:
    page: int = 0
    size: int = 20
    sort: tuple[tuple[str, bool], ...] = ()  # (field, ascending)

    def __post_init__(self) -> None:
        if self.page < 0 or not 1 <= self.size <= 1000:
            raise ValueError("page must not be negative, size must be 1 to 1000")
        names = [f for f, _ in self.sort]
        if len(set(names)) != len(names):
            raise ValueError("a field may be named once")
        for name in names:
            if not re.match(FIELD, name):
                raise ValueError(f"not a field: {name!r}")

    @property
    def offset(self) -> int:
        return self.page * self.size


@dataclass(frozen=True)
class Page:
    content: DataFrame | list
    total: int
    page: int
    size: int

    @property
    def total_pages(self) -> int:
        return min(INT_MAX, math.ceil(self.total / self.size))

    @property
    def has_next(self) -> bool:
        return (self.page + 1) * self.size < self.total

    @property
    def has_previous(self) -> bool:
        return self.page > 0


def find_by_id(view: DataFrame, ident: str) -> DataFrame:
    return view.where(F.col("id") == ident)


def matches(view: DataFrame, field: str, value: Any) -> Column:
    """Equality of a field's canonical text; null and missing match nothing."""
    if field in SYSTEM_FIELDS or not re.match(FIELD, field):
        raise ValueError(f"can't filter by {field!r}")
    refuse_encrypted(view, field)
    if value is None or field not in view.columns:
        return F.lit(False)
    return F.coalesce(canonical_text(F.col(field), view.schema[field].dataType) == canonical_text(value), F.lit(False))


def refuse_encrypted(view: DataFrame, field: str) -> None:
    if field in view.columns and view.schema[field].metadata.get("encrypted"):
        raise ValueError(f"{field!r} is encrypted: it can be neither filtered nor sorted by")


def order_keys(view: DataFrame, sort: tuple[tuple[str, bool], ...]) -> list[Column]:
    """Sort keys: text by code point, missing last when ascending and first when descending, id to break ties."""
    keys = []
    for field, up in sort:
        refuse_encrypted(view, field)
        c = F.lit(None).cast("string") if field not in view.columns else F.col(field) if field in BY_VALUE or field == "id" else canonical_text(F.col(field), view.schema[field].dataType)
        keys.append(c.asc_nulls_last() if up else c.desc_nulls_first())
    if "id" not in {f for f, _ in sort}:
        keys.append(F.col("id").asc())
    return keys


def page_rows(view: DataFrame, request: PageRequest, where: Column | None = None) -> DataFrame:
    """The rows of a page. Offset and limit become a top-n of each task, so no task sorts or gathers the whole view."""
    rows = view.where(where) if where is not None else view
    return rows.orderBy(*order_keys(view, request.sort)).offset(request.offset).limit(request.size)


def find_page(view: DataFrame, request: PageRequest, field: str | None = None, value: Any = None) -> Page:
    """The page and the exact total; the rows are not read when the page lies beyond the end."""
    where = matches(view, field, value) if field is not None else None
    total = (view.where(where) if where is not None else view).count()
    rows = page_rows(view, request, where) if total > request.offset else view.limit(0)
    return Page(rows, total, request.page, request.size)


def page_with_total(view: DataFrame, request: PageRequest, where: Column | None = None) -> DataFrame:
    """The page's rows with `n_total`; one row of nulls with the total if the page is empty."""
    total = (view.where(where) if where is not None else view).agg(F.count("*").alias("n_total"))
    return total.join(page_rows(view, request, where), F.lit(True), "left")


def write_view(view: DataFrame, path: str, index: tuple[str, ...] = ("id",), files: int = 0) -> None:
    """Writes a view laid out for filters and sorts on the index fields: ranges of them in each file, sorted, so that reads skip
    files and row groups by their bounds."""
    for field in index:
        refuse_encrypted(view, field)
    keys = [F.col(f) for f in index]
    parts = view.repartitionByRange(files, *keys) if files else view.repartitionByRange(*keys)
    parts.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


# writes: a view is a log of writes, read latest first


def upserts(writes: DataFrame, offset: str = "global_offset") -> DataFrame:
    """Rows (id, ..., deleted) in the order of offset as the view that they leave: the last write of an id that was not deleted
    after it, with version 0 for an insert and one more for each update since the last delete."""
    columns = [c for c in writes.columns if c not in ("id", "deleted", "version")]
    gone = writes.where("deleted").groupBy("id").agg(F.max(offset).alias("_gone"))
    live = writes.where("not deleted").join(gone, "id", "left").where(F.col("_gone").isNull() | (F.col(offset) > F.col("_gone")))
    last = live.groupBy("id").agg(F.max_by(F.struct(*columns), offset).alias("_r"), (F.count("*") - 1).alias("version"))
    return last.select("id", *(F.col(f"_r.{c}").alias(c) for c in columns), "version")


def compare_and_set(view: DataFrame, writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(view after the writes, writes refused): a write (id, ..., expected) applies if the id is there with that version."""
    at = view.select(F.col("id").alias("_id"), F.col("version").alias("_v"))
    joined = writes.join(at, writes["id"] == at["_id"], "left")
    fits = F.coalesce(F.col("_v") == F.col("expected"), F.lit(False))
    applied = joined.where(fits).withColumn("version", F.col("_v") + 1).drop("_id", "_v", "expected")
    refused = joined.where(~fits).drop("_id", "_v")
    return view.join(applied.select("id"), "id", "left_anti").unionByName(applied.select(*view.columns)), refused


def deleted(view: DataFrame, ids: DataFrame) -> DataFrame:
    return view.join(ids, "id", "left_anti")
