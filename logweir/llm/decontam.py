"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of bare words (A-Z as a-z, ASCII punctuation aside). Runs of LEAST words that a
document shares with items are the seeds; an item goes on only if its seeded words could reach the wanted coverage. Then
the longest common runs are marked again and again, without overlap, found by running Karp-Rabin over shrinking lengths,
and the item counts as leaked if its marked words make up COVERAGE of it, in whatever order the passages stand.

The items are broadcast in blocks of at most BLOCK words. Where there are several, a table of bits for the seeds of all items, of a fixed size,
tells in one pass over the documents which may hold an item at all, and the blocks are joined with those.

Defined results: null and empty texts and items match nothing; items of fewer than LEAST words match nothing; repeated
documents and items are matched each on their own; empty tables give an empty result; further columns are ignored; of
runs of equal length the first in the item, then in the document, is marked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from .common import forget, lean, packed, table, unpacked, written
from .hashing import U, windows, words

#: Words of a tile at least, and the share of an item's words that tiles must cover.
LEAST, COVERAGE = 4, 0.7
#: Words of benchmark items that are broadcast at a time, at most (a longer item goes alone).
BLOCK = 1_000_000
#: The screen for several blocks has 2 to the power of so many bits, 32 MB.
SCREEN = 28
LEAK = StructType([StructField(x, LongType()) for x in ("item_id", "n_words", "n_covered", "n_tiles")])


def _shared(item: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of doc in runs of `least` words that item has too, and their places; -1 is the place of a gap between such runs."""
    hit = np.flatnonzero(np.isin(windows(doc, least), windows(item, least)))
    covered = np.zeros(len(doc) + 1, np.int64)
    np.add.at(covered, hit, 1)
    np.add.at(covered, hit + least, -1)
    at = np.flatnonzero(np.cumsum(covered[:-1]))
    at = np.insert(at, np.flatnonzero(np.diff(at) > 1) + 1, -1)
    return doc[at], at


def tiles(item: np.ndarray, doc: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(place in item, place in doc, length) of the tiles that greedy string tiling marks.

    The longest length at which a free run of the item is one of doc is found by bisection, with Karp-Rabin hashes of all runs of a
    length; the runs of that length are marked, and what is left has shorter ones only. Places are kept as arrays, never as pairs.
    """
    if len(item) < least or len(doc) < least:
        return []
    doc, at = _shared(item, doc, least)
    free_i, free_d, out = np.ones(len(item), bool), at >= 0, []

    def places(words: np.ndarray, free: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        taken = np.concatenate([[0], np.cumsum(~free)])
        where = np.flatnonzero(taken[n:] == taken[:-n])
        return where, windows(words, n)[where]

    def met(n: int):
        if n > len(doc):
            return None
        (i, a), (d, b) = places(item, free_i, n), places(doc, free_d, n)
        d = d[np.isin(b, a)]
        return (i, a, d) if len(d) else None

    low, high = least, len(item)
    while high >= low:
        n, a, b = 0, low, high
        while a <= b:  # a run of n words holds one of n - 1
            mid = (a + b) // 2
            if met(mid):
                n, a = mid, mid + 1
            else:
                b = mid - 1
        if not n:
            break
        starts, hashes, d = met(n)
        keys = windows(doc, n)[d]
        order = np.argsort(keys, kind="stable")
        d, keys = d[order], keys[order]
        first, last = np.searchsorted(keys, hashes, "left"), np.searchsorted(keys, hashes, "right")
        for i, x, y in zip(starts.tolist(), first.tolist(), last.tolist()):
            if not free_i[i : i + n].all():
                continue
            while x < y and not free_d[d[x] : d[x] + n].all():
                x += 1
            if x < y:
                free_i[i : i + n] = free_d[d[x] : d[x] + n] = False
                out.append((i, int(at[d[x]]), n))
        high = n - 1
    return out


class Items:
    """Items of a block with the index of their seeds."""

    def __init__(self, ids: list[int], texts: list[str | None], least: int, coverage: float):
        self.ids, self.least, self.coverage = ids, least, coverage
        self.words = [np.empty(0, U)] * len(ids)
        for first, w, at in words(pa.array(texts, pa.string()), bare=True):
            for i in range(len(at) - 1):
                self.words[first + i] = w[at[i] : at[i + 1]]
        seeds = [windows(w, least) for w in self.words]
        flat = np.concatenate(seeds) if seeds else np.empty(0, U)
        owner = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        place = np.concatenate([np.arange(len(s)) for s in seeds]) if seeds else np.empty(0, int)
        order = np.argsort(flat, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.seeds, self.starts = np.unique(flat[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(flat))
        # a small table that most runs of a document fail at once
        self.screen = np.zeros(1 << 20, bool)
        self.screen[(self.seeds >> U(44)).astype(np.int64)] = True

    def leaks(self, doc: np.ndarray) -> list[dict]:
        runs = windows(doc, self.least)
        runs = runs[self.screen[(runs >> U(44)).astype(np.int64)]] if len(runs) else runs
        if not len(runs) or not len(self.seeds):
            return []
        at = np.searchsorted(self.seeds, runs := np.unique(runs))
        at = at[(at < len(self.seeds)) & (self.seeds[np.minimum(at, len(self.seeds) - 1)] == runs)]
        if not len(at):
            return []
        rows = np.concatenate([np.arange(self.starts[i], self.ends[i]) for i in at])
        rows = rows[np.argsort(self.owner[rows], kind="stable")]
        found, cuts = np.unique(self.owner[rows], return_index=True)
        out = []
        for item, places in zip(found.tolist(), np.split(self.place[rows], cuts[1:])):
            w = self.words[item]
            seeded = np.zeros(len(w), bool)
            for i in range(self.least):
                seeded[places + i] = True
            if seeded.sum() < self.coverage * len(w):
                continue
            marked = tiles(w, doc, self.least)
            covered = sum(t[2] for t in marked)
            if covered >= self.coverage * len(w):
                out.append({"item_id": self.ids[item], "n_words": len(w), "n_covered": covered, "n_tiles": len(marked)})
        return out


def _blocks(benchmark: DataFrame, block: int) -> tuple[int, Iterator[list]]:
    """(number, blocks): the items, a block of at most about `block` words at a time in the driver."""
    sized = benchmark.select("item_id", "text").where("text is not null").withColumn("size", F.length("text"))
    total = sized.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-total // (4 * block)))  # words have more than four characters, the space between them included

    def each() -> Iterator[list]:
        for i in range(parts):
            rows = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i).select("item_id", "text").collect()
            if rows:
                yield sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0], r[1]))

    return parts, each()


def _bit(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte and bit of the screen that stand for each hash."""
    at = hashes >> U(64 - SCREEN)
    return (at >> U(3)).astype(np.int64), (U(1) << (at & U(7))).astype(np.uint8)


def _screened(docs: DataFrame, screen: np.ndarray, shortest: int, least: int, coverage: float) -> DataFrame:
    """docs with `maybe`: whether runs that any item may have cover as many words as the shortest item asks for."""
    sent = docs.sparkSession.sparkContext.broadcast(screen)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            maybe = np.zeros(batch.num_rows, bool)
            for first, w, cuts in words(batch.column(batch.schema.get_field_index("text")), bare=True):
                for i in range(len(cuts) - 1):
                    runs = windows(w[cuts[i] : cuts[i + 1]], least)
                    byte, bit = _bit(runs)
                    hit = np.flatnonzero(bits[byte] & bit)
                    maybe[first + i] = least * len(hit) >= coverage * shortest
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe)], names=[*batch.schema.names, "maybe"])

    return docs.mapInArrow(of, StructType([*docs.schema.fields, StructField("maybe", BooleanType())]))


def _matched(docs: DataFrame, rows: list, least: int, coverage: float) -> DataFrame:
    """docs with the leaks of a block of items (item_id, text) added to `leaks`."""
    sent = docs.sparkSession.sparkContext.broadcast(rows)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items([r[0] for r in sent.value], [r[1] for r in sent.value], least, coverage)
        for batch in batches:
            at, end = batch.schema.get_field_index("text"), batch.num_columns - 1
            before = batch.column(end)
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for first, w, cuts in words(batch.column(at), bare=True):
                for i in range(len(cuts) - 1):
                    found[first + i] = items.leaks(w[cuts[i] : cuts[i + 1]])
            both = [b.as_py() + f for b, f in zip(before, found)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:end], pa.array(both, batch.schema.field(end).type)], schema=batch.schema)

    return docs.mapInArrow(of, docs.schema)


def with_leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, block: int = BLOCK) -> DataFrame:
    """docs with `leaks`, an array of (item_id, n_words, n_covered, n_tiles) of the items leaked into the text."""
    lean(docs.sparkSession)
    docs = docs.withColumn("leaks", F.array().cast(ArrayType(LEAK)))
    parts, each = _blocks(benchmark, block)
    if parts == 1:
        for rows in each:
            docs = _matched(docs, rows, least, coverage)
        return docs
    # more than one block: a first pass leaves the documents that may hold anything, and the blocks go over those only
    screen, shortest = np.zeros(1 << (SCREEN - 3), np.uint8), None
    for rows in each:
        for _, w, cuts in words(pa.array([r[1] for r in rows], pa.string()), bare=True):
            for i in range(len(cuts) - 1):
                n = int(cuts[i + 1] - cuts[i])
                if n >= least:
                    shortest = n if shortest is None else min(n, shortest)
                    np.bitwise_or.at(screen, *_bit(windows(w[cuts[i] : cuts[i + 1]], least)))
    if shortest is None:
        return docs
    told = _screened(docs, screen, shortest, least, coverage)
    some = written(told.where("maybe").drop("maybe"), "leaks")
    for rows in _blocks(benchmark, block)[1]:
        before, some = some, written(_matched(some, rows, least, coverage), "leaks")
        forget(before)
    return told.where("not maybe").drop("maybe").unionByName(some)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all their columns, into which no item has leaked."""
    return unpacked(with_leaks(packed(docs, "text"), benchmark).where(F.size("leaks") == 0))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    rows = found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
    return rows.withColumn("coverage", F.col("n_covered") / F.col("n_words"))
