"""Near-duplicate embeddings by spherical-cap filters.

A filter is a cap of the sphere around a direction that is the product of two random codes, one for each half of the
dimensions after a fixed random rotation, which spreads uneven vectors over both halves and keeps their cosines. Each vector is list-decoded:
from the sorted scores of its halves all directions are enumerated whose score reaches CAP, and at least the `least` best. Vectors
that share a filter and a label are compared: cosines in double precision.

Filters of one first code (or some of them, where there are many vectors) form a cell, the unit of the join: a vector is sent once to
each of its cells, whatever the number of its filters there, and all that meet there are verified. A pair is counted in the
smallest cell that both hold, so that counts add up without a list of pairs; links leave a cell as a spanning forest. The number of codes
grows with the largest label, so that cells and buckets keep their size; cells of more than BLOCK vectors are cut into blocks, and
each pair of blocks is a unit of its own.

Equal vectors of a label are one class with a multiplicity: rows of a class with many rows are cut down to one before anything is sent,
others meet in the same units anyway.

Recall at a cosine of 0.93 is 0.999 or more for vectors in any position (measured in the tests); it grows with the cosine.

Defined results: a null vector or label, a zero vector and one with null or non-finite components link with nothing; vectors of
different lengths don't link; repeated rows count as vectors; a null vec_id keeps its row, and its component_id is null
if no vector of its component has an id; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, components, hot_keys, kept, merged, runs, salted, small_batches, table

#: Random codes of the halves, and the filters that a vector has at least; each level has twice as many codes of both and MORE filters more.
CODES, LEAST, MORE = (8, 128), 16, 8
#: Score (in standard deviations) that a filter's direction must reach to be taken beyond the least number.
CAP = 3.0
#: Dimensions of the codes, at least: fewer would not spread evenly over two halves.
WIDTH = 64
#: Vectors of a cell that one worker compares at a time.
BLOCK = 8192
THRESHOLD = 0.93
SEED = 29


def sizes(vectors: int) -> tuple[int, int]:
    """(level, parts): the level of the codes for a label of so many vectors, and the parts that the filters of a first code are cut into."""
    level = parts = 0
    while CODES[0] * CODES[1] * 4**level * BLOCK < 8 * vectors:
        level += 1
    while (CODES[0] << level + parts) * BLOCK < 4 * vectors and parts < (CODES[1] << level).bit_length() - 1:
        parts += 1
    return level, 1 << parts


def codes(dim: int, level: int = 0, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim, level])
    width = max(dim, WIDTH)
    half = width // 2
    return rng.standard_normal((half, CODES[0] << level)), rng.standard_normal((width - half, CODES[1] << level))


@functools.cache
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random map to the dimensions of the codes that keeps cosines: a rotation, after zeros where there are less than WIDTH."""
    width = max(dim, WIDTH)
    q, r = np.linalg.qr(np.random.default_rng([seed, dim, 1]).standard_normal((width, width)))
    return (q * np.where(np.diag(r) < 0, -1.0, 1.0))[:dim]


def decode(x: np.ndarray, book: tuple[np.ndarray, np.ndarray], least: int = LEAST) -> list[np.ndarray]:
    """The sorted filters of each unit vector; filter (i, j) of the codes has the number i * (codes of the second half) + j."""
    x = x @ rotation(x.shape[1])
    half, wide = book[0].shape[0], book[1].shape[1]
    a, b = x[:, :half] @ book[0], x[:, half:] @ book[1]
    i, j = np.argsort(-a, axis=1), np.argsort(-b, axis=1)
    a, b = np.take_along_axis(a, i, axis=1), np.take_along_axis(b, j, axis=1)
    # sorted codes that can reach the cap at all, and always enough of them for the least best
    m = max(least, int((a + b[:, :1] >= CAP).sum(axis=1).max(initial=0)))
    n = max(least, int((b + a[:, :1] >= CAP).sum(axis=1).max(initial=0)))
    total = (a[:, :m, None] + b[:, None, :n]).reshape(len(x), -1)
    names = (i[:, :m, None] * wide + j[:, None, :n]).reshape(len(x), -1)
    floor = np.minimum(CAP, np.partition(total, -least, axis=1)[:, -least])
    return [np.sort(f[t >= c]) for f, t, c in zip(names, total, floor)]


def unit_vectors(vectors: list) -> np.ndarray:
    """Vectors of one length as rows of length 1, in double precision."""
    x = np.stack([np.asarray(v.values if isinstance(v, pa.Scalar) else v, np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _celled(rows: DataFrame, level: int, parts: int) -> DataFrame:
    """rows (cls, label, m, embedding) with dim and cells, the sorted cells of the vector's filters."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: dict[int, tuple] = {}
        seen: set[int] = set()  # classes of many rows that this task has sent
        for batch in batches:
            often = batch.column(2).to_numpy() > 1
            if often.any():
                keep = ~often
                for i in np.flatnonzero(often).tolist():
                    c = batch.column(0)[i].as_py()
                    keep[i] = c not in seen
                    seen.add(c)
                batch = batch.filter(pa.array(keep))
            vectors = batch.column(3)
            dims = np.array([len(v) for v in vectors], int)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                book = books.setdefault(dim, codes(dim, level))
                size = max(1, (book[1].shape[1]) // parts)
                for a in range(0, len(at), 512):
                    part = at[a : a + 512]
                    filters = decode(unit_vectors([vectors[int(i)] for i in part]), book, LEAST + MORE * level)
                    cells = [np.unique(f // size).astype(np.int32) for f in filters]
                    some = batch.take(pa.array(part))
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array([dim] * len(part), pa.int32()), pa.array(cells, pa.list_(pa.int32()))], names=[*batch.schema.names, "dim", "cells"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(of, f"cls long, label {kinds['label']}, m long, embedding {kinds['embedding']}, dim int, cells array<int>")


def _compared(units: DataFrame, threshold: float) -> DataFrame:
    """Rows (a, b, links): an edge of a unit's forest (links null), or a class with its links in the unit (b null)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, 3):
            cls, first, back = np.unique(rows.column("cls").to_numpy(), return_index=True, return_inverse=True)
            if len(cls) < 2:
                continue
            here, lo, hi = rows.column("cell")[0].as_py(), rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py()
            m, own = np.bincount(back), rows.column("own").to_numpy()[first]
            m = np.maximum(m, rows.column("m").to_numpy()[first])  # a class of many rows has one row for each task, and its number
            column, lists = rows.column("embedding"), rows.column("cells")
            x = unit_vectors([column[int(i)] for i in first])
            smaller = [c[c < here] for c in (np.asarray(lists[int(i)].values) for i in first)]
            names = np.unique(np.concatenate(smaller))
            held = np.zeros((len(cls), len(names)), np.float32)
            held[np.repeat(np.arange(len(cls)), [len(c) for c in smaller]), np.searchsorted(names, np.concatenate(smaller))] = 1
            links, tree = np.zeros(len(cls), np.int64), np.arange(len(cls))
            for a in range(0, len(cls), 512):
                near = x[a : a + 512] @ x[a:].T >= threshold
                near &= held[a : a + 512] @ held[a:].T == 0  # else the pair is counted in a smaller cell
                if lo != hi:
                    near &= own[a : a + 512, None] != own[None, a:]
                i, j = np.nonzero(np.triu(near, 1))
                i, j = i + a, j + a
                links += np.bincount(i, m[j], len(cls)).astype(np.int64) + np.bincount(j, m[i], len(cls)).astype(np.int64)
                tree = merged(tree, i, j)
            edges, some = np.flatnonzero(tree != np.arange(len(cls))), np.flatnonzero(links)
            if len(some):
                cols = (cls[edges].tolist() + cls[some].tolist(), cls[tree[edges]].tolist() + [None] * len(some), [None] * len(edges) + links[some].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "links"])

    rows = units.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return rows.select("key", "lo", "hi", "cell", "own", "cls", "m", "embedding", "cells").mapInArrow(of, "a long, b long, links long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors (vec_id, embedding, label)."""
    fine = F.col("embedding").isNotNull() & F.col("label").isNotNull()
    fine &= F.coalesce(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & F.exists("embedding", lambda v: v != 0)
    usable = F.coalesce(fine, F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label").withColumn("cls", F.when(usable, F.xxhash64("label", "embedding")))
    live = rows.where("cls is not null")
    members = kept(live.groupBy("cls", "label").agg(F.count("*").alias("rows"), F.min("vec_id").alias("least")))
    largest = members.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    level, parts = sizes(largest)
    # one row stands for a class of many, whose number is bounded
    hot = hot_keys(members, "cls", members.agg(F.sum("rows")).first()[0] or 0)
    many = hot.join(members.select("cls", "rows", "least"), "cls").select("cls", "rows", "least")
    one = live.join(F.broadcast(many), "cls", "left").where(F.col("rows").isNull() | F.col("vec_id").eqNullSafe(F.col("least")))
    found = _celled(one.select("cls", "label", F.coalesce("rows", F.lit(1)).cast("long").alias("m"), "embedding"), level, parts)
    each = found.withColumn("cell", F.explode("cells")).withColumn("key", F.xxhash64("label", "dim", "cell"))
    with small_batches(vectors.sparkSession):
        pairs = kept(_compared(blocks(each, F.lit(1), BLOCK, BLOCK, few=True), threshold))
    linked = components(pairs.where("b is not null").select("a", "b"))
    counts = pairs.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    known = members.join(counts, "cls", "left").join(linked.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("component", "cls"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(least, "root").select("cls", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"), "component_id")
    left, right = salted(live.select("vec_id", "cls"), known, "cls", hot, F.col("vec_id"))
    out = left.join(right, ["cls", "salt"]).select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    out = out.unionByName(rows.where("cls is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op1_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP1_SQL = f"""
with recursive v as (select vec_id, label, cast(embedding as double[]) as x from embeddings where label is not null and embedding is not null),
u as (select vec_id, label, x, len(x) as d, sqrt(list_sum(list_transform(x, lambda c: c * c))) as norm from v where list_bool_and(list_transform(x, lambda c: c is not null and isfinite(c)))),
p as (select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.d = b.d and a.vec_id <> b.vec_id where a.norm > 0 and b.norm > 0 and list_dot_product(a.x, b.x) / (a.norm * b.norm) >= {THRESHOLD}),
r as (select vec_id, vec_id as root from embeddings union select p.b, r.root from r join p on p.a = r.vec_id),
n as (select a as vec_id, count(*) as n from p group by a)
select e.vec_id, coalesce(any_value(n), 0) as n_links, min(root) as component_id, e.vec_id = min(root) as kept from embeddings e join r using (vec_id) left join n using (vec_id) group by e.vec_id
"""
