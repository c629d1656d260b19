"""Similarity join on sets of word n-grams with a prefix tree.

Texts become sets of hashed n-grams under one global order: n-grams of rare slots first (the slots are counted over all
rows), then by hash. Texts with equal sets form a class, and only classes are compared. Two sets of the wanted similarity
share one of the first n - need + 1 n-grams of each, so a pair meets below a child of the tree's root, and a bucket of rows
under such an n-gram is one such subtree. Where a bucket has a pair that sizes, places in the order and parity sketches let through, its
sets are put into a trie in the worker, in the global order. The traversal carries the overlaps of candidates with the path walked so far,
shared by all that lies below it. At each node candidates go whose overlap, with what remains of them behind the path's last n-gram and
what remains below the node, can't reach the least overlap with the smallest set there; where none is left the subtree is not entered.

To keep groups of near copies from meeting in every bucket, classes are first joined in the buckets of their smallest
hashes; what that links is one component, and the second, complete join compares different components only. Links leave
the workers as spanning forests, never as all pairs of a group. Buckets with many n-grams or rows are cut into blocks, and each
pair of blocks is a unit of its own; a hot bucket is spread over tasks before it is cut.

Defined results: a null or empty text, or one of white space, has the empty set and is linked with nothing; repeated rows
and equal texts share a component; each row is a node of its own, also when rows share a doc_id; a null
doc_id keeps its row, which is linked like others, and its component_id is null if
no row of its component has an id; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, components, forget, hot_keys, kept, packed, runs, salted, small_batches, swept, table, unpacked, written
from .hashing import U, mix, shingles

#: Slots that n-grams are counted in; the counts are all that the driver gets, 2 MB for any input.
SLOTS = 1 << 18
CHUNK = 1 << 12
#: Buckets of the first join, by smallest hash.
SIGNATURES = 2
#: Least bits of the parity sketch of a set: two sets differ in at least as many n-grams as their sketches do in bits.
#: Sets of more than twice as many n-grams have sketches of twice, four times ... the bits.
SKETCH = 1024
#: N-grams of a bucket that one worker takes at a time; beyond that it is cut into blocks.
BLOCK = 1 << 19
#: Added to the n-grams of a set when buckets are cut, so that a unit never has too many small sets.
SHARE = 64
#: Rows of units that are broadcast at most (100 bytes each at most, so 40 MB); more are joined by a shuffle, of the texts in it only.
BROADCAST_ROWS = 400_000
#: Bits, as a power of two, of the table that tells texts of units before that shuffle: a row for each 64 of them, a million at most.
MARKS = 26


def need(nx, ny, percent: int):
    """The least overlap at which percent * |union| <= 100 * |intersection|."""
    return -(-percent * (nx + ny) // (100 + percent))


def _slot(x: np.ndarray) -> np.ndarray:
    return (x >> U(64 - (SLOTS - 1).bit_length())).astype(np.int64)


def _texts(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(batch.schema.get_field_index("text"))


def slot_counts(docs: DataFrame, k: int) -> np.ndarray:
    """How many (text, n-gram) pairs of all rows fall into each slot."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, s in shingles(_texts(batch), k):
                np.add.at(total, _slot(s), 1)
        parts = total.reshape(-1, CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["chunk", "counts"])

    def add(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CHUNK, np.int64)
        for batch in rows:
            for x in batch.column(1):
                total += np.frombuffer(x.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["chunk", "counts"])

    parts = docs.select("text").mapInArrow(count, "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect()
    total = np.zeros(SLOTS, np.int64)
    for row in parts:
        total[row[0] * CHUNK : (row[0] + 1) * CHUNK] = np.frombuffer(row[1], np.int64)
    return total


def _order(counts: np.ndarray) -> np.ndarray:
    """Ranks of slots: all that are not clearly fuller than the mean share rank 0, the others go by their counts."""
    usual = counts.mean() + 4 * np.sqrt(counts.mean()) + 4
    return np.where(counts > usual, counts, 0)


def features(docs: DataFrame, rank, k: int, percent: int) -> DataFrame:
    """doc_id, rid, n, two hashes of the set, its smallest hashes, its prefix in the global order, how many at the end of it are of over-full
    slots, and its sketch. rank is a broadcast of the ranks of slots; docs has doc_id, rid and text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = rank.value
        for batch in batches:
            texts, cut = _texts(batch), 512
            for a in range(0, batch.num_rows, cut):
                out: list[list] = [[] for _ in range(7)]
                for _, s in shingles(texts.slice(a, cut), k):
                    n = len(s)
                    first = n - -(-percent * n // 100) + 1 if n else 0
                    warm = 0
                    if n:
                        hot = ranks[_slot(s)]
                        p = s[:first]
                        if hot[:first].any():
                            order = np.lexsort((s, hot))[:first]
                            p, warm = s[order], int((hot[order] > 0).sum())
                        wide = max(SKETCH, 1 << ((n - 1) // 2).bit_length())
                        bits = np.bincount((mix(s ^ U(77)) & U(wide - 1)).astype(np.int64), minlength=wide) & 1
                        low = [int(mix(s ^ U(i + 1)).min().view(np.int64)) for i in range(SIGNATURES)]
                    else:
                        p, bits, low = s, np.zeros(SKETCH, np.int64), []
                    a_, b_ = np.sum(mix(s), dtype=U), np.sum(mix(s ^ U(0xABCDEF)), dtype=U)
                    for column, x in zip(out, (n, int(a_.view(np.int64)), int(b_.view(np.int64)), low, p.view(np.int64), warm, np.packbits(bits).tobytes()), strict=True):
                        column.append(x)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary())
                names = ["doc_id", "rid", "n", "h1", "h2", "low", "prefix", "warm", "sketch"]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, cut) for i in range(2)), *(pa.array(x, t) for x, t in zip(out, types, strict=True))], names=names)

    return docs.select("doc_id", "rid", "text").mapInArrow(of, "doc_id long, rid long, n long, h1 long, h2 long, low array<long>, prefix array<long>, warm int, sketch binary")


def trie_links(sets: list[np.ndarray], group: np.ndarray, percent: int, ranks: np.ndarray | None = None, seen: Counter | None = None) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of indices, of the links between sets of different groups; linked groups become one.

    ranks are those of slots, for the global order. seen counts the nodes entered, the subtrees left and the sets below them.
    """
    count, seen = len(sets), Counter() if seen is None else seen
    size = np.array([len(s) for s in sets], np.int64)
    grams, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(grams), np.int64)
    place[np.argsort(ranks[_slot(grams)], kind="stable") if ranks is not None else slice(None)] = np.arange(len(grams))
    # what only one set has belongs to no overlap, so paths go without it
    shared = often[at] > 1
    token, owner = place[at[shared]], np.repeat(np.arange(count), size)[shared]
    by_token = np.argsort(token, kind="stable")
    holders, starts = owner[by_token], np.searchsorted(token[by_token], np.arange(len(grams) + 1))
    by_set = np.lexsort((token, owner))
    held, flat = np.bincount(owner, minlength=count), token[by_set]
    cuts = np.concatenate([[0], np.cumsum(held)])
    spot = owner[by_set] * (len(grams) + 1) + flat  # sorted: where an n-gram would stand in each set
    paths = [flat[cuts[i] : cuts[i + 1]] for i in range(count)]
    walk = np.array(sorted(range(count), key=lambda i: paths[i].astype(">u4").tobytes()), np.int64)
    turn = np.empty(count, np.int64)
    turn[walk] = np.arange(count)
    common = np.zeros(count, np.int64)
    for i in range(1, count):
        a, b = paths[walk[i - 1]], paths[walk[i]]
        m = min(len(a), len(b))
        off = np.flatnonzero(a[:m] != b[:m])
        common[i] = int(off[0]) if len(off) else m
    label, found = group.copy(), []

    # a node: the sets of the walk below it, the depth above it, and the candidates with their overlaps up to there
    stack = [(0, count, 0, np.arange(count), np.zeros(count, np.int64))]
    while stack:
        lo, hi, above, some, over = stack.pop()
        path, below = paths[walk[lo]], walk[lo:hi]
        depth = int(common[lo + 1 : hi].min()) if hi - lo > 1 else len(path)
        seen["nodes"] += 1
        later = turn[some] >= lo  # each pair once, by the one that is walked first
        if (label[below] == label[below[0]]).all():
            later &= label[some] != label[below[0]]
        some, over = some[later], over[later]
        part = path[above:depth]
        if len(part) and len(some):
            a, n = starts[part], starts[part + 1] - starts[part]
            rows = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
            over = over + np.bincount(holders[rows], minlength=count)[some]
        behind = held[some] - (np.searchsorted(spot, some * (len(grams) + 1) + path[depth - 1], "right") - cuts[some]) if depth else held[some]
        fit = over + np.minimum(behind, held[below].max() - depth) >= need(size[some], size[below].min(), percent)
        some, over = some[fit], over[fit]
        if not len(some):
            seen["left"] += hi - lo > 1
            seen["below"] += hi - lo
            continue
        if hi - lo == 1:
            y = int(below[0])
            for q in some[over >= need(size[some], size[y], percent)].tolist():
                if label[q] != label[y]:
                    found.append((y, q))
                    label[label == label[q]] = label[y]
            continue
        ends = [lo, *(lo + 1 + np.flatnonzero(common[lo + 1 : hi] == depth)).tolist(), hi]
        stack.extend((a, b, depth, some, over) for a, b in zip(reversed(ends[:-1]), reversed(ends[1:])))
    return found


def _linked(docs: DataFrame, units: DataFrame, rank, k: int, percent: int) -> DataFrame:
    """Edges (a, b) between classes that units (key, lo, hi, cls, rid, grp) bring together. Each class's set is made
    once, from the text of its own document, where that text is read, and sent to its units."""

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["key", "lo", "hi", "cls", "grp", "grams"], [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            jobs, held, size = batch.column(1), [], 0
            for i, s in shingles(batch.column(0), k):
                own, grams = int(np.sum(mix(s), dtype=U).view(np.int64)), s.tobytes()
                for job in jobs[i].as_py():
                    if job["cls"] == own:
                        held.append((*(job[x] for x in names[:5]), grams))
                        size += len(grams)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), types)], names=names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), types)], names=names)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for rows in runs(batches, 3):
            cls, first = np.unique(rows.column("cls").to_numpy(), return_index=True)
            grp = rows.column("grp").to_numpy()[first]
            if len(cls) < 2 or (grp == grp[0]).all():
                continue
            grams = rows.column("grams")
            for x, y in trie_links([np.frombuffer(grams[int(i)].as_py(), U) for i in first], grp, percent, rank.value):
                a.append(int(cls[x]))
                b.append(int(cls[y]))
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    jobs = units.groupBy("rid").agg(F.collect_list(F.struct("key", "lo", "hi", "cls", "grp")).alias("jobs"))
    small = units.count() <= BROADCAST_ROWS
    texts = docs.select("rid", "text")
    if not small:
        jobs = kept(jobs)
        bit = F.pmod(F.xxhash64("rid"), F.lit(1 << MARKS))
        mark = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))
        words = jobs.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(mark).alias("marks"))
        texts = texts.withColumn("word", F.shiftright(bit, 6)).join(F.broadcast(words), "word").where(F.col("marks").bitwiseAND(mark) != 0).select("rid", "text")
    rows = texts.join(F.broadcast(jobs) if small else jobs, "rid").select("text", "jobs")
    sent = rows.mapInArrow(ship, "key long, lo int, hi int, cls long, grp long, grams binary")
    return sent.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(join, "a long, b long")


def _near(rows: DataFrame, percent: int) -> DataFrame:
    """The rows (key, cls, n, at) that share their key with another row of fitting size and place in the order."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def marked(t: pa.Table) -> pa.Table:
            key, n, at = (t.column(c).to_numpy() for c in ("key", "n", "at"))
            keep, rows, step = np.zeros(len(key), bool), np.arange(len(key)), 1
            while True:
                rows = rows[rows + step < len(key)]
                rows = rows[(key[rows] == key[rows + step]) & (percent * n[rows + step] <= 100 * n[rows])]
                if not len(rows):
                    break
                x, y = rows, rows + step
                least = need(n[x], n[y], percent)
                ok = (n[x] - at[x] >= least) & (n[y] - at[y] >= least)
                keep[x[ok]] = keep[y[ok]] = True
                step += 1
            return t.filter(pa.array(keep)).select(["key", "cls", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            here = pa.Table.from_batches([batch])
            here = pa.concat_tables([rest, here]).combine_chunks() if rest is not None else here
            key = here.column("key").to_numpy()
            whole = int(np.searchsorted(key, key[-1])) if key[0] != key[-1] else 0  # the last key may go on
            rest = here.slice(whole)
            if whole:
                yield from marked(here.slice(0, whole)).to_batches()
        if rest is not None:
            yield from marked(rest).to_batches()

    return rows.repartition("key").sortWithinPartitions("key", "n").mapInArrow(of, "key long, cls long, n long")


def _sketched(units: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that span what rows (key, lo, hi, cls, n, grp, sketch) of different groups may be similar, going by
    their sizes and sketches."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for rows in runs(batches, 3):
            cls, first = np.unique(rows.column("cls").to_numpy(), return_index=True)
            n, grp = rows.column("n").to_numpy()[first], rows.column("grp").to_numpy()[first]
            if len(n) < 2 or (grp == grp[0]).all():
                continue
            order = np.argsort(n, kind="stable")
            cls, n, grp, tree = cls[order], n[order], grp[order], np.arange(len(n))
            sketch = rows.column("sketch")
            raw = [np.frombuffer(sketch[int(i)].as_py(), U) for i in first[order]]
            wide = np.array([len(x) for x in raw])
            even = {w: np.stack([x for x in raw if len(x) == w]) for w in np.unique(wide)}
            half = {w: np.bitwise_xor(m[:, : w // 2], m[:, w // 2 :]) for w, m in even.items() if w // 2 in even}
            starts = {w: int(np.flatnonzero(wide == w)[0]) for w in even}  # sizes are sorted, so widths are
            for i in range(len(n) - 1):
                last = int(np.searchsorted(n, 100 * n[i] // percent, "right"))
                own = raw[i]
                for w in (len(own), 2 * len(own)):
                    if w not in even:
                        continue
                    j = np.arange(max(i + 1, starts[w]), min(last, starts[w] + len(even[w])))
                    j = j[grp[j] != grp[i]]
                    if not len(j):
                        continue
                    apart = np.bitwise_count((even[w] if w == len(own) else half[w])[j - starts[w]] ^ own).sum(axis=1)
                    for x in j[apart <= n[i] + n[j] - 2 * need(n[i], n[j], percent)].tolist():
                        if tree[x] != tree[i]:  # both ends belong to the cluster, whatever groups they are of
                            a.append(int(cls[i]))
                            b.append(int(cls[x]))
                            tree[tree == tree[x]] = tree[i]
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return units.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(of, "a long, b long")


def similar(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of docs (doc_id, text): linked are rows whose sets of k-word
    n-grams have 100 * |intersection| >= percent * |union|. percent is 50 or more, since sketches of one and of two widths are compared."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be 50 to 100")
    # a row without an id is found again by its text; one found by mistake is told by its set
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("rid"), "text")
    context, spare = docs.sparkSession.sparkContext, F.col("n") + SHARE
    with small_batches(docs.sparkSession):
        rank = context.broadcast(_order(slot_counts(docs, k)))
        rows = kept(features(docs, rank, k, percent))
    classes = kept(
        rows.where("n > 0").groupBy(F.col("h1").alias("cls"), "h2", "n")
        .agg(F.count("*").alias("rows"), F.min("doc_id").alias("doc_id"), F.min("rid").alias("rid"), F.first("low").alias("low"), F.first("prefix").alias("prefix"), F.first("warm").alias("warm"), F.first("sketch").alias("sketch"))
    )

    # the first join: one bucket for each smallest hash
    smallest = classes.select(F.posexplode("low").alias("i", "x"), "cls", "rid", "n").select(F.xxhash64("i", "x").alias("key"), "cls", "rid", "n")
    units = kept(blocks(smallest, spare, BLOCK).withColumn("grp", F.col("cls")))
    with small_batches(docs.sparkSession):
        first = written(_linked(docs, units, rank, k, percent), "ngram-links")  # few rows; what reads them goes without the plan behind them
    group = written(components(first), "ngram-groups")
    swept(docs.sparkSession)

    # the second join: one bucket for each n-gram of a prefix; those of over-full slots may be hot, and go to blocks as they are
    heads = classes.select("cls", "n", F.posexplode("prefix").alias("at", "key"), (F.size("prefix") - F.col("warm")).alias("cool"))
    heads = heads.select("key", "cls", "n", F.col("at").cast("long").alias("at"), (F.col("at") >= F.col("cool")).alias("warm"))
    near = kept(_near(heads.where("not warm").drop("warm"), percent).unionByName(heads.where("warm").select("key", "cls", "n")))
    known = classes.select("cls", "sketch").join(group.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "sketch", F.coalesce("component", "cls").alias("grp"))
    full = blocks(near, spare, BLOCK).join(known, "cls")
    # what may be similar to something of another group, in clusters
    cluster = components(_sketched(full.select("key", "lo", "hi", "cls", "n", "grp", "sketch"), percent)).select(F.col("node").alias("cls"), F.col("component").alias("key"))
    of = classes.select("cls", "rid", "n").join(group.withColumnRenamed("node", "cls"), "cls", "left").withColumn("grp", F.coalesce("component", "cls")).drop("component")
    swept(docs.sparkSession)
    pairs = kept(blocks(cluster.join(of, "cls"), spare, BLOCK))
    with small_batches(docs.sparkSession):
        second = written(_linked(docs, pairs, rank, k, percent), "ngram-links")

    linked = written(components(first.unionByName(second)), "ngram-groups")
    for scratch in (units, first, group, near, pairs, second):
        forget(scratch)
    swept(docs.sparkSession)
    of_class = classes.select("cls", "h2", "n", "doc_id").join(linked.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("component", "cls"))
    least = of_class.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = of_class.join(least, "root").select("cls", "h2", "n", "component_id")
    # a class of many rows is spread over tasks, and rows without words have no class
    hot = hot_keys(classes, "cls", classes.agg(F.sum("rows")).first()[0] or 0)
    left, right = salted(rows.where("n > 0").select("doc_id", "n", F.col("h1").alias("cls"), "h2"), of_class, "cls", hot, F.col("doc_id"))
    out = left.join(right, ["cls", "salt", "h2", "n"]).select("doc_id", "n", "component_id").unionByName(rows.where("n = 0").select("doc_id", "n", F.lit(None).cast("long").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all their columns, without those that have a smaller doc_id in their component. Equal rows of one
    id are one document; rows without an id, which nothing can refer to, stay."""
    found = written(similar(docs, k, percent).where("doc_id is not null").select("doc_id", "component_id"), "ngram-found")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    left = packed(docs, F.col("doc_id").cast("long").alias("id"), "text").join(gone, F.col("id") == F.col("gone"), "left_anti")
    if not found.groupBy("doc_id").count().where("count > 1").isEmpty():
        left = left.where("id is not null").dropDuplicates(["id", "text"]).unionByName(left.where("id is null"))
    return unpacked(left)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"), k=3, percent=90)


OP10_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, case when len(w) >= 3 then list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as g from w),
e as (select doc_id, len(g) as n, unnest(g) as x from g),
p as (select a.doc_id as a, b.doc_id as b from e a join e b on a.x = b.x and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r as (select doc_id, doc_id as root from g union select p.b, r.root from r join p on p.a = r.doc_id)
select doc_id, any_value(len(g)) as n_shingles, min(root) as component_id from g join r using (doc_id) group by doc_id
"""
