"""What several operators share: scratch tables, token rules, components of a graph."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text everywhere in this package: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in the one that driver and executors share, spark.checkpoint.dir. Where that is unset a local
    master gets a temporary one; a cluster has no such folder, and the call fails."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="logweir-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/logweir-{spark.sparkContext.applicationId}"


#: What written() and kept() hold, in the order that it was made.
_HELD: list[DataFrame] = []


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: cuts lineage and survives the loss of executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    _HELD.append(out)
    return out


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and held on the executors' disks. What is lost with an executor is computed again from the input, so this is for
    short lineages; loops cut theirs with written(). Freed by forget(), freed(), spark.catalog.clearCache() or the end of the session."""
    df = df.persist(StorageLevel.DISK_ONLY)
    df.count()
    _HELD.append(df)
    return df


@contextlib.contextmanager
def freed():
    """Frees, when it ends, what operators have held since it began: for callers that have written down their result by then. What is given
    to the function it yields stays."""
    mark, stays = len(_HELD), []
    yield stays.append
    for df in _HELD[mark:]:
        if not any(df is x for x in stays):
            forget(df)


def forget(df: DataFrame | None) -> None:
    """Frees what written() or kept() hold for a DataFrame that nothing reads any more."""
    if df is None:
        return
    _HELD[:] = [x for x in _HELD if x is not df]
    path = getattr(df, "_scratch_path", None)
    if not path:
        df.unpersist()
        return
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def swept(spark: SparkSession) -> None:
    """Has the driver collect its garbage between the phases of a long operator: Spark frees shuffles and broadcasts that nothing reads any
    more only then, and a heap that is half full of them is widened by each large allocation."""
    gc.collect()  # Python's handles hold JVM objects
    spark._jvm.System.gc()


def packed(df: DataFrame, *columns) -> DataFrame:
    """`row`, all columns of df as one, beside the given columns: whatever df's columns are named, they meet no other."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *columns)


def unpacked(df: DataFrame, *more) -> DataFrame:
    return df.select("row.*", *more)


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: str = "8m"):
    """Actions inside send Python at most about `size` of rows at a time, so that large rows don't fill its memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def lean(spark: SparkSession, size: str = "8m") -> None:
    """From now on the session sends Python that much at a time, for operators whose rows are large and whose action is the caller's."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(doc_id: Column, n: int = 5) -> Column:
    """crc32 of doc_id as text, modulo n."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def sampled(doc_id: Column, wanted: int, total: int, seed: int) -> Column:
    """Whether a hash of the id picks a row for a sample of about `wanted` of `total` rows; all of them if there are no more.
    Tasks pick on their own, so nothing but the sample leaves them."""
    if total <= wanted:
        return F.lit(True)
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 40)) < int((1 << 40) * wanted / total)


def merged(root, u, v):
    """root, the smallest member of each index's group, after the groups of u and v have become one."""
    import numpy as np

    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            break
        u, v, low = u[apart], v[apart], np.minimum(a, b)[apart]
        root = root.copy()
        np.minimum.at(root, np.maximum(a, b)[apart], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _forest(edges: DataFrame, chunk: int = 2_000_000) -> DataFrame:
    """Each task's edges cut down to a spanning forest of (node, smallest node of its tree): at most one edge a node."""
    import numpy as np
    import pyarrow as pa

    def contracted(a, b):
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = merged(np.arange(len(nodes)), at[: len(a)], at[len(a) :])  # nodes are sorted, so the smallest index is the smallest node
        keep = root != np.arange(len(nodes))
        return nodes[keep], nodes[root[keep]]

    def per_task(batches):
        a, b = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            a = np.concatenate([a, batch.column(0).to_numpy(zero_copy_only=False)])
            b = np.concatenate([b, batch.column(1).to_numpy(zero_copy_only=False)])
            if len(a) > chunk:
                a, b = contracted(a, b)
        if len(a):
            a, b = contracted(a, b)
        for i in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 100_000]), pa.array(b[i : i + 100_000])], names=["a", "b"])

    return edges.mapInArrow(per_task, "a long, b long")


#: Edges of forests that one task contracts at most (16 bytes each); more go through rounds.
ONE_TASK = 1 << 18


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a long, b long): component is the smallest node reachable.

    Tasks first contract their own edges to forests. If these have no more than ONE_TASK edges, a task contracts them too, since each round
    costs the driver some thousand tasks. Else large-star and small-star rounds, each written to the shared folder, run until
    no edge changes. Both give the same rows. Self-loops and repeated edges do no harm; null ends are ignored. Nodes
    without edges don't appear.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    now = written(_forest(edges).distinct(), "edges")  # few rows by now, which the shuffle brings into few files
    state = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    mark, last = state(now), None
    if 0 < mark["n"] <= ONE_TASK:
        last, now, mark = now, written(_forest(now.coalesce(1)), "edges"), {"n": 0}
    while mark["n"]:
        # large-star: what is larger than u goes to the smallest neighbour of u
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small-star: what is smaller than u, and u, go to the smallest of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
        nxt = written(small.where("a <> b").distinct(), "edges")
        seen = state(nxt)
        forget(last)
        last, now = now, nxt
        if seen == mark:
            break
        mark = seen
    forget(last)
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionAll(roots)


def runs(batches, keys: int):
    """Tables of the consecutive rows with equal first `keys` columns."""
    import numpy as np
    import pyarrow as pa

    held = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def hot_keys(counts: DataFrame, key: str, total: int, most: int = 1024) -> DataFrame:
    """(key, parts) of the keys of counts (key, rows) with more than `most` rows and more than a ten-thousandth of all: 10,000 keys at
    most, which can be broadcast. parts of about `most` rows each; the others are small enough to be dealt out whole."""
    most = max(most, total // 10_000)
    return counts.where(F.col("rows") > most).select(key, F.ceil(F.col("rows") / most).cast("int").alias("parts"))


def salted(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, spread: Column) -> tuple[DataFrame, DataFrame]:
    """left and right with `salt`, to be joined on key and salt: rows of a hot key on the left go to one of its parts each, by a hash of
    spread, and those on the right to all of them."""
    hot = F.broadcast(hot)
    left = left.join(hot, key, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    right = right.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return left, right


#: Keys whose sums are broadcast at most (16 bytes each), where a caller's keys are few by design.
BROADCAST_KEYS = 1 << 17


def blocks(members: DataFrame, weight: Column, most: int, rows: int | None = None, few: bool = False) -> DataFrame:
    """members (key, cls, ...) of keys with two rows or more, with own, lo and hi: each key's rows in blocks of about `most`
    units of weight or `rows` rows (by default a thousandth of all, but 256 at least and 2048 at most), and each pair of blocks as
    (key, lo, hi). A hot key is spread before it is cut."""
    totals = kept(members.groupBy("key").agg(F.sum(weight).alias("total"), F.count("*").alias("rows")))
    all_rows, keys = totals.agg(F.sum("rows"), F.count("*")).first()
    rows = rows or max(256, min(2048, (all_rows or 0) // 1000))
    k = F.greatest(F.lit(1), F.ceil(F.col("total") / most), F.ceil(F.col("rows") / rows)).cast("int").alias("k")
    sums = totals.where("rows > 1").select("key", k)
    if few and keys <= BROADCAST_KEYS:
        cut = members.join(F.broadcast(sums), "key")
    else:
        left, right = salted(members, sums, "key", hot_keys(totals, "key", all_rows or 0), F.col("cls"))
        cut = left.join(right, ["key", "salt"]).drop("salt")
    cut = cut.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return cut.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other", "k")
