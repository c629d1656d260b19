"""Mixing sources to target weights by temperature.

Source token shares p are exponentiated to weights w = p^a / sum(p^a). The exponent a is bisected until the weights have
a target entropy or no source is repeated more often than a limit. The weights become token quotas of a budget, and each
quota is realised as passes over the source: whole passes, then one cut pass that takes whole blocks of documents in a
permuted order and, of the last block, documents in a permuted order while they fit.

Nothing is collected but the sums that a bisection step needs. A hot source is spread over 65,536 buckets of documents. The plan of a source
is one row: its passes and the edge of its cut pass in the permuted order, found by sums over ranges of that order. Documents
learn from it whether they are drawn; only those of the edge's bucket are ordered.

Defined results: a null text has no tokens; documents without tokens go with their bucket; null sources form one source;
repeated rows count and are drawn as often as they occur; an empty table gives an empty mix; further columns are kept
when asked for. Ties in the permuted order are broken by doc_id.
"""

from __future__ import annotations

import logging
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, packed, table, unpacked, written

BUCKETS = 1 << 16
#: Sources that are broadcast at most (about 100 bytes each), and the parts of a source where there are more.
SOURCES, SALTS = 1 << 16, 64
#: A source is not repeated more often than this in the query and the pipeline.
REPETITION_LIMIT = 1.25
SEED = 17
_LOG = logging.getLogger(__name__)


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _hash(*parts) -> Column:
    return F.xxhash64(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def exponent(sources: DataFrame, budget: float | None = None, entropy: float | None = None, repetition: float | None = None, wide: int = 32, rounds: int = 7) -> float:
    """The exponent a in [0, 1] for sources (tokens long): the largest a whose weights have at least the target entropy
    (nats), or the smallest a at which no source is repeated more than `repetition` times within the budget. Each round
    is one aggregation that tries `wide` exponents between the bounds. If none fits, a warning is logged and the nearest bound is
    taken: 0 for an entropy, 1 for a repetition.
    """
    if (entropy is None) == (repetition is None):
        raise ValueError("give either entropy or repetition")
    live = sources.where("tokens > 0").select(F.col("tokens").cast("double").alias("t"))
    total, count = live.agg(F.sum("t"), F.count("*")).first()
    if not count:
        return 1.0
    budget = total if budget is None else float(budget)
    low, high = 0.0, 1.0
    share = F.col("t") / F.lit(total)
    least = live.agg(F.min(share)).first()[0]
    for _ in range(rounds):
        tried = [low + (high - low) * i / wide for i in range(wide + 1)]
        each = live.select(share.alias("p"), F.posexplode(F.array(*map(F.lit, tried))).alias("i", "a"))
        sums = {r["i"]: r for r in each.groupBy("i").agg(F.sum(F.pow("p", "a")).alias("z"), F.sum(F.pow("p", "a") * F.ln("p")).alias("l")).collect()}
        ok = []
        for i, a in enumerate(tried):
            z = sums[i]["z"]
            if entropy is not None:  # falls as a grows
                ok.append(math.log(z) - a * sums[i]["l"] / z >= entropy - 1e-12)
            else:  # w/p = p^(a-1)/z is largest at the smallest share, and falls as a grows
                ok.append(budget / total * least ** (a - 1) / z <= repetition + 1e-12)
        if entropy is not None:
            last = max((i for i, x in enumerate(ok) if x), default=None)
            if last is None:
                if low == 0.0:
                    _LOG.warning("no exponent has an entropy of %s", entropy)
                return round(low, 9)
            if last == wide:
                return round(high, 9)
            low, high = tried[last], tried[last + 1]
        else:
            first = next((i for i, x in enumerate(ok) if x), None)
            if first is None:
                _LOG.warning("no exponent keeps repetitions within %s", repetition)
                return 1.0
            if first == 0:
                return round(low, 9)
            low, high = tried[first - 1], tried[first]
    return round(low if entropy is not None else high, 9)


def _with_source(rows: DataFrame, sources: DataFrame, small: bool) -> DataFrame:
    """rows (source, bucket, ...) with the columns of sources, which has a row for each source (`of`). Sources that are too many to be
    broadcast are joined by a shuffle, a source in SALTS parts."""
    same = F.col("source").eqNullSafe(F.col("of"))
    if small:
        return rows.join(F.broadcast(sources), same).drop("of")
    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(salted, same & (F.pmod("bucket", F.lit(SALTS)) == F.col("salt"))).drop("of", "salt")


def plan(docs: DataFrame, budget: int | None = None, entropy: float | None = None, repetition: float | None = REPETITION_LIMIT, seed: int = SEED) -> tuple[DataFrame, bool]:
    """((of, share, weight, quota, passes, edge_key, edge_bucket, room) of every source, whether they are few enough to be broadcast): `passes`
    whole passes; in the cut pass buckets in the order of (key, number) before the edge are taken whole, documents of the edge while they
    fit in `room`, and no others. Without an edge there is no cut pass. docs has source, bucket and tokens.
    """
    per_bucket = written(docs.groupBy("source", "bucket").agg(F.sum("tokens").alias("tokens")), "mix")
    per_source = per_bucket.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    total, count, size = per_source.agg(F.sum("tokens"), F.count("*"), F.sum(F.length("source"))).first()
    total, small = total or 0, count <= SOURCES and (size or 0) <= 64 * SOURCES
    budget = total if budget is None else int(budget)
    a = exponent(per_source, budget, entropy, None if entropy is not None else repetition)
    z = per_source.where("tokens > 0").agg(F.sum(F.pow(F.col("tokens").cast("double") / F.lit(float(max(total, 1))), F.lit(a)))).first()[0] or 1.0
    share = F.col("tokens").cast("double") / F.lit(float(max(total, 1)))
    weights = per_source.withColumn("share", share).withColumn("weight", F.when(F.col("tokens") > 0, F.pow(share, F.lit(a)) / F.lit(z)).otherwise(0.0))
    quotas = weights.withColumn("quota", F.floor(F.col("weight") * F.lit(float(budget)) + F.lit(1e-6)))
    quotas = quotas.withColumn("passes", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(1))
    quotas = quotas.withColumn("rest", F.when(F.col("tokens") > 0, F.col("quota") - F.col("passes") * F.col("tokens")).otherwise(0))
    quotas = written(quotas.select(F.col("source").alias("of"), "share", "weight", "quota", "passes", "rest"), "mix")
    # the edge is looked for among ranges of keys first, then in one range, so no task orders all buckets of a source
    keyed = _with_source(per_bucket, quotas.select("of", "passes", "rest"), small).withColumn("key", _key(seed)).withColumn("part", F.shiftright("key", 56))
    so_far = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = keyed.groupBy("source", "part", "rest").agg(F.sum("tokens").alias("tokens")).withColumn("sum", F.sum("tokens").over(so_far))
    first = parts.where("sum > rest").groupBy("source").agg(F.min_by(F.struct("part", (F.col("sum") - F.col("tokens")).alias("before")), "part").alias("edge"))
    inside = _with_source(keyed, first.select(F.col("source").alias("of"), "edge"), small).where(F.col("part") == F.col("edge.part"))
    within = Window.partitionBy("source").orderBy("key", "bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("sum", F.col("edge.before") + F.sum("tokens").over(within)).where("sum > rest")
    at = F.struct("key", "bucket", (F.col("rest") - F.col("sum") + F.col("tokens")).alias("room"))
    edges = inside.groupBy(F.col("source").alias("s")).agg(F.min(at).alias("at"))
    rows = quotas.join(edges, F.col("of").eqNullSafe(F.col("s")), "left")
    return rows.select("of", "share", "weight", "quota", "passes", F.col("at.key").alias("edge_key"), F.col("at.bucket").alias("edge_bucket"), F.col("at.room").alias("room")), small


def _key(seed: int) -> Column:
    """The place of a bucket in the permuted order of its source's cut pass."""
    return _hash(seed, F.col("passes"), F.col("bucket"))


def mix(docs: DataFrame, budget: int | None = None, entropy: float | None = None, repetition: float | None = REPETITION_LIMIT, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each draw: doc_id, source, n_tokens, draw_pass (from 0), draw_key (the order within the pass), weight and quota.
    Draws of a source have at most its quota of tokens; less than one document is left over. With keep, the columns in it take the
    place of doc_id and source, and a column of the draw that has one of their names is called draw_<name>.
    """
    kept = docs.select(*(F.col(f"`{c}`") for c in keep or ("doc_id", "source")))
    counted = packed(docs, "doc_id", "source", n_tokens(F.col("text")).alias("n_tokens")).withColumn("row", F.struct(*(F.col(f"row.`{c}`").alias(c) for c in kept.columns)))
    counted = counted.withColumn("bucket", F.pmod(_hash(seed, F.col("doc_id")), F.lit(BUCKETS)).cast("int"))
    planned, small = plan(counted.select("source", "bucket", F.col("n_tokens").alias("tokens")), budget, entropy, repetition, seed)
    # the plan comes to the documents, so that no text is shuffled but those of the edges
    rows = _with_source(counted, written(planned.drop("share"), "mix"), small).withColumn("key", _key(seed))
    on_edge = F.coalesce((F.col("key") == F.col("edge_key")) & (F.col("bucket") == F.col("edge_bucket")), F.lit(False))
    before = F.coalesce((F.col("key") < F.col("edge_key")) | ((F.col("key") == F.col("edge_key")) & (F.col("bucket") < F.col("edge_bucket"))), F.lit(False))
    fine = _hash(seed + 1, F.col("passes"), F.col("doc_id"))
    within = Window.partitionBy("source", "bucket").orderBy(fine, "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = rows.where(on_edge).withColumn("fits", (F.sum("n_tokens").over(within) <= F.col("room")).cast("int"))
    drawn = rows.where(~on_edge).withColumn("fits", before.cast("int")).unionByName(edge)
    drawn = drawn.withColumn("times", F.col("passes") + F.col("fits")).where("times > 0")
    drawn = drawn.withColumn("draw_pass", F.explode(F.sequence(F.lit(0), (F.col("times") - 1).cast("int"))))
    key = F.format_string("%016x", _hash(seed, F.col("draw_pass").cast("long"), F.col("bucket"))), F.format_string("%016x", _hash(seed + 1, F.col("draw_pass").cast("long"), F.col("doc_id")))
    taken, own = {c.lower() for c in kept.columns}, []
    for name, column in (("n_tokens", F.col("n_tokens")), ("draw_pass", F.col("draw_pass")), ("draw_key", F.concat_ws("-", *key)), ("weight", F.col("weight")), ("quota", F.col("quota"))):
        while name in taken:
            name = f"draw_{name}"
        taken.add(name)
        own.append(column.alias(name))
    return unpacked(drawn, *own)


def op2_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
