"""Multi-party perspective rotation of dialogues, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and the others as
named users; the mask holds the code points, end exclusive, of what the assistant says, with the mark that ends it.

A dialogue is rendered in parts of PART turn numbers, so that a conversation of any length never meets in one row: part k
holds the turns numbered from k * PART on. Rows of one part beyond PART (repeated turn numbers) go on in sub-parts. Parts in
the order of (part, sub_part) give the whole dialogue. Parts that hold more than their share of all rows (those of rows without a
turn number, say) are ordered by ranges: equal rows become one with its count, a range is one task's, and the counts of
the ranges before it say where its numbers begin. The parts of a long conversation meet its speakers in several tasks.

Defined results: null texts are empty; a null speaker is `unknown`; a null turn comes first, in part -1; ties in turn go by
speaker, then text; repeated rows stay; an empty text makes an empty message; a conversation with system turns only has
no participant and gives no row; null conversation ids form one conversation; further columns are ignored. A text that
holds the mark `<|` has it escaped as `<\\|`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hot_keys, salted, table, written

# The marks of the rendered dialogue.
SYSTEM = "<|system|>"
ASSISTANT = "<|assistant|>"
USER = "<|user:%s|>"
END = "<|end|>"
PART = 512
#: Sub-parts that one row is laid out to at a time, where it stands for many equal ones.
RUN = 1 << 15
#: Rows of a conversation or a part beyond which it is spread, if they are more than a ten-thousandth of all.
HOT = 1024


def _escaped(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def _key(*columns: str) -> Column:
    return F.xxhash64(*columns)


def _placed(rows: DataFrame, part: int) -> DataFrame:
    """Rows with their number n in their part, from 0 on, their sub_part, and times, 1."""
    place = Window.partitionBy("key", "conv_id", "part").orderBy(F.col("at").asc_nulls_first(), "who", "said")
    return rows.withColumn("n", (F.row_number().over(place) - 1).cast("long")).withColumn("sub_part", F.floor(F.col("n") / part)).withColumn("times", F.lit(1).cast("long"))


def _ranged(rows: DataFrame, part: int) -> DataFrame:
    """The same for parts of any size, by ranges. A row stands for `times` equal ones, those of its sub_part."""
    order = [F.col("at").asc_nulls_first(), F.col("who"), F.col("said")]
    once = rows.groupBy("key", "conv_id", "part", "at", "who", "is_system", "said").agg(F.count("*").alias("times"))
    # written down, so that ranges stay what they are when a task runs again
    ranges = written(once.repartitionByRange("conv_id", "part", *order).withColumn("range", F.spark_partition_id()), "turns")
    sums = ranges.groupBy("conv_id", "part", "range").agg(F.sum("times").alias("n"))
    upto = Window.partitionBy("of", "of_part").orderBy("of_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.select(F.col("conv_id").alias("of"), F.col("part").alias("of_part"), F.col("range").alias("of_range"), "n")
    begins = begins.select("of", "of_part", "of_range", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    inside = Window.partitionBy("conv_id", "part", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.withColumn("n", F.coalesce(F.sum("times").over(inside), F.lit(0)))
    # a row for each range and each listed part at most
    meet = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")) & (F.col("range") == F.col("of_range"))
    placed = placed.join(F.broadcast(begins), meet).withColumn("n", F.col("n") + F.col("before"))
    placed = placed.withColumn("lo", F.floor(F.col("n") / part)).withColumn("hi", F.floor((F.col("n") + F.col("times") - 1) / part))
    placed = placed.withColumn("run", F.explode(F.sequence(F.floor(F.col("lo") / RUN), F.floor(F.col("hi") / RUN))))
    placed = placed.withColumn("sub_part", F.explode(F.sequence(F.greatest("lo", F.col("run") * RUN), F.least("hi", F.col("run") * RUN + RUN - 1))))
    first, end = F.greatest(F.col("n"), F.col("sub_part") * part), F.least(F.col("n") + F.col("times"), (F.col("sub_part") + 1) * part)
    return placed.select("key", "conv_id", "part", "sub_part", "who", "is_system", "said", first.alias("n"), (end - first).alias("times"))


def _parts(placed: DataFrame) -> DataFrame:
    """(key, conv_id, part, sub_part) with its turns in their order."""
    listed = F.array_sort(F.collect_list(F.struct("n", "times", "who", "is_system", "said")))
    again = lambda t: F.array_repeat(F.struct(t["who"].alias("who"), t["is_system"].alias("is_system"), t["said"].alias("said")), t["times"].cast("int"))
    return placed.groupBy("key", "conv_id", "part", "sub_part").agg(listed.alias("turns")).withColumn("turns", F.flatten(F.transform("turns", again)))


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", system: str = "system", part: int = PART) -> DataFrame:
    """conv_id, participant, part, sub_part, n_turns, n_masked, rendered and mask (start:end, comma-joined) per part."""
    who = F.coalesce(F.col(speaker), F.lit("unknown"))
    base = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("at"), _escaped(who).alias("who"), (who == system).alias("is_system"),
        _escaped(F.coalesce(F.col(text), F.lit(""))).alias("said"),
    ).withColumn("part", F.coalesce(F.floor(F.col("at") / part), F.lit(-1)))
    sizes = base.groupBy("conv_id", "part").agg(F.count("*").alias("rows"))
    each = sizes.groupBy("conv_id").agg(F.sum("rows").alias("rows"))
    total, longest = (x or 0 for x in each.agg(F.sum("rows"), F.max("rows")).first())
    speakers = base.where(~F.col("is_system")).select(F.col("conv_id").alias("of"), F.col("who").alias("participant")).distinct()  # counted before they are dealt out
    speakers = speakers.withColumn("of_key", _key("of"))
    # not a key of the join, so that what is dealt by the key alone stays where it is
    same = F.coalesce(F.col("conv_id") == F.col("of"), F.col("conv_id").isNull() & F.col("of").isNull())
    keyed = base.withColumn("key", _key("conv_id"))
    met = lambda rows: _parts(_placed(rows.repartition("key"), part)).join(speakers, (F.col("key") == F.col("of_key")) & same)
    columns = ["conv_id", "part", "sub_part", "turns", "participant"]
    if longest <= max(HOT, total // 10_000):  # as in hot_keys
        both = met(keyed).select(*columns)
    else:
        hot = hot_keys(each.groupBy(_key("conv_id").alias("key")).agg(F.sum("rows").alias("rows")), "key", total, HOT)  # 10,000 rows at most, as the next
        full = hot_keys(sizes.groupBy(_key("conv_id", "part").alias("part_key")).agg(F.sum("rows").alias("rows")), "part_key", total, HOT)
        long = keyed.join(F.broadcast(hot.select("key")), "key").withColumn("part_key", _key("conv_id", "part"))
        full = F.broadcast(full.select("part_key"))
        parts = _parts(_placed(long.join(full, "part_key", "left_anti"), part)).unionByName(_parts(_ranged(long.join(full, "part_key"), part)))
        left, right = salted(parts, speakers.withColumnRenamed("of_key", "key"), "key", hot, F.struct("part", "sub_part"))
        right = right.select("of", "participant", F.col("key").alias("of_key"), F.col("salt").alias("of_salt"))
        both = left.join(right, (F.col("key") == F.col("of_key")) & (F.col("salt") == F.col("of_salt")) & same).select(*columns)
        both = both.unionByName(met(keyed.join(F.broadcast(hot.select("key")), "key", "left_anti")).select(*columns))

    def piece(t: Column) -> Column:
        own = ~t["is_system"] & (t["who"] == F.col("participant"))
        head = F.when(t["is_system"], F.lit(SYSTEM)).when(own, F.lit(ASSISTANT)).otherwise(F.format_string(USER, t["who"]))
        return F.struct(own.alias("own"), F.concat(head, F.lit("\n")).alias("head"), F.concat(t["said"], F.lit(END)).alias("body"))

    both = both.withColumn("pieces", F.transform("turns", piece))
    # at most `part` pieces, so the growing array stays small
    step = lambda acc, p: F.struct(
        (acc["at"] + F.char_length(p["head"]) + F.char_length(p["body"]) + 1).alias("at"),
        F.when(p["own"], F.array_append(acc["spans"], F.concat_ws(":", (acc["at"] + F.char_length(p["head"])).cast("string"), (acc["at"] + F.char_length(p["head"]) + F.char_length(p["body"])).cast("string")))).otherwise(acc["spans"]).alias("spans"),
    )
    start = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<string>").alias("spans"))
    spans = F.aggregate("pieces", start, step, lambda acc: acc["spans"])
    return both.select(
        "conv_id", "participant", "part", "sub_part", F.size("turns").cast("long").alias("n_turns"), F.size(F.filter("pieces", lambda p: p["own"])).cast("long").alias("n_masked"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("rendered"), F.array_join(spans, ",").alias("mask"),
    )


def op3_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


OP3_SQL = f"""
with base as (select conv_id, turn as pos, replace(coalesce(role, 'unknown'), '<|', '<\\|') as who, coalesce(role, 'unknown') = 'system' as is_system,
    replace(coalesce(text, ''), '<|', '<\\|') as said, coalesce(cast(floor(turn / {PART}.0) as bigint), -1) as part from conversations),
placed as (select *, row_number() over (partition by conv_id, part order by pos nulls first, who, said) - 1 as n from base),
speakers as (select distinct conv_id, who as participant from base where not is_system),
pieces as (select p.conv_id, participant, part, n // {PART} as sub_part, n, not is_system and who = participant as own,
    case when is_system then '{SYSTEM}' when who = participant then '{ASSISTANT}' else '<|user:' || who || '|>' end || chr(10) as head, said || '{END}' as body
    from placed p join speakers s on p.conv_id is not distinct from s.conv_id),
run as (select *, sum(length(head) + length(body) + 1) over (partition by conv_id, participant, part, sub_part order by n) as e from pieces)
select conv_id, participant, part, sub_part, count(*) as n_turns, count(*) filter (own) as n_masked, string_agg(head || body || chr(10), '' order by n) as rendered,
    coalesce(string_agg(cast(e - 1 - length(body) as bigint) || ':' || cast(e - 1 as bigint), ',' order by n) filter (own), '') as mask
from run group by conv_id, participant, part, sub_part
"""
