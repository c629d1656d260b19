"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of a text is addressed by the SHA-256 of its content. The ledger holds (blob, rule, version) triples that
were scanned before; only blobs with a missing triple are read again, once each, whatever the number of paths that hold
them. Findings are per blob and are joined back to all paths.

What is due is a table in the shared folder, joined with the texts before any pattern is tried: were it a constant, Catalyst
would move the patterns below that join, and every copy of a blob would be scanned. A Ledger keeps the triples and findings of its
scans in a folder; a scan cut off before its triples are written counts for nothing, and its blobs are scanned again. A blob of
many paths is spread over tasks when findings are joined back.

Defined results: a null text is an empty one; an empty table gives an empty result; repeated rows and paths each get the
findings of their blob; a null path is a path like others; further columns are ignored.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, hot_keys, packed, salted, shared_dir, table, written


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    value: int  # the group whose length counts
    least: int  # characters of that group


# The kinds in their order, with the least length of what counts. For access and hex the least length is
# part of the repetition, which gives the same spans as a filter on whole runs.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
)
#: Blobs with findings that are broadcast at most (about 130 bytes each, so 9 MB); more are joined by a shuffle.
BROADCAST_ROWS = 1 << 16
FINDING = "blob string, kind string, rank int, version int, start long, end long"
SEEN = "blob string, kind string, version int"
NO_FINDING = "array<struct<start:long,rank:int,kind:string,end:long>>"


def _pieces(text: Column, rule: Rule) -> Column:
    """Array of (gap, hit, value): the text before each match, the match and its value; the last gap has no hit."""
    pattern = F.lit(rule.pattern)
    gaps = F.split(text, rule.pattern, -1)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    return F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), (F.regexp_extract_all(text, pattern, F.lit(rule.value)) if rule.value else hits).alias("value"))


def _kept(piece: Column, rule: Rule) -> Column:
    return F.coalesce(F.char_length(piece["value"]) >= rule.least, F.lit(False))


def _measures(text: Column, rule: Rule, rank: int, due: Column) -> Column:
    none = F.lit(None).cast("array<struct<rank:int,version:int,gap:int,len:int,kept:boolean>>")
    lengths = F.transform(
        _pieces(text, rule),
        lambda p: F.struct(
            F.lit(rank).alias("rank"), F.lit(rule.version).alias("version"), F.char_length(p["gap"]).alias("gap"),
            F.coalesce(F.char_length(p["hit"]), F.lit(0)).alias("len"), _kept(p, rule).alias("kept"),
        ),
    )
    return F.when(due & text.rlike(rule.pattern), lengths).otherwise(none)


def addressed(versions: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """path and blob of every row of versions, a table in the shared folder."""
    return written(versions.select(F.col(path).alias("path"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("blob")), "secret-paths")


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path: str = "doc_id", text: str = "text", held: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger): findings (blob, kind, rank, version, start, end) of the blobs scanned now, in code points with the
    end exclusive, and the (blob, kind, version) triples scanned now, to be appended to the ledger.

    ledger has blob, kind and version of earlier scans; None for a first scan. held is addressed(versions), if it is at hand.
    """
    wanted, body = F.array(*(F.lit(f"{r.kind}:{r.version}") for r in rules)), F.coalesce(F.col(text), F.lit(""))
    held = addressed(versions, path, text) if held is None else held
    # one path stands for a blob; counting is done before anything is dealt out, so a blob with many paths is no hot key
    blobs = held.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is None:
        blobs = blobs.withColumn("due", wanted)
    else:
        before = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "kind", "version")).alias("had"))
        blobs = blobs.join(before, "blob", "left").withColumn("due", F.array_except(wanted, F.coalesce("had", F.array().cast("array<string>")))).drop("had")
    due = written(blobs.where(F.size("due") > 0), "secret-due")
    source = versions.select(F.col(path).alias("path"), body.alias("body"), F.sha2(body, 256).alias("blob"))
    asked = due.select(F.col("path").alias("due_path"), F.col("blob").alias("due_blob"), "due")
    bodies = source.join(asked, F.col("path").eqNullSafe(F.col("due_path")) & (F.col("blob") == F.col("due_blob")))
    parts = [_measures(F.col("body"), r, i, F.array_contains("due", f"{r.kind}:{r.version}")) for i, r in enumerate(rules)]
    none = F.array().cast("array<struct<rank:int,version:int,gap:int,len:int,kept:boolean>>")
    measured = bodies.select("blob", F.concat(*(F.coalesce(p, none) for p in parts)).alias("pieces"))
    # the outer form, since for the inner one a filter on the size would compute the pieces a second time
    rows = measured.select("blob", F.posexplode_outer("pieces").alias("at", "p")).where("p is not null")
    rows = rows.repartition("blob").dropDuplicates(["blob", "at"]).select("blob", "at", "p.*")
    run = Window.partitionBy("blob", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(run)).where("kept")
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    findings = ends.select("blob", kinds[F.col("rank")].alias("kind"), "rank", "version", (F.col("end") - F.col("len")).alias("start"), "end")
    done = due.select("blob", F.explode("due").alias("pair")).select("blob", F.substring_index("pair", ":", 1).alias("kind"), F.substring_index("pair", ":", -1).cast("int").alias("version"))
    return findings, done


class Ledger:
    """Scans and what they found, in a folder: a new one in the shared folder unless one is given."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, (folder or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}").rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        top = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = top.getFileSystem(conf)
        scans = sorted(x.getPath().toString() for x in fs.listStatus(top)) if fs.exists(top) else []
        done = [f"{x}/{name}" for x in scans if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{x}/ledger/_SUCCESS"))]
        if done:
            return self.spark.read.schema(schema).parquet(*done)
        columns = [c.strip().split(" ") for c in schema.split(",")]
        return self.spark.range(0).select(*(F.lit(None).cast(t).alias(c) for c, t in columns))

    def seen(self) -> DataFrame:
        """(blob, kind, version) of all scans."""
        return self._table("ledger", SEEN)

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """What all scans found by these versions of rules."""
        return self._table("findings", FINDING).where(F.concat_ws(":", "kind", "version").isin(*(f"{r.kind}:{r.version}" for r in rules)))

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, path: str = "doc_id", text: str = "text") -> DataFrame:
        """Scans what is due, and gives addressed(versions)."""
        held = addressed(versions, path, text)
        found, done = scan(versions, self.seen(), rules, path, text, held)
        at = f"{self.folder}/{uuid.uuid4().hex}"
        found.write.parquet(f"{at}/findings")
        done.write.parquet(f"{at}/ledger")  # last: from now on the scan counts
        return held


def by_path(versions: DataFrame, findings: DataFrame, path: str = "doc_id", text: str = "text", held: DataFrame | None = None) -> DataFrame:
    """path, blob and the sorted array `found` of (start, rank, kind, end) for every row of versions. held is addressed(versions), if it is
    at hand."""
    held = addressed(versions, path, text) if held is None else held
    per_blob = findings.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("found"))
    # held is a table of files, whose rows have the same number each time
    left, right = salted(held, per_blob, "blob", hot_keys(held.groupBy("blob").agg(F.count("*").alias("rows")), "blob", held.count()), F.monotonically_increasing_id())
    rows = left.join(right, ["blob", "salt"], "left")
    return rows.select(F.col("path").alias(path), "blob", F.coalesce("found", F.array().cast(NO_FINDING)).alias("found"))


def redacted(text: Column, rule: Rule) -> Column:
    """The text with each secret of a rule replaced by [kind]."""
    mask = F.lit(f"[{rule.kind}]")
    return F.array_join(F.transform(_pieces(text, rule), lambda p: F.concat(p["gap"], F.when(_kept(p, rule), mask).otherwise(F.coalesce(p["hit"], F.lit(""))))), "")


def redact_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All documents; those whose blob has findings get a text with secrets replaced, the kinds one after the other in their
    order, and its length as n_chars."""
    ledger = Ledger(docs.sparkSession)
    held = ledger.scan(docs, rules)
    flagged = written(ledger.findings(rules).select("blob").distinct().withColumn("flagged", F.lit(True)), "secret-blobs")
    rows = packed(docs, F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"), F.col("text").alias("body"), F.col("doc_id").alias("path"))
    if flagged.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(flagged), "blob", "left")
        forget(held)
    else:
        left, right = salted(rows, flagged, "blob", hot_keys(held.groupBy("blob").agg(F.count("*").alias("rows")), "blob", held.count()), F.xxhash64("path"))
        rows = left.join(right, ["blob", "salt"], "left")
    for rule in rules:  # a column each, since a nested expression would be computed again for every use
        rows = rows.withColumn("body", F.when(F.col("flagged"), redacted(F.col("body"), rule)).otherwise(F.col("body")))
    new = {"text": F.col("body")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("flagged"), F.char_length("body").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return rows.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ledger = table(spark, sf_dir, "documents"), Ledger(spark)
    held = ledger.scan(docs)
    found = by_path(docs, ledger.findings(), held=held)
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


_SQL_ASSIGN = """([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _sql_part(kind: str, rank: int, pattern: str, value: int, least: int) -> str:
    return f"""select doc_id, '{kind}' as kind, {rank} as rank, unnest(range(1, len(hits) + 1)) as i, unnest(hits) as hit, unnest(vals) as val, {least} as least, gaps
    from (select doc_id, regexp_extract_all(t, '{pattern}', 0) as hits, regexp_extract_all(t, '{pattern}', {value}) as vals, regexp_split_to_array(t, '{pattern}') as gaps
          from (select doc_id, coalesce(text, '') as t from documents))"""


OP5_SQL = f"""
with parts as ({" union all ".join(_sql_part(*x) for x in (("assign", 0, _SQL_ASSIGN, 2, 12), ("access", 1, "AKIA[A-Z0-9]+", 0, 18), ("hex", 2, "[0-9a-f]{{16,}}".replace("{{", "{").replace("}}", "}"), 0, 16)))}),
placed as (select doc_id, kind, rank, length(val) >= least as kept,
    sum(length(gaps[i]) + length(hit)) over (partition by doc_id, kind order by i) as e, length(hit) as n from parts),
found as (select doc_id, count(*) filter (kind = 'assign') as a, count(*) filter (kind = 'access') as k, count(*) filter (kind = 'hex') as h,
    string_agg(kind || ':' || cast(e - n as bigint) || ':' || cast(e as bigint), ',' order by e - n, rank) as s from placed where kept group by doc_id)
select d.doc_id, coalesce(a, 0) as n_assign, coalesce(k, 0) as n_access, coalesce(h, 0) as n_hex, sha256(coalesce(s, '')) as base_sha256, coalesce(s, '') as spans
from documents d left join found using (doc_id)
"""
